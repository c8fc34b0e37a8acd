import hashlib

import pytest
from pyspark.sql import functions as F

from postloom.functions import codecs, filters
from postloom.functions import text as tx


def values(spark, rows, make, schema="t string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(make("t")).collect()]


@pytest.mark.parametrize(
    "given, want",
    [
        ("경력 3~5년", (3, 5)), ("1-3년", (1, 3)), ("5년 이상", (5, None)), ("7년↑", (7, None)), ("경력 10년", (10, 10)),
        ("신입", (0, 0)), ("신입·경력무관", (0, 0)), ("경력무관", (-1, -1)), ("경력 무관", (-1, -1)), ("5년", (None, None)),
        ("", (None, None)), ("3 ~ 5 년 신입", (3, 5)), ("99999999999년 이상", (None, None)),
    ],
)
def test_years(spark, given, want):
    low, high = tx.years(F.lit(given))
    assert tuple(spark.range(1).select(low, high).head()) == want


def test_experience_falls_back_to_title(spark, raw):
    df = raw({"title": "백엔드 3년 이상", "experience": " "}, {"title": "신입", "experience": "경력 2년"})
    low, _ = tx.years(tx.experience_source())
    assert [r[0] for r in df.orderBy("ingest_seq").select(low).collect()] == [3, 2]


@pytest.mark.parametrize(
    "given, want",
    [
        ("C++ 와 C# 개발", ["C++", "C#"]), ("Golang", ["Golang"]), ("Go언어", ["Go"]), ("MySQL2", ["MySQL"]),
        ("JavaScript", ["JavaScript"]), ("java, JAVASCRIPT", ["Java", "JavaScript"]), ("GitHub Actions", ["GitHub Actions"]),
        ("node.js/React", ["React", "Node.js"]), ("interest", []), ("", []), (None, []),
    ],
)
def test_tech_stack(spark, given, want):
    assert values(spark, [given], tx.tech_stack) == [want]


def test_it_title(spark):
    titles = ["백엔드 개발자", "시설보안 개발", "Sales Manager", "", None, "Email marketing", "보안요원"]
    assert values(spark, titles, tx.is_it_title) == [True, False, False, False, False, True, False]


def test_normalise(spark):
    rows = ["  A,B\tC++ (x)　é½_²  ", None, "C# .NET-core!"]
    assert values(spark, rows, tx.normalise) == ["a b c++ x é½_²", "", "c# .net-core"]


def test_strip_takes_every_kind_of_space(spark):
    assert values(spark, [" 　 a b \t\n"], tx.strip) == ["a b"]


def test_clean(spark):
    assert values(spark, [None, " NaN ", " x ", "nano"], tx.clean) == ["", "", "x", "nano"]


def test_uid_is_null_safe_and_trimmed(spark, raw):
    df = raw({"title": " T ", "company": None, "url": "u "})
    assert df.select(tx.posting_uid()).head()[0] == hashlib.sha256("|T|u".encode()).hexdigest()


def test_token_sort(spark):
    assert values(spark, ["b  a\tc", ""], tx.token_sorted) == ["a b c", ""]


def test_absolute_url(spark):
    assert values(spark, ["/x", "http://y", None], lambda c: tx.absolute_url(c, "https://h")) == ["https://h/x", "http://y", ""]


def test_like_is_literal(spark):
    rows = ["100% remote", "100 remote", "a_b", "axb"]
    assert values(spark, rows, lambda c: tx.like_literal(c, "0% R")) == [True, False, False, False]
    assert values(spark, rows, lambda c: tx.like_literal(c, "A_b")) == [False, False, True, False]


def test_codecs(spark):
    json_in = ['["a","b"]', "", None, "no json", "[]"]
    assert values(spark, json_in, codecs.decode_json) == [["a", "b"], [], [], [], []]
    literal_in = ["['a', \"it's\"]", "[]", "", None, "['a'", "['a' 'b']", "[1, 2]", r"['it\'s']"]
    assert values(spark, literal_in, codecs.decode_literal) == [["a", "it's"], [], [], [], [], [], [], ["it's"]]


BANDS = ["전체", "신입", "신입 (경력무관 포함)", "1~3년", "3~5년", "5년 이상", "모름"]


@pytest.mark.parametrize(
    "low, high, text, want",
    [
        (0, 0, "", [1, 1, 1, 0, 0, 0, 1]),
        (-1, -1, "", [1, 1, 1, 1, 1, 1, 1]),
        (3, None, "", [1, 0, 0, 1, 1, 0, 1]),
        (2, 6, "", [1, 0, 0, 1, 1, 1, 1]),
        (None, None, "3년", [1, 0, 0, 1, 1, 0, 1]),
        (None, None, "무관", [1, 1, 1, 0, 0, 0, 1]),
        (None, None, None, [1, 0, 0, 0, 0, 0, 1]),
    ],
)
def test_bands(spark, low, high, text, want):
    df = spark.createDataFrame([(low, high, text)], "min_exp int, max_exp int, experience string")
    assert [int(v) for v in df.select(*[filters.in_band(b).alias(str(i)) for i, b in enumerate(BANDS)]).head()] == want


def test_open_maximum_is_unbounded_in_the_table_filter(spark):
    df = spark.createDataFrame([(3, None), (3, 4), (-1, -1), (None, None)], "min_exp int, max_exp int")
    assert df.where(filters.table_filter(max_exp=5)).count() == 2
    assert df.where(filters.table_filter(min_exp=2)).count() == 2


def test_intern_only_turns_the_band_off(spark, raw):
    df = raw({"title": "International sales", "experience": "경력 9년"}, {"keyword": "인턴"}, {"title": "백엔드"})
    df = df.withColumn("min_exp", F.lit(9)).withColumn("max_exp", F.lit(9))
    hit = filters.combined(experience="신입", intern_only=True)
    assert [r.ingest_seq for r in df.where(hit).orderBy("ingest_seq").collect()] == [0, 1]


def test_keyword_is_literal_unless_asked(spark):
    df = spark.createDataFrame([("c++ dev",), ("ccc dev",)], "_search_text string")
    assert df.where(filters.combined(keyword="C++")).count() == 1
    assert df.where(filters.combined(keyword="c+ d", regex=True)).count() == 1


def test_simple_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1)], "source string, min_exp int").write.parquet(path)
    plan = spark.read.parquet(path).where(filters.table_filter(sources=["a", "b"], min_exp=3))._jdf.queryExecution().executedPlan().toString()
    assert "In(source" in plan and "LessThanOrEqual(min_exp,3)" in plan.replace("PushedFilters: [", "")


def test_facets_come_from_one_scan(spark, tmp_path):
    from postloom.operators import stats

    rows = [("서울, 판교", "x", "s1", 3, ["Java", "Go"]), ("서울", None, "s1", None, None), (None, "x", "s2", -1, ["Go"])]
    spark.createDataFrame(rows, "location string, keyword string, source string, min_exp int, tech_stack array<string>").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    board = stats.facet_board(df, {"tech": 1})
    got = {(r.facet, r.value): (r.cnt, r["rank"]) for r in board.collect()}
    assert got[("tech", "Go")] == (2, 1) and ("tech", "Java") not in got
    assert got[("token", "서울")] == (2, 1) and got[("token", "판교")] == (1, 2)
    assert got[("source", "s1")] == (2, 1) and got[("min_exp", "-1")] == (1, 1) and got[("keyword", "x")] == (2, 1)
    assert sum(n for (f, _), (n, _) in got.items() if f == "location") == 3
    assert board._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert stats.facet_board(df.limit(0)).count() == 0


def test_strip_takes_what_the_unicode_pattern_takes(spark):
    chars = [chr(c) for c in range(1, 0x3100)] + ["﻿", "\U0001f600", "가"]
    rows = [(p + "a b" + q,) for c in chars for p, q in ((c, c), (c + " ", "\n" + c))] + [(c * 2,) for c in chars] + [("",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    by_pattern = F.regexp_replace("s", r"(?U)^\s+|\s+$", "")
    assert df.where(~by_pattern.eqNullSafe(tx.strip("s"))).count() == 0
    assert df.select(tx.strip("s").alias("x")).where("x = ''").count() > 20


def test_terms_are_plain_text(spark):
    """Also signs that mean something within a pattern, and its quoting."""
    rows = ["a\\E. x", "abc", "a.c", None, ""]
    assert values(spark, rows, lambda c: tx.contains_any(c, ["a\\E."])) == [True, False, False, False, False]
    assert values(spark, rows, lambda c: tx.contains_any(c, ["a.c", "zz"])) == [False, False, True, False, False]
    assert values(spark, rows, lambda c: tx.contains_any(c, [])) == [False] * 5
    titles = ["Backend \\E 개발", "경비 개발", "개발", "요리사", None]
    assert values(spark, titles, tx.is_it_title) == [True, False, True, False, False]
