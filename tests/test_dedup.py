import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postloom.functions import similarity
from postloom.functions.similarity import _lcs_pairs
from postloom.operators import dedup, fuzzy, refine


def one_by_one(rows):
    """The three rules as a sequential pass."""
    pairs, urls, titles, kept = set(), set(), set(), []
    for r in rows:
        t, c, u = (r.get(k, "").strip() for k in ("title", "company", "url"))
        if not t:
            continue
        if c:
            fresh = (t, c) not in pairs
            if fresh:
                pairs.add((t, c))
                urls |= {u} - {""}
        elif u:
            fresh = u not in urls
            if fresh:
                urls.add(u)
                titles.add(t)
        else:
            fresh = t not in titles
            titles.add(t)
        if fresh:
            kept.append(r["ingest_seq"])
    return kept


def test_rules_equal_a_sequential_pass(spark, raw):
    rng = random.Random(3)
    rows = [
        {"ingest_seq": i, "title": rng.choice(["", "a", "b ", " b", "c"]), "company": rng.choice(["", " ", "X", "Y"]),
         "url": rng.choice(["", "u1", "u2", "u3 ", "u4"])}
        for i in range(400)
    ]
    # many small feeds in one run would be one feed, so each gets titles and urls of its own
    for i, r in enumerate(rows):
        part = i // 20
        r["title"] = r["title"] and f"{r['title']}{part}" if r["title"].strip() else ""
        r["url"] = r["url"] and f"{part}{r['url']}"
    got = sorted(r.ingest_seq for r in dedup.dedup_rules(raw(*rows)).select("ingest_seq").collect())
    assert got == one_by_one(rows)


def test_first_of_a_uid_wins(spark, raw):
    df = dedup.with_uid(raw({"title": "a", "company": "x", "ingest_seq": 5}, {"title": "a", "company": "x", "ingest_seq": 2}))
    assert [r.ingest_seq for r in dedup.dedup_uid(df).collect()] == [2]


def test_hot_keys_are_cut_before_the_shuffle(spark, raw):
    plan = dedup.dedup_uid(dedup.with_uid(raw({"title": "a"})))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs_of_many():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcé한글 ") for _ in range(n))
    b = [w for w in (word(rng.randint(0, 40)) for _ in range(30)) for _ in range(rng.randint(1, 9))]
    a = [word(rng.randint(0, 40)) for _ in b]
    assert _lcs_pairs(a, b) == [lcs(x, y) for x, y in zip(a, b)]
    long_a, long_b = [word(9_000), word(9_000)], [word(50)] * 2
    assert _lcs_pairs(long_a, long_b) == [lcs(x, y) for x, y in zip(long_a, long_b)]


def alike(a, b, threshold):
    total = len(a) + len(b)
    return 200 * lcs(a, b) >= threshold * total


def near_copies(rng, n, alphabet, longest):
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))) for _ in range(max(2, n // 5))]
    out = set()
    for _ in range(n):
        s = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            if s and rng.random() < 0.5:
                s.pop(rng.randrange(len(s)))
            else:
                s.insert(rng.randint(0, len(s)), rng.choice(alphabet))
        out.add("".join(s))
    return sorted(out - {""})


@pytest.mark.parametrize("threshold", [95, 90, 85, 80, 70, 50, 100])
def test_similarity_join_misses_nothing(spark, threshold):
    rng = random.Random(threshold)
    keys = near_copies(rng, 120, "abcdef가나", 40)
    sig = fuzzy.Signature(threshold, buckets=64)
    df = spark.createDataFrame(list(enumerate(keys)), "rank long, key string")
    nodes = sig.add_to(df)
    got = {(r.a, r.b) for r in sig.matches(nodes, nodes, ordered=True).collect()}
    want = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if alike(keys[i], keys[j], threshold)}
    assert got == want


@pytest.mark.parametrize("threshold", [90, 50, 100])
def test_similarity_sweep_misses_nothing(spark, threshold, monkeypatch):
    rng = random.Random(threshold)
    keys = near_copies(rng, 120, "abcdef가나", 40)
    sig = fuzzy.Signature(threshold)
    df = spark.createDataFrame(list(enumerate(keys)), "rank long, key string")
    want = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if alike(keys[i], keys[j], threshold)}
    for most in (fuzzy.ROUND_BYTES, 4_000):  # also in several rounds
        monkeypatch.setattr(fuzzy, "ROUND_BYTES", most)
        assert {(r.a, r.b) for r in sig.matches(df, df, ordered=True).collect()} == want
        assert {r["rank"] for r in sig.removed(df, df).collect()} == {j for _, j in want}


def test_running_text_is_not_joined_by_its_grams(spark):
    """Lines of a few common words share grams with all others: pairs that do not match must not reach a shuffle."""
    rng = random.Random(8)
    words = ["the", "then", "there", "and", "hand", "stand", "with", "width"]
    keys = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(20, 40))) for _ in range(80)})
    sig = fuzzy.Signature(90)
    df = spark.createDataFrame(list(enumerate(keys)), "rank long, key string")
    assert not sig.grams_tell_apart(df)
    plan = sig.matches(df, df, ordered=True)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    rare = spark.range(2_000).select(F.col("id").alias("rank"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 24).alias("key"))
    assert sig.grams_tell_apart(rare)


@pytest.mark.parametrize("threshold", [95, 90, 85, 60, 100])
def test_long_keys_are_compared_whole_only_where_their_beginnings_allow(threshold, monkeypatch):
    rng = random.Random(threshold)
    words = ["the", "then", "there", "and", "hand", "stand", "with", "width", "é", "개발"]
    keys = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 120))) for _ in range(60)]
    for key in keys[:20]:  # copies with other beginnings, ends, and places all over
        n, cut = len(key), int(len(key) * (100 - threshold) / 100)
        keys += [key[cut:], key[: n - cut], "x" * cut + key[cut:], "".join(c for c in key if rng.random() > cut / n / 1.5), key[: n // 2] + "y" * cut + key[n // 2 :]]
    keys = sorted(set(keys))
    half = len(keys) // 2
    common = lambda a, b: _lcs_pairs([a], [b])[0]
    want = {(i, j) for i in range(half) for j in range(half, len(keys)) if 200 * common(keys[i], keys[j]) >= threshold * (len(keys[i]) + len(keys[j]))}
    compared = []
    plain = similarity._lcs_chunk
    monkeypatch.setattr(similarity, "_lcs_chunk", lambda b, partners, places: compared.extend(partners) or plain(b, partners, places))
    left = similarity.by_length(range(half), keys[:half])
    batch = pa.RecordBatch.from_pydict({"rank": list(range(half, len(keys))), "key": keys[half:]})
    found = lambda single, names: [r for b in similarity.near_pairs([batch], left, threshold, True, single, names) for r in b.to_pylist()]
    assert {(r["a"], r["b"]) for r in found(False, ["a", "b", "ka", "kb"])} == want
    if threshold in (90, 95):
        assert len(compared) < len(want) + half
    assert sorted(r["b"] for r in found(True, ["b"])) == sorted({j for _, j in want})


def greedy(rows, threshold):
    """rows: (uid, company, title, deadline), one per uid."""
    kept = []
    for r in sorted(sorted(rows), key=lambda r: r[3], reverse=True):
        key = " ".join(sorted(f"{r[1].strip().lower()} {r[2].strip().lower()}".split()))
        if not r[1].strip():
            kept.append((r, None))
        elif not any(k is not None and alike(k, key, threshold) for _, k in kept):
            kept.append((r, key))
    return sorted(r[0] for r, _ in kept)


@pytest.mark.parametrize("first_batch, growth", [(10, 2), (30, 4), (10_000, 8)])
def test_leaders_equal_a_sequential_scan(spark, first_batch, growth):
    rng = random.Random(first_batch)
    titles = near_copies(rng, 150, "abcd ef", 25)
    rows = [
        (f"{i:04d}", rng.choice(["", "Acme", "Acme ", "acme inc", "Zeta"]), t, rng.choice(["", "상시채용", "2026-01-01", "05/30"]))
        for i, t in enumerate(titles + titles[:20])
    ]
    df = spark.createDataFrame(rows, "uid string, company string, title string, deadline string")
    got = fuzzy.fuzzy_dedup(df, exact_order=None, first_batch=first_batch, growth=growth)
    assert sorted(r.uid for r in got.select("uid").collect()) == greedy(rows, 90)


def test_a_removed_posting_removes_nothing(spark):
    # a ~ b and b ~ c, but a and c are too far apart: c stays
    rows = [("1", "co", "x" * 20, "3"), ("2", "co", "x" * 18 + "yy", "2"), ("3", "co", "x" * 16 + "yyyy", "1")]
    df = spark.createDataFrame(rows, "uid string, company string, title string, deadline string")
    got = sorted(r.uid for r in fuzzy.fuzzy_dedup(df, exact_order=None).collect())
    assert got == greedy(rows, 90)


def test_one_group_of_near_copies_is_never_paired_with_itself(spark):
    """A third of all rows are near copies: after the first batch its leader takes them all."""
    rows = [(f"{i:05d}", "samsung", f"backend engineer of platform team number {i}", "2026") for i in range(600)]
    rows += [(f"x{i:05d}", f"firm{i * 7919}", f"role {i * 104729} {i}", "2025") for i in range(300)]
    df = spark.createDataFrame(rows, "uid string, company string, title string, deadline string")
    seen = []
    plain = fuzzy.Signature.matches

    def counted(self, left, right, ordered):
        out = plain(self, left, right, ordered)
        seen.append(out.count())
        return out

    fuzzy.Signature.matches = counted
    try:
        got = fuzzy.fuzzy_dedup(df, exact_order=None, first_batch=32, growth=4).count()
    finally:
        fuzzy.Signature.matches = plain
    assert got == len(greedy(rows, 90))
    assert sum(seen) < 600 * 600 / 20


def test_refining_a_listing_without_order_of_arrival(spark, raw):
    rows = raw(*[{"title": f"개발자 {t}", "company": "a", "deadline": d, "experience": "신입"} for t, d in (("python", "2"), ("python", "1"), ("웹", ""))])
    got = refine.refine(rows.drop("ingest_seq")).orderBy("title").collect()
    assert [(r.title, r.deadline, r.min_exp, r.tech_stack) for r in got] == [("개발자 python", "1", 0, ["Python"]), ("개발자 웹", "", 0, [])]
