import datetime as dt
import random

from pyspark.sql import functions as F

from postloom.operators import refine, upsert
from postloom.schema import POSTING
from postloom.sources import files
from postloom.sources.store import PostingStore
from postloom.streaming import ingest as streaming

DAY1, DAY2 = dt.datetime(2026, 5, 1), dt.datetime(2026, 5, 2)


def records(spark, day, *rows):
    blank = {f.name: "" for f in POSTING.fields} | {"min_exp": None, "max_exp": None, "tech_stack": [], "posted_date": day, "updated_at": day}
    return spark.createDataFrame([tuple((blank | {"title": "t"} | r)[n] for n in POSTING.names) for r in rows], POSTING)


def deadlines(df):
    return {r.uid: (r.deadline, r.title, r.updated_at) for r in df.collect()}


OLD = [{"uid": u, "deadline": d, "title": "old"} for u, d in (("a", ""), ("b", "2026-05-30"), ("c", "2026-05-30"), ("d", "상시채용"), ("e", ""))]
NEW = [{"uid": u, "deadline": d, "title": "new"} for u, d in (("a", "2026-01-01"), ("b", "05/30"), ("c", "상시채용"), ("d", "2027-01-01"), ("e", ""), ("f", "x"), ("", "y"))]
# text order: digits before Hangul, '0' before '2'; a blank old deadline always moves
WANT = {"a": ("2026-01-01", "old", DAY2), "b": ("2026-05-30", "old", DAY1), "c": ("상시채용", "old", DAY2), "d": ("상시채용", "old", DAY1), "e": ("", "old", DAY2), "f": ("x", "new", DAY2)}


def test_merge_and_counts(spark):
    old, new = records(spark, DAY1, *OLD), upsert.one_row_per_uid(records(spark, DAY2, *NEW))
    assert deadlines(upsert.merge(old, new)) == WANT
    assert tuple(upsert.counts(old, new).head()) == (1, 3, 2)


def test_repeats_within_a_batch(spark):
    batch = records(spark, DAY1, {"uid": "a", "deadline": "1"}, {"uid": "a", "deadline": "3"}, {"uid": "a", "deadline": "2"})
    assert [(r.uid, r.deadline) for r in upsert.one_row_per_uid(batch).collect()] == [("a", "3")]


def test_store_equals_merge_and_replays_are_harmless(spark, tmp_path):
    store = PostingStore(spark, str(tmp_path / "s"))
    assert store.read().count() == 0
    assert store.upsert(records(spark, DAY1, *OLD), 0) == (5, 0, 0)
    assert store.upsert(records(spark, DAY2, *NEW), 1) == (1, 3, 2)
    assert store.upsert(records(spark, DAY2, *NEW), 1) == (1, 3, 2)
    assert deadlines(store.read()) == WANT
    assert store.changes().count() == 9  # five, and one new with three moved
    # a later batch moves a deadline again
    assert store.upsert(records(spark, DAY2, {"uid": "a", "deadline": "2026-09-01"}), 2) == (0, 1, 0)
    assert deadlines(store.read())["a"][0] == "2026-09-01"
    folded = PostingStore(spark, str(tmp_path / "folded"))
    assert folded.upsert(store.read(), 0) == (6, 0, 0)
    assert deadlines(folded.read()) == deadlines(store.read()) == WANT | {"a": ("2026-09-01", "old", DAY2)}
    assert folded.upsert(records(spark, DAY2, {"uid": "g"}), 1) == (1, 0, 0)
    assert folded.read().count() == 7


def test_a_batch_that_broke_off_is_completed(spark, tmp_path):
    """Only some of a batch's files arrived; another writer came before it ran again."""
    whole, store = PostingStore(spark, str(tmp_path / "whole")), PostingStore(spark, str(tmp_path / "s"))
    whole.upsert(records(spark, DAY1, *OLD), 0)
    whole.changes().where("uid < 'c'").write.mode("append").parquet(store.path)
    assert store.upsert(records(spark, DAY2, *NEW), 0, "other") == (4, 1, 1)  # "b" stays, "c" to "f" look new
    assert store.upsert(records(spark, DAY1, *OLD), 0) == (5, 0, 0)
    assert store.upsert(records(spark, DAY2, *NEW), 0, "other") == (1, 3, 2)
    assert deadlines(store.read()) == WANT
    assert store.upsert(records(spark, DAY1, *OLD), 0) == (5, 0, 0) and deadlines(store.read()) == WANT


def test_history_in_any_order_gives_one_table(spark, tmp_path):
    """Batches of random deadlines against the rule applied row by row."""
    rng = random.Random(3)
    for case in range(2):
        store, want = PostingStore(spark, str(tmp_path / f"s{case}")), {}
        for day in range(4):
            rows = {u: rng.choice(["", "1", "2", "3"]) for u in rng.sample("abcdefgh", 6)}
            at = DAY1 + dt.timedelta(days=day)
            for u, d in rows.items():
                old = want.get(u)
                if old is None:
                    want[u] = (d, f"t{day}", at)
                elif old[0] == "" or old[0] < d:
                    want[u] = (d, old[1], at)
            for _ in range(2):
                store.upsert(records(spark, at, *[{"uid": u, "deadline": d, "title": f"t{day}"} for u, d in rows.items()]), day)
        assert deadlines(store.read()) == want


def test_query_has_no_hidden_limit(spark, tmp_path):
    store = PostingStore(spark, str(tmp_path / "s"))
    rows = [{"uid": str(i), "source": "x" if i % 2 else "y"} for i in range(6000)]
    store.upsert(records(spark, DAY1, *rows), 0)
    assert store.query().count() == 6000
    assert store.query(sources=["x"]).count() == 3000
    assert store.query(limit=10).count() == 10


def test_csv(spark, tmp_path, raw):
    folder = str(tmp_path)
    df = raw({"title": 'say "hi", 개발', "company": "a\nb"})
    files.save_csv(df, folder, "feed_2.csv")
    files.save_csv(df.withColumn("title", F.lit("old")), folder, "feed_1.csv")
    (tmp_path / "feed_3.csv").write_text("﻿공고제목,회사명,근무지,경력,마감일,공고URL,출처,검색키워드\n제목,,,,,u,s,k\n", encoding="utf-8")
    got = files.newest_csv(spark, folder, "feed_*.csv").head()
    assert (got.title, got.company, got.url) == ("제목", None, "u")
    assert [r.path.rsplit("/", 1)[1] for r in files.csv_names(spark, folder).collect()] == ["feed_3.csv", "feed_2.csv", "feed_1.csv"]
    back = files.read_csv(spark, f"{folder}/feed_2.csv").head()
    assert (back.title, back.company) == ('say "hi", 개발', "a\nb")
    assert files.newest_csv(spark, folder, "none_*.csv").count() == 0


def test_refined_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("공고제목,회사명,근무지,경력,마감일,공고URL,출처,검색키워드,uid,min_exp,max_exp,tech_stack\nt,c,,,,,,,u,3,,\"['Go', 'C#']\"\n", encoding="utf-8")
    row = files.read_refined_csv(spark, str(path)).head()
    assert (row.min_exp, row.max_exp, row.tech_stack) == (3, None, ["Go", "C#"])


def test_stream_equals_batch(spark, tmp_path, raw):
    rows = [{"title": f"백엔드 개발자 {i % 7}", "company": f"co{i % 5}", "url": f"u{i % 3}", "deadline": "2026"} for i in range(60)]
    df = raw(*rows)
    landed = str(tmp_path / "landed")
    df.coalesce(1).write.parquet(landed)
    now = F.lit(DAY1)
    store = PostingStore(spark, str(tmp_path / "store"))
    for _ in range(2):  # the second run finds nothing new
        streaming.ingest(streaming.landed_stream(spark, landed), store, str(tmp_path / "state"), now=now).awaitTermination()
    from postloom.operators.dedup import dedup_rules

    batch = refine.to_records(refine.refine(dedup_rules(df)), now)
    assert sorted(map(str, store.read().collect())) == sorted(map(str, batch.collect()))


def test_stream_dedup_over_several_files(spark, tmp_path, raw):
    landed = str(tmp_path / "landed")
    for start in (0, 5):
        raw(*[{"title": f"t{i}"} for i in range(start, start + 10)]).coalesce(1).write.mode("append").parquet(landed)
    out = streaming.dedup_stream(streaming.landed_stream(spark, landed, max_files=1))
    run = out.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("seen").count() == 15


def test_writers_may_use_the_same_ids(spark, tmp_path):
    store = PostingStore(spark, str(tmp_path / "s"))
    assert store.upsert(records(spark, DAY1, *OLD), 0, "a") == (5, 0, 0)
    assert store.upsert(records(spark, DAY2, *NEW), 0, "b") == (1, 3, 2)
    assert store.upsert(records(spark, DAY2, *NEW), 0, "b") == (1, 3, 2)
    assert deadlines(store.read()) == WANT


def test_two_streams_that_go_on(spark, tmp_path, raw):
    store = PostingStore(spark, str(tmp_path / "store"))
    for part in range(2):
        landed = str(tmp_path / f"landed{part}")
        raw(*[{"title": f"백엔드 {part} {i}", "company": f"co{part}{i}"} for i in range(3)]).coalesce(1).write.parquet(landed)
        streaming.ingest(streaming.landed_stream(spark, landed), store, str(tmp_path / f"state{part}"), threshold=100).awaitTermination()
        raw({"title": f"late {part}", "company": "x"}).coalesce(1).write.mode("append").parquet(landed)
        streaming.ingest(streaming.landed_stream(spark, landed), store, str(tmp_path / f"state{part}"), threshold=100).awaitTermination()
    assert store.read().count() == 8


def test_merge_folds_repeats_and_drops_blank_uids(spark):
    old, new = records(spark, DAY1, *OLD), records(spark, DAY2, *NEW, *NEW)
    assert deadlines(upsert.merge(old, new)) == WANT and upsert.merge(old, new).count() == len(WANT)
    assert tuple(upsert.counts(old, new).head()) == (1, 3, 2)


def test_windows_of_a_stream_forget_what_is_over(spark, tmp_path):
    """Batches one by one: the first of each key and hour, late rows dropped, state bounded by the watermark."""
    from postloom.streaming import ingest as streaming

    schema = "event_id long, ts timestamp, user_id long, event_type string"
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    at = lambda hour, minute=0: f"2026-01-01 {hour:02d}:{minute:02d}:00"
    batches = [
        [(5, at(1), 1, "a"), (4, at(1, 30), 1, "a"), (6, at(1), 2, "a")],
        [(3, at(1, 59), 1, "a"), (7, at(9), 1, "a")],  # within the delay still
        [(1, at(1), 1, "a"), (8, at(9, 1), 1, "a"), (9, at(8, 30), 2, None)],  # the first one is late
    ]
    last = None
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string")
        frame.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
        stream = streaming.landed_stream(spark, path, spark.read.parquet(path).schema, max_files=1)
        run = streaming.write_updates(streaming.first_per_window(stream, ["user_id", "event_type"], "ts", "event_id"), out, state)
        run.awaitTermination()
        last = run.lastProgress
    got = spark.read.schema("window_start timestamp, user_id long, event_type string, first long").parquet(out)
    best = {(str(r.window_start)[11:13], r.user_id, r.event_type): r.m for r in got.groupBy("window_start", "user_id", "event_type").agg(F.min("first").alias("m")).collect()}
    assert best == {("01", 1, "a"): 3, ("01", 2, "a"): 6, ("09", 1, "a"): 7, ("08", 2, None): 9}
    assert last["stateOperators"][0]["numRowsTotal"] <= 2  # the windows of one o'clock are gone


def test_a_batch_handed_over_again_is_not_made_whole(spark, tmp_path):
    """Uid and deadline tell that no row is missing, so that the other columns are never computed."""
    store = PostingStore(spark, str(tmp_path / "s"))
    assert store.upsert(records(spark, DAY1, *OLD), 0) == (5, 0, 0)
    new = records(spark, DAY2, *NEW, {"uid": "f", "deadline": "z"})
    assert store.upsert(new, 1) == (1, 3, 2)
    before = store.changes().count()
    broken = new.withColumn("description", F.raise_error(F.lit("computed")).cast("string"))
    assert store.upsert(broken, 1) == (1, 3, 2)
    assert store.changes().count() == before and deadlines(store.read())["f"][0] == "z"


def test_rows_stay_where_their_uid_put_them(spark, raw):
    """From the first of each uid to one row per uid there is one exchange."""
    from postloom.operators import dedup

    rows = raw(*[{"title": f"t{i % 7}", "company": "c"} for i in range(40)])
    batch = upsert.one_row_per_uid(refine.to_records(refine.enrich(dedup.dedup_uid(dedup.with_uid(rows))), F.lit(DAY1)))
    plan = batch._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and batch.count() == 7
