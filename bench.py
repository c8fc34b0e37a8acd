"""Times the headline queries and prints one JSON line."""

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from postloom.plans.queries import QUERIES  # noqa: E402
from postloom.session import build_session  # noqa: E402

HEADLINE = (
    "flagship",
    "refine_postings",
    "rule_dedup",
    "uid_dedup",
    "snapshot_stats",
    "source_rollup",
    "top_tech",
    "filter_search",
    "table_query",
    "upsert_merge",
    "tfidf_search",
    "batch_search",
    "vector_topk",
    "query_expand",
    "feed_wanted",
    "feed_saramin",
    "feed_quality",
    "fuzzy_dedup",
    "fuzzy_dedup_documents",
    "fuzzy_dedup_postings",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["row_count"](spark, sf_dir).collect()  # starts the engine
    took = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - begin, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    total = round(sum(took.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
