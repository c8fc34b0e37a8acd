import glob
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = [os.path.basename(p)[:-8] for p in glob.glob(SF + "/*.parquet")]
needs_data = pytest.mark.skipif(not TABLES, reason="test data not there")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain(rows):
    def value(v):
        if v is None or v != v:
            return None
        return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(value(v) for v in r) for r in rows), key=repr)


@needs_data
@pytest.mark.parametrize(
    "name",
    ["flagship", "refine_postings", "rule_dedup", "fuzzy_dedup", "source_rollup", "feed_quality", "upsert_merge", "filter_search", "tfidf_search_filtered", "stored_expansion", "feed_naver"],
)
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    sql = con.sql(f"SELECT {', '.join(names)} FROM ({entry.oracle_sql()[name]})")
    assert sorted(con.sql(entry.oracle_sql()[name]).columns) == names
    assert plain(df.select(*names).collect()) == plain(sql.fetchall())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
