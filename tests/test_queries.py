import pytest
from oracle import BASE, compare, needs_data

from assize.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


#: Columns that name a row of a query without SQL.
KEYS = {
    "calibrate_ranked": ["id"], "few_shot_examples": ["id", "place"], "context_blocks": ["query_id"], "chunk_retrieval": ["query_id", "rank"], "chunk_packing": ["query_id", "place"],
    "p3_islands": ["log_name", "field", "first_file"],
}


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_have_their_keys(spark, name):
    df = QUERIES[name](spark, BASE).cache()
    keys = KEYS.get(name, [])
    assert df.count() > 0 and df.filter(" OR ".join([f"{k} IS NULL" for k in keys]) or "false").isEmpty()
    assert not keys or df.select(*keys).distinct().count() == df.count()


@needs_data
def test_merging_counts_every_finding(spark):
    assert QUERIES["merge_findings"](spark, BASE).selectExpr("sum(n_merged)").first()[0] == spark.read.parquet(f"{BASE}/findings.parquet").count()


@needs_data
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
