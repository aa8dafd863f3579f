import pytest
from oracle import BASE, compare, needs_data

from assize.llm import queries as llm

QUERIES, SQL = llm.queries(), llm.oracle_sql()


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


#: Columns that name a row of a query without SQL.
KEYS = {
    "p1_values": ["first_seq", "field_name", "value"], "p2_groups": ["id"], "p4_found": ["id", "line_no"], "p5_found": ["finding_id"], "p5_items": ["finding_id"], "p5_annotators": ["annotator"],
    "p6_found": ["seq", "trace_no"], "p6_matches": ["seq", "trace_no"], "p7_found": ["id", "line_no"], "p8_coverage": ["doc_id", "passage_id"], "p9_mixture": ["source"],
    "p9_selection": ["doc_id"], "p10_repetition": ["doc_id"],
}


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_have_their_keys(spark, name):
    df = QUERIES[name](spark, BASE).cache()
    keys = KEYS.get(name, [])
    assert df.count() > 0 and df.filter(" OR ".join([f"{k} IS NULL" for k in keys]) or "false").isEmpty()
    assert not keys or df.select(*keys).distinct().count() == df.count()


@needs_data
def test_every_row_has_an_answer(spark):
    rows = {n: spark.read.parquet(f"{BASE}/{n}.parquet").count() for n in ("chunks", "documents", "findings")}
    assert QUERIES["p4_redacted"](spark, BASE).count() == rows["chunks"] and QUERIES["p10_repetition"](spark, BASE).count() == rows["documents"] and QUERIES["p2_groups"](spark, BASE).count() == rows["findings"]
