from datetime import datetime

from assize.plans import registry


def test_each_leg_brings_candidates(spark, tmp_path):
    words = " ".join(f"other{k}" for k in range(45))
    near = [(f"b{k:02d}", "rare " + words, None) for k in range(41)]  # crowds "a" out of the BM25 leg
    rows = [*near, ("name", "nothing alike", "a::find_it"), ("vec", "held held held", None)]
    at = datetime(2025, 12, 1)
    spark.createDataFrame([(i, c, n, "src/x.rs", at, "symbol") for i, c, n in rows], "id string, content string, qualified_name string, source_path string, indexed_at timestamp, chunk_kind string").write.parquet(f"{tmp_path}/chunks.parquet")
    asked = [("q", "rare `a::find_it`", "held, held", "y.rs", 100), ("skipped", "rare", "", "y.rs", 101)]
    spark.createDataFrame(asked, "id string, title string, description string, file_path string, line_start int").write.parquet(f"{tmp_path}/findings.parquet")
    got = {r["id"]: r for r in registry._chunk_candidates(spark, str(tmp_path)).collect()}
    assert {r["query_id"] for r in got.values()} == {"q"} and got["name"]["exact"] and not got["vec"]["exact"]
    assert got["vec"]["vec"] > 0 and got["b00"]["bm25"] > 0 and all(r["same_lang"] for r in got.values())
    best = registry.queries()["chunk_retrieval"](spark, str(tmp_path)).filter("rank <= 2").collect()
    assert "name" in {r["id"] for r in best}
    assert registry.queries()["chunk_packing"](spark, str(tmp_path)).count() == 8
