import pytest

from assize.llm import near_duplicates, queries


@pytest.mark.parametrize("copies", [199, 200, 201, 2005])
def test_every_copy_is_linked_with_copies_and_other_sites(spark, tmp_path, copies):
    rows = [(f"c{k:04d}", "same words here", "and there", 7) for k in range(copies)] + [("d", "same words here", "and there too", 9)]
    spark.createDataFrame(rows, "id string, title string, description string, line_start int").write.parquet(f"{tmp_path}/findings.parquet")
    got = queries.queries()["p2_found"](spark, str(tmp_path))
    assert got.count() == got.distinct().count() == copies * (copies - 1) // 2 + copies
    assert got.filter("id_b = 'd'").count() == copies and got.filter("id_a >= id_b").isEmpty()


def test_dense_and_hot_nodes_lose_no_pair(spark, monkeypatch):
    """Many different texts near one line, all similar to one another."""
    monkeypatch.setattr(near_duplicates, "CELL", 40)
    base = [f"word{k}" for k in range(20)]
    rows = [(f"f{k:03d}", " ".join(base), f"only{k}", 5 + k % 4) for k in range(150)]
    got = near_duplicates.found(spark.createDataFrame(rows, "id string, title string, description string, line_start int"))
    assert got.count() == got.distinct().count() == 150 * 149 // 2
