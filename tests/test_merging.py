from assize.operators import merging

SCHEMA = "run_id string, file_path string, id string, title string, category string, severity string, line_start int, line_end int, evidence array<string>, created_at timestamp"


def test_merge(spark):
    from datetime import datetime

    at = lambda n: datetime(2025, 1, 1, 0, n)
    rows = [
        ("r", "f", "a", "Use of unwrap here", "bug", "low", 5, 6, ["e1"], at(1)),
        ("r", "f", "b", "Use of unwrap here", "BUG", "high", 90, 91, ["e1", "e2"], at(2)),
        ("r", "f", "c", "Use of unwrap there", "bug", "info", 5, 6, None, at(3)),
        ("r", "f", "d", "Other words entirely", "bug", "info", 5, 6, [], at(4)),
        ("r", None, "e", "Alone", "bug", "info", 9, 3, None, at(5)),
        ("q", "f", "g", None, None, None, 1, 1, None, at(6)),
    ]
    got = {r["id"]: r for r in merging.merge_findings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {"a", "c", "d", "e", "g"}
    a = got["a"]
    assert (a["severity"], a["line_start"], a["line_end"], a["n_merged"]) == ("high", 5, 91, 2)
    assert a["evidence"] == ["e1", "e2", "2 occurrences merged"]
    assert (got["e"]["line_start"], got["e"]["line_end"], got["e"]["evidence"]) == (3, 9, [])


def test_grounding(spark):
    found = spark.createDataFrame(
        [("1", "f", "llm", "Call of `do_it()`", "high", 2, 2), ("2", "f", "llm", "Call of `gone_fn`", "high", 2, 2), ("3", "f", "llm", "x", "info", 9, 9), ("4", "f", "linter", "x", "low", 1, 1), ("5", "z", "llm", "x", "low", 1, 1)],
        "id string, file_path string, source_kind string, title string, severity string, line_start int, line_end int",
    )
    lines = spark.createDataFrame([("f", 3, ["a", "do_it()", "c"])], "file_path string, n_lines int, lines array<string>")
    got = {r["id"]: (r["status"], r["severity"]) for r in merging.grounded(found, lines).collect()}
    assert got == {"1": ("verified", "high"), "2": ("symbol-not-found", "medium"), "3": ("line-out-of-range", "info"), "4": ("not-checked", "low"), "5": ("not-checked", "low")}
