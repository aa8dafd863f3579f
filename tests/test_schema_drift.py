import json

from assize.operators import schema_drift as D

SCHEMA = "log_name string, file_no int, line_no int, line_text string, field string"


def raw(spark, files):
    rows = [(log, no, k, line if isinstance(line, (str, type(None))) else json.dumps(line), "clash") for (log, no), lines in files.items() for k, line in enumerate(lines)]
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, files):
    return {(r["log_name"], r["file_no"], r["field_name"], r["new_name"], r["change_kind"]) for r in D.changes(raw(spark, files)).collect()}


def test_kinds_of_change(spark):
    got = changes(spark, {
        ("feedback-1", 1): [{"verdict": "tp", "ts": "x", "old": 1, "keep": None}, {"verdict": "fp", "keep": 2}],
        ("feedback-1", 3): [{"outcome": "tp", "ts": 5, "new": [], "keep": 1}, None, "", "# note", '{"cut": ', '{"a": 1} {"b": 2}', '{"a": 1}]', "[1]", '"x"'],
        ("feedback-2", 9): [{"a": 1}],
    })
    assert got == {
        ("feedback-1", 3, "verdict", "outcome", "renamed"), ("feedback-1", 3, "ts", "", "retyped"), ("feedback-1", 3, "old", "", "removed"), ("feedback-1", 3, "new", "", "added"),
    }


def test_members_only_between_whole_objects(spark):
    got = changes(spark, {
        ("traces-1", 1): [{"provenance": {"repo": "r", "dirty": True}}],
        ("traces-1", 2): [{"provenance": {"project": "r", "dirty": 0}}],
        ("traces-1", 3): [{"provenance": "text"}],
        ("traces-1", 4): [{"provenance": {"x": 1}}],
        ("feedback-1", 1): [{"provenance": {"human": {}}}],
        ("feedback-1", 2): [{"provenance": {"post_fix": {}}}],
    })
    assert got == {
        ("traces-1", 2, "provenance.repo", "provenance.project", "renamed"), ("traces-1", 2, "provenance.dirty", "", "retyped"),
        ("traces-1", 3, "provenance", "", "retyped"), ("traces-1", 4, "provenance", "", "retyped"),
    }


def test_order_is_by_number_and_repeats_change_nothing(spark):
    files = {("inbox-1", no): [{"a": 1} if no < 10 else {"b": 1}] * 2 for no in (2, 10, 11)}
    assert changes(spark, files) == {("inbox-1", 10, "a", "", "removed"), ("inbox-1", 10, "b", "", "added")}
    assert changes(spark, {}) == set()


def test_islands_and_table(spark):
    files = {("feedback-1", n): [{"ts": "2025-01-01T00:00:00Z" if n < 3 else 1735689600000, "conf": "0.5", "verdict": {}, "model": {"name": "m"}}] for n in (1, 2, 3, 5)}
    rows = {(r["field"], r["types"], r["first_file"], r["last_file"]) for r in D.islands(raw(spark, files)).collect()}
    assert ("ts", "string", 1, 2) in rows and ("ts", "number", 3, 5) in rows and ("conf", "string", 1, 5) in rows
    table = D.consistent(raw(spark, files)).collect()
    assert {r["ts"].isoformat() for r in table} == {table[0]["ts"].isoformat()} and {r["confidence"] for r in table} == {0.5} and {r["model"] for r in table} == {"m"}
