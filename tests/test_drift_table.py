import json

from assize.operators import schema_drift as D

SCHEMA = "log_name string, file_no int, line_no int, line_text string"


def table(spark, logs):
    rows = [(log, 1, k, json.dumps(line)) for log, lines in logs.items() for k, line in enumerate(lines)]
    raw = spark.createDataFrame(rows, SCHEMA)
    return {(r["log_name"], r["line_no"]): r for r in D.consistent(raw).collect()}, raw


def test_every_catalogued_field_is_in_the_table(spark):
    got, raw = table(spark, {
        "feedback-1": [{"tags": ["a", "b"], "blamed_lines": 3, "newField": {"x": 1}}, {"tags": "a,b", "blamed_lines": [1, 2], "file": "f"}],
        "trace-1": [{"provenance": {"dirty": 1, "model": "m", "run_id": "r", "sha": "s"}, "run_id": "own"}, {"provenance": {"dirty": "false", "review_model": "n"}}],
    })
    a, b, c, d = (got[k] for k in (("feedback-1", 0), ("feedback-1", 1), ("trace-1", 0), ("trace-1", 1)))
    assert (a["tags"], a["blamed_lines"], a["new_field"]) == ('["a","b"]', "3", '{"x":1}')
    assert (b["tags"], b["blamed_lines"], b["file_path"]) == ("a,b", "[1,2]", "f")
    assert (c["provenance_dirty"], c["provenance_review_model"], c["provenance_run_id"], c["run_id"], c["commit_sha"]) == (True, "m", "r", "own", "s")
    assert (d["provenance_dirty"], d["provenance_review_model"]) == (False, "n")
    for r in D.islands(raw).collect():  # each cast of the catalogue runs
        assert raw.selectExpr(r["cast"]).columns == [r["common_name"]]


def test_no_lines(spark):
    df = D.consistent(spark.createDataFrame([("trace-1", 1, 0, "# note")], SCHEMA))
    assert df.count() == 0 and set(D.CORE) <= set(df.columns)


def test_numbered_verdicts_provenance_in_text_and_unread_values(spark):
    got, _ = table(spark, {
        "feedback-1": [*({"verdict": n} for n in (0, 1, 2, 3, 7)), {"outcome": {"context_misleading": {"ids": ["c"]}}}, {"conf": "high", "ts": "soon", "verdict": {"tp": {}}}, {"file_path": "a", "location": "b", "ts": 10**18}],
        "trace-1": [{"provenance": json.dumps({"commit_sha": "s", "project": "p", "version": "1", "only_here": 5})}, {"provenance": "{cut"}],
    })
    verdicts = [got["feedback-1", k]["verdict"] for k in range(7)]
    assert verdicts == ["tp", "fp", "partial", "wontfix", None, "context_misleading", "tp"]
    kept = [json.loads(got["feedback-1", k]["raw_values"] or "{}") for k in range(8)]
    assert kept[:4] == [{}] * 4 and kept[4] == {"verdict": "7"} and kept[5] == {"outcome": '{"context_misleading":{"ids":["c"]}}'}
    assert kept[6] == {"conf": "high", "ts": "soon"} and kept[7] == {"location": "b", "ts": str(10**18)}
    r = got["trace-1", 0]
    assert (r["commit_sha"], r["repo"], r["tool_version"], r["provenance_only_here"]) == ("s", "p", "1", "5")
    assert got["trace-1", 1]["provenance"] == "{cut" and got["trace-1", 1]["commit_sha"] is None
