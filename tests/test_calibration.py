"""Golden scenarios of the calibration decision, both variants."""

import pytest

from assize.operators import calibration as C

NOW = 1_700_000_000_000_000
HOUR, DAY = 3_600_000_000, 86_400_000_000
RACE, UNWRAP, SQLI = "Race condition in shared HashMap", "Use of unwrap", "SQL injection"


def scenario(title, cat, severity, rows, precedent_cat=None):
    return title, cat, severity, [(title, precedent_cat or cat, *r) for r in rows]


def many(n, verdict, provenance, kind=None, age=HOUR):
    return [(verdict, provenance, kind, age)] * n


EXTERNAL = '{"external": {"agent": "a"}}'
CASES = {
    "02": (scenario("Some new finding", "security", "medium", []), ("medium", None, "no_match", 0, 0, 0, 0), ("medium", None, "no_match", 0, 0, 0, 0)),
    "03": (scenario(RACE, "concurrency", "medium", many(1, "tp", "human")), ("medium", "confirmed", "boost_weight_too_low", 1, 0, 0, 1), ("medium", "confirmed", "boost_weight_too_low", 0.775, 0, 0, 1)),
    "04": (scenario(RACE, "concurrency", "medium", many(3, "tp", "human")), ("high", "confirmed", "boosted", 3, 0, 0, 3), ("high", "confirmed", "boosted", 2.325, 0, 0, 3)),
    "05": (scenario("Function `foo` has cyclomatic complexity 30", "performance", "medium", many(3, "tp", "human"), "complexity"), ("medium", "confirmed", "boost_blocked_by_gate", 3, 0, 0, 3), ("medium", None, "no_match", 0, 0, 0, 0)),
    "06": (scenario(UNWRAP, "error-handling", "medium", many(1, "fp", "human")), ("info", "disputed", "disputed", 0, 1, 0, 1), ("medium", None, "no_match", 0, 0, 0, 0)),
    "07": (scenario(UNWRAP, "error-handling", "medium", many(5, "fp", "human")), ("medium", "disputed", "disputed", 0, 5, 0, 5), ("medium", None, "no_match", 0, 0, 0, 0)),
    "08": (scenario(UNWRAP, "error-handling", "medium", many(1, "tp", "human") + many(4, "fp", "human")), ("medium", "disputed", "disputed", 1, 4, 0, 5), ("medium", None, "no_match", 0, 0, 0, 0)),
    "09": (scenario(SQLI, "security", "high", many(5, "fp", "human", '{"out_of_scope": {}}')), ("high", None, "no_match", 0, 0, 0, 0), ("high", None, "no_match", 0, 0, 0, 0)),
    "10": (scenario(SQLI, "security", "high", many(10, "tp", EXTERNAL)), ("high", "confirmed", "boost_weight_too_low", 1.4, 0, 0, 10), ("high", None, "no_match", 0, 0, 0, 0)),
    "11": (scenario(UNWRAP, "error-handling", "medium", many(5, "wontfix", "human")), ("medium", None, "boost_weight_too_low", 0, 0, 5, 5), ("medium", None, "no_match", 0, 0, 0, 0)),
    "13": (scenario(UNWRAP, "error-handling", "medium", many(3, "fp", "human", "hallucination", 30 * DAY)), ("medium", "disputed", "disputed", 0, 2.3364, 0, 3), ("medium", None, "no_match", 0, 0, 0, 0)),
    "14": (scenario(UNWRAP, "error-handling", "medium", many(3, "fp", "human", "trust_model_assumption", 30 * DAY)), ("info", "disputed", "disputed", 0, 1.4171, 0, 3), ("medium", None, "no_match", 0, 0, 0, 0)),
}


@pytest.mark.parametrize("name", sorted(CASES))
@pytest.mark.parametrize("index", [False, True])
def test_golden(spark, name, index):
    (title, cat, severity, rows), *expected = CASES[name]
    findings = spark.createDataFrame([("x", title, "snapshot scenario finding", severity, cat, [])], "id string, title string, description string, severity string, category string, evidence array<string>")
    schema = "seq bigint, finding_title string, finding_category string, verdict string, provenance string, fp_kind string, us bigint, received_us bigint, finding_id string, model string"
    feedback = spark.createDataFrame([(n, t, c, v, p, k, NOW - age, NOW, None, None) for n, (t, c, v, p, k, age) in enumerate(rows)], schema)
    feedback = feedback.selectExpr("*", "timestamp_micros(us) AS ts", "timestamp_micros(received_us) AS received_at").drop("us", "received_us")
    r = C.calibrate(findings, feedback, NOW, index=index).first()
    want = expected[index]
    got = (r["output_severity"], r["action"], r["reason"], r["tp"], r["fp"], r["wontfix"], r["n_precedents"])
    assert got[:3] == want[:3] and got[6] == want[6]
    assert got[3:6] == pytest.approx(want[3:6], abs=1e-4)


def test_empty(spark):
    findings = spark.createDataFrame([], "id string, title string, description string, severity string, category string, evidence array<string>")
    feedback = spark.createDataFrame([], "seq bigint, finding_title string, finding_category string, verdict string, provenance string, fp_kind string, finding_id string, model string, ts timestamp, received_at timestamp")
    assert C.calibrate(findings, feedback, NOW).count() == 0
