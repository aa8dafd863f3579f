"""Survivors, consensus and entity matching on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from assize.llm import consensus, entities, survivors

FB = "seq bigint, file_path string, finding_title string, finding_category string, verdict string, reason string, model string, ts string, provenance string, fp_kind string, finding_id string, rule_id string, received_at string, fid string, us bigint, trust string"
A, B = "01JH2Q5PCJ30YSPRMNRFHFV1Y6", "01JGXJ831YZW16WCN3X04RQTED"
DAY = "2025-01-0"


def feedback(spark, rows):
    """Rows as dicts; extra columns have the names of the operators' own."""
    names = [f.split()[0] for f in FB.split(", ")]
    full = [tuple({"received_at": "2025-02-01 00:00:00", **r}.get(n) for n in names) for r in rows]
    return spark.createDataFrame(full, FB).withColumn("ts", F.to_timestamp("ts")).withColumn("received_at", F.to_timestamp("received_at"))


def row(seq, fid, verdict="tp", prov="human", ts="2025-01-01 00:00:00", **more):
    return {"seq": seq, "finding_id": fid, "verdict": verdict, "provenance": prov, "ts": ts, "finding_title": "t", "file_path": "p", **more}


def test_survivor_order(spark):
    df = feedback(spark, [
        row(1, A, "tp", "human", reason="old"),
        row(2, f"#{A.lower()}", "fp", "post_fix", reason=" "),
        row(3, A, "partial", "human", "2025-01-02 00:00:00", reason="new"),
        row(4, A, "wontfix", "human", "2026-01-01 00:00:00", reason="ahead of its clock", model="m"),
        row(5, A, None, None),
        row(6, B, "tp"),
    ])
    got = {r["field_name"]: r["from_seq"] for r in survivors.found(df).collect()}
    assert got == {"verdict": 2, "reason": 3, "model": 4}


def test_row_without_id_joins_its_equal(spark):
    df = feedback(spark, [row(7, A, reason="r", prov="unknown"), row(8, "n/a", "fp", "post_fix", reason="r"), row(9, None, "fp", "post_fix", reason="other")])
    got = {(r["first_seq"], r["field_name"], r["from_seq"]) for r in survivors.found(df).collect()}
    assert got == {(7, "verdict", 8), (7, "reason", 8)}


def test_ties_and_repeated_rows(spark):
    df = feedback(spark, [row(3, A, "fp"), row(2, A, "tp"), row(2, A, "tp")])
    assert [(r["first_seq"], r["from_seq"]) for r in survivors.found(df).distinct().collect()] == [(2, 2)]


def test_two_sided_model_trusts_agreement(spark):
    rows, seq = [], 0
    for n in range(40):
        fid = f"{n:026d}"
        for who, v in (("human", "tp"), ("post_fix", "tp"), ("external:bad", "fp" if n % 4 else "tp")):
            seq += 1
            rows.append(row(seq, fid, v, who))
    values = survivors.resolve(feedback(spark, rows)).filter("field_name = 'verdict'").groupBy("value").agg(F.avg("posterior").alias("p")).collect()
    p = {r["value"]: r["p"] for r in values}
    assert p["tp"] > 0.8 > 0.4 > p["fp"]


def test_consensus_beats_spammers(spark):
    rng, rows, seq, truth = random.Random(1), [], 0, {}
    for n in range(150):
        fid = f"{n:026d}"
        truth[fid] = rng.choice(["tp", "fp", "partial", "wontfix"])
        for who in ("human", "external:good", "auto_calibrate:m", "external:spam1", "external:spam2", "external:spam3"):
            v = "tp" if "spam" in who else truth[fid] if rng.random() < 0.9 else rng.choice(["tp", "fp", "partial", "wontfix"])
            seq += 1
            rows.append(row(seq, fid, v, who))
    items, people = consensus.agree(feedback(spark, rows))
    right = [truth[r["finding_id"]] == r["consensus"] for r in items.collect()]
    assert sum(right) / len(right) > 0.95
    skill = {r["annotator"]: r["competence"] for r in people.collect()}
    assert max(skill[f"external:spam{k}"] for k in (1, 2, 3)) < 0.5 < min(skill["human"], skill["external:good"], skill["auto:m"])


def test_latest_vote_counts(spark):
    df = feedback(spark, [row(1, A, "tp"), row(2, A, "fp", ts="2025-01-02 00:00:00"), row(3, A, "wontfix", ts="2026-01-02 00:00:00"), row(4, A, "tp", None), row(5, A, "", "post_fix"), row(6, A, "fp", "human", "2025-01-02 00:00:00")])
    assert [(r["who"], r["label"]) for r in consensus.votes(df).collect()] == [("human", "fp")]


TR = "trace_no bigint, finding_title string, finding_category string, file_path string, sig string"


@pytest.fixture
def pair(spark):
    left, right = [], []
    for n in range(60):
        left += [row(n, None, finding_title=f"Unchecked input in `Widget{n}::run_all`", file_path=f"src/a/w{n}.rs"), row(1000 + n, A, finding_title=f"(medium) unchecked imput in **Widget{n}.runAll**", file_path=f".\\src\\a\\w{n}.rs:12")]
        right += [(n, f"Unchecked input in `Widget{n}::run_all`", None, f"src/a/w{n}.rs" if n % 3 else None, "x")]
        if n % 5 == 1:
            right += [(500 + n, f"Unchecked input in `Widget{n}::run_all`", None, f"lib/other/z{n}.py", "x")]
    return feedback(spark, left + [row(5000, A, finding_title=None)]), spark.createDataFrame(right + [(900, None, None, None, "x"), (901, "!!", None, "p", "x")], TR)


def test_entities(pair):
    got = {(r["seq"], r["trace_no"]) for r in entities.found(*pair).collect()}
    assert got == {(s, n) for n in range(60) for s in (n, 1000 + n)}


def test_empty_tables(spark):
    none = feedback(spark, [])
    assert survivors.found(none).count() == 0
    assert consensus.found(none).count() == 0
    assert entities.found(none, spark.createDataFrame([], TR)).count() == 0
