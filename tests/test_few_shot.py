import random

from test_corpus_join import shuffled, title, words

from assize.operators import calibration


def tables(spark, findings, precedents):
    f = spark.createDataFrame([(f"f{n}", *x) for n, x in enumerate(findings)], "id string, title string, category string")
    p = spark.createDataFrame([(n, t, c, c, v, tier, 1.0) for n, (t, c, v, tier) in enumerate(precedents)], "seq bigint, title string, cat string, raw_category string, v string, tier string, w double")
    return f, p


def listed(f, p):
    return {tuple(r) for r in calibration.few_shot(calibration.similar_precedents(f, p, 0.6)).collect()}


def test_titles_of_one_template_are_not_shuffled_as_pairs(spark):
    rng = random.Random(1)
    f, p = tables(spark, [(title(rng, n), "security") for n in range(600)], [(title(rng, n), "security", rng.choice(["tp", "fp"]), "human") for n in range(300, 900)])
    rows, n = shuffled(spark, lambda: {tuple(r) for r in calibration.few_shot_examples(f, p).collect()})
    assert rows == listed(f, p)
    assert n < 15_000  # there are 360,000 pairs


def test_same_examples_as_of_the_listed_precedents(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(calibration, "FEW_ASKED", 30)
    monkeypatch.setattr(calibration, "FEW_HELD", 70)
    monkeypatch.setattr(calibration, "STEP", 3)
    cats = ["security", "logic", "performance", "maintainability"]
    some = lambda: rng.choice(["", "", "Complexity 4 ", "complexity 7 ", "Complexity 5: ", "complexity x "]) + words(rng, rng.randint(0, 6)) + rng.choice(["", "!", " ..."])
    f, p = tables(
        spark,
        [(some(), rng.choice([*cats, None])) for _ in range(200)] + [(None, "logic"), ("", "logic"), ("...", "logic")],
        [(some(), rng.choice(cats), rng.choice(["tp", "fp", "partial"]), rng.choice(["human", "post_fix", "external"])) for _ in range(600)],
    )
    p = p.withColumn("raw_category", calibration.F.when(calibration.F.col("seq") % 7 == 0, "").when(calibration.F.col("seq") % 11 == 0, None).otherwise(calibration.F.col("raw_category")))
    rows = {tuple(r) for r in calibration.few_shot_examples(f, p).collect()}
    assert rows == listed(f, p)
    assert {0.6} < {r[4] for r in rows}
