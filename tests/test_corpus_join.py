import datetime as dt
import random
from collections import Counter

import duckdb

from assize.operators import corpus_join
from assize.plans import registry

DAY = dt.datetime(2025, 1, 1)


def shuffled(spark, run):
    """What ``run`` returns and the rows that its shuffles wrote."""
    sc = spark.sparkContext

    def said() -> dict[int, int]:
        found = stages()
        return {s.stageId(): s.shuffleWriteRecords() for s in map(found.apply, range(found.size()))}

    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    before = said()
    out = run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return out, sum(n for s, n in said().items() if s not in before)


def tables(spark, feedback, traces):
    fb = spark.createDataFrame(
        [(n, t, p, v, "human", None, DAY, DAY, "f") for n, (t, p, v) in enumerate(feedback)],
        "seq bigint, finding_title string, file_path string, verdict string, provenance string, fp_kind string, ts timestamp, received_at timestamp, finding_id string",
    )
    tr = spark.createDataFrame([(n, *x) for n, x in enumerate(traces)], "trace_no bigint, finding_title string, file_path string, tp_weight double, fp_weight double")
    return fb, tr


def by_sql(spark, tmp_path, fb, tr):
    c = duckdb.connect()
    for name, df in (("feedback", fb), ("traces", tr)):
        df.write.parquet(str(tmp_path / name))
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / name}/*.parquet'")
    return Counter(c.execute(f"SELECT seq, positive, tier, score FROM ({registry.oracle_sql()['corpus_join_samples']})").fetchall())


def words(rng, n):
    return " ".join(rng.sample(["alpha", "beta", "gamma", "delta", "kappa", "query", "loop", "lock", "is", "built", "by", "the"], n))


def title(rng, n):
    return f"{rng.choice(['cursor', 'shard', 'ledger'])} query in `Part{n}::call{n}` is built by string concatenation"


def test_one_path_with_many_titles_is_not_shuffled_as_pairs(spark, tmp_path):
    rng = random.Random(1)
    fb, tr = tables(
        spark,
        [(title(rng, n), "hot.rs", "tp") for n in range(700)] + [(title(rng, n % 5), "hot.rs", "fp") for n in range(50)],
        [(title(rng, n + 600), "hot.rs", 1.0, 0.5) for n in range(700)],
    )
    rows, n = shuffled(spark, lambda: Counter(map(tuple, corpus_join.corpus_join(fb, tr).collect())))
    assert rows == by_sql(spark, tmp_path, fb, tr)
    assert n < 15_000  # 21,878 when pairs were shuffled


def test_stats_of_one_path_are_not_shuffled_as_pairs(spark, tmp_path):
    rng = random.Random(4)
    fb, tr = tables(spark, [(title(rng, n), "hot.rs", "tp" if n % 3 else "fp") for n in range(700)], [(title(rng, n + 600), "hot.rs", 1.0, 0.5) for n in range(700)])
    rows, n = shuffled(spark, lambda: {tuple(r) for r in corpus_join.join_stats(fb, tr).collect()})
    expected = by_sql(spark, tmp_path, fb, tr)
    assert rows == {(t, sum(c for r, c in expected.items() if r[2] == t), sum(c for r, c in expected.items() if r[2] == t and r[1])) for t in {r[2] for r in expected}}
    assert n < 15_000


def test_tiers_against_sql_in_blocks(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    paths = ["a.rs", "a.rs", "a.rs", "b.py", "c.go", "", None]
    monkeypatch.setattr(corpus_join, "ASKED_BLOCK", 40)
    monkeypatch.setattr(corpus_join, "HELD_BLOCK", 50)
    some = lambda: rng.choice(["", "sec-1: ", "## "]) + words(rng, rng.randint(1, 7)) + rng.choice(["", "", "!"])
    fb, tr = tables(
        spark,
        [(some(), rng.choice(paths), rng.choice(["tp", "fp", "partial", "wontfix"])) for _ in range(900)] + [("!!", "a.rs", "tp"), ("", "a.rs", "tp"), (None, "a.rs", "tp")],
        [(some(), rng.choice(paths), rng.choice([0.0, 1.0, -1.0, None]), rng.choice([0.0, 0.5, 2.0])) for _ in range(400)] + [("--", "a.rs", 1.0, 0.0), ("", "", 1.0, 0.0), (None, None, 1.0, 0.0)],
    )
    expected = by_sql(spark, tmp_path, fb, tr)
    assert Counter(map(tuple, corpus_join.corpus_join(fb, tr).collect())) == expected
    assert {r[2] for r in expected} == {*corpus_join.TIERS, "ambiguous_skipped", "below_threshold", "unmatched"}


def test_pruned_search_finds_the_best_two(monkeypatch):
    import numpy as np

    from assize.operators.postings import Postings

    rng = random.Random(3)
    asked, held = ([words(rng, rng.randint(1, 9)).split() for _ in range(200)] for _ in range(2))
    copies = np.array([rng.choice([1, 1, 1, 2]) for _ in held])
    index = lambda: Postings(["p"] * 200, asked, ["p"] * 200, held)
    outcome = lambda r: [(round(b, 9), round(b - s, 9) >= corpus_join.MARGIN and k) if b >= corpus_join.FUZZY else None for b, s, k in zip(*r)]
    whole = outcome(corpus_join._best_two(index(), copies))
    monkeypatch.setattr(corpus_join, "ALL_PAIRS", 0)
    assert outcome(corpus_join._best_two(index(), copies)) == whole
    assert any(x and x[1] is not False for x in whole)
