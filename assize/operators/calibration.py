"""Precedent voting: weights, capped votes, decisions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import age_days
from ..functions.text import any_of, category, complexity_metric, edge_tokens, jaccard, lower_tokens, metric_compatible, severity_name, severity_rank, word_boundary_regex
from ..storage import materialize
from .kpi import typed
from .postings import Postings

#: Weight of a verdict by provenance tier (fixed values).
TIER_WEIGHT = {"post_fix": 1.5, "human": 1.0, "external": 0.7, "auto_calibrate": 0.5}
UNKNOWN_WEIGHT = 0.3
#: Caps of the summed weight of a tier (fixed values).
CAPS = {"auto_calibrate": 1.0, "external": 1.4}
#: Decay constants in days (fixed values).
TAU, TAU_TRUST = 120.0, 40.0

# -- fixed values: phrases that allow a raise to critical, categories and phrases that allow one to high --
CRITICAL_PHRASES = (
    "rce", "remote code execution", "code execution", "arbitrary code", "data corruption", "auth bypass",
    "authentication bypass", "credential leak", "credential exfil", "credentials leaked", "leaks credentials",
    "leaks the password", "leaks all passwords", "secret exfil", "exfiltrates secrets", "guaranteed crash",
    "guaranteed production crash", "durable data loss", "permanent data loss",
)
HIGH_CATEGORIES = ("security", "correctness", "logic", "concurrency", "reliability", "robustness", "error-handling", "error handling", "validation")
HIGH_PHRASES = (
    "hides a bug", "hidden bug", "race condition", "resource leak", "memory leak", "exploit", "vulnerability",
    "injection", "data race", "use-after-free", "null deref", "null dereference", "buffer overflow", "unsafe",
)


def weight(tier: Column, v: Column, kind: Column, ts: Column, now_us: int) -> Column:
    """Provenance weight times exponential decay by absolute age in whole days."""
    base = F.when(tier == "post_fix", TIER_WEIGHT["post_fix"])
    for name in ("human", "external", "auto_calibrate"):
        base = base.when(tier == name, TIER_WEIGHT[name])
    trust = (v == "fp") & F.coalesce(F.lower(kind).contains("trust"), F.lit(False))
    return base.otherwise(UNKNOWN_WEIGHT) * F.exp(-F.abs(age_days(now_us, ts)) / F.when(trust, TAU_TRUST).otherwise(TAU))


def precedents(feedback: DataFrame, now_us: int, use_auto: bool = True) -> DataFrame:
    """Feedback as precedents: ``seq, title, cat, raw_category, v, tier, w``; out-of-scope false positives are left out."""
    scope = F.regexp_replace(F.lower("fp_kind"), "[^a-z]", "")
    rows = typed(feedback).filter(F.col("v").isNotNull() & F.col("finding_title").isNotNull() & F.col("ts").isNotNull() & ~((F.col("v") == "fp") & F.coalesce(scope.contains("outofscope"), F.lit(False))))
    if not use_auto:
        rows = rows.filter("tier != 'auto_calibrate'")
    return rows.select(
        "seq", F.col("finding_title").alias("title"), category(F.col("finding_category")).alias("cat"), F.col("finding_category").alias("raw_category"), "v", "tier",
        weight(F.col("tier"), F.col("v"), F.col("fp_kind"), F.col("ts"), now_us).alias("w"),
    )


def capped(w: Column, tier: Column, v: Column, of: tuple[str, ...]) -> Column:
    """Sum of the weights of verdicts ``of``, with the automatic and the external part capped."""
    mine = v.isin(*of)
    part = lambda cond: F.coalesce(F.sum(F.when(mine & cond, w)), F.lit(0.0))
    auto, external = tier == "auto_calibrate", tier == "external"
    return F.least(part(auto), F.lit(CAPS["auto_calibrate"])) + F.least(part(external), F.lit(CAPS["external"])) + part(~auto & ~external)


def votes_by_title(feedback: DataFrame, now_us: int) -> DataFrame:
    """Capped votes of all precedents of one title."""
    rows = precedents(feedback, now_us)
    return rows.groupBy("title").agg(
        F.count("*").alias("n"), *[F.round(capped(F.col("w"), F.col("tier"), F.col("v"), of), 6).alias(name) for name, of in (("tp", ("tp", "partial")), ("fp", ("fp",)), ("wontfix", ("wontfix",)))]
    )


def rubric_allows(rank: Column, title: Column, description: Column, cat: Column) -> Column:
    """Whether the text supports a severity of ``rank``; below high always."""
    hay = F.lower(F.concat_ws(" ", title, description))
    says = lambda phrases: any_of([hay.rlike(word_boundary_regex(p)) for p in phrases])
    head = F.split(F.lower(cat), "[/, ]").getItem(0)
    free = F.lower(cat).isin(*HIGH_CATEGORIES) | head.isin(*HIGH_CATEGORIES)
    return F.when(rank == 4, says(CRITICAL_PHRASES)).when(rank == 3, free | says(HIGH_PHRASES)).otherwise(F.lit(True))


def _similar_titles(mine: DataFrame, theirs: DataFrame, least: float) -> DataFrame:
    """``a, b, j`` of texts (``text, ws``) whose word sets have a similarity of at least ``least``.

    Such texts share a word among the rarest of either side; pairs meet by these words only.
    """
    mine, theirs = materialize(mine, "mine"), materialize(theirs, "theirs")
    # Sizes of similar sets differ at most by the factor 1 / least.
    longest = theirs.agg(F.max(F.size("ws")).alias("longest"))
    mine = mine.crossJoin(F.broadcast(longest)).filter(F.size("ws") * least <= F.col("longest")).drop("longest")  # one row
    df = mine.select(F.explode("ws").alias("w")).unionByName(theirs.select(F.explode("ws").alias("w"))).groupBy("w").agg(F.count("*").alias("df"))

    def prefix(side: DataFrame, name: str) -> DataFrame:
        place = Window.partitionBy("text").orderBy("df", "w")
        rows = side.select("text", F.size("ws").alias("size"), F.explode("ws").alias("w")).join(df, "w").withColumn("rn", F.row_number().over(place))
        return rows.filter(F.col("rn") <= F.col("size") - F.ceil(F.lit(least) * F.col("size")) + 1).select("w", F.col("text").alias(name), F.col("size").alias(f"n_{name}"))

    return (
        prefix(mine, "a")
        .join(prefix(theirs, "b"), "w")
        .filter((F.col("n_a") * least <= F.col("n_b")) & (F.col("n_b") * least <= F.col("n_a")))
        .select("a", "b")
        .distinct()
        .join(mine.select(F.col("text").alias("a"), F.col("ws").alias("wa")), "a")
        .join(theirs.select(F.col("text").alias("b"), F.col("ws").alias("wb")), "b")
        .select("a", "b", jaccard(F.col("wa"), F.col("wb")).alias("j"))
        .filter(F.col("j") >= least - 1e-9)
    )


def similar_precedents(findings: DataFrame, precedent: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``id, seq, v, tier, w, similarity`` of every finding and precedent with (3 title + 2 category) / 5 of at least ``threshold``."""
    least = (5 * threshold - 2) / 3
    if least <= 0:
        raise ValueError("a threshold of 0.4 or less would make every pair of a category similar")
    asked = materialize(findings.select("id", F.col("title"), category(F.col("category")).alias("cat")).filter("title IS NOT NULL"), "asked")
    words = lambda df: df.select(F.col("title").alias("text")).distinct().withColumn("ws", edge_tokens(F.col("text")))
    titles = _similar_titles(words(asked), words(precedent), least).filter(metric_compatible(F.col("a"), F.col("b")))
    score = (3 * F.col("j") + F.when(F.col("fc") == F.col("pc"), 2.0).otherwise(0.0)) / 5
    return (
        titles.join(asked.select("id", F.col("title").alias("a"), F.col("cat").alias("fc")), "a")
        .join(precedent.select("seq", F.col("title").alias("b"), F.when(F.coalesce("raw_category", F.lit("")) != "", F.col("cat")).alias("pc"), "v", "tier", "w"), "b")
        .withColumn("similarity", score)
        .filter(F.col("similarity") >= threshold - 1e-9)
        .select("id", "seq", "v", "tier", "w", F.round("similarity", 6).alias("similarity"))
    )


def ranked_precedents(findings: DataFrame, precedent: DataFrame, threshold: float = 0.72, k: int = 50) -> DataFrame:
    """The index variant: up to ``k`` precedents of 0.6 text + 0.4 category, weights scaled by similarity.

    The text asked is title, description and first evidence; the category of a
    precedent counts as it was written.
    """
    least = (threshold - 0.4) / 0.6
    if least <= 0:
        raise ValueError("a threshold of 0.4 or less would make every pair of a category similar")
    text = F.concat_ws(" ", "title", "description", F.get("evidence", 0))
    asked = materialize(findings.filter("title IS NOT NULL").select("id", "title", text.alias("text"), category(F.col("category")).alias("cat")), "asked")
    words = lambda df, c: df.select(F.col(c).alias("text")).distinct().withColumn("ws", lower_tokens(F.col("text")))
    pairs = (
        _similar_titles(words(asked, "text"), words(precedent, "title"), least)
        .join(asked.select("id", F.col("text").alias("a"), F.col("title").alias("t"), F.col("cat").alias("fc")), "a")
        .filter(metric_compatible(F.col("t"), F.col("b")))
        .join(precedent.select("seq", F.col("title").alias("b"), "raw_category", "v", "tier", "w"), "b")
        .withColumn("similarity", 0.6 * F.col("j") + F.when(F.col("fc") == F.col("raw_category"), 0.4).otherwise(0.0))
    )
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "seq")
    top = pairs.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= k) & (F.col("similarity") >= threshold - 1e-9))
    return top.select("id", "seq", "v", "tier", (F.col("w") * F.col("similarity")).alias("w"), F.round("similarity", 6).alias("similarity"))


PARTS = [(who, what) for who in ("auto", "external", "other") for what in ("tp", "fp", "wontfix")]
#: Distinct titles of either side that one task of the block join holds.
ASKED_BLOCK, HELD_BLOCK = 4_000, 100_000


def _score_block(threshold: float):
    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        names = [f"{who}_{what}" for who, what in PARTS]
        postings: dict[str, list[int]] = {}
        for n, ws in enumerate(held["ws"]):
            for w in ws:
                postings.setdefault(w, []).append(n)
        lists = {w: np.array(v, np.int64) for w, v in postings.items()}
        sizes, cats, metrics = held["ws"].map(len).to_numpy(np.float64), held["cat"].fillna("").to_numpy(str), held["metric"].to_numpy()
        weights, counts = held[names].to_numpy(np.float64), held["n"].to_numpy()
        out = []
        for key, ws, cat, metric in zip(asked["key"], asked["ws"], asked["cat"], asked["metric"]):
            near = [lists[w] for w in ws if w in lists]
            if not near:
                continue
            shared = np.bincount(np.concatenate(near), minlength=len(held))
            at = np.flatnonzero(shared)
            score = (3 * shared[at] / (sizes[at] + len(ws) - shared[at]) + 2 * (cats[at] == cat)) / 5
            fits = (metrics[at] == -1) if metric == -1 else (metrics[at] != -1) & (np.abs(metrics[at] - metric) <= 2)
            at = at[(score >= threshold - 1e-9) & fits]
            if len(at):
                out.append((key, int(counts[at].sum()), *weights[at].sum(0)))
        return pd.DataFrame(out, columns=["key", "n", *names])

    return run


def vote_sums(findings: DataFrame, precedent: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``id, n_precedents, tp, fp, wontfix``: capped votes of all precedents similar to each finding.

    Titles are made of few templates, so a finding is similar to a large part
    of the precedents of its category, and pairs must not be written out.
    Precedents are first summed by title, category, tier and verdict. Then
    blocks of distinct titles of both sides meet, each pair of blocks in one
    task, which keeps only sums; those of a finding are added over blocks and
    capped at last.
    """
    if (5 * threshold - 2) / 3 <= 0:
        raise ValueError("a threshold of 0.4 or less would make every pair of a category similar")
    metric = F.coalesce(complexity_metric(F.col("title")), F.lit(-1)).alias("metric")
    rows = findings.filter("title IS NOT NULL").select("id", "title", category(F.col("category")).alias("cat"))
    rows = materialize(rows.withColumn("key", F.xxhash64("title", "cat")), "asked")
    asked = rows.groupBy("key").agg(F.first("title").alias("title"), F.first("cat").alias("cat")).select("key", "cat", edge_tokens(F.col("title")).alias("ws"), metric)
    of = {"tp": F.col("v").isin("tp", "partial"), "fp": F.col("v") == "fp", "wontfix": F.col("v") == "wontfix"}
    who = {"auto": F.col("tier") == "auto_calibrate", "external": F.col("tier") == "external", "other": ~F.col("tier").isin("auto_calibrate", "external")}
    sums = [F.coalesce(F.sum(F.when(who[a] & of[b], F.col("w"))), F.lit(0.0)).alias(f"{a}_{b}") for a, b in PARTS]
    known = precedent.withColumn("pc", F.when(F.coalesce("raw_category", F.lit("")) != "", F.col("cat")))
    held = known.groupBy("title", "pc").agg(F.count("*").alias("n"), *sums)
    held = held.select(edge_tokens(F.col("title")).alias("ws"), F.col("pc").alias("cat"), metric, "n", *[f"{a}_{b}" for a, b in PARTS], F.xxhash64("title", "pc").alias("h"))
    asked, held = materialize(asked, "asked"), materialize(held, "held")
    n_asked, n_held = max(1, -(-asked.count() // ASKED_BLOCK)), max(1, -(-held.count() // HELD_BLOCK))
    left = asked.withColumn("i", F.pmod("key", F.lit(n_asked))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_held - 1))))
    right = held.withColumn("j", F.pmod("h", F.lit(n_held)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_asked - 1).cast("long")))).drop("h")
    schema = "key bigint, n bigint, " + ", ".join(f"{a}_{b} double" for a, b in PARTS)
    blocks = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(_score_block(threshold), schema)
    total = blocks.groupBy("key").agg(F.sum("n").alias("n_precedents"), *[F.sum(f"{a}_{b}").alias(f"{a}_{b}") for a, b in PARTS])
    votes = [(F.least(F.col(f"auto_{b}"), F.lit(CAPS["auto_calibrate"])) + F.least(F.col(f"external_{b}"), F.lit(CAPS["external"])) + F.col(f"other_{b}")).alias(b) for b in ("tp", "fp", "wontfix")]
    return rows.select("id", "key").join(total.select("key", "n_precedents", *votes), "key").drop("key")


def votes_of(matched: DataFrame) -> DataFrame:
    """Capped votes per finding of listed precedents (id, v, tier, w)."""
    return matched.groupBy("id").agg(
        F.count("*").alias("n_precedents"),
        *[capped(F.col("w"), F.col("tier"), F.col("v"), of).alias(name) for name, of in (("tp", ("tp", "partial")), ("fp", ("fp",)), ("wontfix", ("wontfix",)))],
    )


def decide(findings: DataFrame, vote: DataFrame, suppress_below: float | None = None, boost_from: float | None = None) -> DataFrame:
    """One row per finding: weights, action, severities, reason, and whether it is suppressed.

    ``vote`` has ``id, n_precedents, tp, fp, wontfix``. Given thresholds
    replace the fixed ratios. A demotion comes before a boost.
    """
    rows = findings.select("id", "title", "description", "severity", category(F.col("category")).alias("cat")).join(vote, "id", "left").na.fill(0.0, ["tp", "fp", "wontfix"]).na.fill(0, ["n_precedents"])
    tp, fp, rank = F.col("tp"), F.col("fp"), severity_rank(F.col("severity"))
    score = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.5))
    gone = ((score < suppress_below) & (fp > 0)) if suppress_below is not None else ((fp >= 1.5) & (fp > 2 * tp))
    demote = ((fp >= 1) & (fp > 2 * tp)) | ((fp >= 0.5) & (tp < 0.1))
    boost = ((score >= boost_from) & (tp > 0)) if boost_from is not None else ((tp >= 1.5) & (tp > 2 * fp))
    confirm = tp > 1.5 * fp
    some = F.col("n_precedents") > 0
    rows = rows.withColumns({"gone": some & gone, "demoted": some & ~gone & demote})
    start = F.when(F.col("demoted"), 0).otherwise(rank)
    target = F.least(start + 1, F.lit(4))
    rows = rows.withColumn("wants", some & ~F.col("gone") & boost).withColumn("allowed", rubric_allows(target, F.col("title"), F.col("description"), F.col("cat")))
    raised = F.col("wants") & F.col("allowed")
    out_rank = F.when(F.col("gone"), rank).when(raised, target).otherwise(start)
    action = F.when(F.col("gone"), "disputed").when(F.col("wants"), "confirmed").when(F.col("demoted"), "disputed").when(some & confirm, "confirmed")
    reason = (
        F.when(~some, "no_match").when(F.col("gone"), "disputed").when(raised, "boosted").when(F.col("wants"), "boost_blocked_by_gate").when(F.col("demoted"), "disputed").otherwise("boost_weight_too_low")
    )
    return rows.select(
        "id", F.col("severity").alias("input_severity"), severity_name(out_rank).alias("output_severity"), action.alias("action"), reason.alias("reason"), F.col("gone").alias("suppressed"),
        F.round("tp", 4).alias("tp"), F.round("fp", 4).alias("fp"), F.round("wontfix", 4).alias("wontfix"), F.col("n_precedents").cast("long").alias("n_precedents"),
    )


def calibrate(findings: DataFrame, feedback: DataFrame, now_us: int, threshold: float | None = None, suppress_below: float | None = None, boost_from: float | None = None, index: bool = False) -> DataFrame:
    """Decisions for all findings; ``index`` takes the ranked variant of precedents."""
    known = materialize(precedents(feedback, now_us), "precedents")
    vote = votes_of(ranked_precedents(findings, known, threshold or 0.72)) if index else vote_sums(findings, known, threshold or 0.5)
    return decide(findings, vote, suppress_below, boost_from)


#: Weights of a trace that its fingerprint writes with four places (fixed values).
WEIGHTS = ("tp_weight", "fp_weight", "wontfix_weight", "full_suppress_weight", "soft_fp_weight")


def fingerprints(traces: DataFrame, *keys: str) -> DataFrame:
    """What of a trace must stay equal between versions: names, severities, action, rounded weights and the number of precedents."""
    return traces.select(
        *keys, "finding_title", "finding_category", "input_severity", "output_severity", "calibrator_action", "severity_change_reason",
        *[F.format_string("%.4f", w).alias(w) for w in WEIGHTS], F.coalesce(F.size("matched_precedents"), F.lit(0)).alias("n_precedents"),
    )


def few_shot(matched: DataFrame) -> DataFrame:
    """Up to three examples per finding: at most two true ones, then at most two false ones, then more true ones; by similarity, then seq."""
    known = matched.filter("similarity >= 0.6 AND tier IN ('human', 'post_fix') AND v IN ('tp', 'fp')")
    own = Window.partitionBy("id", "v").orderBy(F.desc("similarity"), "seq")
    placed = known.withColumn("n", F.row_number().over(own)).filter("v = 'tp' OR n <= 2")
    turn = F.when((F.col("v") == "tp") & (F.col("n") <= 2), 0).when(F.col("v") == "fp", 1).otherwise(2)
    order = Window.partitionBy("id").orderBy(turn, F.desc("similarity"), "seq")
    return placed.withColumn("place", F.row_number().over(order)).filter("place <= 3").select("id", "place", "seq", "v", "similarity")


#: Most true and false examples of a finding, and the least similarity of one (fixed values).
EXAMPLES, EXAMPLE_FROM = {"tp": 3, "fp": 2}, 0.6
#: Findings and precedents of one category that one task compares: at least so many, and precedents at most.
FEW_ASKED, FEW_HELD = 8_000, 100_000
#: Precedents scored at once at first.
STEP = 512


def _scored(j):
    return (3 * j + 2.0) / 5


def _nearest(index: Postings, a: int, k: int, metric: int, metrics: np.ndarray, seqs: np.ndarray, sub: tuple, met: np.ndarray) -> list[tuple[float, int, float]]:
    """The best ``k`` held titles of one asked: (rounded similarity, seq, similarity), ties by the smaller seq.

    Held titles are in the order of size and seq. Those that share none of the
    words so far share at most the others; of such a size and word they are
    scored by seq until none that follows can be among the best.
    """
    heads, sizes, begins, ends = sub
    words, n = index.words_of(a), int(index.sizes_a[a])
    index.mark[words] = 1
    best: list[tuple[float, int, float]] = []
    for done, word in enumerate(words):
        rest = len(words) - done
        if round(_scored(rest / n), 6) < (-best[-1][0] if len(best) == k else EXAMPLE_FROM):
            break
        for at in range(heads[word], heads[word + 1]):
            size = sizes[at]
            most = round(_scored(min(rest, size) / (n + size - min(rest, size))), 6)
            begin, end, step = begins[at], ends[at], STEP
            while begin < end:
                if most < EXAMPLE_FROM or (len(best) == k and (-most, seqs[index.posted[begin]]) > best[-1][:2]):
                    break
                held = index.posted[begin : min(end, begin + step)]
                begin, step = begin + step, step * 4
                held = held[met[held] != a]
                if not len(held):
                    continue
                met[held] = a
                raw = _scored(index.similar(a, held))
                fits = (metrics[held] == -1) if metric == -1 else (metrics[held] != -1) & (np.abs(metrics[held] - metric) <= 2)
                least = -best[-1][0] if len(best) == k else EXAMPLE_FROM
                good = np.flatnonzero(fits & (np.round(raw, 6) >= least))
                good = good[np.lexsort((seqs[held[good]], -np.round(raw[good], 6)))[:k]]
                best = sorted(best + [(-float(np.round(raw[g], 6)), int(seqs[held[g]]), float(raw[g])) for g in good])[:k]
    index.mark[words] = 0
    return best


def _examples(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    out: list[tuple] = []
    titles = asked.drop_duplicates("title").reset_index(drop=True)
    ids = asked.groupby("title")["id"].agg(list).to_dict()
    for v, k in EXAMPLES.items():
        own = held[held["v"] == v]
        own = own.assign(size=own["ws"].map(len)).sort_values(["size", "seq"]).reset_index(drop=True)
        if own.empty or titles.empty:
            continue
        index = Postings(np.zeros(len(titles), int), titles["ws"], np.zeros(len(own), int), own["ws"])
        metrics, seqs = own["metric"].to_numpy(), own["seq"].to_numpy()
        # Where in the postings a word and a size begin and end.
        word, size = np.repeat(np.arange(index.n), index.count), own["size"].to_numpy()[index.posted]
        new = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (size[1:] != size[:-1]))))
        sub = (np.searchsorted(word[new], np.arange(index.n + 1)).tolist(), size[new].tolist(), new.tolist(), [*new[1:].tolist(), len(word)])
        met = np.full(len(own), -1)
        for a, (title, metric) in enumerate(zip(titles["title"], titles["metric"])):
            best = _nearest(index, a, k, metric, metrics, seqs, sub, met)
            out += [(i, seq, v, raw) for i in ids[title] for _, seq, raw in best]
    return pd.DataFrame(out, columns=["id", "seq", "v", "raw"])


def few_shot_examples(findings: DataFrame, precedent: DataFrame) -> DataFrame:
    """``few_shot`` of the precedents similar to each finding, without listing all of these.

    A similarity of 0.6 takes the same category, or else the same words. Within
    a category blocks of titles meet in tasks that keep the examples a finding
    can have. Of equal words, the first rows of each category and verdict are met.
    """
    metric = F.coalesce(complexity_metric(F.col("title")), F.lit(-1)).alias("metric")
    asked = findings.filter("title IS NOT NULL").select("id", "title", category(F.col("category")).alias("cat"), edge_tokens(F.col("title")).alias("ws"), metric)
    known = precedent.filter("tier IN ('human', 'post_fix') AND v IN ('tp', 'fp')").select("seq", "title", F.when(F.coalesce("raw_category", F.lit("")) != "", F.col("cat")).alias("cat"), "v", edge_tokens(F.col("title")).alias("ws"), metric)
    words = F.array_join(F.array_sort("ws"), " ").alias("words")
    asked, known = (materialize(df.filter(F.size("ws") > 0).withColumn("words", words), name) for df, name in ((asked, "asked"), (known, "known")))
    # Rows of the same words, metric, category and verdict differ in seq only.
    of = Window.partitionBy("words", "metric", "cat", "v").orderBy("seq")
    held = materialize(known.withColumn("n", F.row_number().over(of)).filter(F.col("n") <= max(EXAMPLES.values())).drop("n", "title"), "held")

    many = max(FEW_ASKED, asked.count() // 100)
    count = lambda df: {r["cat"]: r["n"] for r in df.filter("cat IS NOT NULL").groupBy("cat").agg(F.count("*").alias("n")).collect()}  # noqa: E731 - ten categories
    n_asked, n_held = count(asked), count(held)

    def blocks(counts: dict[str, int], most: int) -> Column:
        out = F.lit(1)
        for cat, n in counts.items():
            out = F.when(F.col("cat") == cat, -(-n // most)).otherwise(out)
        return out.cast("int")

    place = lambda n: F.pmod(F.xxhash64("words"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = asked.filter(F.col("cat").isin(list(n_held))).withColumn("i", place(blocks(n_asked, many))).withColumn("j", each(blocks(n_held, FEW_HELD))).select("cat", "i", "j", "id", "title", "ws", "metric")
    right = held.filter(F.col("cat").isin(list(n_asked))).withColumn("j", place(blocks(n_held, FEW_HELD))).withColumn("i", each(blocks(n_asked, many))).select("cat", "i", "j", "seq", "v", "ws", "metric")
    types = dict(asked.dtypes) | {"seq": dict(held.dtypes)["seq"]}
    near = left.groupBy("cat", "i", "j").cogroup(right.groupBy("cat", "i", "j")).applyInPandas(_examples, f"id {types['id']}, seq {types['seq']}, v string, raw double")

    other = held.select("words", "seq", "v", F.col("cat").alias("pc"), F.col("metric").alias("pm"))
    fits = F.when(F.col("metric") == -1, F.col("pm") == -1).otherwise((F.col("pm") != -1) & (F.abs(F.col("pm") - F.col("metric")) <= 2))
    same = asked.select("id", "cat", "metric", "words").join(other, "words").filter(fits & ~F.col("pc").eqNullSafe(F.col("cat"))).select("id", "seq", "v", F.lit(EXAMPLE_FROM).alias("raw"))
    return few_shot(near.unionByName(same).select("id", "seq", "v", F.lit("human").alias("tier"), F.round("raw", 6).alias("similarity")))
