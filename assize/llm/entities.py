"""Matching feedback rows and calibrator traces that speak of the same finding.

Rows are blocked by the code element named in the title. Equal descriptions
(element, title, path, category) count once per side. Each pair of
descriptions in a block has a vector of similarities: title, path, category; a
similarity of something missing is missing. Two Gaussian mixtures, for matched
and unmatched pairs, are fitted to these vectors without labels. Their
variances are regularised by the distance of their means, so a feature that is
constant on one side stays usable.

Transitivity is enforced in every step of expectation-maximisation: two
descriptions on one side that name different files are not the same finding,
so nothing on the other side may match both. Of such rivals the more probable
keeps its posterior, the others are scaled down by its complement.

Vectors are rounded to two places and counted, so a step reads only the
distinct vectors (at most 101 per feature) and the few pairs with rivals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

FEATURES = ("s_title", "s_path", "s_cat")
KAPPA = 0.05
FLOOR = 1e-3
#: Descriptions of one side of a block that meet the other side in one task.
PART = 1_000


def _element(title: Column) -> Column:
    """The qualified name in a title as written; '' if there is none."""
    scoped = F.regexp_extract(title, r"[A-Za-z_]\w*(?:::\w+)+", 0)
    return F.when(scoped != "", scoped).otherwise(F.regexp_extract(title, r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+", 0))


def _described(rows: DataFrame, key: str) -> DataFrame:
    element = F.col("raw")
    rest = F.regexp_replace(F.lower(F.replace(F.col("title"), element, F.lit(" "))), r"\((?:info|low|medium|high|critical)\)|\[[^\]]*\]|^\W*[a-z ]{1,12}:", " ")
    rest = F.trim(F.regexp_replace(rest, r"[^\p{L}\p{N}]+", " "))
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim("file_path")), r"\\", "/"), r"/{2,}", "/"), r"(?::\d+(?:-\d+)?)+$|^(?:\./)+", "")
    cat = F.regexp_replace(F.lower("finding_category"), r"[^a-z]", "")
    blank = lambda c: F.when(c != "", c)
    return (
        rows.select(key, F.col("finding_title").alias("title"), "file_path", "finding_category")
        .filter(F.col("title").isNotNull())
        .withColumn("raw", _element(F.col("title")))
        .select(
            key,
            F.when(element != "", F.lower(F.regexp_replace(element, r"[^A-Za-z0-9]", ""))).otherwise(F.concat(F.lit("~"), rest)).alias("elem"),
            rest.alias("rest"),
            (F.col("title").contains("…") | F.col("title").endswith("...")).alias("cut"),
            blank(path).alias("path"),
            blank(cat).alias("cat"),
        )
        .filter(F.col("elem") != "~")
        .withColumn("sig", F.xxhash64("elem", "rest", "cut", F.coalesce("path", F.lit("")), F.coalesce("cat", F.lit(""))))
    )


def _trigrams(text: Column) -> Column:
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - 2)), lambda i: F.substring(padded, i, F.lit(3))))


def _one_side(members: DataFrame) -> DataFrame:
    """One row per description, ready to be compared."""
    return (
        members.groupBy("sig")
        .agg(F.first("elem").alias("elem"), F.first("rest").alias("rest"), F.first("cut").alias("cut"), F.first("path").alias("path"), F.first("cat").alias("cat"))
        .select("sig", "elem", "cut", "cat", _trigrams(F.col("rest")).alias("tri"), F.reverse(F.split("path", "/")).alias("segs"))
    )


def _vectors(left: DataFrame, right: DataFrame) -> DataFrame:
    # A block with many descriptions on one side is met in parts, each by all of the other side.
    parts = left.groupBy("elem").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    left = left.join(parts, "elem").withColumn("part", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int")).drop("parts")
    right = right.join(parts, "elem").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    pairs = left.alias("f").join(right.alias("t"), ["elem", "part"])
    shared = F.size(F.array_intersect("f.tri", "t.tri"))
    nf, nt = F.size("f.tri"), F.size("t.tri")
    title = F.when(F.col("f.cut") | F.col("t.cut"), shared / F.least(nf, nt)).otherwise(shared / (nf + nt - shared))
    m = F.least(F.size("f.segs"), F.size("t.segs"))
    same = F.zip_with(F.slice("f.segs", 1, m), F.slice("t.segs", 1, m), lambda a, b: a == b)
    first_other = F.array_position(same, F.lit(False))
    path = F.when(F.col("f.segs").isNotNull() & F.col("t.segs").isNotNull(), F.when(first_other == 0, 1.0).otherwise((first_other - 1) / m))
    cat = F.when(F.col("f.cat").isNotNull() & F.col("t.cat").isNotNull(), (F.col("f.cat") == F.col("t.cat")).cast("double"))
    name = lambda s: F.when(F.col(f"{s}.segs").isNotNull(), F.xxhash64(F.get(f"{s}.segs", 0)))
    return pairs.select(
        F.col("f.sig").alias("f"),
        F.col("t.sig").alias("t"),
        name("f").alias("file_f"),
        name("t").alias("file_t"),
        F.round(title, 2).alias("s_title"),
        F.round(path, 2).alias("s_path"),
        F.round(cat, 2).alias("s_cat"),
    )


class Mixture:
    """Two Gaussians per feature and the share of matches; missing features don't count."""

    converged = False

    def __init__(self, share: float, matched: dict[str, float], unmatched: dict[str, float], variance: dict[str, float]):
        self.share, self.matched, self.unmatched, self.variance = share, matched, unmatched, variance

    def posterior(self) -> Column:
        odds = F.lit(math.log(self.share / (1 - self.share)))
        for name in FEATURES:
            m1, m0, v = self.matched[name], self.unmatched[name], self.variance[name]
            if m1 > m0:  # more similar is never less matched
                odds = odds + F.coalesce((F.col(name) - (m1 + m0) / 2) * ((m1 - m0) / v), F.lit(0.0))
        return 1 / (1 + F.exp(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), -odds))))


def _sums(rows: DataFrame) -> DataFrame:
    g, n = F.col("g"), F.col("n")
    out = [F.sum(n).alias("n"), F.sum(g * n).alias("g")]
    for k in FEATURES:
        x, here = F.col(k), F.when(F.col(k).isNotNull(), n).otherwise(0)
        out += [F.sum(here * g).alias(f"{k}_m0"), F.sum(here * (1 - g)).alias(f"{k}_u0")]
        out += [F.sum(g * n * x).alias(f"{k}_m1"), F.sum((1 - g) * n * x).alias(f"{k}_u1"), F.sum(g * n * x * x).alias(f"{k}_m2"), F.sum((1 - g) * n * x * x).alias(f"{k}_u2")]
    return rows.agg(*out)


def _mixture(r) -> Mixture:
    matched, unmatched, variance = {}, {}, {}
    for k in FEATURES:
        def moments(s: str, prior: float) -> tuple[float, float, float]:
            w = (r[f"{k}_{s}0"] or 0.0) + 1.0  # one pseudo-pair keeps an empty side defined
            mean = ((r[f"{k}_{s}1"] or 0.0) + prior) / w
            return w, mean, max(0.0, ((r[f"{k}_{s}2"] or 0.0) + prior * prior) / w - mean * mean)

        (w1, m1, v1), (w0, m0, v0) = moments("m", 0.95), moments("u", 0.05)
        matched[k], unmatched[k] = m1, m0
        variance[k] = (w1 * v1 + w0 * v0) / (w1 + w0) + KAPPA * (m1 - m0) ** 2 + FLOOR
    return Mixture(min(0.999, max(0.001, (r["g"] or 0.5) / max(r["n"] or 1, 1))), matched, unmatched, variance)


def _constrained(pairs: DataFrame) -> DataFrame:
    """Scale down the posterior ``g`` of pairs whose rival, of another file, is more probable."""
    g = F.col("g")
    for one, file in (("f", "file_t"), ("t", "file_f")):
        whole, own = Window.partitionBy(one), Window.partitionBy(one, file)
        pairs = pairs.withColumn("own", F.max("g").over(own)).withColumn("best", F.max(F.when(F.col(file).isNotNull(), F.col("g"))).over(whole))
        loses = F.col(file).isNotNull() & (F.col("own") < F.col("best"))
        pairs = pairs.withColumn("g", F.when(loses, g * (1 - F.col("best"))).otherwise(g)).drop("own", "best")
    return pairs


def fit(vectors: DataFrame, iterations: int = 50, tolerance: float = 1e-4) -> tuple[Mixture, DataFrame]:
    """The mixture, and the pairs that have rivals (``f, t``).

    Ends when no mean moves by more than ``tolerance``; the mixture's
    ``converged`` says whether that was reached.
    """
    crowded = []
    for one, file in (("f", "file_t"), ("t", "file_f")):
        many = vectors.filter(F.col(file).isNotNull()).groupBy(one).agg(F.min(file).alias("lo"), F.max(file).alias("hi")).filter("lo != hi").select(one)
        crowded.append(vectors.join(many, one, "left_semi"))
    rivals = materialize(crowded[0].unionByName(crowded[1]).distinct(), "rivals")
    calm = vectors.groupBy(*FEATURES).agg(F.count("*").alias("n")).unionByName(rivals.groupBy(*FEATURES).agg((-F.count("*")).alias("n")))
    grid = materialize(calm.groupBy(*FEATURES).agg(F.sum("n").alias("n")).filter("n > 0"), "grid")
    start = F.coalesce((F.coalesce("s_title", F.lit(0.5)) + 2 * F.coalesce("s_path", F.lit(0.5))) / 3, F.lit(0.5))
    model: Mixture | None = None
    for _ in range(iterations):
        g = model.posterior() if model else F.when(start > 0.5, 0.95).otherwise(0.05)
        contested = _constrained(rivals.withColumn("g", g)).select(*FEATURES, F.lit(1).cast("long").alias("n"), "g")
        new = _mixture(_sums(grid.withColumn("g", g).unionByName(contested)).first())
        moved = 1.0 if model is None else max(abs(new.matched[k] - model.matched[k]) + abs(new.unmatched[k] - model.unmatched[k]) for k in FEATURES)
        model = new
        model.converged = moved < tolerance
        if model.converged:
            break
    return model, rivals


def match(feedback: DataFrame, traces: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``seq, trace_no, confidence`` of every feedback row and trace that describe the same finding.

    Rows with a null title, or one without any letter or digit, match nothing. A title without a
    qualified name is its own block. A missing path or category neither speaks
    for nor against a match. Repeated rows have their pairs each; an empty side
    gives an empty result. Ids take no part, usable or not.
    """
    left = materialize(_described(feedback, "seq"), "feedback")
    right = materialize(_described(traces, "trace_no"), "traces")
    vectors = materialize(_vectors(_one_side(left), _one_side(right)), "vectors")
    model, rivals = fit(vectors)
    scored = vectors.withColumn("g", model.posterior())
    contested = _constrained(rivals.withColumn("g", model.posterior()))
    settled = scored.filter(F.col("g") >= threshold).join(rivals.select("f", "t"), ["f", "t"], "left_anti").select("f", "t", "g")
    accepted = settled.unionByName(contested.filter(F.col("g") >= threshold).select("f", "t", "g"))
    return (
        accepted.join(left.select(F.col("sig").alias("f"), "seq"), "f")
        .join(right.select(F.col("sig").alias("t"), "trace_no"), "t")
        .select("seq", "trace_no", F.round("g", 6).alias("confidence"))
    )


def found(feedback: DataFrame, traces: DataFrame) -> DataFrame:
    return match(feedback, traces).select("seq", "trace_no")
