"""Precision-recall curves and the thresholds learned from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .running import running_totals


def pr_curve(samples: DataFrame) -> DataFrame:
    """``threshold, precision, recall, n_tp, n_fp`` per distinct score, from ``score, positive``.

    Scores are grouped to 12 places; those that aren't finite are left out.
    Empty without a positive sample. The running counts go over distinct scores.
    """
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != F.lit(float("inf")))
    points = samples.filter(finite).groupBy(F.round("score", 12).alias("threshold")).agg(F.count_if("positive").alias("tp"), F.count_if(~F.col("positive")).alias("fp"))
    return (
        running_totals(materialize(points, "points"), "threshold", ("tp", "fp"), falling=True)
        .withColumnsRenamed({"upto_tp": "n_tp", "upto_fp": "n_fp"})
        .filter("all_tp > 0")
        .select("threshold", F.round(F.col("n_tp") / (F.col("n_tp") + F.col("n_fp")), 6).alias("precision"), F.round(F.col("n_tp") / F.col("all_tp"), 6).alias("recall"), "n_tp", "n_fp")
    )


def threshold_at_precision(curve: DataFrame, target: float) -> DataFrame:
    """The lowest threshold that reaches the target; null if none does."""
    return curve.agg(F.round(F.min(F.when(F.col("precision") >= target, F.col("threshold"))), 6).alias("threshold"))


def f1_threshold(curve: DataFrame) -> DataFrame:
    """Threshold of the highest F1; the lowest among equals."""
    f1 = F.round(F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)), 6)
    best = curve.withColumn("f1", f1).agg(F.max_by(F.struct("threshold", "f1", "precision", "recall"), F.struct("f1", -F.col("threshold"))).alias("b"))
    return best.filter("b IS NOT NULL").select(F.round("b.threshold", 6).alias("threshold"), "b.f1", "b.precision", "b.recall")


def thresholds(samples: DataFrame, suppress_target: float = 0.95, boost_target: float = 0.85, least: int = 20, least_side: int = 10) -> DataFrame:
    """Learned thresholds: one row ``n, n_positive, suppress, boost``; null where none could be learned.

    Needs ``least`` samples, and ``least_side`` negatives to suppress or
    positives to boost. The suppress side looks at 1 - score of negatives. If
    the two overlap, the side with fewer samples is dropped, on a tie the boost.
    """
    kept = materialize(samples.filter(F.col("score").isNotNull() & ~F.isnan("score")).select("score", "positive"), "samples")
    counts = kept.agg(F.count("*").alias("n"), F.count_if("positive").alias("n_positive"))
    boost = threshold_at_precision(pr_curve(kept), boost_target).select(F.col("threshold").alias("up"))
    mirrored = kept.select((1 - F.col("score")).alias("score"), (~F.col("positive")).alias("positive"))
    down = threshold_at_precision(pr_curve(mirrored), suppress_target).select((1 - F.col("threshold")).alias("down"))
    n_negative = F.col("n") - F.col("n_positive")
    one = counts.crossJoin(boost).crossJoin(down).select(  # one row each
        "n", "n_positive",
        F.when((F.col("n") >= least) & (F.col("n_positive") >= least_side), F.col("up")).alias("up"),
        F.when((F.col("n") >= least) & (n_negative >= least_side), F.col("down")).alias("down"),
    )
    overlap = F.coalesce(F.col("down") >= F.col("up"), F.lit(False))
    return one.select(
        "n", "n_positive",
        F.round(F.when(~(overlap & (n_negative < F.col("n_positive"))), F.col("down")), 6).alias("suppress"),
        F.round(F.when(~(overlap & (n_negative >= F.col("n_positive"))), F.col("up")), 6).alias("boost"),
    )
