"""Grouped quality figures over feedback and review logs.

Every operator is one or two hash aggregations with partial aggregation on the
map side; groups are formed on nullable columns, so a missing repo stays apart
from one literally named so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import precision, price, ratio, wilson
from ..functions.records import VERDICTS, annotator, effective_micros, provenance_kind, usable_finding_id, verdict
from .running import running_totals

LEVELS = ("critical", "high", "medium", "low", "info")
TIERS = ("human", "post_fix", "external", "auto_calibrate", "unknown")


def typed(feedback: DataFrame) -> DataFrame:
    """Feedback with one spelling per enum: adds ``v, tier, agent, fid, us``."""
    who = annotator(F.col("provenance"))
    return feedback.withColumns({
        "v": verdict(F.col("verdict")),
        "tier": provenance_kind(F.col("provenance")),
        "agent": F.when(provenance_kind(F.col("provenance")) == "external", F.substr(who, F.lit(10))),
        "fid": usable_finding_id(F.col("finding_id")),
        "us": effective_micros(F.col("ts"), F.col("received_at")),
    })


def verdict_counts() -> list[Column]:
    return [F.count_if(F.col("v") == v).alias(f"n_{v}") for v in VERDICTS]


def _with_precision(df: DataFrame) -> DataFrame:
    return df.withColumn("precision", F.round(precision(F.col("n_tp"), F.col("n_partial"), F.col("n_fp")), 6))


def verdicts_by_model(feedback: DataFrame) -> DataFrame:
    """Verdict counts and precision per model; a missing model is ``unknown``."""
    rows = typed(feedback).groupBy(F.lower(F.coalesce("model", F.lit("unknown"))).alias("model"))
    return _with_precision(rows.agg(F.count("*").alias("n_rows"), *verdict_counts()))


def tier_rollup(feedback: DataFrame) -> DataFrame:
    """Counts per provenance tier and, for external rows, per agent: ``level`` is tier or agent."""
    rows = typed(feedback)
    fine = rows.groupBy("tier", F.coalesce("agent", F.lit("(none)")).alias("agent")).agg(F.count("*").alias("n_rows"), *verdict_counts())
    counts = [f"n_{v}" for v in VERDICTS]
    sets = fine.groupingSets([["tier"], ["tier", "agent"]], "tier", "agent").agg(F.grouping("agent").alias("whole"), *[F.sum(c).alias(c) for c in ("n_rows", *counts)])
    both = sets.filter("whole = 1 OR tier = 'external'").withColumns({"level": F.when(F.col("whole") == 1, "tier").otherwise("agent"), "agent": F.coalesce("agent", F.lit(""))})
    return _with_precision(both.select("level", "tier", "agent", "n_rows", *counts))


def fp_kind_utilization(feedback: DataFrame) -> DataFrame:
    """Share of false positives that carry a kind; null without any."""
    rows = typed(feedback).filter("v = 'fp'")
    tagged = F.count_if(F.col("fp_kind").isNotNull() & ~F.col("fp_kind").rlike(r"^\s*$"))
    return rows.agg(F.count("*").alias("n_fp"), tagged.alias("n_tagged")).withColumn("utilization", F.round(F.try_divide("n_tagged", "n_fp"), 6))


def linkage(feedback: DataFrame, reviews: DataFrame) -> DataFrame:
    """How many human and post-fix rows name a finding that some review reported."""
    known = reviews.select(F.explode("finding_ids").alias("known")).distinct()
    rows = typed(feedback).filter(F.col("tier").isin("human", "post_fix")).select("fid")
    joined = rows.join(known, rows.fid == known.known, "left")
    return joined.agg(F.count("*").alias("n_rows"), F.count("known").alias("n_linked")).withColumn("rate", F.round(ratio(F.col("n_linked"), F.col("n_rows")), 6))


def external_overlap(feedback: DataFrame) -> DataFrame:
    """External verdicts against the last human verdict of the same finding, per agent."""
    rows = typed(feedback)
    human = rows.filter("tier = 'human' AND fid IS NOT NULL AND v IS NOT NULL").groupBy("fid").agg(F.max_by("v", "seq").alias("human_v"))
    side = lambda c: F.when(F.col(c).isin("tp", "partial"), "pos").when(F.col(c) == "fp", "neg")
    joined = rows.filter("tier = 'external'").join(human, "fid", "left")
    return (
        joined.groupBy(F.coalesce("agent", F.lit("(none)")).alias("agent"))
        .agg(F.count("*").alias("n_external"), F.count("human_v").alias("n_overlap"), F.count_if(side("v") == side("human_v")).alias("n_agree"))
        .withColumn("agreement", F.round(ratio(F.col("n_agree"), F.col("n_overlap")), 6))
    )


def n_findings(prefix: str = "findings_by_severity") -> Column:
    return sum((F.coalesce(F.col(f"{prefix}.{s}"), F.lit(0)).cast("long") for s in LEVELS), F.lit(0))


def n_suppressed() -> Column:
    return F.coalesce(F.aggregate(F.map_values("suppressed_by_rule"), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))


def review_measures() -> list[Column]:
    has_lines = F.max((F.col("lines_added").isNotNull() | F.col("lines_removed").isNotNull()).cast("int"))
    lines = F.sum(F.coalesce("lines_added", F.lit(0)).cast("long") + F.coalesce("lines_removed", F.lit(0)).cast("long"))
    n = F.sum(n_findings())
    s = F.sum(n_suppressed())
    return [
        F.count("*").alias("n_reviews"),
        n.alias("n_findings"),
        F.round(ratio(n, F.sum(F.col("files_reviewed").cast("long"))), 6).alias("findings_per_file"),
        F.round(F.when((has_lines == 1) & (lines > 0), n * 1000.0 / lines), 6).alias("findings_per_kloc"),
        *[F.sum(F.coalesce(F.col(f"findings_by_severity.{x}"), F.lit(0)).cast("long")).alias(f"n_{x}") for x in LEVELS],
        s.alias("n_suppressed"),
        F.round(ratio(s, n + s), 6).alias("suppression_rate"),
        F.floor(F.sum("duration_ms") / F.count("duration_ms")).alias("avg_duration_ms"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.round(ratio(F.sum("tokens_cache_read"), F.sum("tokens_in")), 6).alias("cache_hit_rate"),
        (F.count("*") < 5).alias("low_sample"),
    ]


def slice_by(reviews: DataFrame, key: str, missing: str = "(no repo)") -> DataFrame:
    """Measures per value of ``key``; rows without one form their own group, marked by ``is_missing``."""
    grouped = reviews.groupBy(F.col(key).alias("k")).agg(*review_measures())
    return grouped.select(F.coalesce("k", F.lit(missing)).alias(key), F.col("k").isNull().alias("is_missing"), *grouped.columns[1:])


def slice_by_rule(reviews: DataFrame) -> DataFrame:
    """Measures per suppression rule; a review counts once for each rule that fired in it."""
    return reviews.select("*", F.explode(F.map_keys("suppressed_by_rule")).alias("rule")).groupBy("rule").agg(*review_measures())


def severity_histogram(reviews: DataFrame) -> DataFrame:
    levels = F.explode(F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(4 - i).alias("rank"), F.coalesce(F.col(f"findings_by_severity.{s}"), F.lit(0)).alias("n")) for i, s in enumerate(LEVELS)]))
    return reviews.select(levels.alias("x")).groupBy("x.severity", "x.rank").agg(F.sum(F.col("x.n").cast("long")).alias("n"), F.count_if(F.col("x.n") > 0).alias("n_reviews"))


def recent(reviews: DataFrame, feedback: DataFrame, days: int = 7) -> DataFrame:
    """Figures of the last ``days`` before the latest review, priced by the most used model (ties by name)."""
    span = days * 86_400_000_000
    end = reviews.agg(F.max(F.unix_micros("reviewed_at")).alias("end_us"))
    late = reviews.crossJoin(F.broadcast(end)).filter(F.unix_micros("reviewed_at") > F.col("end_us") - span)  # one row
    totals = late.agg(
        F.count("*").alias("n_reviews"), F.sum(n_findings()).alias("n_findings"), F.sum(n_suppressed()).alias("n_suppressed"),
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
    )
    modal = late.groupBy("model").agg(F.count("*").alias("uses")).agg(F.min_by("model", F.struct(-F.col("uses"), "model")).alias("model"))
    judged = feedback.crossJoin(F.broadcast(end)).filter((F.unix_micros("ts") > F.col("end_us") - span) & (F.unix_micros("ts") <= F.col("end_us"))).agg(F.count("*").alias("n_feedback"))
    p_in, p_out = price(F.coalesce("model", F.lit("")))
    return totals.crossJoin(modal).crossJoin(judged).select(
        "n_reviews", "n_findings", "n_suppressed", "tokens_in", "tokens_out", "model", "n_feedback",
        F.round(ratio(F.col("n_findings"), F.col("n_reviews")), 6).alias("findings_per_review"),
        F.round(ratio(F.col("n_suppressed"), F.col("n_findings") + F.col("n_suppressed")), 6).alias("suppression_rate"),
        F.round(ratio(F.col("tokens_in") + F.col("tokens_out"), F.col("n_findings")), 6).alias("tokens_per_finding"),
        F.round((F.col("tokens_in") * p_in + F.col("tokens_out") * p_out) / 1e6, 6).alias("cost"),
        F.round(F.least(F.lit(1.0), ratio(F.col("n_feedback"), F.col("n_findings"))), 6).alias("capture_rate"),
    )


def cost_by_model(reviews: DataFrame) -> DataFrame:
    p_in, p_out = price(F.coalesce("model", F.lit("")))
    rows = reviews.groupBy("model").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    return rows.withColumn("cost", F.round((F.col("tokens_in") * p_in + F.col("tokens_out") * p_out) / 1e6, 6))


def misleading_chunks(feedback: DataFrame, after: int = 3, floor: float = 0.2) -> DataFrame:
    """Confirmations per blamed chunk and the threshold that follows: raised step by step, infinite from ``after`` on."""
    listed = F.coalesce(
        F.from_json(F.get_json_object("verdict", "$.context_misleading.blamed_chunk_ids"), "array<string>"),
        F.from_json(F.get_json_object("verdict", "$.ContextMisleading.blamed"), "array<string>"),
    )
    counts = feedback.filter(F.col("verdict").startswith("{")).select(F.explode(listed).alias("chunk_id")).groupBy("chunk_id").agg(F.count("*").alias("n"))
    step = floor + F.col("n") * (1 - floor) / after
    return counts.withColumn("threshold", F.round(F.when(F.col("n") >= after, F.lit(None).cast("double")).otherwise(step), 6)).withColumn("blocked", F.col("n") >= after)


def wilson_by_tier(feedback: DataFrame) -> DataFrame:
    counts = typed(feedback).groupBy("tier").agg(*verdict_counts())
    k, n = F.col("n_tp") + F.col("n_partial"), F.col("n_tp") + F.col("n_partial") + F.col("n_fp")
    low, high = wilson(k, n)
    return counts.select("tier", k.alias("k"), n.alias("n"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def grounding_counts(findings: DataFrame) -> DataFrame:
    """Findings per grounding status and source; a missing status counts as not-checked."""
    return findings.groupBy("source_kind", F.coalesce("grounding_status", F.lit("not-checked")).alias("status")).agg(F.count("*").alias("n"))


def score_distribution(findings: DataFrame) -> DataFrame:
    """Nearest-rank p10 and p90 and the median of confidence per source kind; NaN and null left out."""
    rows = findings.filter(F.col("confidence").isNotNull() & ~F.isnan("confidence")).select("source_kind", F.col("confidence").cast("double").alias("x"))
    placed = running_totals(rows.groupBy("source_kind", "x").agg(F.count("*").alias("n")), "x", ("n",), by=("source_kind",))
    at = lambda rank: F.min(F.when(F.col("upto_n") >= rank, F.col("x")))  # noqa: E731  # the value with that rank
    middle = (F.col("all_n") + 1) / 2
    return placed.groupBy("source_kind").agg(
        F.first("all_n").alias("n"),
        F.round(at(F.ceil(F.col("all_n") / 10)), 6).alias("p10"),
        F.round((at(F.floor(middle)) + at(F.ceil(middle))) / 2, 6).alias("median"),
        F.round(at(F.ceil(F.col("all_n") * 9 / 10)), 6).alias("p90"),
    )


def by_count(rows: DataFrame, key: str) -> DataFrame:
    """``key, n, place``: the groups by falling count, then rising key; null comes last. Only groups are ordered."""
    groups = rows.groupBy(key).agg(F.count("*").alias("n"))
    return groups.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), F.asc_nulls_last(key))))


def exit_codes(findings: DataFrame) -> DataFrame:
    """Exit code per run: 2 with a finding of high or critical, 1 with a medium one, else 0."""
    top = F.max(F.when(F.col("severity").isin("high", "critical"), 2).when(F.col("severity") == "medium", 1).otherwise(0))
    return findings.groupBy("run_id").agg(F.count("*").alias("n"), top.alias("exit_code"))


def top_findings(findings: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` weightiest findings of each run: severity falling, then line, then id."""
    rank = F.when(F.col("severity") == "critical", 4).when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).when(F.col("severity") == "low", 1).otherwise(0)
    w = Window.partitionBy("run_id").orderBy(rank.desc(), "line_start", "id")
    return findings.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("run_id", "place", "id", "severity", "line_start")


def telemetry_fold(reviews: DataFrame) -> DataFrame:
    """Repeated records of a run folded into one: sums, or, last and first non-null values."""
    order = F.struct("received_at", "reviewed_at")
    return reviews.groupBy("run_id").agg(
        F.count("*").alias("n_records"),
        F.sum("tokens_in").alias("tokens_in"),
        F.bool_or("flags.deep").alias("deep"),
        F.max_by("model", order).alias("last_model"),
        F.min_by(F.col("repo"), F.when(F.col("repo").isNotNull(), order)).alias("first_repo"),
        F.size(F.array_distinct(F.flatten(F.collect_list("finding_ids")))).alias("n_finding_ids"),
    )
