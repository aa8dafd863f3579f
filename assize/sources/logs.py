"""Append-only JSON logs: typed readers, quarantine, writers.

A schema is stated, never inferred. Missing fields take the defaults of the
log; unknown ones are ignored. Enum fields stay text, in whichever encoding
they were written, and are decoded by ``functions.records``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import is_blank, verdict

MAX_LINE = 1 << 20
MOST_ERRORS = 1_000
CORRUPT = "_corrupt"


#: Fields of each log.
SCHEMAS = {
    "feedback": "file_path string, finding_title string, finding_category string, verdict string, reason string, model string, timestamp timestamp, provenance string, fp_kind string, finding_id string, rule_id string",
    "inbox": "file_path string, finding_title string, finding_category string, verdict string, reason string, agent string, agent_model string, confidence double",
    "reviews": (
        "run_id string, timestamp timestamp, tool_version string, repo string, invoked_from string, model string, files_reviewed int, lines_added int, lines_removed int, "
        "findings_by_severity struct<critical:int,high:int,medium:int,low:int,info:int>, suppressed_by_rule map<string,int>, tokens_in bigint, tokens_out bigint, "
        "tokens_cache_read bigint, duration_ms bigint, flags struct<deep:boolean,parallel_n:int,ensemble:boolean>, mode string, finding_ids array<string>"
    ),
    "telemetry": "ts timestamp, files array<string>, findings map<string,bigint>, model string, tokens_in bigint, tokens_out bigint, duration_ms bigint, suppressed bigint",
    "traces": (
        "finding_title string, finding_category string, tp_weight double, fp_weight double, wontfix_weight double, full_suppress_weight double, soft_fp_weight double, "
        "matched_precedents array<struct<finding_title:string,verdict:string,similarity:double,weight:double,provenance:string,file_path:string>>, action string, input_severity string, "
        "output_severity string, severity_change_reason string, file_path string, provenance string"
    ),
    "chunks": (
        "id string, source string, kind string, subtype string, qualified_name string, signature string, content string, source_path string, line_start int, line_end int, "
        "commit_sha string, indexed_at timestamp, source_version string, language string, is_exported boolean, neighboring_symbols array<string>, extractor string, confidence float, source_uri string"
    ),
}

#: Values that stand in for missing fields (fixed values).
DEFAULTS = {
    "feedback": {"provenance": "unknown"},
    "inbox": {"finding_category": "unknown"},
    "reviews": {"files_reviewed": 0, "tokens_in": 0, "tokens_out": 0, "tokens_cache_read": 0, "duration_ms": 0},
    "telemetry": {"tokens_in": 0, "tokens_out": 0, "duration_ms": 0, "suppressed": 0},
    "traces": {"tp_weight": 0.0, "fp_weight": 0.0, "wontfix_weight": 0.0, "full_suppress_weight": 0.0, "soft_fp_weight": 0.0},
    "chunks": {},
}


def read(spark: SparkSession, log: str, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """A log as its table; in mode PERMISSIVE with the text of unreadable lines in ``_corrupt``.

    PERMISSIVE keeps them apart, DROPMALFORMED skips them, FAILFAST stops at the first.
    """
    schema = SCHEMAS[log] + (f", {CORRUPT} string" if mode == "PERMISSIVE" else "")
    df = spark.read.schema(schema).option("mode", mode).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return df.na.fill(DEFAULTS[log])


def split_corrupt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable rows, and the texts of the others."""
    return rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), rows.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def read_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col(CORRUPT).isNull()).alias("kept"), F.count_if(F.col(CORRUPT).isNotNull()).alias("skipped"))


def read_bounded(spark: SparkSession, log: str, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of lines of at most 1 MiB, and a report of all others: ``file, head, problem``, ``head`` being their first 80 characters."""
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file")).filter(~is_blank(F.col("value")))
    parsed = F.from_json("value", f"{SCHEMAS[log]}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})
    problem = F.when(F.octet_length("value") > MAX_LINE, "too long").when(F.col(f"doc.{CORRUPT}").isNotNull(), "not readable")
    tagged = lines.withColumn("doc", parsed).withColumn("problem", problem)
    good = tagged.filter("problem IS NULL").select("doc.*").drop(CORRUPT).na.fill(DEFAULTS[log])
    bad = tagged.filter("problem IS NOT NULL").select("file", F.substring("value", 1, 80).alias("head"), "problem")
    return good, bad


def since(rows: DataFrame, column: str, start: str) -> DataFrame:
    return rows.filter(F.col(column) >= F.lit(start).cast("timestamp"))


def append(rows: DataFrame, path: str, form: str = "json") -> None:
    rows.write.mode("append").format(form).save(path)


def external_verdicts(inbox: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Inbox rows as feedback, and the rejected ones.

    Only tp, fp and partial pass, and only with an agent; the agent is
    lower-cased without blanks, the confidence cut to [0, 1] or null if it
    isn't finite, a blank category is ``unknown``.
    """
    v = verdict(F.col("verdict"))
    agent = F.lower(F.regexp_replace("agent", r"\s+", ""))
    ok = F.coalesce(v.isin("tp", "fp", "partial") & (agent != ""), F.lit(False))
    sure = F.when(F.col("confidence").isNotNull() & ~F.isnan("confidence") & (F.abs("confidence") != float("inf")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))
    accepted = inbox.filter(ok).select(
        "file_path", "finding_title", F.when(is_blank(F.col("finding_category")), "unknown").otherwise(F.col("finding_category")).alias("finding_category"), v.alias("verdict"), "reason",
        F.lit(None).cast("string").alias("model"), F.lit(now).cast("timestamp").alias("timestamp"),
        F.to_json(F.struct(F.struct(agent.alias("agent"), F.col("agent_model").alias("model"), sure.alias("confidence")).alias("external"))).alias("provenance"),
        F.lit(None).cast("string").alias("fp_kind"), F.lit(None).cast("string").alias("finding_id"), F.lit(None).cast("string").alias("rule_id"),
    )
    return accepted, inbox.filter(~ok)


def misleading_verdicts(reports: DataFrame, now: str) -> DataFrame:
    """Reports of misleading context (file_path, finding_title, finding_category, blamed_chunk_ids, reason) as human feedback."""
    blamed = F.coalesce("blamed_chunk_ids", F.array().cast("array<string>"))
    none = [F.lit(None).cast("string").alias(c) for c in ("model", "fp_kind", "finding_id", "rule_id")]
    verdict_text = F.to_json(F.struct(F.struct(blamed.alias("blamed_chunk_ids")).alias("context_misleading")))
    return reports.select(
        "file_path", "finding_title", "finding_category", verdict_text.alias("verdict"), "reason", F.lit(now).cast("timestamp").alias("timestamp"), F.lit("human").alias("provenance"), *none
    )


def validate_chunks(chunks: DataFrame) -> DataFrame:
    """Faults of a chunk table: ``id, fault``; ids that occur twice, empty texts, bad line ranges and confidences."""
    own = F.array_compact(F.array(
        F.when(is_blank(F.col("id")), "empty id"),
        F.when(is_blank(F.col("source")), "empty source"),
        F.when(is_blank(F.col("content")), "empty content"),
        F.when((F.col("line_start") < 1) | (F.col("line_end") < F.col("line_start")), "line range"),
        F.when(F.isnan("confidence") | (F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence"),
    ))
    twice = chunks.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("duplicate id").alias("fault"))
    return chunks.select("id", F.explode(own).alias("fault")).unionByName(twice)


def write_index(chunks: DataFrame, path: str) -> None:
    """Replace the partitions of the sources in ``chunks``, leaving other sources as they are."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


