"""The inbox as a stream: files dropped into a folder become feedback, each exactly once.

The checkpoint remembers which files were read; read files move to an archive.
``available`` drains what lies there and ends, like a run that starts by
emptying its inbox.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.records import provenance_kind, verdict
from ..sources.logs import CORRUPT, DEFAULTS, MAX_LINE, SCHEMAS


def stream(spark: SparkSession, folder: str, log: str = "inbox", archive: str | None = None, files_per_batch: int = 1_000) -> DataFrame:
    """Rows of the folder's ``*.jsonl`` files of at most 1 MiB (``too_large`` lists the others); unreadable lines have their text in ``_corrupt``."""
    reader = spark.readStream.schema(f"{SCHEMAS[log]}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", files_per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.json(folder).filter(F.col("_metadata.file_size") <= MAX_LINE).na.fill(DEFAULTS[log])


def too_large(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length`` of the files that ``stream`` leaves out for their size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(folder)
    return files.select("path", "length").filter(F.col("length") > MAX_LINE)


def drain(rows: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Append what lies in the folder to a parquet table and end."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(sink)


def counts(rows: DataFrame) -> DataFrame:
    """Running counts by verdict and provenance tier."""
    return rows.filter(F.col(CORRUPT).isNull()).groupBy(verdict(F.col("verdict")).alias("v"), provenance_kind(F.col("provenance")).alias("tier")).agg(F.count("*").alias("n"))


def windowed(rows: DataFrame, width: str = "1 day", late: str = "2 days", column: str = "timestamp") -> DataFrame:
    """Counts per time window and verdict; rows later than ``late`` behind the newest are left out."""
    return rows.withWatermark(column, late).groupBy(F.window(column, width).alias("w"), verdict(F.col("verdict")).alias("v")).agg(F.count("*").alias("n"))


def misleading_counts(rows: DataFrame) -> DataFrame:
    """Running confirmations per blamed chunk."""
    listed = F.from_json(F.get_json_object("verdict", "$.context_misleading.blamed_chunk_ids"), "array<string>")
    return rows.filter(F.col(CORRUPT).isNull()).select(F.explode(listed).alias("chunk_id")).groupBy("chunk_id").agg(F.count("*").alias("n"))


def feedback_counts_by_stream(spark: SparkSession, feedback: DataFrame, shared: str) -> DataFrame:
    """Write the feedback as JSON files, drain them through the stream, and count what arrived."""
    source = f"{shared}/inbox"
    out = feedback.select("file_path", "finding_title", "finding_category", "verdict", "reason", "model", F.col("ts").alias("timestamp"), "provenance", "fp_kind", "finding_id", "rule_id")
    # files stay under the size limit of the inbox
    out.write.option("maxRecordsPerFile", 1_500).mode("append").json(source)
    rows = stream_of_json(spark, source)
    drain(rows, f"{shared}/drained", f"{shared}/checkpoint").awaitTermination()
    return counts(spark.read.parquet(f"{shared}/drained"))


def stream_of_json(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(f"{SCHEMAS['feedback']}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).option("pathGlobFilter", "*.json").json(folder).na.fill(DEFAULTS["feedback"])
