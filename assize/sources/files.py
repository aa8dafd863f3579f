"""Source trees as tables of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_regex
from ..operators.scanning import language

MAX_FILE = 1 << 20
#: Folders that are never read, beside those whose names begin with a dot or underscore (fixed values).
IGNORED = ("**/node_modules/**", "**/target/**", "**/__pycache__/**", "**/.venv/**", "**/dist/**", "**/build/**")


def scan(spark: SparkSession, root: str, ignore: tuple[str, ...] = (), largest: int = MAX_FILE) -> DataFrame:
    """Every file below ``root``: ``path`` (relative), ``lang``, ``size``, ``status`` and, where it was read, ``text``.

    Status: ok, ignored (a glob of ``ignore`` or of ``IGNORED``), too large,
    unknown language, not text. Only files with status ok have a text; the
    content of others isn't decoded.
    """
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.element_at(F.split("path", F.regexp_replace(F.lit(base.split("://")[-1]), r"([\\.\[\]{}()*+?^$|])", r"\\$1"), 2), -1)
    rows = files.select(path.alias("path"), F.col("length").alias("size"), "content").withColumn("lang", language(F.col("path")))
    skipped = reduce(lambda a, g: a | F.col("path").rlike(glob_regex(g)), (*IGNORED, *ignore), F.lit(False))
    wanted = ~skipped & (F.col("size") <= largest) & F.col("lang").isNotNull()
    text = F.when(wanted & F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    status = F.when(skipped, "ignored").when(F.col("size") > largest, "too large").when(F.col("lang").isNull(), "unknown language").when(F.col("text").isNull(), "not text").otherwise("ok")
    return rows.withColumn("text", text).select("path", "lang", "size", status.alias("status"), "text")


def diagnostics(files: DataFrame) -> DataFrame:
    return files.groupBy("status").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def subtype(path):
    """readme, changelog, adr or doc of a Markdown path, by the name without its ending, in any case."""
    low = F.lower(path)
    stem = F.regexp_replace(F.regexp_extract(low, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return (
        F.when(stem.contains("readme"), "readme")
        .when(stem.contains("changelog") | stem.contains("history"), "changelog")
        .when(low.contains("docs/adr/") | stem.contains("adr") | stem.contains("decision"), "adr")
        .otherwise("doc")
    )
