"""Joining code facts: calls inside functions, symbols used, imports of dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines of one bucket of an interval join.
BUCKET = 256


def callers(calls: DataFrame, functions: DataFrame, outside: bool = False) -> DataFrame:
    """Calls (path, line, callee) with the innermost function (path, name, first, last) around them.

    With ``outside``, calls outside any function are kept with a null caller.
    An interval join by buckets of lines: a call has one bucket, a function as
    many as it covers, so both sides are joined by equality.
    """
    spans = functions.select("path", "name", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / BUCKET), F.floor(F.col("last") / BUCKET))).alias("bucket"))
    asked = calls.withColumn("bucket", F.floor(F.col("line") / BUCKET)).alias("c")
    around = (F.col("c.path") == F.col("f.path")) & (F.col("c.bucket") == F.col("f.bucket")) & F.col("line").between(F.col("first"), F.col("last"))
    rows = asked.join(spans.alias("f"), around, "left" if outside else "inner").select("c.path", "line", "callee", "name", "first", "last")
    inner = Window.partitionBy("path", "line", "callee").orderBy(F.col("last") - F.col("first"), F.desc("first"), "name")
    return rows.withColumn("rn", F.row_number().over(inner)).filter("rn = 1").select("path", "line", "callee", F.col("name").alias("caller"))


def used_symbols(references: DataFrame, definitions: DataFrame, ranges: DataFrame) -> DataFrame:
    """Definitions (name, path, first, last, signature) that are referenced (path, line, name) within changed ranges (file, first, last)."""
    changed = references.join(ranges, (references.path == ranges.file) & (references.line >= ranges["first"]) & (references.line <= ranges["last"]), "left_semi")
    return definitions.join(changed.select("name").distinct(), "name", "left_semi")


def imported_dependencies(imports: DataFrame, dependencies: DataFrame, most: int = 5) -> DataFrame:
    """Dependencies (run_id, name) that a file imports (run_id, path, place, module), in the order of import, at most ``most``.

    The head of the module is compared with the name in lower case, ``_`` as ``-``; scoped packages keep their scope.
    """
    clean = lambda c: F.lower(F.replace(c, F.lit("_"), F.lit("-")))
    scoped = F.regexp_extract("module", r"^(@[^/]+/[^/]+)", 1)
    head = F.when(scoped != "", scoped).otherwise(F.regexp_extract("module", r"^([^./:]+)", 1))
    deps = dependencies.select("run_id", "name", clean(F.col("name")).alias("key")).distinct()
    rows = imports.withColumn("key", clean(head)).join(deps, ["run_id", "key"]).groupBy("run_id", "path", "name").agg(F.min("place").alias("place"))
    order = Window.partitionBy("run_id", "path").orderBy("place", "name")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("run_id", "path", "name", "rank")


def orphans(registered: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys that are present but not registered, and registered but not present: ``key, side``."""
    a, b = registered.select(key).distinct(), present.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("side", F.lit("orphan")).unionByName(a.join(b, key, "left_anti").withColumn("side", F.lit("missing")))
