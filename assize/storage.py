"""Cutting lineage and reading tables.

Intermediate results that an operator reads more than once are written as
parquet below the folder named by ``spark.checkpoint.dir`` (shared by all
executors on a cluster), so a lost executor costs a task, never a result.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor sees.

    Where none is set, a local master gets a temporary folder; any other is
    refused, because a folder of one machine loses rows on a cluster.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _FALLBACK:
        _FALLBACK.append(tempfile.mkdtemp(prefix="assize-"))
        atexit.register(shutil.rmtree, _FALLBACK[0], ignore_errors=True)
    return f"file://{_FALLBACK[0]}"


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/assize/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*written: DataFrame) -> None:
    """Delete tables written by ``materialize`` that nothing reads any more."""
    for df in written:
        paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for path in paths:
            if "/assize/" not in path:
                raise ValueError(f"not a written step: {path}")
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Read one table of a data folder."""
    return spark.read.parquet(f"{base}/{name}.parquet")
