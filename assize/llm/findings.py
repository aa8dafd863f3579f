"""Which feedback rows belong to which finding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import effective_micros, trust_rank, usable_finding_id
from ..storage import materialize

#: Columns in which a row without a usable id must equal a row that has one.
SAME_ROW = ("file_path", "finding_title", "reason", "ts")
#: The two halves of the 128-bit hash by which equal rows meet.
SAME = ("same_a", "same_b")


def finding_rows(feedback: DataFrame, *extra: str) -> DataFrame:
    """One row per (finding, feedback row): ``fid, seq, trust, us`` and the ``extra`` columns.

    The feedback is read and decoded once; what follows reads the written rows.

    A row with a usable id belongs to that finding. A row without one belongs
    to every finding that has a row equal to it in all of ``SAME_ROW`` (nulls
    equal nulls), and to none if there is no such finding. Only the named
    columns are read, so further columns of any name do no harm.
    """
    extra = tuple(dict.fromkeys(extra))
    keyed = feedback.select(
        usable_finding_id(F.col("finding_id")).alias("fid"),
        F.col("seq"),
        trust_rank(F.col("provenance")).alias("trust"),
        effective_micros(F.col("ts"), F.col("received_at")).alias("us"),
        *[F.xxhash64(F.lit(k), *[x for c in SAME_ROW for x in (F.isnull(c), F.col(c))]).alias(name) for k, name in enumerate(SAME)],
        *[F.col(c).alias(f"x_{c}") for c in extra],
    )
    keyed = materialize(keyed, "keyed")
    own = keyed.filter(F.col("fid").isNotNull())
    known = own.select("fid", *SAME).distinct()
    lost = keyed.filter(F.col("fid").isNull()).drop("fid").join(known, list(SAME)).select(keyed.columns)
    return own.unionByName(lost).select("fid", "seq", "trust", "us", *[F.col(f"x_{c}").alias(c) for c in extra])
