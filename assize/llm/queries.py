"""Queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..storage import table
from . import consensus, credentials, entities, leakage, mixing, near_duplicates, repetition, splitting, survivors

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: survivors.found(table(s, d, "feedback")),
        "p1_values": lambda s, d: survivors.resolve(table(s, d, "feedback")),
        "p5_found": lambda s, d: consensus.found(table(s, d, "feedback")),
        "p5_items": lambda s, d: consensus.agree(table(s, d, "feedback"))[0],
        "p5_annotators": lambda s, d: consensus.agree(table(s, d, "feedback"))[1],
        "p2_found": lambda s, d: near_duplicates.found(table(s, d, "findings")),
        "p2_groups": lambda s, d: near_duplicates.groups(table(s, d, "findings")),
        "p4_found": lambda s, d: credentials.found(table(s, d, "chunks")),
        "p4_redacted": lambda s, d: credentials.scan(table(s, d, "chunks")),
        "p6_found": lambda s, d: entities.found(table(s, d, "feedback"), table(s, d, "traces")),
        "p6_matches": lambda s, d: entities.match(table(s, d, "feedback"), table(s, d, "traces")),
        "p7_found": lambda s, d: splitting.found(table(s, d, "chunks")),
        "p7_pieces": lambda s, d: splitting.pieces(table(s, d, "chunks")),
        "p8_found": lambda s, d: leakage.found(table(s, d, "documents"), table(s, d, "bench_passages")),
        "p8_coverage": lambda s, d: leakage.leaks(table(s, d, "documents"), table(s, d, "bench_passages"), min_run=5, min_coverage=0.5),
        "p9_mixture": lambda s, d: mixing.select(table(s, d, "documents"), table(s, d, "mix_targets"))[1],
        "p9_selection": lambda s, d: mixing.select(table(s, d, "documents"), table(s, d, "mix_targets"))[0],
        "p10_found": lambda s, d: repetition.found(table(s, d, "documents")),
        "p10_repetition": lambda s, d: repetition.measure(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"p1_found": survivors.FOUND_SQL, "p2_found": near_duplicates.FOUND_SQL, "p8_found": leakage.FOUND_SQL, "p10_found": repetition.FOUND_SQL}
