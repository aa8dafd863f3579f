"""Merging similar findings of one file, in order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SEVERITIES

SCHEMA = "file_path string, rep_id string, id string, title string, category string, severity string, line_start int, line_end int, n_merged int, evidence array<string>"


def _overlap(a0: int, a1: int, b0: int, b1: int) -> float:
    low, high = max(a0, b0), min(a1, b1)
    return 0.0 if low > high else (high - low + 1) / (max(a1, b1) - min(a0, b0) + 1)


def _similarity(a: dict, b: dict) -> float:
    same = a["category"] == b["category"]
    if same and a["title"] == b["title"]:
        return 1.0
    shared, every = len(a["ws"] & b["ws"]), len(a["ws"] | b["ws"])
    words = 1.0 if a["title"] == b["title"] else shared / every if every else 0.0
    return (3 * words + 2 * same + 2 * _overlap(a["line_start"], a["line_end"], b["line_start"], b["line_end"])) / 7


def _merger(threshold: float):
    rank = {s: i for i, s in enumerate(SEVERITIES)}

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        by_word: dict[str, list[int]] = {}
        exact: dict[tuple, int] = {}
        for r in rows.sort_values(["created_us", "id"]).to_dict("records"):
            r["ws"] = set((r["title"] or "").split())
            r["evidence"] = list(r["evidence"]) if r["evidence"] is not None else []
            # Without a shared word the similarity is at most 4/7, so only representatives with one can absorb.
            near = {k for w in r["ws"] for k in by_word.get(w, ())}
            if (k := exact.get((r["title"], r["category"]))) is not None:
                near.add(k)
            home = next((kept[k] for k in sorted(near) if _similarity(kept[k], r) >= threshold), None)
            if home is None:
                r["n"] = 1
                for w in r["ws"]:
                    by_word.setdefault(w, []).append(len(kept))
                exact.setdefault((r["title"], r["category"]), len(kept))
                kept.append(r)
                continue
            if rank.get(r["severity"], -1) > rank.get(home["severity"], -1):
                home["severity"] = r["severity"]
            home["line_start"], home["line_end"] = min(home["line_start"], r["line_start"]), max(home["line_end"], r["line_end"])
            home["evidence"] += [e for e in r["evidence"] if e not in home["evidence"]]
            home["n"] += 1
        for r in kept:
            if r["n"] > 1:
                r["evidence"] = [*r["evidence"], f"{r['n']} occurrences merged"]
        return pd.DataFrame({
            "file_path": [r["file_path"] for r in kept], "rep_id": [r["id"] for r in kept], "id": [r["id"] for r in kept], "title": [r["title"] for r in kept],
            "category": [r["category"] for r in kept], "severity": [r["severity"] for r in kept], "line_start": [r["line_start"] for r in kept],
            "line_end": [r["line_end"] for r in kept], "n_merged": [r["n"] for r in kept], "evidence": [r["evidence"] for r in kept],
        })

    return fold


def merge_findings(findings: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Findings of one run and file, merged one after the other into the first similar representative.

    The fold depends on its order (creation, then id), so it runs within one
    run and file: what one review says of one file, a size its author bounds.
    Representatives keep the highest severity, the widest lines and all evidence.
    """
    if threshold <= 4 / 7:
        raise ValueError("merging needs a threshold over 4/7")
    rows = findings.select(
        "run_id", "file_path", "id", "title", F.lower("category").alias("category"), "severity", F.least("line_start", "line_end").alias("line_start"), F.greatest("line_start", "line_end").alias("line_end"), "evidence",
        F.unix_micros("created_at").alias("created_us"),
    )
    sizes = rows.groupBy("run_id", "file_path").agg(F.count("*").alias("size"))
    same = (F.col("r.run_id").eqNullSafe(F.col("s.run_id"))) & (F.col("r.file_path").eqNullSafe(F.col("s.file_path")))
    sized = rows.alias("r").join(sizes.alias("s"), same).select("r.*", "s.size")
    # A finding that stands alone has nothing to merge with and never reaches Python.
    alone = sized.filter("size = 1").select(
        "file_path", "id", "title", "category", "severity", "line_start", "line_end", F.lit(1).alias("n_merged"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence")
    )
    several = sized.filter("size > 1").drop("size")
    return alone.unionByName(several.groupBy("run_id", "file_path").applyInPandas(_merger(threshold), SCHEMA).drop("rep_id"))


def grounded(findings: DataFrame, lines: DataFrame, around: int = 2) -> DataFrame:
    """Status of language-model findings against the lines of their files.

    ``lines``: file_path, n_lines, lines (array). A line range outside the file
    is line-out-of-range; an identifier of the title missing within ``around``
    lines is symbol-not-found; both lower the severity by one level. Other
    sources, unknown files and titles without an identifier are not-checked.
    """
    from ..functions.text import backtick_identifiers, contains_symbol, severity_name, severity_rank

    rows = findings.join(lines, "file_path", "left")
    inside = (F.col("line_start") >= 1) & (F.col("line_start") <= F.col("line_end")) & (F.col("line_end") <= F.col("n_lines"))
    first = F.greatest(F.lit(1), F.col("line_start") - around)
    near = F.array_join(F.slice("lines", first, F.greatest(F.lit(0), F.least(F.col("n_lines"), F.col("line_end") + around) - first + 1)), "\n")
    names = backtick_identifiers(F.col("title"))
    there = F.forall(names, lambda n: contains_symbol(near, n))
    status = (
        F.when((F.col("source_kind") != "llm") | F.col("lines").isNull(), "not-checked").when(F.coalesce(~inside, F.lit(True)), "line-out-of-range").when(F.coalesce(F.size(names), F.lit(0)) == 0, "not-checked").when(there, "verified").otherwise("symbol-not-found")
    )
    lower = F.col("status").isin("line-out-of-range", "symbol-not-found")
    rank = severity_rank(F.col("severity"))
    return rows.withColumn("status", status).select("id", "status", severity_name(F.when(lower, F.greatest(rank - 1, F.lit(0))).otherwise(rank)).alias("severity"))
