"""Small results as text: tables, compact lines, JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

MOST_ROWS = 1_000


def _rows(df: DataFrame) -> list[dict]:
    """The rows of a report; a report has few."""
    rows = [r.asDict(recursive=True) for r in df.limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report has at most {MOST_ROWS} rows")
    return rows


def _cell(v) -> str:
    if v is None:
        return "-"
    return f"{v:.3f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)


def table(df: DataFrame, title: str = "") -> str:
    """Aligned columns; numbers to the right."""
    rows, names = _rows(df), df.columns
    cells = [[_cell(r[n]) for n in names] for r in rows]
    width = [max([len(n), *(len(c[k]) for c in cells)]) for k, n in enumerate(names)]
    right = [bool(rows) and all(isinstance(r[n], (int, float)) or r[n] is None for r in rows) for n in names]
    line = lambda c: "  ".join(x.rjust(w) if r else x.ljust(w) for x, w, r in zip(c, width, right)).rstrip()
    return "\n".join([*([title] if title else []), line(names), line(["-" * w for w in width]), *map(line, cells)])


def compact(df: DataFrame) -> str:
    """One line per row: name=value."""
    return "\n".join(" ".join(f"{k}={_cell(v)}" for k, v in r.items()) for r in _rows(df))


def as_json(df: DataFrame) -> str:
    return json.dumps(_rows(df), default=str, ensure_ascii=False)
