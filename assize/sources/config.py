"""Small settings on the driver: suppression rules, thresholds, sources, index state."""

from __future__ import annotations

import json
import math
import os
import tomllib
from dataclasses import asdict, dataclass

SCHEMA_VERSION = 1
SOURCE_KINDS = ("rust", "typescript", "javascript", "python", "go", "terraform", "service", "docs")


def suppression_rules(text: str) -> list[dict]:
    """Rules of a TOML text in their order; [] if it can't be read. Rules without a pattern are left out."""
    try:
        rules = tomllib.loads(text).get("suppress", [])
    except tomllib.TOMLDecodeError:
        return []
    return [{k: r[k] for k in ("pattern", "category", "file", "reason") if r.get(k)} for r in rules if isinstance(r, dict) and isinstance(r.get("pattern"), str) and r["pattern"]]


def thresholds(text: str) -> dict[str, float] | None:
    """``{"suppress": t, "boost": t}`` of a TOML text; None unless all values are in [0, 1] and suppress lies under boost."""
    try:
        doc = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return None
    out = {}
    for side in ("suppress", "boost"):
        if side in doc:
            values = [doc[side].get("precision_target"), doc[side].get("threshold")]
            if not all(isinstance(v, (int, float)) and math.isfinite(v) and 0 <= v <= 1 for v in values):
                return None
            out[side] = float(values[1])
    if len(out) == 2 and out["suppress"] >= out["boost"]:
        return None
    return out


def thresholds_text(learned: dict[str, tuple[float, float]]) -> str:
    """TOML text of ``{side: (precision target, threshold)}``."""
    return "\n".join(f"[{s}]\nprecision_target = {t}\nthreshold = {v}\n" for s, (t, v) in learned.items())


def write_atomically(path: str, text: str) -> None:
    """Write to a neighbour, then take its place; the former file stays as ``.bak``."""
    beside = f"{path}.tmp"
    with open(beside, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    if os.path.exists(path):
        os.replace(path, f"{path}.bak")
    os.replace(beside, path)


@dataclass(frozen=True)
class Source:
    name: str
    kind: str
    path: str | None = None
    git: str | None = None
    paths: tuple[str, ...] = ()
    weight: float | None = None
    ignore: tuple[str, ...] = ()


def sources(text: str) -> list[Source]:
    """Sources of a TOML registry; names are unique, each has a known kind and either a path or a git address."""
    out: list[Source] = []
    for r in tomllib.loads(text).get("source", []):
        s = Source(r["name"], r["kind"], r.get("path"), r.get("git"), tuple(r.get("paths", ())), r.get("weight"), tuple(r.get("ignore", ())))
        if s.kind not in SOURCE_KINDS or (s.path is None) == (s.git is None) or any(o.name == s.name for o in out):
            raise ValueError(f"source {s.name!r} is not valid")
        out.append(s)
    return out


@dataclass(frozen=True)
class IndexState:
    embedder: str
    schema_version: int = SCHEMA_VERSION
    head: str | None = None
    indexed_at: str | None = None

    @staticmethod
    def load(path: str) -> IndexState | None:
        try:
            with open(path, encoding="utf-8") as f:
                return IndexState(**json.load(f))
        except FileNotFoundError:
            return None

    def save(self, path: str) -> None:
        write_atomically(path, json.dumps(asdict(self)))


def check(state: IndexState | None, embedder: str) -> str:
    """fresh, ok, migrate or reembed."""
    if state is None:
        return "fresh"
    if state.schema_version != SCHEMA_VERSION:
        return "migrate"
    return "ok" if state.embedder == embedder else "reembed"
