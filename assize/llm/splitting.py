"""Splitting oversized texts at natural boundaries.

Content-defined chunking. A polynomial hash rolls over the characters; places
where it meets a fixed condition are landmarks that depend only on the text
around them. Within the allowed sizes the first landmark decides where a cut
falls, and the cut snaps to the nearest natural boundary: a line on which a
top-level unit begins, else the start of a paragraph, else of a line. So an
edit alters only the pieces around it. Without landmark or boundary the piece
ends at its maximum.

One pass over the texts, no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import rolling

LIMIT = 3000
WINDOW = 32
SPACING = 256

#: Language of a file name's ending (fixed values).
ENDINGS = {
    "rs": "rust", "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript",
    "go": "go", "tf": "hcl", "hcl": "hcl", "tfvars": "hcl", "yaml": "yaml", "yml": "yaml", "md": "markdown", "markdown": "markdown",
}

#: What begins a top-level unit, at the start of a line, by language.
UNITS = {
    "rust": r'(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|async|const|unsafe|extern(?:\s+"[^"]*")?)\s+)*(?:(?:fn|struct|enum|union|trait|impl|type|static|const)\b|mod\b(?!\s+\w+;))|macro_rules!',
    "python": r"(?:async\s+def|def|class)\b|if\s+__name__\b|[A-Za-z_]\w*\s*(?::[^=]+)?=[^=]",
    "typescript": r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\b|class\b|interface\b|type\s+\w+|enum\b|namespace\b|module\b|(?:const|let|var)\s)|export\s+default\b",
    "go": r"(?:func|type|var|const)\b",
    "hcl": r"[A-Za-z_][\w\-]*(?:\s+(?:\"[^\"]*\"|[\w\-]+))*\s*\{|[A-Za-z_][\w\-]*\s*=[^=]",
    "yaml": r"(?:\"[^\"]*\"|'[^']*'|[A-Za-z_0-9][^\s:#]*(?: [^\s:#]+)*)\s*:(?:\s|$)",
}
_UNITS = {k: re.compile(v) for k, v in UNITS.items()}

#: Lines that, directly above a unit, belong to it: comments, attributes, decorators.
_ABOVE = {
    "rust": re.compile(r"//|#!?\[|/\*|\*/"),
    "python": re.compile(r"#|@"),
    "typescript": re.compile(r"//|/\*|\*/|@"),
    "go": re.compile(r"//|/\*|\*/"),
    "hcl": re.compile(r"#|//|/\*|\*/"),
    "yaml": re.compile(r"#"),
}
_HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]|$)")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)")

#: Delimiters of strings that run over lines, by language.
_LONG_STRINGS = {
    "rust": re.compile(r'r(#+)"|(?<!\w)r"'),
    "python": re.compile(r'"""|\'\'\''),
    "typescript": re.compile("`"),
    "go": re.compile("`"),
    "hcl": re.compile(r"<<-?(\w+)\s*$"),
}


def language_of(text: str, lang: str | None, path: str | None) -> str:
    """Language by file ending, else by the lines themselves, else by the given name."""
    ending = (path or "").rsplit(".", 1)[-1].strip().lower() if "." in (path or "") else ""
    if ending in ENDINGS:
        return ENDINGS[ending]
    lines = [x.rstrip("\r") for x in text.split("\n")]
    strict = {"python": re.compile(r"(?:async\s+def|def|class)\b.*:\s*$|from\s+\S+\s+import\b"), "yaml": re.compile(r"[\w\-]+:\s*$"), "hcl": re.compile(r"(?:resource|module|variable|data|output|locals|terraform|provider)\b.*\{\s*$")}
    scores = {k: sum(1 for x in lines if strict.get(k, p).match(x)) for k, p in _UNITS.items()}
    scores["markdown"] = sum(1 for x in lines if _HEADING.match(x) and not x.startswith("#!")) if not any(scores.values()) else 0
    best = max(scores, key=lambda k: scores[k])
    named = (lang or "").strip().lower()
    if scores.get(named, 0) == scores[best]:
        best = named if named in scores else best
    return best if scores[best] else (named if named in scores else "text")


def _headings(lines: list[str]) -> list[int]:
    out, fence = [], ""
    for n, x in enumerate(lines, 1):
        m = _FENCE.match(x)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
        elif m and not (m[1][0] == "`" and "`" in m[2]):
            fence = m[1]
        elif _HEADING.match(x):
            out.append(n)
        elif n > 1 and re.fullmatch(r" {0,3}=+\s*", x) and lines[n - 2].strip() and (n - 1) not in out:
            out.append(n - 1)
    return out


def _inside(lines: list[str], lang: str) -> list[bool]:
    """For each line, whether it begins inside a string or comment that runs over lines."""
    opener = _LONG_STRINGS.get(lang)
    out, end = [], ""
    for x in lines:
        out.append(bool(end))
        at = 0
        while True:
            if end:
                if lang == "hcl" and end != "*/":
                    if x.strip() == end:
                        end = ""
                    break
                k = x.find(end, at)
                if k < 0:
                    break
                at, end = k + len(end), ""
            m = opener.search(x, at) if opener else None
            c = x.find("/*", at) if lang in ("rust", "typescript", "go", "hcl") else -1
            comment = min((k for k in (x.find(s, at) for s in (("#",) if lang == "python" else ("//",) if lang != "hcl" else ("#", "//"))) if k >= 0), default=len(x))
            if m and m.start() < comment and (c < 0 or m.start() < c):
                at = m.end()
                end = (m[1] if lang == "hcl" else '"' + (m[1] or "") if lang == "rust" else m.group())
                if lang == "hcl":
                    break
            elif 0 <= c < comment:
                at, end = c + 2, "*/"
            else:
                break
    return out


def unit_lines(text: str, lang: str | None = None, path: str | None = None) -> list[int]:
    """Lines on which a top-level unit begins; line 1 always.

    A unit of code or configuration counts from the first comment, attribute or
    decorator line directly above it; in Markdown each heading outside fences is one.
    """
    lines = [x.rstrip("\r") for x in text.split("\n")]
    kind = language_of(text, lang, path)
    if kind == "markdown":
        return sorted({1, *_headings(lines)})
    unit, above = _UNITS.get(kind), _ABOVE.get(kind)
    if unit is None:
        return [1]
    inside = _inside(lines, kind)
    starts = {1}
    for n, x in enumerate(lines):
        if inside[n] or not unit.match(x):
            continue
        k = n
        while k > 0 and (above.match(lines[k - 1]) or (inside[k - 1] and _closes_comment(lines, inside, k - 1))):
            k -= 1
            while inside[k] and k > 0:  # down to the line that opens the comment
                k -= 1
        starts.add(k + 1)
    return sorted(starts)


def _closes_comment(lines: list[str], inside: list[bool], n: int) -> bool:
    """Whether line ``n``, inside something, ends a comment block that an unindented line opens."""
    if not lines[n].rstrip().endswith("*/"):
        return False
    while inside[n] and n > 0:
        n -= 1
    return lines[n].startswith("/*")


def cuts(text: str, starts: list[int], size_min: int, size_max: int) -> list[int]:
    """Offsets at which pieces begin, 0 first; ``starts`` are offsets of natural boundaries."""
    if len(text) <= size_max:
        return [0]
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    hashes = rolling(codes, WINDOW)
    marks = (np.flatnonzero((hashes >> np.uint64(40)) % np.uint64(SPACING) == 0) + WINDOW).tolist()
    lines = [m.end() for m in re.finditer("\n", text)]
    paragraphs = [m.end() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    out = [0]
    while len(text) - out[-1] > size_max:
        low, high = out[-1] + size_min, out[-1] + size_max
        k = bisect_left(marks, low)
        mark = marks[k] if k < len(marks) and marks[k] <= high else None
        for natural in (starts, paragraphs, lines):
            near = natural[bisect_left(natural, low) : bisect_right(natural, high)]
            if near:
                out.append(min(near, key=lambda p: (abs(p - mark), p)) if mark is not None else near[-1])
                break
        else:
            out.append(mark if mark is not None else high)
    return out


def split(text: str, units: list[int], limit: int, overlap: int, size_min: int) -> list[tuple[int, int, int]]:
    """``(start, core, end)`` of each piece: it begins with the overlap, its own part begins at ``core``."""
    heads = [0, *(m.end() for m in re.finditer("\n", text))]
    starts = [heads[n - 1] for n in units if n > 1]
    begins = cuts(text, starts, size_min, limit - overlap)
    out = []
    for i, core in enumerate(begins):
        start = core
        if i:
            back = max(core - overlap, begins[i - 1])
            at = bisect_left(heads, back)
            start = heads[at] if at < len(heads) and heads[at] < core else back
        out.append((start, core, begins[i + 1] if i + 1 < len(begins) else len(text)))
    return out


def _splitter(limit: int, overlap: int, size_min: int):
    names = ("piece_no", "line_start", "line_end", "char_start", "char_end", "overlap_chars", "unit_lines", "piece")
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[str] = []
            rows: list[tuple] = []
            for id_, text, lang, path in zip(*(batch[c].to_pylist() for c in ("id", "content", "lang", "source_path"))):
                units = unit_lines(text, lang, path)
                line_at = lambda p, ends=[m.start() for m in re.finditer("\n", text)]: bisect_left(ends, p) + 1
                pieces = split(text, units, limit, overlap, size_min)
                for n, (start, core, end) in enumerate(pieces, 1):
                    first, last = line_at(core), line_at(max(core, end - 1))
                    own = units[bisect_left(units, first) : bisect_right(units, last)]
                    if core and text[core - 1] != "\n":
                        own = [u for u in own if u != first]  # that line began in the piece before
                    ids.append(id_)
                    rows.append((n, line_at(start), last, start, end, core - start, own, text[start:end]))
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), *(pa.array(c, t) for c, t in zip(cols, types))], ["id", *names])

    return run


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = 200, size_min: int = 1600) -> DataFrame:
    """Pieces of every chunk: ``id, piece_no, line_start, line_end, char_start, char_end, overlap_chars, unit_lines, piece``.

    No piece has more than ``limit`` characters, ``overlap_chars`` of which, at
    its start, repeat the end of the piece before; without those the pieces of
    a chunk make up its content. Lines are counted in the content, from 1.
    ``unit_lines`` are the lines of the piece's own part on which a top-level
    unit begins. A content of up to ``limit`` characters is one piece, an empty
    one too; a null content has none. Repeated rows are split each.
    """
    return (
        chunks.select("id", "content", "lang", "source_path")
        .filter(F.col("content").isNotNull())
        .mapInArrow(
            _splitter(limit, overlap, size_min),
            "id string, piece_no int, line_start int, line_end int, char_start int, char_end int, overlap_chars int, unit_lines array<int>, piece string",
        )
    )


def found(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``id, line_no`` of the lines that begin a unit, of chunks over the limit."""
    return pieces(chunks.filter(F.length("content") > limit), limit).select("id", F.explode("unit_lines").alias("line_no"))
