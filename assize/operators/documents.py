"""Documents and symbols: Markdown sections, exported symbols, diffs, manifests."""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")


def markdown_sections(text: str) -> list[tuple[str, str, int, int, str]]:
    """``(heading, slug, first line, last line, body)`` of each second-level section.

    What stands before the first is ``__preamble__``; blank bodies are left
    out; a repeated slug gets ``-2``, ``-3``; headings inside fences don't count.
    """
    lines = text.split("\n")
    starts, fence = [], ""
    for n, x in enumerate(lines):
        m = _FENCE.match(x)
        if m and (not fence or (m[1][0] == fence[0] and len(m[1]) >= len(fence))):
            fence = "" if fence else m[1]
        elif not fence and re.match(r"##[ \t]+\S", x):
            starts.append(n)
    bounds = [(None, 0, starts[0] if starts else len(lines))] + [(s, s, e) for s, e in zip(starts, [*starts[1:], len(lines)])]
    out, used = [], {}
    for head, a, b in bounds:
        body = lines[a + 1 : b] if head is not None else lines[a:b]
        if not any(x.strip() for x in body):
            continue
        title = lines[head].lstrip("#").strip() if head is not None else "__preamble__"
        slug = re.sub(r"[\s_]+", "-", re.sub(r"[^\w\s-]", "", title.lower())).strip("-") if head is not None else title
        used[slug] = used.get(slug, 0) + 1
        last = b
        while last > a and not lines[last - 1].strip():
            last -= 1
        out.append((title, slug if used[slug] == 1 else f"{slug}-{used[slug]}", a + 1, last, "\n".join(lines[a:last])))
    return out


#: Exported symbols at the start of a line: language, kind and name are groups.
_SYMBOLS = {
    "rust": re.compile(r"^pub(?:\([^)]*\))?\s+(?:async\s+|unsafe\s+|const\s+)*(?P<kind>fn|struct|enum|trait)\s+(?P<name>\w+)"),
    "typescript": re.compile(r"^export\s+(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?P<kind>function|class|interface|type)\s+(?P<name>\w+)"),
    "python": re.compile(r"^(?:async\s+)?(?P<kind>def|class)\s+(?P<name>[A-Za-z]\w*)"),
    "hcl": re.compile(r"^(?P<kind>resource|module|variable|output|data|provider|locals)\s*(?P<name>(?:\"[^\"]*\"\s*)*)\{"),
    "go": re.compile(r"^(?P<kind>func|type)\s+(?:\([^)]*\)\s*)?(?P<name>[A-Z]\w*)"),
}
_DOC = re.compile(r"\s*(?:///|//|#(?!\[)|\*|/\*\*)")


def symbols(lang: str, text: str) -> list[tuple[str, str, str, int, int, str]]:
    """``(kind, name, signature, first line, last line, doc)`` of the exported symbols of a file."""
    rx = _SYMBOLS.get(lang)
    if rx is None:
        return []
    lines = [x.rstrip("\r") for x in text.split("\n")]
    out = []
    for n, x in enumerate(lines):
        m = rx.match(x)
        if not m:
            continue
        k = n
        while k > 0 and _DOC.match(lines[k - 1]):
            k -= 1
        end = n
        while end + 1 < len(lines) and (not lines[end + 1].strip() or lines[end + 1][0] in " \t})"):
            end += 1
            if lines[end][:1] in ("}", ")"):
                break
        while end > n and not lines[end].strip():
            end -= 1
        name = ".".join(re.findall(r'"([^"]*)"', m["name"])) if lang == "hcl" else m["name"]
        out.append((m["kind"], name, re.sub(r"\s*[{:]\s*$", "", x), n + 1, end + 1, "\n".join(lines[k:n])))
    return out


def extract(files: DataFrame) -> DataFrame:
    """Chunks of files (``path, lang, text``): ``path, kind, name, signature, line_start, line_end, doc``."""
    names = ("path", "kind", "name", "signature", "line_start", "line_end", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, lang, text in zip(*(batch[c].to_pylist() for c in ("path", "lang", "text"))):
                if text is None:
                    continue
                if lang == "markdown":
                    rows += [(path, "section", slug, head, a, b, None) for head, slug, a, b, _ in markdown_sections(text)]
                else:
                    rows += [(path, *x) for x in symbols(lang or "", text)]
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], list(names))

    return files.select("path", "lang", "text").mapInArrow(run, "path string, kind string, name string, signature string, line_start int, line_end int, doc string")


#: Strings and comments of a language, in which brackets and definitions don't count.
_OPAQUE = {
    "rust": re.compile(r"""//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*.*?\*/)*\*/|\bb?r(?P<q>#*)".*?"(?P=q)|"(?:\\.|[^"\\])*"|'(?:\\u\{[^}\n]*\}|\\x\w\w|\\.|[^'\\\n])'""", re.S),
    "typescript": re.compile(
        r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\}|[^`\\])*`"""
        r"""|(?:(?<=[=(,:!&|?;{}])|(?<=[=(,:!&|?;{}] )|(?<=return ))/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/""",
        re.S,
    ),
    "go": re.compile(r"""//[^\n]*|/\*.*?\*/|`[^`]*`|"(?:\\.|[^"\\\n])*"|'(?:\\.[^'\n]*|[^'\\\n])'""", re.S),
    "python": re.compile(r"""#[^\n]*|\"{3}(?:\\.|[^\\])*?\"{3}|'{3}(?:\\.|[^\\])*?'{3}|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", re.S),
}
_DEFINITIONS = {
    "rust": re.compile(r"\bfn\s+(?P<name>(?:r#)?\w+)"),
    "typescript": re.compile(
        r"\bfunction\b\s*\*?\s*(?P<name>[\w$]+)"
        r"|(?:^|(?<=[{};,]))[ \t]*(?:(?:public|private|protected|static|async|override|readonly|get|set)[ \t]+)*(?:\*[ \t]*)?(?P<method>#?[A-Za-z_$][\w$]*)\s*(?=[<(])",
        re.M,
    ),
    "go": re.compile(r"^func\s*(?:\([^)]*\)\s*)?(?P<name>\w+)", re.M),
    "python": re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<name>\w+)", re.M),
}
#: Words before a bracket that make a statement, not a method.
_STATEMENTS = {"if", "for", "while", "switch", "catch", "with", "return", "function", "super", "await", "typeof", "new", "throw", "yield", "delete", "void", "in", "of", "else", "do", "case"}
_PARTNER = {")": "(", "]": "[", "}": "{"}
_CALL = re.compile(r"\b([A-Za-z_]\w*)\(", re.ASCII)


def _masked(lang: str, text: str) -> str:
    """The text with strings and comments blanked, as long and with the same line ends."""
    return _OPAQUE[lang].sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _partners(text: str) -> dict[int, int]:
    """Place of the closing bracket of each opening one; one that is never closed has none."""
    out: dict[int, int] = {}
    stack: list[int] = []
    for m in re.finditer(r"[(){}\[\]]", text):
        c = m.group()
        if c not in _PARTNER:
            stack.append(m.start())
        elif stack and text[stack[-1]] == _PARTNER[c]:
            out[stack.pop()] = m.start()
        elif c == "}":  # brackets left open inside end with their block
            k = len(stack) - 1
            while k >= 0 and text[stack[k]] != "{":
                k -= 1
            if k >= 0:
                out[stack[k]] = m.start()
                del stack[k:]
    return out


def _body(lang: str, text: str, at: int, closing: dict[int, int]) -> int | None:
    """Place of the brace that opens the body of the function whose name ends at ``at``; None for a declaration without body."""
    after, seen, typed = "", False, False  # the last token; whether parameters, and in TypeScript the type after them, have begun
    while at < len(text):
        c = text[at]
        if c in "([" or (c == "{" and (not seen or (lang == "typescript" and after in (":", "|", "&", "<", ",", "=>")) or (lang == "go" and re.search(r"\b(?:interface|struct)\s*$", text[max(0, at - 20) : at])))):
            if at not in closing:
                return None
            seen = seen or c == "("
            at = closing[at]
        elif c == "{":
            return at
        elif c in ")]};" or (lang == "go" and c == "\n" and seen):
            return None
        elif lang == "typescript" and seen:
            typed = typed or c == ":"
            if (not typed and not c.isspace()) or (c == "=" and not text.startswith("=>", at)) or (c == "\n" and not typed and not re.match(r"\s*[{:]", text[at:])):
                return None
            if c == "=":
                at += 1
        if not text[at].isspace():
            after = "=>" if c == "=" else text[at]
        at += 1
    return None


def _indented_end(lines: list[str], first: int, goes_on: list[bool] | None = None) -> int:
    """Last line of the block that line ``first`` begins, by indentation."""
    width = lambda x: len(x.expandtabs()) - len(x.expandtabs().lstrip())
    own, end = width(lines[first]), first
    for n in range(first + 1, len(lines)):
        if goes_on and goes_on[n]:
            end = n
        elif not lines[n].strip():
            continue
        elif width(lines[n]) > own or (goes_on is None and lines[n].lstrip()[:1] in ("}", ")")):
            end = n
            if goes_on is None and width(lines[n]) <= own and lines[n].lstrip()[:1] == "}":
                break
        else:
            break
    return end


def functions(lang: str, text: str) -> tuple[list[tuple[str, int, int]], set[int]]:
    """``(name, first line, last line)`` of all functions and methods of a file, nested and private ones too, and the places of defined names.

    Declarations without a body have no span, but their names are among the places.
    """
    if lang not in _DEFINITIONS:
        return [], set()
    masked = _masked(lang, text)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line_of = lambda at: bisect.bisect_right(starts, at) - 1
    lines, code = text.split("\n"), masked.split("\n")
    closing = {} if lang == "python" else _partners(masked)
    goes_on = [False] * len(lines)
    if lang == "python":
        for m in _OPAQUE[lang].finditer(text):
            for n in range(line_of(m.start()) + 1, line_of(m.end() - 1) + 1):
                goes_on[n] = True
        depth = 0
        for n, x in enumerate(code):
            if re.match(r"\s*(?:(?:async\s+)?def|class)\s+\w", x):
                depth = 0
            goes_on[n] = goes_on[n] or depth > 0
            depth = max(0, depth + sum(map(x.count, "([{")) - sum(map(x.count, ")]}")))
    out, places = [], set()
    for m in _DEFINITIONS[lang].finditer(masked):
        group = "name" if m["name"] else "method"
        if group == "method" and m["method"] in _STATEMENTS:
            continue
        name, first = m[group], line_of(m.start(group))
        if lang == "python":
            out.append((name, first + 1, _indented_end(code, first, goes_on) + 1))
        else:
            brace = _body(lang, masked, m.end(group), closing)
            if brace is not None:
                end = line_of(closing[brace]) if brace in closing else _indented_end(code, first)
                out.append((name, first + 1, max(end, line_of(brace)) + 1))
            elif group == "method":
                continue
        places.add(m.start(group) + (2 if name.startswith("r#") else name.startswith("#")))
    return [(n.removeprefix("r#"), a, b) for n, a, b in out], places


def _by_file(files: DataFrame, rows_of, schema: dict[str, pa.DataType]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, *x) for path, lang, text in zip(*(batch[c].to_pylist() for c in ("path", "lang", "text"))) if text is not None for x in rows_of(lang or "", text)]
            cols = list(zip(*rows)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, schema.values())], list(schema))

    return files.select("path", "lang", "text").mapInArrow(run, ", ".join(f"{n} {'int' if k == pa.int32() else k}" for n, k in schema.items()))


def definitions(files: DataFrame) -> DataFrame:
    """All functions and methods of files (``path, lang, text``), at any depth and visibility: ``path, name, first, last``."""
    return _by_file(files, lambda lang, text: functions(lang, text)[0], {"path": pa.string(), "name": pa.string(), "first": pa.int32(), "last": pa.int32()})


def calls(files: DataFrame) -> DataFrame:
    """Names before an opening bracket, once a line: ``path, line, callee``. The name that a definition gives isn't one."""

    def rows_of(lang: str, text: str) -> list[tuple[int, str]]:
        places, out, line, at = functions(lang, text)[1], {}, 1, 0
        for m in _CALL.finditer(text):
            line += text.count("\n", at, m.start())
            at = m.start()
            if at not in places:
                out[line, m[1]] = None
        return list(out)

    return _by_file(files, rows_of, {"path": pa.string(), "line": pa.int32(), "callee": pa.string()})



def diff_ranges(lines: DataFrame) -> DataFrame:
    """Changed ranges of unified diffs given as ``diff_id, line_no, line``: ``diff_id, file, first, last``.

    Hunks of no lines are left out; a missing count is 1.
    """
    order = Window.partitionBy("diff_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    name = F.when(F.col("line").startswith("+++ "), F.regexp_replace(F.regexp_extract("line", r"^\+\+\+ (?:b/)?([^\t]*)", 1), r"\s+$", ""))
    hunk = r"^@@ .*?\+(\d+)(?:,(\d+))?"
    rows = lines.withColumn("file", F.last(name, ignorenulls=True).over(order)).filter(F.col("line").rlike(hunk) & F.col("file").isNotNull() & (F.col("file") != "/dev/null"))
    first = F.regexp_extract("line", hunk, 1).try_cast("int")
    count = F.coalesce(F.nullif(F.regexp_extract("line", hunk, 2), F.lit("")).try_cast("int"), F.lit(1))
    return rows.select("diff_id", "file", first.alias("first"), count.alias("n")).filter("n > 0").select("diff_id", "file", "first", (F.col("first") + F.col("n") - 1).alias("last"))


def touched(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings whose lines meet a changed range of their file."""
    on = (findings.file_path == ranges.file) & (findings.line_start <= ranges["last"]) & (findings.line_end >= ranges["first"])
    return findings.join(ranges, on, "left_semi")


def dependencies(name: str, text: str, typescript: bool = False) -> list[tuple[str, str]]:
    """``(dependency, language)`` of a manifest by its file name, each once, in order of the name.

    ``typescript`` says that a tsconfig lies beside a package.json. Names of
    crates are written with underscores, as code names them.
    """
    import tomllib

    base = name.rsplit("/", 1)[-1].lower()
    try:
        if base == "cargo.toml":
            doc = tomllib.loads(text)
            places = [doc, *(x for x in doc.get("target", {}).values() if isinstance(x, dict))]
            tables = [p.get(k, {}) for p in places for k in ("dependencies", "dev-dependencies", "build-dependencies")]
            return sorted({(n.replace("-", "_"), "rust") for t in tables if isinstance(t, dict) for n in t})
        if base == "package.json":
            doc = json.loads(text)
            sections = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
            return sorted({(n, "typescript" if typescript else "javascript") for k in sections if isinstance(doc.get(k), dict) for n in doc[k]})
        if base == "pyproject.toml":
            doc = tomllib.loads(text)
            project, poetry = doc.get("project", {}), doc.get("tool", {}).get("poetry", {})
            specs = [*project.get("dependencies", []), *(x for v in project.get("optional-dependencies", {}).values() for x in v), *(x for v in doc.get("dependency-groups", {}).values() for x in v if isinstance(x, str))]
            tables = [poetry.get("dependencies", {}), poetry.get("dev-dependencies", {}), *(g.get("dependencies", {}) for g in poetry.get("group", {}).values())]
            return sorted({(n, "python") for n in [*map(_bare, specs), *(n for t in tables for n in t if n.lower() != "python")] if n})
        if base.startswith("requirements") and base.endswith(".txt"):
            return sorted({(n, "python") for n in (_bare(x) for x in text.splitlines() if not x.strip().startswith(("#", "-"))) if n})
    except (ValueError, AttributeError, TypeError):
        return []
    return []


def project_dependencies(files: dict[str, str]) -> list[tuple[str, str]]:
    """Dependencies of one project folder from its files by name; requirements.txt counts where no pyproject.toml can be read."""
    import tomllib

    found = dependencies("Cargo.toml", files.get("Cargo.toml", "")) + dependencies("package.json", files.get("package.json", ""), "tsconfig.json" in files)
    try:
        readable = "pyproject.toml" in files and bool({"project", "tool", "dependency-groups"} & set(tomllib.loads(files["pyproject.toml"])))
    except tomllib.TOMLDecodeError:
        readable = False
    name = "pyproject.toml" if readable else "requirements.txt"
    return found + dependencies(name, files.get(name, ""))


def _bare(spec: str) -> str:
    m = re.match(r"\s*([A-Za-z0-9][A-Za-z0-9._\-]*)", spec.split("#")[0])
    return m[1] if m else ""
