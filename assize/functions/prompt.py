"""Text made safe for prompts and Markdown, and small display helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags whose closing form must not end a sandbox (fixed values).
SANDBOX_TAGS = (
    "document", "framework_docs", "hydration_context", "historical_findings", "truncation_notice",
    "file_metadata", "referenced_context", "retrieved_reference", "untrusted_code", "tool_output",
)

#: Structural words of paths (fixed values).
PATH_NOISE = ("src", "lib", "tests", "test", "mod", "main", "rs", "py", "ts", "js", "tsx", "jsx", "mjs", "cjs", "yaml", "yml", "sh", "bash", "zsh", "tf", "tfvars")

ZERO_WIDTH = "\u200b"


def defang(text: Column, tags: tuple[str, ...] = SANDBOX_TAGS) -> Column:
    """Closing sandbox tags broken by a zero-width space; everything else stays."""
    return F.regexp_replace(text, rf"(?i)</\s*({'|'.join(tags)})\s*>", f"</{ZERO_WIDTH}$1>")


def fence(body: Column) -> Column:
    """A code fence longer than any run of back ticks in the text, at least three."""
    runs = F.transform(F.regexp_extract_all(body, F.lit("(`+)"), F.lit(1)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def fence_lang(language: Column) -> Column:
    return F.substring(F.regexp_replace(F.coalesce(language, F.lit("")), r"[^A-Za-z0-9_+#-]", ""), 1, 32)


def inline(text: Column) -> Column:
    """One line without control characters, line separators, back ticks and pipes, defanged."""
    return defang(F.regexp_replace(text, r"[\x00-\x1f\x7f`|\x{85}\x{2028}\x{2029}]", ""))


def first_lines(text: Column, n: int = 500) -> Column:
    """The first ``n`` lines, with a notice where some were cut."""
    lines = F.split(text, "\n", -1)
    return F.when(F.size(lines) > n, F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.format_string("\n... (%d more lines)", F.size(lines) - n))).otherwise(text)


def first_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def redact_userinfo(url: Column) -> Column:
    """Addresses without user and password."""
    return F.regexp_replace(url, r"://[^/@\s]*@", "://[REDACTED]@")


def age_text(seconds: Column) -> Column:
    """``3d``, ``5h``, ``7m`` or ``just now``."""
    return (
        F.when(seconds < 0, "just now")
        .when(seconds >= 86_400, F.concat(F.floor(seconds / 86_400).cast("string"), F.lit("d")))
        .when(seconds >= 3_600, F.concat(F.floor(seconds / 3_600).cast("string"), F.lit("h")))
        .when(seconds >= 120, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m")))
        .otherwise("just now")
    )


def bar(value: Column, top: Column, full: str = "█", rest: str = "·") -> Column:
    """Ten cells filled in proportion."""
    share = F.when((top <= 0) | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / top)))
    cells = F.round(share * 10).cast("int")
    return F.concat(F.repeat(F.lit(full), cells), F.repeat(F.lit(rest), 10 - cells))


def path_words(path: Column) -> Column:
    """Words of a path without the ending: split at slashes, ``_``, ``-`` and camel case; at least three long, no structural words."""
    bare = F.regexp_replace(path, r"\.[^./\\]*$", "")
    parts = F.split(F.regexp_replace(bare, r"([a-z0-9])([A-Z])", "$1_$2"), r"[/\\_-]+")
    return F.filter(parts, lambda t: (F.octet_length(t) >= 3) & ~F.lower(t).isin(*PATH_NOISE))


def card(kind: Column, name: Column, language: Column, path: Column, first: Column, last: Column, source: Column, commit: Column, content: Column) -> Column:
    """Markdown card of a chunk: heading, source, and the content, fenced unless it is prose."""
    where = F.concat(inline(path), F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"))
    prose = kind == "doc"
    label = F.when(kind == "schema", "Schema").otherwise("Symbol")
    heading = F.when(prose, F.concat(F.lit("### Doc: "), where)).otherwise(
        F.concat(F.lit("### "), label, F.lit(": `"), inline(F.coalesce(name, F.lit("<anonymous>"))), F.lit("` ("), fence_lang(language), F.lit(", "), where, F.lit(")"))
    )
    safe = defang(F.when(prose, F.regexp_replace(content, r"(?m)^## ", "### ")).otherwise(content))
    ended = F.when(safe.endswith("\n"), safe).otherwise(F.concat(safe, F.lit("\n")))
    body = F.when(prose, ended).otherwise(F.concat(fence(safe), fence_lang(language), F.lit("\n"), ended, fence(safe), F.lit("\n")))
    return F.concat(heading, F.lit("\n> Source: "), inline(source), F.lit(", commit "), F.substring(commit, 1, 7), F.lit("\n\n"), body)
