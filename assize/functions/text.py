"""Text expressions over finding titles, categories and reasons. All run in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- fixed values: category aliases -------------------------------------------------
CATEGORY_ALIASES = {
    "security": ("security", "safety"),
    "correctness": ("correctness", "functional-bug", "bug"),
    "logic": ("logic", "logic-error"),
    "concurrency": ("concurrency",),
    "reliability": ("reliability", "resource-lifecycle", "resource-management"),
    "robustness": ("robustness", "compatibility", "hardware"),
    "error-handling": ("error-handling",),
    "validation": ("validation", "schema-evolution", "data-quality"),
    "performance": ("performance", "complexity"),
}
DEFAULT_CATEGORY = "maintainability"

# -- fixed values: pattern names and their literal keywords, first match wins ---------
PATTERN_KEYWORDS = (
    ("sql_injection", ("sql injection", "sql query", "execute(", "cursor.execute")),
    ("xss", ("innerhtml", "outerhtml", "document.write", "dangerouslysetinnerhtml", "cross-site scripting")),
    ("eval_exec", ("eval(", "exec(", "code injection")),
    ("hardcoded_secret", ("hardcoded secret", "hardcoded key", "hardcoded password", "secret_key")),
    ("debug_mode", ("debug=true", "debug mode")),
    ("open_binding", ("0.0.0.0", "all interfaces", "all network")),
    ("bare_except", ("bare except", "broad except")),
    ("blocking_in_async", ("block_in_place", "future.result()", "blocking call", "stall.*reactor", "stall.*event loop")),
    ("resource_leak", ("resource leak", "tab.*leak", "connection.*leak", "file.*leak", "not closed")),
    ("race_condition", ("race condition", "not synchronized", "not thread-safe", "thread safety")),
    ("missing_timeout", ("no timeout", "missing timeout", "hang indefinitely")),
    ("exception_disclosure", ("exception detail", "str(e)", "internal error.*client", "error.*expose")),
    ("mutate_while_iterate", ("mutating.*while.*iterating", "mutating.*while.*iterate")),
    ("mutable_default", ("mutable default",)),
    ("complexity_high", ("cyclomatic complexity", "complexity")),
    ("unsafe_code", ("unsafe block", "unsafe code")),
    ("unwrap_panic", ("unwrap()", "may panic")),
    ("ssrf", ("ssrf", "server-side request", "unvalidated.*url", "arbitrary.*url")),
    ("path_traversal", ("path traversal", "directory traversal", "../")),
    ("weak_crypto", ("md5", "sha1", "weak.*hash", "weak.*crypto")),
    ("unused_code", ("unused import", "unused variable", "dead code")),
    ("non_atomic_write", ("non-atomic", "atomic write")),
)

# -- fixed values: secret patterns in their order, with replacements ------------------
SECRET_PATTERNS = (
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED PRIVATE KEY]"),
    (r"(?:A3T[A-Z0-9]|ABIA|ACCA|AKIA|ASIA)[0-9A-Z]{16}", "[REDACTED]"),
    (r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{36,}", "[REDACTED]"),
    (r"xox[abposr]-(?:\d+-)+[a-z0-9]+", "[REDACTED]"),
    (r"[rs]k_live_[0-9a-zA-Z]{24,}", "[REDACTED]"),
    (r"(?:AC|SK)[a-z0-9]{32}", "[REDACTED]"),
    (r"Bearer\s+[A-Za-z0-9\-._~+/]+=*", "Bearer [REDACTED]"),
    (r'(?i)(^|[^A-Za-z0-9])((?:api[_-]?key|password|secret|token|passwd)(?:[_-][A-Za-z0-9]+)*\s*[=:]\s*)"((?:\\.|[^\n"])+)"', '$1$2"[REDACTED]"'),
    (r"(?i)(^|[^A-Za-z0-9])((?:api[_-]?key|password|secret|token|passwd)(?:[_-][A-Za-z0-9]+)*\s*[=:]\s*)'((?:\\.|[^\n'])+)'", "$1$2'[REDACTED]'"),
    (r"sk-[a-zA-Z0-9\-]{6,}", "[REDACTED]"),
    (r"(://[^:/@]+:)([^@\s]+)(@)", "$1[REDACTED]$3"),
)

#: Severity levels, lowest first (fixed values).
SEVERITIES = ("info", "low", "medium", "high", "critical")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def category(raw: Column) -> Column:
    """Canonical category of a free label; unknown and null labels are maintainability."""
    key = F.regexp_replace(F.trim(F.lower(raw)), "[ _]", "-")
    out = None
    for name, aliases in CATEGORY_ALIASES.items():
        out = F.when(key.isin(*aliases), name) if out is None else out.when(key.isin(*aliases), name)
    return out.otherwise(DEFAULT_CATEGORY)


def normalize_title(title: Column) -> Column:
    """Title without a leading hyphenated rule name, in lower case, runs of other characters than letters, digits and ``_`` as one space."""
    bare = F.regexp_replace(title, r"^[a-z][a-z0-9]*-[a-z0-9-]*:\s*", "")
    return F.trim(F.lower(F.regexp_replace(bare, r"[^\p{L}\p{N}_]+", " ")))


def tokens(text: Column) -> Column:
    """Distinct words between white space, as they are."""
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda t: t != ""))


def lower_tokens(text: Column) -> Column:
    """Distinct words between white space in lower case."""
    return tokens(F.lower(text))


def edge_tokens(text: Column) -> Column:
    """Distinct words in lower case without the signs at their edges."""
    bare = F.transform(F.split(text, r"\s+"), lambda t: F.lower(F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    return F.array_distinct(F.filter(bare, lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays of distinct items; 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared, F.size(a) + F.size(b) - shared), F.lit(0.0))


def classify_pattern(title: Column, description: Column, raw_category: Column) -> Column:
    """First pattern of which a keyword occurs, as plain text, in title, description or category; else null."""
    hay = F.lower(F.concat_ws(" ", title, description, raw_category))
    out = None
    for name, words in PATTERN_KEYWORDS:
        hit = any_of([F.contains(hay, F.lit(w)) for w in words])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def embedding_text(title: Column, description: Column, raw_category: Column) -> Column:
    return F.concat_ws(" ", classify_pattern(title, description, raw_category), raw_category, title)


def _with(text: Column, extras: Column) -> Column:
    """A text and, behind it, those extras that aren't blank."""
    said = F.filter(F.transform(F.coalesce(extras, F.array().cast("array<string>")), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.when(F.size(said) > 0, F.concat(text, F.lit(" "), F.array_join(said, " "))).otherwise(text)


def embedding_text_enriched(title: Column, description: Column, raw_category: Column, extras: Column) -> Column:
    """``embedding_text`` with words that tell alike findings apart."""
    return _with(embedding_text(title, description, raw_category), extras)


def enriched_query(title: Column, extras: Column) -> Column:
    return _with(title, extras)


def index_text(title: Column, reason: Column) -> Column:
    """Text of a feedback entry for an index: title and, unless blank, reason."""
    return _with(title, F.array(reason))


def match_expression(names: Column) -> Column:
    """Names as quoted phrases joined by OR; null without any name."""
    parts = F.filter(F.transform(names, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    quoted = F.transform(parts, lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"')))
    return F.when(F.size(quoted) > 0, F.array_join(quoted, " OR "))


#: What an error text of a service may repeat of a request's secrets (fixed value).
ERROR_SECRETS = (
    r"""(?i)bearer\s+[A-Za-z0-9_\-.=]+|sk-[A-Za-z0-9_\-]+|api[\s_-]?key["']?\s*[:=]\s*["']?[A-Za-z0-9_\-]+"""
    r"""|x-api-key["']?\s*[:=]\s*["']?[A-Za-z0-9_\-]+|"(?:token|secret|access_token)"\s*:\s*"[^"]+\""""
)


def sanitize_error(body: Column, most: int = 200) -> Column:
    """An error text without secrets, its first ``most`` characters."""
    return F.substring(F.regexp_replace(body, ERROR_SECRETS, "[REDACTED]"), 1, most)


def redact_secrets(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), SECRET_PATTERNS, text)


def complexity_metric(title: Column) -> Column:
    """Number after the first ``complexity `` in a title; null if none follows it."""
    low = F.lower(title)
    tail = F.substring(low, F.locate("complexity ", low) + 11, 12)
    return F.when(F.locate("complexity ", low) > 0, F.regexp_extract(tail, r"^(\d+)", 1).try_cast("int"))


def metric_compatible(a: Column, b: Column) -> Column:
    """Both titles without complexity, or with values at most 2 apart."""
    x, y = complexity_metric(a), complexity_metric(b)
    return (x.isNull() & y.isNull()) | F.coalesce(F.abs(x - y) <= 2, F.lit(False))


def severity_rank(severity: Column) -> Column:
    """0 for info up to 4 for critical; null for anything else."""
    low = F.lower(severity)
    return F.nullif(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), low), F.lit(0)) - 1


def severity_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), rank.cast("int"))


#: Words of languages that name nothing in particular (fixed values).
STOP_IDENTIFIERS = (
    "self", "Self", "super", "crate", "true", "false", "None", "Some", "unwrap", "expect", "clone", "iter", "into", "from",
    "default", "push", "is_empty", "map", "filter", "collect", "Result", "Option", "String", "Vec", "Box", "Arc", "Mutex",
    "True", "False", "print", "list", "dict", "str", "int", "float", "bool", "type", "init",
    "this", "null", "undefined", "console", "log", "length", "toString", "Promise",
)


def backtick_identifiers(title: Column, stop: tuple[str, ...] = STOP_IDENTIFIERS) -> Column:
    """Distinct identifiers between back ticks of at least four bytes, without blanks around and ``()``; no stop words."""
    found = F.transform(F.regexp_extract_all(title, F.lit("`([^`]+)`"), F.lit(1)), lambda t: F.regexp_replace(F.regexp_replace(t, r"^\s+|\s+$", ""), r"\(\)$", ""))
    kept = F.filter(found, lambda t: F.octet_length(t) >= 4)
    return F.array_distinct(F.array_except(kept, F.array(*[F.lit(s) for s in stop]).cast("array<string>")))


def contains_symbol(text: Column, name: Column) -> Column:
    """Whether a name occurs with no word character beside those of its ends that are word characters."""
    word = r"[\p{L}\p{N}_]"
    quoted = F.concat(F.lit("\\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    before = F.when(name.rlike(f"^{word}"), f"(?<!{word})").otherwise("")
    after = F.when(name.rlike(f"{word}\\z"), f"(?!{word})").otherwise("")
    return F.regexp_like(text, F.concat(before, quoted, after))


def word_boundary_regex(word: str) -> str:
    """A pattern for a word whose neighbours aren't letters or digits; ``_`` is a boundary."""
    return rf"(?<![\p{{L}}\p{{N}}])\Q{word}\E(?![\p{{L}}\p{{N}}])"


def split_identifier(token: Column) -> Column:
    """Parts of camel case, snake case and hyphenated names, at least three long, in lower case."""
    parts = F.split(F.regexp_replace(token, r"([a-z0-9])([A-Z])", "$1_$2"), r"[_\-:.]+")
    return F.filter(F.transform(parts, F.lower), lambda t: F.length(t) >= 3)


def slug(heading: Column) -> Column:
    """Lower case, other characters than letters, digits, hyphens dropped, spaces as hyphens."""
    low = F.regexp_replace(F.lower(F.trim(heading)), r"[^\p{L}\p{N}\s_-]", "")
    return F.regexp_replace(F.regexp_replace(low, r"[\s_]+", "-"), r"-{2,}|^-+|-+$", "-")


def glob_regex(pattern: str) -> str:
    """Regular expression of a path glob: ``**`` crosses folders, ``*``, ``?`` and classes (``[a-z]``, ``[!x]``) don't."""
    classes: list[str] = []

    def keep(m: re.Match) -> str:
        inside = m[1].replace("\\", "\\\\").replace("[", "\\[")
        classes.append(f"[^/{inside[1:]}]" if inside[0] == "!" else f"[{inside}]")
        return f"\3{len(classes) - 1}\3"

    quoted = re.sub(r"([.+^$(){}|\[\]\\])", r"\\\1", re.sub(r"\[(!?\]?[^\]/]+)\]", keep, pattern))
    for old, new in (("**/", "\1"), ("**", "\2"), ("*", "[^/]*"), ("?", "[^/]"), ("\1", "(?:.*/)?"), ("\2", ".*")):
        quoted = quoted.replace(old, new)
    return "^" + re.sub("\3(\\d+)\3", lambda m: classes[int(m[1])], quoted) + "$"


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Cntrl}", "")


def token_estimate(text: Column) -> Column:
    """Tokens of a text, estimated as a quarter of its bytes, rounded up."""
    return ((F.octet_length(text) + 3) / 4).cast("long")
