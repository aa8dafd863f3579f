"""Column expressions that bring logged identifiers and enums to one spelling.

All are JVM-side expressions; null in gives null out unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings that stand for "no identifier" (fixed values).
ID_PLACEHOLDERS = ("", "NA", "NULL", "NONE", "NIL", "UNKNOWN", "UNDEFINED", "TBD", "TODO")

#: Trust order of provenance kinds, most trusted first (fixed values).
TRUST = {"post_fix": 0, "human": 1, "external": 2, "auto_calibrate": 3}
UNTRUSTED = 4

VERDICTS = ("tp", "fp", "partial", "wontfix", "context_misleading")


def is_blank(c: Column) -> Column:
    """True for null and for strings of white space only; never null."""
    return c.isNull() | c.rlike(r"^\s*$")


def usable_finding_id(c: Column) -> Column:
    """Canonical finding id (upper case, letters and digits only); null for a placeholder.

    A leading ``finding:`` and any quotes, braces, signs or white space around
    the id are dropped.
    """
    bare = F.upper(F.regexp_replace(F.regexp_replace(c, r"(?i)^\W*finding(_?id)?\s*[:=#/]\s*", ""), r"[^0-9A-Za-z]", ""))
    # Most ids are written plainly, and none of the placeholders is so long.
    return F.when(c.rlike(r"^[0-9A-Za-z]{20,}\z"), F.upper(c)).otherwise(F.get(F.filter(F.array(bare), lambda b: ~b.isin(*ID_PLACEHOLDERS)), 0))


def _tag(c: Column, key: str) -> Column:
    """The discriminator of an enum stored as a bare word, quoted word or JSON object."""
    s = F.trim(c)
    named = F.when(s.contains(f'"{key}"'), F.get_json_object(s, f"$.{key}"))
    inner = F.coalesce(named, F.get(F.json_object_keys(s), 0))
    return F.when(s.startswith("{"), inner).otherwise(F.split(s, ":").getItem(0))


def _letters(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^A-Za-z]", ""))


def verdict(c: Column) -> Column:
    """tp, fp, partial, wontfix or context_misleading from any historic encoding, else null."""
    w = _letters(_tag(c, "verdict"))
    return (
        F.when(w.isin("tp", "truepositive"), "tp")
        .when(w.isin("fp", "falsepositive"), "fp")
        .when(w == "partial", "partial")
        .when(w == "wontfix", "wontfix")
        .when(w == "contextmisleading", "context_misleading")
    )


def provenance_kind(c: Column) -> Column:
    """post_fix, human, external, auto_calibrate or unknown; null and blank give unknown."""
    w = _letters(_tag(c, "kind"))
    return (
        F.when(w == "postfix", "post_fix")
        .when(w == "human", "human")
        .when(w == "external", "external")
        .when(w == "autocalibrate", "auto_calibrate")
        .otherwise("unknown")
    )


def trust_rank(c: Column) -> Column:
    """0 for the most trusted provenance kind, rising; unknown kinds come last."""
    k = provenance_kind(c)
    out = F.when(k == "post_fix", TRUST["post_fix"])
    for name in ("human", "external", "auto_calibrate"):
        out = out.when(k == name, TRUST[name])
    return out.otherwise(UNTRUSTED)


def annotator(c: Column) -> Column:
    """Who gave a verdict: human, post_fix, external:<agent> or auto:<model>; null if that can't be told.

    Letter case and blanks of agents and models are ignored.
    """
    k = provenance_kind(c)

    def payload(keys: str, tag: str) -> Column:
        name = r'"([^"]*[^"\s][^"]*)"'
        forms = (rf'"(?:{keys})"\s*:\s*{name}', rf'(?i)^\s*\{{\s*"{tag}"\s*:\s*{name}', rf"(?i)^\s*{tag}\s*:(.*\S.*)$")
        found = F.coalesce(*[F.get(F.regexp_extract_all(c, F.lit(f), F.lit(1)), 0) for f in forms])  # a later form only where none before matches
        return F.lower(F.regexp_replace(found, r"\s+", ""))

    return (
        F.when(k.isin("human", "post_fix"), k)
        .when(k == "external", F.concat(F.lit("external:"), payload("agent|agent_name", "external")))
        .when(k == "auto_calibrate", F.concat(F.lit("auto:"), payload("model", "auto[_-]?calibrate")))
    )


def effective_micros(ts: Column, received: Column) -> Column:
    """Microseconds of ``ts``; a missing one or one after its arrival counts as the oldest possible."""
    oldest = F.lit(-(1 << 62)).cast("long")
    us = F.unix_micros(ts.cast("timestamp"))
    return F.when(ts.isNull() | F.coalesce(ts > received, F.lit(False)), oldest).otherwise(us)
