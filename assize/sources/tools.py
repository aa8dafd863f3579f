"""Output of linters and language models as findings.

Each reader takes ``(run_id, output)`` rows and gives ``run_id, file_path, rule,
title, description, severity, category, line_start, line_end, evidence``. The
category is the canonical one of the tool's label. Output that can't be read
gives no rows.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import category

COLUMNS = ("run_id", "file_path", "rule", "title", "description", "severity", "category", "line_start", "line_end", "evidence")


def _table(rows: DataFrame, tool: str, path: Column, rule: Column, message: Column, severity: Column, first: Column, last: Column, label: Column | None = None) -> DataFrame:
    message = F.coalesce(message, F.lit(""))
    start = F.coalesce(first.try_cast("int"), F.lit(1))
    values = (
        F.col("run_id"), path, rule, F.concat(rule, F.lit(": "), message), message, severity, category(F.lit("lint") if label is None else label),
        start, F.coalesce(last.try_cast("int"), start), F.array(F.concat(F.lit(f"{tool} "), rule)),
    )
    return rows.select(*[v.alias(n) for v, n in zip(values, COLUMNS)])


def _items(outputs: DataFrame, schema: str, path: str = "") -> DataFrame:
    doc = F.from_json("output", schema)
    return outputs.select("run_id", F.explode(doc[path] if path else doc).alias("x"))


def _named(rule: str) -> Column:
    return F.coalesce(F.col(rule), F.lit("unknown"))


def _level(level: Column, **severities: str) -> Column:
    """Severity of a tool's level; ``other`` is that of any unnamed one."""
    other = severities.pop("other")
    out = None
    for name, severity in severities.items():
        out = F.when(level == name, severity) if out is None else out.when(level == name, severity)
    return out.otherwise(other)


def ruff(outputs: DataFrame) -> DataFrame:
    rows = _items(outputs, "array<struct<code:string,message:string,filename:string,location:struct<row:int>,end_location:struct<row:int>>>")
    code = _named("x.code")
    first = F.substring(code, 1, 1)
    label = _level(first, F="import", E="style", W="style", S="security", B="bug", C="complexity", other="lint")
    return _table(rows, "ruff", F.col("x.filename"), code, F.col("x.message"), _level(first, S="high", B="medium", F="medium", E="low", W="low", other="info"), F.col("x.location.row"), F.col("x.end_location.row"), label)


def clippy(outputs: DataFrame) -> DataFrame:
    """One JSON document per line; only compiler messages count, at their first place."""
    lines = outputs.select("run_id", F.explode(F.split("output", "\n")).alias("line"))
    doc = F.from_json("line", "struct<reason:string,message:struct<message:string,level:string,code:struct<code:string>,spans:array<struct<file_name:string,line_start:int,line_end:int>>>>")
    rows = lines.select("run_id", doc.alias("x")).filter("x.reason = 'compiler-message'").withColumn("s", F.get("x.message.spans", 0))
    severity = _level(F.coalesce("x.message.level", F.lit("warning")), error="high", warning="medium", other="low")
    return _table(rows, "clippy", F.col("s.file_name"), _named("x.message.code.code"), F.col("x.message.message"), severity, F.col("s.line_start"), F.coalesce("s.line_end", F.lit(1)))


def eslint(outputs: DataFrame) -> DataFrame:
    files = _items(outputs, "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,message:string,line:int,endLine:int>>>>")
    rows = files.select("run_id", F.col("x.filePath").alias("path"), F.explode("x.messages").alias("x"))
    severity = F.when(F.coalesce("x.severity", F.lit(1)) == 2, "high").when(F.coalesce("x.severity", F.lit(1)) == 1, "medium").otherwise("low")
    return _table(rows, "eslint", F.col("path"), _named("x.ruleId"), F.col("x.message"), severity, F.col("x.line"), F.col("x.endLine"))


def shellcheck(outputs: DataFrame) -> DataFrame:
    """Output of the format json1: an object with ``comments``."""
    rows = _items(outputs, "struct<comments:array<struct<file:string,line:int,endLine:int,level:string,code:int,message:string>>>", "comments")
    severity = _level(F.coalesce("x.level", F.lit("warning")), error="high", warning="medium", info="low", style="info", other="low")
    return _table(rows, "shellcheck", F.col("x.file"), F.concat(F.lit("SC"), F.coalesce("x.code", F.lit(0)).cast("string")), F.col("x.message"), severity, F.col("x.line"), F.col("x.endLine"))


def tflint(outputs: DataFrame) -> DataFrame:
    rows = _items(outputs, "struct<issues:array<struct<rule:struct<name:string,severity:string>,message:string,range:struct<filename:string,start:struct<line:int>,end:struct<line:int>>>>>", "issues")
    severity = _level(F.coalesce("x.rule.severity", F.lit("warning")), error="high", warning="medium", other="low")
    return _table(rows, "tflint", F.col("x.range.filename"), _named("x.rule.name"), F.col("x.message"), severity, F.col("x.range.start.line"), F.col("x.range.end.line"))


def _lines(outputs: DataFrame) -> DataFrame:
    bare = F.regexp_replace("output", r"\x1b\[[\d;]*m", "")
    return outputs.select("run_id", F.explode(F.split(bare, r"\r?\n")).alias("line"))


def yamllint(outputs: DataFrame) -> DataFrame:
    """``path:line:column: [level] message``; the line is the third part from the end of what stands before the level."""
    rx = r"^(.*?) \[(error|warning)\](.*)$"
    rows = _lines(outputs).filter(F.col("line").rlike(rx))
    g = lambda n: F.regexp_extract("line", rx, n)
    parts = F.split(g(1), ":")
    place = F.when(F.size(parts) >= 3, F.get(parts, F.size(parts) - 3))
    path = F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 3)), ":")
    severity = F.when(g(2) == "error", "high").otherwise("medium")
    rows = _table(rows, "yamllint", path, F.lit("yamllint"), F.trim(g(3)), severity, F.trim(place), F.trim(place))
    return rows.withColumn("evidence", F.array(F.lit("yamllint")))


def hadolint(outputs: DataFrame) -> DataFrame:
    """``path:line rule level: message``."""
    rx = r"^(\S*) (\S+) (\S+) (.*)$"
    rows = _lines(outputs).filter(F.col("line").rlike(rx))
    g = lambda n: F.regexp_extract("line", rx, n)
    place = F.regexp_extract(g(1), r":(\d+)$", 1)
    severity = _level(F.regexp_replace(g(3), ":+$", ""), error="high", warning="medium", other="low")
    return _table(rows, "hadolint", F.regexp_replace(g(1), r":[^:]*$", ""), g(2), g(4), severity, place, place)


def _array(text: str) -> str | None:
    """The first bracket that opens an array of objects, up to the one that closes it."""
    for m in re.finditer(r"\[", text):
        depth, quoted, skip = 0, False, False
        for k in range(m.start(), len(text)):
            ch = text[k]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = ch == "\\", ch != '"'
            elif ch == '"':
                quoted = True
            elif ch in "[{":
                depth += 1
            elif ch in "]}":
                depth -= 1
                if depth == 0:
                    body = text[m.start() : k + 1]
                    if re.match(r"\[\s*(?:\{|\])", body):
                        return body
                    break
    return None


def _load(text: str):
    """Parsed JSON, after repair of bad escapes and control characters if need be; None if it stays unreadable."""
    for candidate in (text, re.sub(r"\\(?![\"\\/bfnrtu])", r"\\\\", text), re.sub(r"[\x00-\x1f]", " ", re.sub(r"\\(?![\"\\/bfnrt]|u[0-9a-fA-F]{4})", r"\\\\", text))):
        try:
            return json.loads(candidate, strict=True)
        except ValueError:
            continue
    return None


def repair(text: str | None) -> list[dict]:
    """Finding objects of a model's answer: fences stripped, the array found, envelopes opened, escapes repaired."""
    if not text:
        return []
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
    bare = re.sub(r"^\s*```[\w]*\s*\n?|\n?\s*```\s*$", "", text)
    doc = _load(bare)
    if isinstance(doc, dict):
        doc = next((doc[k] for full in (True, False) for k in ("findings", "issues", "results") if isinstance(doc.get(k), list) and (doc[k] or not full)), [doc] if "title" in doc else None)
    if not isinstance(doc, list):
        body = _array(bare)
        doc = _load(body) if body else None
    return [x for x in doc if isinstance(x, dict) and isinstance(x.get("title"), str)] if isinstance(doc, list) else []


def _int(value, least: int = 1) -> int:
    try:
        return max(least, int(value))
    except (TypeError, ValueError, OverflowError):
        return least


#: Severity by what models call it (fixed values).
LEVELS = {
    "critical": "critical", "high": "high", "error": "high", "medium": "medium", "warning": "medium", "warn": "medium",
    "low": "low", "note": "low", "info": "info", "suggestion": "info", "hint": "info",
}


def model_answers(outputs: DataFrame) -> DataFrame:
    """Findings of model answers: severity of unknown name is medium, lines are at least 1, confidence in [0, 1] or null."""

    def run(batches):
        for batch in batches:
            rows = []
            for run_id, output in zip(batch["run_id"], batch["output"]):
                for x in repair(output):
                    severity = LEVELS.get(str(x.get("severity", "")).lower(), "medium")
                    first = _int(x.get("line_start", x.get("line")))
                    sure = x.get("confidence")
                    sure = min(1.0, max(0.0, float(sure))) if isinstance(sure, (int, float)) and not isinstance(sure, bool) and sure == sure else None
                    rows.append((run_id, x["title"], str(x.get("description", "")), severity, str(x.get("category", "")), first, max(first, _int(x.get("line_end", first))), sure))
            yield pd.DataFrame(rows, columns=["run_id", "title", "description", "severity", "category", "line_start", "line_end", "confidence"])

    return outputs.select("run_id", "output").mapInPandas(run, "run_id string, title string, description string, severity string, category string, line_start int, line_end int, confidence double")


def usage(payload: Column) -> Column:
    """Tokens of a response in either of two shapes: ``struct<tokens_in, tokens_out, cached>``."""
    get = lambda *paths: F.coalesce(*[F.get_json_object(payload, f"$.usage.{p}").try_cast("bigint") for p in paths], F.lit(0))
    return F.struct(
        get("prompt_tokens", "input_tokens").alias("tokens_in"), get("completion_tokens", "output_tokens").alias("tokens_out"),
        get("prompt_tokens_details.cached_tokens", "input_tokens_details.cached_tokens").alias("cached"),
    )
