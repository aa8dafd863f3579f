"""Schemas that drift between the files of append-only JSON logs.

``observe`` catalogues which field occurs with which JSON types in which file;
``islands`` turns that into lifespans (runs of consecutive files in which a
field keeps its types) and the cast that brings each to the common schema;
``changes`` lists every start, end, renaming and change of type;
``consistent`` reads all lines into one table of all catalogued fields, by the
same casts.

Everything is a scan with a partial aggregation by (log, file, field), then
windows over that catalogue, whose size follows files and fields, not lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import VERDICTS, annotator, provenance_kind, verdict
from ..storage import materialize

#: Names under which producers write a field, by the field's common name (fixed values).
ALIASES = {
    "file_path": ("file", "location"),
    "finding_title": ("headline", "issue_title"),
    "finding_category": ("category", "topic"),
    "verdict": ("outcome", "judgement"),
    "reason": ("note", "rationale"),
    "ts": ("timestamp_utc", "recorded"),
    "provenance": ("origin", "verdict_source"),
    "model": ("llm", "review_model"),
    "confidence": ("certainty", "conf"),
    "finding_id": ("fid", "finding_ulid"),
    "agent": ("bot", "reviewer"),
    "agent_model": ("bot_model",),
    "input_severity": ("severity_in",),
    "output_severity": ("severity_out",),
    "tp_weight": ("w_tp", "confirm_weight"),
    "provenance.commit_sha": ("provenance.sha",),
    "provenance.repo": ("provenance.project",),
    "provenance.review_model": ("provenance.model",),
    "provenance.tool_version": ("provenance.version",),
}

#: JSON types as bits of a set.
TYPES = {"string": 1, "number": 2, "boolean": 4, "object": 8, "array": 16}

#: Type of each field in the common table where it isn't string.
TARGETS = {
    "ts": "timestamp",
    "confidence": "double",
    "tp_weight": "double",
    "fp_weight": "double",
    "wontfix_weight": "double",
    "soft_fp_weight": "double",
    "provenance.dirty": "boolean",
}

#: Columns that the common table always has, in this order; further catalogued fields follow.
CORE = (
    "file_path", "finding_title", "finding_category", "reason", "rule_id", "fp_kind", "finding_id", "agent", "agent_model", "input_severity", "output_severity",
    "confidence", "tp_weight", "fp_weight", "wontfix_weight", "soft_fp_weight", "verdict", "model", "ts", "provenance_kind", "annotator", "commit_sha", "repo", "tool_version",
)
#: Most fields of one catalogue; each becomes a column or a part of one.
MOST_FIELDS = 2_000


def canonical(field: Column) -> Column:
    """Common name of a field: from the alias table, else the name itself in snake case."""
    snake = F.lower(F.regexp_replace(F.regexp_replace(field, r"([a-z0-9])([A-Z])", "$1_$2"), "-", "_"))
    pairs = [F.lit(x) for name, others in ALIASES.items() for o in others for x in (o, name)]
    return F.coalesce(F.element_at(F.create_map(*pairs), snake), snake)


def is_object(line: Column) -> Column:
    """Whether a line is one whole JSON object; white space around it is allowed, anything else isn't."""
    bare = F.regexp_replace(line, r"^\s+|\s+$", "")
    return F.coalesce(
        bare.startswith("{") & bare.endswith("}") & (F.json_array_length(F.concat(F.lit("["), bare, F.lit("]"))) == 1) & F.try_parse_json(bare).isNotNull(),
        F.lit(False),
    )


def _type_bit(schema: Column) -> Column:
    return (
        F.when(schema.startswith("OBJECT"), TYPES["object"])
        .when(schema.startswith("ARRAY"), TYPES["array"])
        .when(schema == "STRING", TYPES["string"])
        .when(schema == "BOOLEAN", TYPES["boolean"])
        .when(schema == "VOID", 0)
        .otherwise(TYPES["number"])
    )


def type_names(bits: Column) -> Column:
    """``number|string`` for a set of type bits; '' for the empty set."""
    names = F.array(*[F.when(bits.bitwiseAND(F.lit(b)) != 0, n) for n, b in sorted(TYPES.items())])
    return F.array_join(names, "|")


def observe(raw: DataFrame, nested: str = "provenance", nested_logs: str = "trace") -> DataFrame:
    """Catalogue: ``log_name, file_no, field, types, n, n_null`` over all whole JSON objects.

    Members of ``nested``, where it is an object, are fields of logs whose
    name starts with ``nested_logs``. ``types`` is a set of type bits of the
    non-null values.
    """
    spark = raw.sparkSession
    lines = raw.filter(is_object(F.col("line_text"))).select("log_name", "file_no", F.try_parse_json("line_text").alias("doc"))
    top = spark.sql("SELECT log_name, file_no, e.key AS field, e.value AS value FROM {lines}, LATERAL variant_explode(doc) e", lines=lines)
    inner = lines.filter(F.col("log_name").startswith(nested_logs)).select("log_name", "file_no", F.expr(f"try_variant_get(doc, '$.{nested}', 'variant')").alias("doc"))
    inner = inner.filter(F.schema_of_variant("doc").startswith("OBJECT"))
    members = spark.sql(
        f"SELECT log_name, file_no, concat('{nested}.', e.key) AS field, e.value AS value FROM {{inner}}, LATERAL variant_explode(doc) e", inner=inner
    )
    bit = _type_bit(F.schema_of_variant("value"))
    return (
        top.unionByName(members)
        .select("log_name", "file_no", "field", bit.alias("bit"))
        .groupBy("log_name", "file_no", "field")
        .agg(F.bit_or("bit").alias("types"), F.count("*").alias("n"), F.count_if(F.col("bit") == 0).alias("n_null"))
    )


def _placed(raw: DataFrame, nested: str, nested_logs: str) -> DataFrame:
    """The catalogue with each file's place in its log and what lies beside it."""
    seen = materialize(observe(raw, nested, nested_logs), "fields")
    whole = seen.filter((F.col("field") == nested) & (F.col("types") == TYPES["object"]) & (F.col("n_null") == 0)).select("log_name", "file_no", F.lit(True).alias("whole"))
    of_log = Window.partitionBy("log_name").orderBy("file_no")
    files = (
        raw.select("log_name", "file_no")
        .distinct()
        .join(whole, ["log_name", "file_no"], "left")
        .select(
            "log_name",
            "file_no",
            F.row_number().over(of_log).alias("place"),
            F.lead("file_no").over(of_log).alias("next_file"),
            F.coalesce("whole", F.lit(False)).alias("whole"),
        )
        .withColumns({
            "whole_before": F.coalesce(F.lag("whole").over(of_log), F.lit(False)),
            "whole_after": F.coalesce(F.lead("whole").over(of_log), F.lit(False)),
        })
    )
    span = Window.partitionBy("log_name", "field").orderBy("place")
    return seen.join(files, ["log_name", "file_no"]).withColumns({
        "is_member": F.col("field").contains("."),
        "place_before": F.lag("place").over(span),
        "types_before": F.lag("types").over(span),
        "place_after": F.lead("place").over(span),
    })


def islands(raw: DataFrame, nested: str = "provenance", nested_logs: str = "trace") -> DataFrame:
    """Lifespans: ``log_name, field, common_name, types, first_file, last_file, n_files, cast``.

    A lifespan is a run of consecutive files of a log in which the field has
    the same types. ``cast`` is the expression that reads it into the common table.
    """
    span = Window.partitionBy("log_name", "field").orderBy("place")
    starts = F.col("place_before").isNull() | (F.col("place_before") != F.col("place") - 1) | (F.col("types_before") != F.col("types"))
    common = canonical(F.col("field"))
    text = F.concat(F.lit("get_json_object(line_text, '$."), F.col("field"), F.lit("')"))
    shaped = {n: F.replace(F.lit(_cast("{text}", n)), F.lit("{text}"), text) for n in TARGETS}
    cast = reduce(lambda rest, n: F.when(common == n, shaped[n]).otherwise(rest), TARGETS, text)
    return (
        _placed(raw, nested, nested_logs)
        .withColumn("island", F.sum(starts.cast("int")).over(span))
        .groupBy("log_name", "field", "island")
        .agg(F.first("types").alias("bits"), F.min("file_no").alias("first_file"), F.max("file_no").alias("last_file"), F.count("*").alias("n_files"))
        .select(
            "log_name",
            "field",
            common.alias("common_name"),
            type_names(F.col("bits")).alias("types"),
            "first_file",
            "last_file",
            "n_files",
            F.concat(cast, F.lit(" AS `"), common, F.lit("`")).alias("cast"),
        )
    )


def changes(raw: DataFrame, nested: str = "provenance", nested_logs: str = "trace") -> DataFrame:
    """``log_name, file_no, field_name, new_name, change_kind`` of each file against the previous file of its log.

    A field that goes and one that comes in the same file make one ``renamed``
    row if they have the same common name; several such pairs are matched in
    order of name. Members of ``nested`` count only between files in which
    ``nested`` is an object in every line that has it. Files are ordered by
    number; a file without any whole JSON object has no fields. Repeated lines
    change nothing; null or blank lines don't count; an empty table gives an
    empty result, and so does a log of one file.
    """
    placed = _placed(raw, nested, nested_logs)
    here = ~F.col("is_member") | (F.col("whole") & F.col("whole_before"))
    there = ~F.col("is_member") | (F.col("whole") & F.col("whole_after"))
    adjoins = F.col("place_before").eqNullSafe(F.col("place") - 1)
    events = F.array_compact(F.array(
        F.when((F.col("place") > 1) & ~adjoins & here, F.struct(F.col("file_no").alias("at"), F.lit("added").alias("kind"))),
        F.when(adjoins & (F.col("types") != F.col("types_before")) & here, F.struct(F.col("file_no").alias("at"), F.lit("retyped").alias("kind"))),
        F.when(F.col("next_file").isNotNull() & ~F.col("place_after").eqNullSafe(F.col("place") + 1) & there, F.struct(F.col("next_file").alias("at"), F.lit("removed").alias("kind"))),
    ))
    found = placed.select("log_name", "field", F.explode(events).alias("e")).select("log_name", F.col("e.at").alias("file_no"), "field", F.col("e.kind").alias("kind"))
    slot = Window.partitionBy("log_name", "file_no", "kind", "common").orderBy("field")
    moved = (
        found.filter("kind != 'retyped'")
        .withColumn("common", canonical(F.col("field")))
        .withColumn("slot", F.row_number().over(slot))
        .groupBy("log_name", "file_no", "common", "slot")
        .agg(F.max(F.when(F.col("kind") == "removed", F.col("field"))).alias("old"), F.max(F.when(F.col("kind") == "added", F.col("field"))).alias("new"))
        .select(
            "log_name",
            "file_no",
            F.coalesce("old", "new").alias("field_name"),
            F.when(F.col("old").isNotNull(), F.coalesce("new", F.lit(""))).otherwise("").alias("new_name"),
            F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("renamed").alias("change_kind"),
        )
    )
    retyped = found.filter("kind = 'retyped'").select("log_name", "file_no", F.col("field").alias("field_name"), F.lit("").alias("new_name"), F.col("kind").alias("change_kind"))
    return moved.unionByName(retyped)


def _cast(text: str, common: str) -> str:
    """SQL that reads a field's text into the type of its common name, null where that fails."""
    target = TARGETS.get(common, "string")
    if target == "timestamp":  # ISO text, epoch milliseconds, or an object of seconds and microseconds
        part = lambda k: f"try_cast(get_json_object({text}, '$.{k}') AS bigint)"
        micros = f"try_add(try_multiply({part('s')}, 1000000L), coalesce({part('us')}, 0L))"
        return f"coalesce(timestamp_micros({micros}), CASE WHEN {text} RLIKE '^[0-9]{{1,15}}$' THEN timestamp_millis(try_cast({text} AS bigint)) END, try_to_timestamp({text}))"
    return text if target == "string" else f"try_cast({text} AS {target})"


def _verdict(text: Column) -> Column:
    """A verdict from any encoding, its number in the order of declaration included."""
    numbered = F.coalesce(*[F.when(text == str(n), name) for n, name in enumerate(VERDICTS[:4])])
    return F.coalesce(verdict(text), numbered)


def _fields(raw: DataFrame, lines: DataFrame, nested: str, nested_logs: str) -> dict[str, list[str]]:
    """The catalogued fields by common name, each name's own spelling first; members of ``nested`` held as text too."""
    inside = lines.filter(F.col("log_name").startswith(nested_logs)).select(F.explode(F.map_keys("members")).alias("member")).select(F.concat(F.lit(f"{nested}."), "member").alias("field"))
    seen = observe(raw, nested, nested_logs).select("field").unionByName(inside).distinct()
    rows = seen.select("field", canonical(F.col("field")).alias("common")).limit(MOST_FIELDS + 1).collect()
    if len(rows) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} fields")
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["common"], r["field"] != r["common"], r["field"])):
        out.setdefault(r["common"], []).append(r["field"])
    return out


def consistent(raw: DataFrame, nested: str = "provenance", nested_logs: str = "trace") -> DataFrame:
    """All whole JSON objects as one table with common names and types.

    Columns: ``CORE``, then every further common name of the catalogue (members
    of ``nested`` as ``provenance_x``), typed by ``TARGETS``, else as text.
    Members of ``nested`` are read from an object and from a string that holds
    one. ``raw_values`` is a JSON object of the texts that the columns don't
    hold, by field: those that can't be read in their type, verdicts and models
    with more than their name, and a second spelling with another value.
    Lines that aren't whole objects are left out.
    """
    lines = raw.filter(is_object(F.col("line_text"))).select("log_name", "file_no", "line_no", F.from_json("line_text", "map<string,string>").alias("fields"))
    origin = F.coalesce(*[F.col("fields")[f] for f in (nested, *ALIASES.get(nested, ()))])
    lines = lines.withColumn("members", F.when(origin.rlike(r"^\s*\{"), F.from_json(origin, "map<string,string>")))
    fields = _fields(raw, lines, nested, nested_logs)

    reads, held, extra = {}, {}, []
    for common, spellings in fields.items():
        for f in spellings:
            place = f"members['{_quoted(f[len(nested) + 1 :])}']" if f.startswith(f"{nested}.") else f"fields['{_quoted(f)}']"
            text, value, k = F.expr(place), F.expr(_cast(place, common)), len(reads) // 2
            if common == "verdict":
                value = _verdict(text)
            elif common == "model":
                value = F.coalesce(F.get_json_object(text, "$.name"), F.when(~text.startswith("{"), text))
            reads |= {f"text{k}": text, f"value{k}": value}
            before = held.setdefault(common, [])
            lost = F.col(f"value{k}").isNull()
            if before:
                lost |= F.coalesce(*before) != F.col(f"value{k}")
            if common == "verdict":
                lost |= F.col(f"text{k}").startswith("{") & ~F.col(f"text{k}").rlike(r'^\{\s*"[^"]*"\s*:\s*\{\s*\}\s*\}$')
            elif common == "model":
                lost |= F.col(f"text{k}").startswith("{")
            extra.append((f, F.when(lost, F.col(f"text{k}"))))
            before.append(F.col(f"value{k}"))

    column = {common: F.coalesce(*values) for common, values in held.items()}
    source = column.pop(nested, F.lit(None).cast("string"))
    typed = lambda n: F.lit(None).cast(TARGETS.get(n, "string"))
    out = {n: column.pop(n, typed(n)) for n in CORE if n not in ("provenance_kind", "annotator", "commit_sha", "repo", "tool_version")}
    out |= {"provenance_kind": F.when(source.isNotNull(), provenance_kind(source)), "annotator": annotator(source)}
    out |= {n: column.pop(f"{nested}.{n}", typed(n)) for n in ("commit_sha", "repo", "tool_version")}
    out[nested] = source
    for n, c in sorted(column.items()):
        n = n.replace(".", "_")
        while n in out or n in ("log_name", "file_no", "line_no", "raw_values"):
            n += "_2"
        out[n] = c
    kept = F.map_filter(F.map_from_arrays(F.array(*[F.lit(f) for f, _ in extra]), F.array(*[c for _, c in extra])), lambda _, v: v.isNotNull()) if extra else F.lit(None).cast("map<string,string>")
    return lines.select("log_name", "file_no", "line_no", *[c.alias(n) for n, c in reads.items()]).select(
        "log_name", "file_no", "line_no", *[c.alias(n) for n, c in out.items()], F.when(F.size(kept) > 0, F.to_json(kept)).alias("raw_values")
    )


def _quoted(field: str) -> str:
    return field.replace("\\", "\\\\").replace("'", "\\'")


def oracle_changes() -> str:
    """The SQL of ``changes`` for DuckDB."""
    rows = ", ".join(f"('{o}', '{name}')" for name, others in ALIASES.items() for o in others)
    kinds = "CASE WHEN t IN ('OBJECT') THEN 'object' WHEN t = 'ARRAY' THEN 'array' WHEN t = 'VARCHAR' THEN 'string' WHEN t = 'BOOLEAN' THEN 'boolean' WHEN t = 'NULL' THEN NULL ELSE 'number' END"
    return f"""
WITH alias(other, common) AS (VALUES {rows}),
docs AS (SELECT log_name, file_no, line_no, line_text::JSON AS j FROM (SELECT * FROM raw_lines WHERE CASE WHEN json_valid(line_text) THEN json_type(line_text) = 'OBJECT' ELSE false END)),
pairs AS (
  SELECT log_name, file_no, k AS field, json_type(j, '$."' || k || '"') AS t FROM (SELECT *, unnest(json_keys(j)) AS k FROM docs)
  UNION ALL
  SELECT log_name, file_no, 'provenance.' || k, json_type(j, '$.provenance."' || k || '"')
  FROM (SELECT *, unnest(json_keys(j, '$.provenance')) AS k FROM docs WHERE log_name LIKE 'trace%' AND json_type(j, '$.provenance') = 'OBJECT')),
seen AS (
  SELECT log_name, file_no, field, string_agg(DISTINCT {kinds}, '|' ORDER BY {kinds}) AS types, count(*) FILTER (WHERE t = 'NULL') AS n_null
  FROM pairs GROUP BY ALL),
files AS (
  SELECT *, lag(file_no) OVER (PARTITION BY log_name ORDER BY file_no) AS before
  FROM (SELECT DISTINCT log_name, file_no FROM raw_lines)),
whole AS (SELECT log_name, file_no FROM seen WHERE field = 'provenance' AND types = 'object' AND n_null = 0),
steps AS (
  SELECT f.*, EXISTS (SELECT 1 FROM whole w WHERE w.log_name = f.log_name AND w.file_no = f.file_no)
          AND EXISTS (SELECT 1 FROM whole w WHERE w.log_name = f.log_name AND w.file_no = f.before) AS both_whole
  FROM files f WHERE before IS NOT NULL),
olds AS (SELECT s.log_name, s.file_no, s.both_whole, o.field, o.types FROM steps s JOIN seen o ON o.log_name = s.log_name AND o.file_no = s.before),
news AS (SELECT s.log_name, s.file_no, s.both_whole, n.field, n.types FROM steps s JOIN seen n ON n.log_name = s.log_name AND n.file_no = s.file_no),
diff AS (
  SELECT log_name, file_no, field, coalesce(o.both_whole, n.both_whole) AS ok,
    CASE WHEN n.field IS NULL THEN 'removed' WHEN o.field IS NULL THEN 'added' WHEN coalesce(o.types, '') <> coalesce(n.types, '') THEN 'retyped' END AS kind
  FROM (SELECT *, field AS f2 FROM olds) o FULL JOIN news n USING (log_name, file_no, field)),
events AS (
  SELECT d.log_name, d.file_no, d.field, d.kind, coalesce(a.common, d.field) AS common,
    row_number() OVER (PARTITION BY d.log_name, d.file_no, d.kind, coalesce(a.common, d.field) ORDER BY d.field) AS slot
  FROM diff d LEFT JOIN alias a ON a.other = d.field
  WHERE d.kind IS NOT NULL AND (d.field NOT LIKE '%.%' OR d.ok)),
moved AS (
  SELECT log_name, file_no, max(field) FILTER (WHERE kind = 'removed') AS old, max(field) FILTER (WHERE kind = 'added') AS new
  FROM events WHERE kind <> 'retyped' GROUP BY log_name, file_no, common, slot)
SELECT log_name, file_no, coalesce(old, new) AS field_name, CASE WHEN old IS NOT NULL THEN coalesce(new, '') ELSE '' END AS new_name,
  CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'renamed' END AS change_kind FROM moved
UNION ALL
SELECT log_name, file_no, field, '', 'retyped' FROM events WHERE kind = 'retyped'
"""
