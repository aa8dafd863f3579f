"""DuckDB texts that several oracle queries share."""

TAG = r"""CASE WHEN trim({c}) LIKE '{{%' THEN coalesce(nullif(regexp_extract({c}, '"{k}"\s*:\s*"([^"]*)"', 1), ''), regexp_extract({c}, '^\s*\{{\s*"([^"]*)"', 1)) ELSE split_part(trim({c}), ':', 1) END"""


def letters(column: str, key: str) -> str:
    return f"regexp_replace(lower(coalesce({TAG.format(c=column, k=key)}, '')), '[^a-z]', '', 'g')"


VERDICT = f"""CASE {letters('verdict', 'verdict')} WHEN 'tp' THEN 'tp' WHEN 'truepositive' THEN 'tp' WHEN 'fp' THEN 'fp' WHEN 'falsepositive' THEN 'fp'
 WHEN 'partial' THEN 'partial' WHEN 'wontfix' THEN 'wontfix' WHEN 'contextmisleading' THEN 'context_misleading' END"""
TIER = f"""CASE {letters('provenance', 'kind')} WHEN 'postfix' THEN 'post_fix' WHEN 'human' THEN 'human' WHEN 'external' THEN 'external' WHEN 'autocalibrate' THEN 'auto_calibrate' ELSE 'unknown' END"""
AGENT = r"""nullif(regexp_replace(lower(coalesce(nullif(regexp_extract(provenance, '"(?:agent|agent_name)"\s*:\s*"([^"]*)"', 1), ''),
 nullif(regexp_extract(provenance, '(?i)^\s*\{\s*"external"\s*:\s*"([^"]*)"', 1), ''), regexp_extract(provenance, '(?i)^\s*external\s*:(.*)$', 1))), '\s+', '', 'g'), '')"""
BARE_ID = r"""upper(regexp_replace(regexp_replace(finding_id, '(?i)^\W*finding(_?id)?\s*[:=#/]\s*', ''), '[^0-9A-Za-z]', '', 'g'))"""
FID = f"CASE WHEN {BARE_ID} NOT IN ('', 'NA', 'NULL', 'NONE', 'NIL', 'UNKNOWN', 'UNDEFINED', 'TBD', 'TODO') THEN {BARE_ID} END"
US = "CASE WHEN ts IS NULL OR ts > received_at THEN -4611686018427387904 ELSE epoch_us(ts) END"
#: Feedback with one spelling per enum.
FB = f"fb AS (SELECT *, {VERDICT} AS v, {TIER} AS tier, CASE WHEN {TIER} = 'external' THEN {AGENT} END AS agent, {FID} AS fid, {US} AS us FROM feedback)"

COUNTS = ", ".join(f"count(*) FILTER (WHERE v = '{v}') AS n_{v}" for v in ("tp", "fp", "partial", "wontfix", "context_misleading"))
PRECISION = "round(CASE WHEN n_tp + n_partial + n_fp > 0 THEN (n_tp + n_partial) / (n_tp + n_partial + n_fp) ELSE 0 END, 6) AS precision"

LEVELS = ("critical", "high", "medium", "low", "info")
FOUND = "(" + " + ".join(f"coalesce(findings_by_severity.{s}, 0)" for s in LEVELS) + ")"
SUPPRESSED = "coalesce(list_sum(map_values(suppressed_by_rule)), 0)"


def div(a: str, b: str) -> str:
    return f"CASE WHEN {b} IS NULL OR {b} = 0 THEN 0 ELSE ({a}) / ({b}) END"


MEASURES = f"""count(*) AS n_reviews, sum({FOUND})::BIGINT AS n_findings,
 round({div(f'sum({FOUND})', 'sum(files_reviewed)')}, 6)::DOUBLE AS findings_per_file,
 round(CASE WHEN count(lines_added) + count(lines_removed) > 0 AND sum(coalesce(lines_added, 0) + coalesce(lines_removed, 0)) > 0
   THEN sum({FOUND}) * 1000.0 / sum(coalesce(lines_added, 0) + coalesce(lines_removed, 0)) END, 6)::DOUBLE AS findings_per_kloc,
 {', '.join(f'sum(coalesce(findings_by_severity.{s}, 0))::BIGINT AS n_{s}' for s in LEVELS)},
 sum({SUPPRESSED})::BIGINT AS n_suppressed, round({div(f'sum({SUPPRESSED})', f'sum({FOUND}) + sum({SUPPRESSED})')}, 6)::DOUBLE AS suppression_rate,
 (sum(duration_ms) // count(duration_ms))::BIGINT AS avg_duration_ms, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out,
 round({div('sum(tokens_cache_read)', 'sum(tokens_in)')}, 6)::DOUBLE AS cache_hit_rate, count(*) < 5 AS low_sample"""

CATEGORY = """CASE replace(replace(trim(lower({c})), ' ', '-'), '_', '-')
 WHEN 'security' THEN 'security' WHEN 'safety' THEN 'security' WHEN 'correctness' THEN 'correctness' WHEN 'functional-bug' THEN 'correctness' WHEN 'bug' THEN 'correctness'
 WHEN 'logic' THEN 'logic' WHEN 'logic-error' THEN 'logic' WHEN 'concurrency' THEN 'concurrency' WHEN 'reliability' THEN 'reliability'
 WHEN 'resource-lifecycle' THEN 'reliability' WHEN 'resource-management' THEN 'reliability' WHEN 'robustness' THEN 'robustness' WHEN 'compatibility' THEN 'robustness'
 WHEN 'hardware' THEN 'robustness' WHEN 'error-handling' THEN 'error-handling' WHEN 'validation' THEN 'validation' WHEN 'schema-evolution' THEN 'validation'
 WHEN 'data-quality' THEN 'validation' WHEN 'performance' THEN 'performance' WHEN 'complexity' THEN 'performance' ELSE 'maintainability' END"""
NORM = r"trim(lower(regexp_replace(regexp_replace({c}, '^[a-z][a-z0-9]*-[a-z0-9-]*:\s*', ''), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')))"
