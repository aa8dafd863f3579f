"""Queries of the core over whole tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embedding, numbers, prompt, text
from ..functions.records import annotator, provenance_kind, verdict
from ..operators import calibration, context, corpus_join, curves, documents, hydration, kpi, merging, retrieval, scanning, schema_drift, trends
from ..sources import logs, tools
from ..storage import materialize, shared_dir, table
from ..streaming import inbox
from . import sql as S

Query = Callable[[SparkSession, str], DataFrame]

#: The time from which ages are counted: 2026-01-01, in microseconds.
NOW_US = 1_767_225_600_000_000

RULES = [
    {"pattern": "unwraps the", "file": "**/*.rs"},
    {"pattern": "cyclomatic complexity", "category": "complexity"},
    {"pattern": "race on the shared"},
    {"pattern": "Doc comment", "file": "src/*/*.py"},
]

_SQL: dict[str, str] = {}
_QUERIES: dict[str, Query] = {}


def _add(name: str, query: Query, oracle: str | None = None) -> None:
    _QUERIES[name] = query
    if oracle:
        _SQL[name] = oracle


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- figures -----------------------------------------------------------------------

_add("verdict_precision_by_source", lambda s, d: kpi.verdicts_by_model(table(s, d, "feedback")),
     f"WITH {S.FB}, g AS (SELECT lower(coalesce(model, 'unknown')) AS model, count(*) AS n_rows, {S.COUNTS} FROM fb GROUP BY 1) SELECT *, {S.PRECISION} FROM g")
_add("tier_rollup_by_agent", lambda s, d: kpi.tier_rollup(table(s, d, "feedback")),
     f"""WITH {S.FB}, g AS (SELECT 'tier' AS level, tier, '' AS agent, count(*) AS n_rows, {S.COUNTS} FROM fb GROUP BY tier
 UNION ALL SELECT 'agent', tier, coalesce(agent, '(none)'), count(*), {S.COUNTS} FROM fb WHERE tier = 'external' GROUP BY ALL) SELECT *, {S.PRECISION} FROM g""")
_add("fp_kind_utilization", lambda s, d: kpi.fp_kind_utilization(table(s, d, "feedback")),
     rf"""WITH {S.FB}, g AS (SELECT count(*) AS n_fp, count(*) FILTER (WHERE regexp_matches(fp_kind, '\S')) AS n_tagged FROM fb WHERE v = 'fp') SELECT *, round(n_tagged / nullif(n_fp, 0), 6) AS utilization FROM g""")
_add("linkage_stats", lambda s, d: kpi.linkage(table(s, d, "feedback"), table(s, d, "reviews")),
     f"""WITH {S.FB}, k AS (SELECT DISTINCT unnest(finding_ids) AS known FROM reviews), g AS (SELECT count(*) AS n_rows, count(known) AS n_linked FROM fb LEFT JOIN k ON fid = known WHERE tier IN ('human', 'post_fix'))
 SELECT *, round({S.div('n_linked', 'n_rows')}, 6)::DOUBLE AS rate FROM g""")
_add("external_overlap", lambda s, d: kpi.external_overlap(table(s, d, "feedback")),
     f"""WITH {S.FB}, h AS (SELECT fid, arg_max(v, seq) AS human_v FROM fb WHERE tier = 'human' AND fid IS NOT NULL AND v IS NOT NULL GROUP BY 1),
 g AS (SELECT coalesce(agent, '(none)') AS agent, count(*) AS n_external, count(human_v) AS n_overlap,
  count(*) FILTER (WHERE (v IN ('tp', 'partial') AND human_v IN ('tp', 'partial')) OR (v = 'fp' AND human_v = 'fp')) AS n_agree FROM fb LEFT JOIN h USING (fid) WHERE tier = 'external' GROUP BY 1)
 SELECT *, round({S.div('n_agree', 'n_overlap')}, 6)::DOUBLE AS agreement FROM g""")
_add("slice_by_repo", lambda s, d: kpi.slice_by(table(s, d, "reviews"), "repo"),
     f"WITH g AS (SELECT repo AS k, {S.MEASURES} FROM reviews GROUP BY repo) SELECT coalesce(k, '(no repo)') AS repo, k IS NULL AS is_missing, * EXCLUDE (k) FROM g")
_add("slice_by_caller", lambda s, d: kpi.slice_by(table(s, d, "reviews"), "invoked_from", "(unknown)"),
     f"WITH g AS (SELECT invoked_from AS k, {S.MEASURES} FROM reviews GROUP BY invoked_from) SELECT coalesce(k, '(unknown)') AS invoked_from, k IS NULL AS is_missing, * EXCLUDE (k) FROM g")
_add("slice_by_rule_exploded", lambda s, d: kpi.slice_by_rule(table(s, d, "reviews")),
     f"SELECT rule, {S.MEASURES} FROM (SELECT *, unnest(map_keys(suppressed_by_rule)) AS rule FROM reviews) GROUP BY rule")
_add("severity_histogram", lambda s, d: kpi.severity_histogram(table(s, d, "reviews")),
     "SELECT severity, rank, sum(n)::BIGINT AS n, count(*) FILTER (WHERE n > 0) AS n_reviews FROM (" + " UNION ALL ".join(f"SELECT '{x}' AS severity, {4 - i} AS rank, coalesce(findings_by_severity.{x}, 0) AS n FROM reviews" for i, x in enumerate(S.LEVELS)) + ") GROUP BY ALL")
_PRICE = {k: "CASE " + " ".join(f"WHEN {'starts_with' if p[0] == 'prefix' else 'contains'}(coalesce(model, ''), '{p[1]}') THEN {p[k]}" for p in __import__("assize.functions.numbers", fromlist=["PRICES"]).PRICES) + f" ELSE {(3.0, 15.0)[k - 2]} END" for k in (2, 3)}
_add("cost_estimate", lambda s, d: kpi.cost_by_model(table(s, d, "reviews")),
     f"WITH g AS (SELECT model, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out FROM reviews GROUP BY 1) SELECT *, round((tokens_in * {_PRICE[2]} + tokens_out * {_PRICE[3]}) / 1e6, 6)::DOUBLE AS cost FROM g")
_add("kpi_recent", lambda s, d: kpi.recent(table(s, d, "reviews"), table(s, d, "feedback")),
     f"""WITH e AS (SELECT max(reviewed_at) AS t FROM reviews), l AS (SELECT r.* FROM reviews r, e WHERE reviewed_at > t - INTERVAL 7 DAY),
 g AS (SELECT count(*) AS n_reviews, sum({S.FOUND})::BIGINT AS n_findings, sum({S.SUPPRESSED})::BIGINT AS n_suppressed, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out FROM l),
 m AS (SELECT model FROM l GROUP BY model ORDER BY count(*) DESC, model LIMIT 1), f AS (SELECT count(*) AS n_feedback FROM feedback, e WHERE ts > t - INTERVAL 7 DAY AND ts <= t)
 SELECT *, round({S.div('n_findings', 'n_reviews')}, 6)::DOUBLE AS findings_per_review, round({S.div('n_suppressed', 'n_findings + n_suppressed')}, 6)::DOUBLE AS suppression_rate,
 round({S.div('tokens_in + tokens_out', 'n_findings')}, 6)::DOUBLE AS tokens_per_finding, round((tokens_in * {_PRICE[2]} + tokens_out * {_PRICE[3]}) / 1e6, 6)::DOUBLE AS cost,
 round(least(1.0, {S.div('n_feedback', 'n_findings')}), 6)::DOUBLE AS capture_rate FROM g, m, f""")
_MISLED = r"""m AS (SELECT unnest(regexp_extract_all(verdict, '"(ck-[^"]*)"', 1)) AS chunk_id FROM feedback WHERE verdict LIKE '{%' AND regexp_matches(verdict, '(?i)context_?misleading'))"""
_add("misleading_chunks", lambda s, d: kpi.misleading_chunks(table(s, d, "feedback")),
     f"WITH {_MISLED} SELECT chunk_id, count(*) AS n, round(CASE WHEN count(*) < 3 THEN 0.2 + count(*) * (1 - 0.2) / 3 END, 6)::DOUBLE AS threshold, count(*) >= 3 AS blocked FROM m GROUP BY 1")
_add("wilson_bounds", lambda s, d: kpi.wilson_by_tier(table(s, d, "feedback")),
     f"""WITH {S.FB}, g AS (SELECT tier, {S.COUNTS} FROM fb GROUP BY tier), h AS (SELECT tier, n_tp + n_partial AS k, n_tp + n_partial + n_fp AS n FROM g), p AS (SELECT *, k / nullif(n, 0) AS p FROM h)
 SELECT tier, k, n, round(coalesce(greatest(0, (p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)), 0), 6)::DOUBLE AS low,
 round(coalesce(least(1, (p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)), 1), 6)::DOUBLE AS high FROM p""")
_add("grounding_counts", lambda s, d: kpi.grounding_counts(table(s, d, "findings")), "SELECT source_kind, coalesce(grounding_status, 'not-checked') AS status, count(*) AS n FROM findings GROUP BY ALL")
_add("score_distribution", lambda s, d: kpi.score_distribution(table(s, d, "findings")),
     "SELECT source_kind, count(*) AS n, round(quantile_disc(confidence::DOUBLE, 0.1), 6) AS p10, round(quantile_cont(confidence::DOUBLE, 0.5), 6) AS median, round(quantile_disc(confidence::DOUBLE, 0.9), 6) AS p90 FROM findings WHERE confidence IS NOT NULL AND NOT isnan(confidence) GROUP BY 1")
_add("exit_codes", lambda s, d: kpi.exit_codes(table(s, d, "findings")),
     "SELECT run_id, count(*) AS n, max(CASE WHEN severity IN ('high', 'critical') THEN 2 WHEN severity = 'medium' THEN 1 ELSE 0 END) AS exit_code FROM findings GROUP BY 1")
_add("top_findings", lambda s, d: kpi.top_findings(table(s, d, "findings")),
     "SELECT run_id, place::INT AS place, id, severity, line_start FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY list_position(['info', 'low', 'medium', 'high', 'critical'], severity) DESC, line_start, id) AS place FROM findings) WHERE place <= 3")
_add("telemetry_fold", lambda s, d: kpi.telemetry_fold(table(s, d, "reviews")),
     """SELECT run_id, count(*) AS n_records, sum(tokens_in)::BIGINT AS tokens_in, bool_or(flags.deep) AS deep, arg_max(model, (received_at, reviewed_at)) AS last_model,
 arg_min(repo, (received_at, reviewed_at)) FILTER (WHERE repo IS NOT NULL) AS first_repo, len(list_distinct(flatten(list(finding_ids)))) AS n_finding_ids FROM reviews GROUP BY 1""")

# -- trends ------------------------------------------------------------------------

_TREND = f"""t AS (SELECT *, min(at_us) OVER () AS first FROM r), w AS (SELECT ((at_us - first) // 604800000000)::BIGINT AS window_no, any_value(first) AS first, count(*) AS n, {S.COUNTS} FROM t GROUP BY 1 HAVING count(*) >= 10)
 SELECT window_no, (first + window_no * 604800000000)::BIGINT AS start_us, n, n_tp + n_partial + n_fp AS denominator, {S.PRECISION} FROM w"""
_add("precision_trend_7d", lambda s, d: trends.precision_trend(table(s, d, "feedback")), f"WITH {S.FB}, r AS (SELECT v, epoch_us(ts) AS at_us FROM fb WHERE ts IS NOT NULL), {_TREND}")
_add("precision_trend_per_finding", lambda s, d: trends.precision_trend_per_finding(table(s, d, "feedback")),
     f"""WITH {S.FB}, o AS (SELECT v, epoch_us(ts) AS at_us, row_number() OVER (PARTITION BY fid ORDER BY tier <> 'human', ts, seq) AS rn FROM fb WHERE fid IS NOT NULL AND ts IS NOT NULL AND tier IN ('human', 'post_fix')),
 r AS (SELECT v, at_us FROM o WHERE rn = 1), {_TREND}""")
_add("rolling_windows_n", lambda s, d: trends.rolling_windows(table(s, d, "reviews")),
     f"""WITH o AS (SELECT *, (row_number() OVER (ORDER BY reviewed_at DESC, run_id DESC, received_at DESC) - 1) // 50 AS w FROM reviews)
 SELECT w::BIGINT AS window_no, CASE WHEN w = 0 THEN 'last 50' WHEN w = 1 THEN 'prev 50' ELSE 'prev ' || (w * 50)::BIGINT END AS label, count(*) AS n_reviews, sum({S.FOUND})::BIGINT AS n_findings,
 round({S.div(f'sum({S.FOUND})', 'sum(files_reviewed)')}, 6)::DOUBLE AS findings_per_file, min(epoch_us(reviewed_at)) AS from_us, max(epoch_us(reviewed_at)) AS to_us FROM o GROUP BY w""")
_SPARK = f"""o AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY reviewed_at, run_id, received_at) AS i, count(*) OVER (PARTITION BY repo) AS total FROM reviews),
 b AS (SELECT repo, ((5 * i - 1) // total)::INT AS bucket, count(*) AS n_reviews, round({S.div(f'sum({S.FOUND})', 'sum(files_reviewed)')}, 6)::DOUBLE AS value FROM o WHERE total >= 5 GROUP BY ALL)"""
_add("sparkline_buckets", lambda s, d: trends.sparklines(table(s, d, "reviews")), f"WITH {_SPARK} SELECT * FROM b")
_add("trend_arrows", lambda s, d: trends.trend_arrows(table(s, d, "reviews")),
     f"""WITH {_SPARK}, e AS (SELECT repo, arg_min(value, bucket) AS f, arg_max(value, bucket) AS l FROM b GROUP BY repo)
 SELECT repo, CASE WHEN (l - f) / greatest(abs(f), 1e-9) > 0.05 THEN 'up' WHEN (l - f) / greatest(abs(f), 1e-9) < -0.05 THEN 'down' ELSE 'flat' END AS arrow FROM e""")

_add("series_glyphs", lambda s, d: trends.sparklines(table(s, d, "reviews")).groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("bucket", "value"))).alias("v")).select("repo", numbers.sparkline(F.col("v.value")).alias("glyphs")),  # five values
     f"""WITH {_SPARK}, m AS (SELECT *, min(value) OVER (PARTITION BY repo) AS lo, max(value) OVER (PARTITION BY repo) AS hi FROM b)
 SELECT repo, string_agg(substr('▁▂▃▄▅▆▇█', CASE WHEN hi > lo THEN round((value - lo) / (hi - lo) * 7)::INT ELSE 0 END + 1, 1), '' ORDER BY bucket) AS glyphs FROM m GROUP BY repo""")
_add("context_sparkline", lambda s, d: trends.context_sparklines(table(s, d, "reviews"), "repo", "files_reviewed"),
     """WITH o AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY reviewed_at, run_id, received_at) AS i, count(*) OVER (PARTITION BY repo) AS total FROM reviews),
 k AS (SELECT *, unnest(range(5)) AS bucket FROM o)
 SELECT repo, bucket::INT AS bucket, count(*) AS n_reviews, round(avg(coalesce(files_reviewed, 0)), 6) AS value FROM k
 WHERE i > bucket * total // 5 AND i <= least(total, greatest((bucket + 1) * total // 5, bucket * total // 5 + 1)) GROUP BY ALL""")
_add("last_reviews", lambda s, d: trends.last_n(table(s, d, "reviews"), 50).select("run_id", numbers.micros(F.col("received_at")).alias("received_us")),
     "SELECT run_id, epoch_us(received_at) AS received_us FROM reviews ORDER BY reviewed_at DESC, run_id DESC, received_at DESC LIMIT 50")
_add("repos_by_count", lambda s, d: kpi.by_count(table(s, d, "reviews"), "repo"),
     "SELECT repo, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, repo NULLS LAST)::INT AS place FROM reviews GROUP BY repo")

# -- curves and thresholds ---------------------------------------------------------------


def _samples(s: SparkSession, d: str) -> DataFrame:
    """Confirmed findings against their confidence."""
    rows = table(s, d, "findings").filter("calibrator_action IS NOT NULL")
    return rows.select(F.col("confidence").cast("double").alias("score"), (F.col("calibrator_action") == "confirmed").alias("positive"))


_CURVE = """s AS (SELECT confidence::DOUBLE AS score, calibrator_action = 'confirmed' AS positive FROM findings WHERE calibrator_action IS NOT NULL AND confidence IS NOT NULL AND NOT isnan(confidence)),
 p AS (SELECT round(score, 12) AS threshold, count(*) FILTER (WHERE positive) AS tp, count(*) FILTER (WHERE NOT positive) AS fp FROM s GROUP BY 1),
 k AS (SELECT threshold, sum(tp) OVER (ORDER BY threshold DESC) AS n_tp, sum(fp) OVER (ORDER BY threshold DESC) AS n_fp, sum(tp) OVER () AS all_tp FROM p),
 c AS (SELECT threshold, round(n_tp / (n_tp + n_fp), 6)::DOUBLE AS precision, round(n_tp / all_tp, 6)::DOUBLE AS recall, n_tp::BIGINT AS n_tp, n_fp::BIGINT AS n_fp FROM k WHERE all_tp > 0)"""
_add("pr_curve", lambda s, d: curves.pr_curve(_samples(s, d)), f"WITH {_CURVE} SELECT * FROM c")
_add("threshold_at_precision", lambda s, d: curves.threshold_at_precision(curves.pr_curve(_samples(s, d)), 0.5), f"WITH {_CURVE} SELECT round(min(threshold) FILTER (WHERE precision >= 0.5), 6) AS threshold FROM c")
_add("f1_threshold", lambda s, d: curves.f1_threshold(curves.pr_curve(_samples(s, d))),
     f"WITH {_CURVE}, f AS (SELECT *, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM c) SELECT round(threshold, 6) AS threshold, f1, precision, recall FROM f ORDER BY f1 DESC, threshold LIMIT 1")
_MIRROR = _CURVE.replace("s AS (SELECT confidence::DOUBLE AS score, calibrator_action = 'confirmed' AS positive", "s AS (SELECT 1 - confidence::DOUBLE AS score, calibrator_action <> 'confirmed' AS positive").replace("c AS (", "mc AS (").replace(" p AS (", " mp AS (").replace("FROM p)", "FROM mp)").replace(" k AS (", " mk AS (").replace("FROM k ", "FROM mk ").replace("s AS (SELECT 1", "ms AS (SELECT 1").replace("FROM s GROUP", "FROM ms GROUP")
_add("thresholds", lambda s, d: curves.thresholds(_samples(s, d), 0.5, 0.5),
     f"""WITH {_CURVE}, {_MIRROR}, n AS (SELECT count(*) AS n, count(*) FILTER (WHERE positive) AS n_positive FROM s),
 t AS (SELECT n, n_positive, CASE WHEN n >= 20 AND n_positive >= 10 THEN (SELECT round(min(threshold) FILTER (WHERE precision >= 0.5), 6) FROM c) END AS up,
  CASE WHEN n >= 20 AND n - n_positive >= 10 THEN 1 - (SELECT round(min(threshold) FILTER (WHERE precision >= 0.5), 6) FROM mc) END AS down FROM n)
 SELECT n, n_positive, round(CASE WHEN NOT (coalesce(down >= up, false) AND n - n_positive < n_positive) THEN down END, 6) AS suppress,
  round(CASE WHEN NOT (coalesce(down >= up, false) AND n - n_positive >= n_positive) THEN up END, 6) AS boost FROM t""")

# -- joins -------------------------------------------------------------------------

_T = S.NORM.format(c="finding_title")
_JOIN = rf"""{S.FB},
 t AS (SELECT finding_title AS title, coalesce(file_path, '') AS path, {_T} AS norm, greatest(coalesce(tp_weight, 0), 0) AS tp_w, greatest(coalesce(fp_weight, 0), 0) AS fp_w FROM traces WHERE finding_title <> ''),
 f AS (SELECT seq, v <> 'fp' AS positive, finding_title AS title, coalesce(file_path, '') AS path, {_T} AS norm FROM fb WHERE v IN ('tp', 'partial', 'fp') AND finding_title <> ''),
 k1 AS (SELECT title, path, any_value(tp_w) / nullif(any_value(tp_w) + any_value(fp_w), 0) AS s1 FROM t WHERE path <> '' GROUP BY ALL HAVING count(*) = 1),
 k2 AS (SELECT norm, path, any_value(tp_w) / nullif(any_value(tp_w) + any_value(fp_w), 0) AS s2 FROM t WHERE path <> '' AND norm <> '' GROUP BY ALL HAVING count(*) = 1),
 k4 AS (SELECT title, any_value(tp_w) / nullif(any_value(tp_w) + any_value(fp_w), 0) AS s4 FROM t WHERE path = '' AND title NOT IN (SELECT title FROM t WHERE path <> '') GROUP BY ALL HAVING count(*) = 1),
 k5 AS (SELECT norm, any_value(tp_w) / nullif(any_value(tp_w) + any_value(fp_w), 0) AS s5 FROM t WHERE path = '' AND norm <> '' AND norm NOT IN (SELECT norm FROM t WHERE path <> '') GROUP BY ALL HAVING count(*) = 1),
 fw AS (SELECT DISTINCT path, norm, list_distinct(list_filter(string_split(norm, ' '), lambda x: x <> '')) AS ws FROM f WHERE path <> '' AND norm <> ''),
 tw AS (SELECT path, norm, tp_w, fp_w, list_distinct(list_filter(string_split(norm, ' '), lambda x: x <> '')) AS ws FROM t WHERE path <> '' AND norm <> ''),
 j AS (SELECT fw.path, fw.norm, tw.tp_w, tw.fp_w, tw.norm AS cand, len(list_intersect(fw.ws, tw.ws)) / (len(fw.ws) + len(tw.ws) - len(list_intersect(fw.ws, tw.ws))) AS j FROM fw JOIN tw USING (path)),
 r AS (SELECT *, row_number() OVER (PARTITION BY path, norm ORDER BY j DESC, cand) AS rn, lead(j) OVER (PARTITION BY path, norm ORDER BY j DESC, cand) AS second FROM j),
 k3 AS (SELECT path, norm, j AS best, coalesce(second, 0) AS second, tp_w / nullif(tp_w + fp_w, 0) AS s3 FROM r WHERE rn = 1),
 a AS (SELECT f.seq, f.positive, f.norm, s1, s2, s3, s4, s5, best, second, CASE WHEN s1 IS NOT NULL THEN 'exact_raw' WHEN s2 IS NOT NULL THEN 'exact_normalized'
   WHEN best >= 0.5 AND NOT (best - second >= 0.1) THEN 'ambiguous_skipped' WHEN best >= 0.5 AND s3 IS NOT NULL THEN 'fuzzy_same_file' WHEN s4 IS NOT NULL THEN 'raw_title_only' WHEN s5 IS NOT NULL THEN 'normalized_title_only'
   WHEN best < 0.5 THEN 'below_threshold' ELSE 'unmatched' END AS tier
  FROM f LEFT JOIN k1 USING (title, path) LEFT JOIN k2 ON k2.norm = f.norm AND k2.path = f.path LEFT JOIN k3 ON k3.norm = f.norm AND k3.path = f.path LEFT JOIN k4 ON k4.title = f.title LEFT JOIN k5 ON k5.norm = f.norm)"""
_add("corpus_join_samples", lambda s, d: corpus_join.corpus_join(table(s, d, "feedback"), table(s, d, "traces")),
     f"WITH {_JOIN} SELECT seq, positive, tier, round(CASE tier WHEN 'exact_raw' THEN s1 WHEN 'exact_normalized' THEN s2 WHEN 'fuzzy_same_file' THEN s3 WHEN 'raw_title_only' THEN s4 WHEN 'normalized_title_only' THEN s5 END, 6) AS score FROM a")
_add("corpus_join_stats", lambda s, d: corpus_join.join_stats(table(s, d, "feedback"), table(s, d, "traces")), f"WITH {_JOIN} SELECT tier, count(*) AS n, count(*) FILTER (WHERE positive) AS n_positive FROM a GROUP BY tier")
_add("backfill_paths", lambda s, d: corpus_join.backfill_paths(table(s, d, "traces"), table(s, d, "feedback")),
     rf"""WITH f AS (SELECT finding_title AS title, {_T} AS norm, file_path FROM feedback WHERE finding_title <> '' AND file_path <> ''),
 e AS (SELECT title, min(file_path) AS p1, count(DISTINCT file_path) AS n1 FROM f GROUP BY 1), n AS (SELECT norm, min(file_path) AS p2, count(DISTINCT file_path) AS n2 FROM f WHERE norm <> '' GROUP BY 1),
 t AS (SELECT trace_no, coalesce(file_path, '') AS path, coalesce(finding_title, '') AS title, {S.NORM.format(c="coalesce(finding_title, '')")} AS norm, list_distinct(list_filter(list_transform(coalesce(matched_precedents, []), lambda p: p.file_path), lambda x: x IS NOT NULL AND x <> '')) AS own FROM traces),
 a AS (SELECT *, CASE WHEN path <> '' THEN 'already_present' WHEN title = '' THEN 'no_match' WHEN n1 = 1 THEN 'feedback_exact' WHEN n2 = 1 THEN 'feedback_normalized' WHEN len(own) = 1 THEN 'precedent_inferred' WHEN n1 > 1 OR n2 > 1 THEN 'ambiguous' ELSE 'no_match' END AS source FROM t LEFT JOIN e USING (title) LEFT JOIN n ON n.norm = t.norm)
 SELECT trace_no, CASE source WHEN 'already_present' THEN path WHEN 'feedback_exact' THEN p1 WHEN 'feedback_normalized' THEN p2 WHEN 'precedent_inferred' THEN own[1] END AS filled_path, source FROM a""")
_add("suppression_apply", lambda s, d: corpus_join.suppress(table(s, d, "findings"), RULES).select("id", "rule_no"),
     f"""SELECT id, CASE WHEN contains(lower(title), 'unwraps the') AND coalesce(regexp_matches(file_path, '^(?:.*/)?[^/]*\\.rs$'), false) THEN 1
 WHEN contains(lower(title), 'cyclomatic complexity') AND {S.CATEGORY.format(c='category')} = 'performance' THEN 2 WHEN contains(lower(title), 'race on the shared') THEN 3
 WHEN contains(lower(title), 'doc comment') AND coalesce(regexp_matches(file_path, '^src/[^/]*/[^/]*\\.py$'), false) THEN 4 END AS rule_no FROM findings""")

# -- retrieval ---------------------------------------------------------------------


def _doc_terms(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), retrieval.terms(F.col("text")).alias("terms"))
    asked = docs.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "terms")
    return asked, docs


_BM25 = r"""d AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_:$]+') AS terms FROM documents),
 q AS (SELECT DISTINCT id AS query_id, unnest(terms) AS term FROM d WHERE id % 50 = 0), l AS (SELECT count(*) AS n_docs, avg(len(terms)) AS avg_len FROM d),
 o AS (SELECT id, len(terms) AS len, unnest(terms) AS term FROM d), p AS (SELECT term, id, count(*) AS tf, any_value(len) AS len FROM o WHERE term IN (SELECT term FROM q) GROUP BY ALL),
 f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
 x AS (SELECT term, id, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) AS part FROM p JOIN f USING (term), l),
 b AS (SELECT query_id, id, round(sum(part), 6) AS score FROM x JOIN q USING (term) GROUP BY ALL), bk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b)"""
_add("bm25_topk", lambda s, d: retrieval.bm25(*_doc_terms(s, d), 10), f"WITH {_BM25} SELECT query_id, id, score, rank::INT AS rank FROM bk WHERE rank <= 10")


def _word_sets(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    asked = table(s, d, "traces").filter("trace_no % 50 = 0").select(F.col("trace_no").alias("query_id"), text.lower_tokens(F.coalesce("finding_title", F.lit(""))).alias("words"), text.category(F.col("finding_category")).alias("cat"))
    held = table(s, d, "feedback").select(F.col("seq").alias("id"), text.lower_tokens(F.coalesce("finding_title", F.lit(""))).alias("words"), text.category(F.col("finding_category")).alias("cat"))
    return asked, held


_W = r"list_distinct(list_filter(regexp_split_to_array(lower(coalesce(finding_title, '')), '\s+'), lambda x: x <> ''))"
_JAC = rf"""q AS (SELECT trace_no AS query_id, {_W} AS qw, {S.CATEGORY.format(c='finding_category')} AS qc FROM traces WHERE trace_no % 50 = 0),
 e AS (SELECT seq AS id, {_W} AS ew, {S.CATEGORY.format(c='finding_category')} AS ec FROM feedback),
 j AS (SELECT query_id, id, len(list_intersect(qw, ew)) AS n, round(0.6 * len(list_intersect(qw, ew)) / (len(qw) + len(ew) - len(list_intersect(qw, ew))) + CASE WHEN qc = ec THEN 0.4 ELSE 0 END, 6)::DOUBLE AS score FROM q, e),
 jk AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM j WHERE score > 0)"""
_add("jaccard_topk", lambda s, d: retrieval.jaccard_search(*_word_sets(s, d), 10), f"WITH {_JAC} SELECT query_id, id, score, rank::INT AS rank FROM jk WHERE rank <= 10")


def _knn(metric: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        held = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
        return retrieval.knn(held.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vec"), held, 10, metric)

    return run


_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
for _metric, _value in (("cosine", _COS), ("l2", "1 - least(2.0, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / 2")):
    _add(f"{_metric}_knn", _knn(_metric),
         f"""WITH x AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_value}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM x) SELECT query_id, id, score, rank::INT AS rank FROM k WHERE rank <= 10""")


def _fusion(s: SparkSession, d: str) -> DataFrame:
    docs = materialize(_doc_terms(s, d)[1], "terms")  # read by two searches, in blocks
    asked = docs.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "terms")
    sets = lambda df, key: df.select(F.col(key), F.array_distinct("terms").alias("words"), F.lit(None).cast("string").alias("cat"))
    return retrieval.reciprocal_rank_fusion([retrieval.bm25(asked, docs, 30), retrieval.jaccard_search(sets(asked, "query_id"), sets(docs, "id"), 30)], 10)


_add("rrf_fusion", _fusion,
     rf"""WITH {_BM25}, s AS (SELECT id, list_distinct(terms) AS ws FROM d), j AS (SELECT a.id AS query_id, b.id, len(list_intersect(a.ws, b.ws)) AS n, len(a.ws) + len(b.ws) AS m FROM s a, s b WHERE a.id % 50 = 0),
 js AS (SELECT query_id, id, round(0.6 * n / (m - n), 6) AS score FROM j WHERE n > 0), jr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM js),
 u AS (SELECT query_id, id, rank FROM bk WHERE rank <= 30 UNION ALL SELECT query_id, id, rank FROM jr WHERE rank <= 30), fu AS (SELECT query_id, id, sum(1 / (60 + rank)) AS s FROM u GROUP BY ALL),
 z AS (SELECT query_id, id, round(s / max(s) OVER (PARTITION BY query_id), 6) AS score FROM fu), zk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM z)
 SELECT query_id, id, score, rank::INT AS rank FROM zk WHERE rank <= 10""")


def _rerank_candidates(s: SparkSession, d: str) -> DataFrame:
    asked, docs = _doc_terms(s, d)
    meta = table(s, d, "documents").select("doc_id", "lang", "repo", "created_at")
    hits = retrieval.bm25(asked, docs, 40).select("query_id", "id", F.col("score").alias("bm25"))
    mine = meta.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("q_lang"), F.col("repo").alias("q_repo"))
    return hits.join(mine, "query_id").join(meta, hits.id == meta.doc_id).select(
        "query_id", "id", "bm25", F.lit(0.0).alias("vec"), (F.col("q_repo") == F.col("repo")).alias("exact"), (F.col("q_lang") == F.col("lang")).alias("same_lang"), F.col("created_at").alias("indexed_at"))


_RERANK = f"""{_BM25}, h AS (SELECT query_id, id, score AS bm25 FROM bk WHERE rank <= 40),
 m AS (SELECT h.*, a.repo = b.repo AS exact, a.lang = b.lang AS same_lang, epoch_us(b.created_at) AS at_us, min(bm25) OVER (PARTITION BY query_id) AS lo, max(bm25) OVER (PARTITION BY query_id) AS hi FROM h JOIN documents a ON a.doc_id = query_id JOIN documents b ON b.doc_id = id),
 y AS (SELECT query_id, id, round((0.6 * CASE WHEN hi - lo < 1e-12 THEN CASE WHEN hi > 0 THEN 1.0 ELSE 0 END ELSE (bm25 - lo) / (hi - lo) END + CASE WHEN exact THEN 1.0 ELSE 0 END + CASE WHEN same_lang THEN 0.5 ELSE 0 END)
  * greatest(exp(-ln(2.0) * greatest(0.0, ({NOW_US} - at_us) / 86400000000.0) / 90.0), 0.25), 6) AS score FROM m),
 yk AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM y)"""
_add("hybrid_rerank", lambda s, d: retrieval.rerank(_rerank_candidates(s, d), NOW_US, 10), f"WITH {_RERANK} SELECT query_id, id, score, rank::INT AS rank FROM yk WHERE rank <= 10")


def _packed(s: SparkSession, d: str) -> DataFrame:
    ranked = retrieval.rerank(_rerank_candidates(s, d), NOW_US, 20)
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), (F.col("doc_kind") == "rule").alias("is_symbol"))
    return retrieval.pack(ranked.join(docs, "id"), budget=2000, most=8)


_add("injection_packing", _packed,
     rf"""WITH RECURSIVE {_RERANK}, k AS (SELECT yk.query_id, yk.id, (strlen(text) + 3) // 4 AS tokens, row_number() OVER (PARTITION BY yk.query_id ORDER BY doc_kind <> 'rule', yk.rank, yk.id) AS pos FROM yk JOIN documents ON doc_id = yk.id WHERE yk.rank <= 20),
 w AS (SELECT query_id, id, pos, tokens, CASE WHEN tokens <= 2000 THEN tokens ELSE 0 END AS used, CASE WHEN tokens <= 2000 THEN 1 ELSE 0 END AS n, tokens <= 2000 AS taken FROM k WHERE pos = 1
  UNION ALL SELECT k.query_id, k.id, k.pos, k.tokens, w.used + CASE WHEN w.used + k.tokens <= 2000 AND w.n < 8 THEN k.tokens ELSE 0 END, w.n + CASE WHEN w.used + k.tokens <= 2000 AND w.n < 8 THEN 1 ELSE 0 END, w.used + k.tokens <= 2000 AND w.n < 8
  FROM w JOIN k ON k.query_id = w.query_id AND k.pos = w.pos + 1)
 SELECT query_id, id::VARCHAR AS id, n::INT AS place, tokens::BIGINT AS tokens FROM w WHERE taken""")



def _chunk_candidates(s: SparkSession, d: str, most: int = 40) -> DataFrame:
    """Chunks that BM25, hashed vectors or a name in backticks finds for findings on every hundredth line."""
    chunks = table(s, d, "chunks")
    said = F.concat_ws(" ", "title", "description")
    asked = materialize(
        table(s, d, "findings").filter("line_start % 100 = 0").select(
            F.col("id").alias("query_id"), retrieval.terms(said).alias("terms"), embedding.embedding(said, 64).alias("vec"), text.backtick_identifiers(F.col("title")).alias("names"), scanning.language(F.col("file_path")).alias("q_lang")), "asked")
    held = materialize(chunks.select("id", retrieval.terms(F.col("content")).alias("terms"), embedding.embedding(F.col("content"), 64).alias("vec")), "held")
    legs = retrieval.bm25(asked.select("query_id", "terms"), held, most), retrieval.knn(asked.select("query_id", "vec"), held, most), retrieval.structural(asked, chunks)
    meta = chunks.select("id", scanning.language(F.col("source_path")).alias("lang"), "indexed_at")
    return retrieval.candidate_union(*legs).join(asked.select("query_id", "q_lang"), "query_id").join(meta, "id").select(
        "query_id", "id", "bm25", "vec", "exact", F.coalesce(F.col("q_lang") == F.col("lang"), F.lit(False)).alias("same_lang"), "indexed_at")


def _chunk_packing(s: SparkSession, d: str) -> DataFrame:
    ranked = retrieval.rerank(_chunk_candidates(s, d), NOW_US, 20)
    content = table(s, d, "chunks").select("id", "content", (F.col("chunk_kind") != "doc").alias("is_symbol"))
    return retrieval.pack(ranked.join(content, "id"), budget=2000, most=8)


_add("chunk_retrieval", lambda s, d: retrieval.rerank(_chunk_candidates(s, d), NOW_US, 10))
_add("chunk_packing", _chunk_packing)

_WEIGHTS = {"cobalt-scheduler": 2.0, "amber-notifier": 1.5, "birch-vault": 1.0}
_RANKED = "CASE source WHEN 'cobalt-scheduler' THEN 2.0 WHEN 'amber-notifier' THEN 1.5 WHEN 'birch-vault' THEN 1.0 ELSE 0.0 END"
_add("precedence_dedup", lambda s, d: retrieval.precedence(table(s, d, "chunks"), _WEIGHTS),
     f"""WITH c AS (SELECT *, {_RANKED} AS w FROM chunks), g AS (SELECT qualified_name, count(*) AS n, max(w) AS hi, min(w) AS lo, max(indexed_at) AS late, min(indexed_at) AS early FROM c WHERE qualified_name IS NOT NULL GROUP BY 1),
 r AS (SELECT qualified_name, id, row_number() OVER (PARTITION BY qualified_name ORDER BY w DESC, indexed_at DESC, source, id) AS rn FROM c WHERE qualified_name IS NOT NULL)
 SELECT qualified_name, id, n - 1 AS n_dropped, CASE WHEN n = 1 THEN 'only' WHEN hi > lo THEN 'weight' WHEN late > early THEN 'recency' ELSE 'name' END AS reason FROM r JOIN g USING (qualified_name) WHERE rn = 1
 UNION ALL SELECT NULL, id, 0, 'unnamed' FROM c WHERE qualified_name IS NULL""")
_add("chunk_threshold", lambda s, d: retrieval.chunk_thresholds(table(s, d, "chunks"), kpi.misleading_chunks(table(s, d, "feedback"))),
     f"WITH {_MISLED}, n AS (SELECT chunk_id, count(*) AS n FROM m GROUP BY 1) SELECT id, coalesce(n, 0) AS n, round(CASE WHEN coalesce(n, 0) < 3 THEN 0.2 + coalesce(n, 0) * (1 - 0.2) / 3 END, 6)::DOUBLE AS threshold FROM chunks LEFT JOIN n ON chunk_id = id")

# -- calibration -------------------------------------------------------------------

_AGE = f"abs(({NOW_US} - epoch_us(ts)) // 86400000000)"
_PREC = rf"""{S.FB}, pr AS (SELECT seq, finding_title AS title, finding_category AS raw_category, {S.CATEGORY.format(c='finding_category')} AS cat, v, tier,
 CASE tier WHEN 'post_fix' THEN 1.5 WHEN 'human' THEN 1.0 WHEN 'external' THEN 0.7 WHEN 'auto_calibrate' THEN 0.5 ELSE 0.3 END
 * exp(-abs(trunc(({NOW_US} - epoch_us(ts)) / 86400000000.0)) / CASE WHEN v = 'fp' AND coalesce(contains(lower(fp_kind), 'trust'), false) THEN 40.0 ELSE 120.0 END) AS w
 FROM fb WHERE v IS NOT NULL AND finding_title IS NOT NULL AND ts IS NOT NULL AND NOT (v = 'fp' AND coalesce(contains(regexp_replace(lower(fp_kind), '[^a-z]', '', 'g'), 'outofscope'), false)))"""


def _cap(of: str) -> str:
    part = lambda cond: f"coalesce(sum(w) FILTER (WHERE v IN ({of}) AND {cond}), 0)"
    return f"least({part(chr(39).join(['tier = ', 'auto_calibrate', '']))}, 1.0) + least({part(chr(39).join(['tier = ', 'external', '']))}, 1.4) + " + part("tier NOT IN ('auto_calibrate', 'external')")


_add("decay_weights", lambda s, d: calibration.precedents(table(s, d, "feedback"), NOW_US).select("seq", "v", "tier", F.round("w", 6).alias("w")), f"WITH {_PREC} SELECT seq, v, tier, round(w, 6) AS w FROM pr")
_add("capped_vote", lambda s, d: calibration.votes_by_title(table(s, d, "feedback"), NOW_US),
     f"WITH {_PREC} SELECT title, count(*) AS n, round({_cap(chr(39) + 'tp' + chr(39) + ', ' + chr(39) + 'partial' + chr(39))}, 6)::DOUBLE AS tp, round({_cap(chr(39) + 'fp' + chr(39))}, 6)::DOUBLE AS fp, round({_cap(chr(39) + 'wontfix' + chr(39))}, 6)::DOUBLE AS wontfix FROM pr GROUP BY title")
_PHRASE = lambda ps: "regexp_matches(hay, '(?:^|[^\\p{L}\\p{N}])(?:" + "|".join(p.replace("-", "[-]") for p in ps) + ")(?:[^\\p{L}\\p{N}]|$)')"
_EDGE = r"list_distinct(list_filter(list_transform(regexp_split_to_array(title, '\s+'), lambda x: lower(regexp_replace(regexp_replace(x, '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', ''))), lambda x: x <> ''))"
_add("calibrate_decisions", lambda s, d: calibration.calibrate(table(s, d, "findings"), table(s, d, "feedback"), NOW_US),
     rf"""WITH {_PREC},
 ft AS (SELECT DISTINCT title, {_EDGE} AS ws FROM findings), pt AS (SELECT DISTINCT title, {_EDGE} AS ws FROM pr),
 fi AS (SELECT title AS a, len(ws) AS na, unnest(ws) AS x FROM ft), pi AS (SELECT title AS b, len(ws) AS nb, unnest(ws) AS x FROM pt),
 ov AS (SELECT a, b, count(*) AS k, any_value(na) AS na, any_value(nb) AS nb FROM fi JOIN pi USING (x) GROUP BY ALL),
 tj AS (SELECT a, b, k / (na + nb - k) AS j, try_cast(regexp_extract(lower(a), '^.*?complexity (\d+)', 1) AS INT) AS ma, try_cast(regexp_extract(lower(b), '^.*?complexity (\d+)', 1) AS INT) AS mb FROM ov),
 mt AS (SELECT f.id, pr.v, pr.tier, pr.w, (3 * j + CASE WHEN coalesce(raw_category, '') <> '' AND {S.CATEGORY.format(c='f.category')} = pr.cat THEN 2 ELSE 0 END) / 5 AS s
  FROM tj JOIN findings f ON f.title = a JOIN pr ON pr.title = b WHERE ((ma IS NULL AND mb IS NULL) OR coalesce(abs(ma - mb) <= 2, false))),
 vt AS (SELECT id, count(*) AS n_precedents, {_cap("'tp', 'partial'")} AS tp, {_cap("'fp'")} AS fp, {_cap("'wontfix'")} AS wontfix FROM mt WHERE s >= 0.5 - 1e-12 GROUP BY id),
 b AS (SELECT f.id, severity, lower(concat_ws(' ', title, description)) AS hay, {S.CATEGORY.format(c='category')} AS cat, list_position(['info', 'low', 'medium', 'high', 'critical'], lower(severity)) - 1 AS rank,
  coalesce(n_precedents, 0) AS n_precedents, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(wontfix, 0) AS wontfix FROM findings f LEFT JOIN vt USING (id)),
 g AS (SELECT *, n_precedents > 0 AND fp >= 1.5 AND fp > 2 * tp AS gone FROM b),
 h AS (SELECT *, n_precedents > 0 AND NOT gone AND ((fp >= 1 AND fp > 2 * tp) OR (fp >= 0.5 AND tp < 0.1)) AS demoted, n_precedents > 0 AND NOT gone AND tp >= 1.5 AND tp > 2 * fp AS wants FROM g),
 i AS (SELECT *, CASE WHEN demoted THEN 0 ELSE rank END AS start FROM h), o AS (SELECT *, least(start + 1, 4) AS target FROM i),
 q AS (SELECT *, CASE target WHEN 4 THEN {_PHRASE(calibration.CRITICAL_PHRASES)} WHEN 3 THEN cat IN ('security', 'correctness', 'logic', 'concurrency', 'reliability', 'robustness', 'error-handling', 'validation') OR {_PHRASE(calibration.HIGH_PHRASES)} ELSE true END AS allowed FROM o)
 SELECT id, severity AS input_severity, ['info', 'low', 'medium', 'high', 'critical'][(CASE WHEN gone THEN rank WHEN wants AND allowed THEN target ELSE start END) + 1] AS output_severity,
  CASE WHEN gone THEN 'disputed' WHEN wants THEN 'confirmed' WHEN demoted THEN 'disputed' WHEN n_precedents > 0 AND tp > 1.5 * fp THEN 'confirmed' END AS action,
  CASE WHEN n_precedents = 0 THEN 'no_match' WHEN gone THEN 'disputed' WHEN wants AND allowed THEN 'boosted' WHEN wants THEN 'boost_blocked_by_gate' WHEN demoted THEN 'disputed' ELSE 'boost_weight_too_low' END AS reason,
  gone AS suppressed, round(tp, 4)::DOUBLE AS tp, round(fp, 4)::DOUBLE AS fp, round(wontfix, 4)::DOUBLE AS wontfix, n_precedents FROM q""")

_add("calibrate_ranked", lambda s, d: calibration.calibrate(table(s, d, "findings"), table(s, d, "feedback"), NOW_US, index=True))
_add("few_shot_examples", lambda s, d: calibration.few_shot_examples(table(s, d, "findings"), calibration.precedents(table(s, d, "feedback"), NOW_US)))

# -- scalars -----------------------------------------------------------------------

_add("normalize_title", lambda s, d: table(s, d, "feedback").select("seq", text.normalize_title(F.col("finding_title")).alias("norm")), f"SELECT seq, {_T} AS norm FROM feedback")
_add("category_normalize", lambda s, d: table(s, d, "findings").select("id", text.category(F.col("category")).alias("cat")), f"SELECT id, {S.CATEGORY.format(c='category')} AS cat FROM findings")
_HAY = "lower(concat_ws(' ', title, description, category))"
_add("classify_pattern", lambda s, d: table(s, d, "findings").select("id", text.classify_pattern(F.col("title"), F.col("description"), F.col("category")).alias("pattern")),
     "SELECT id, CASE " + " ".join("WHEN " + " OR ".join(f"contains({_HAY}, '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in text.PATTERN_KEYWORDS) + " END AS pattern FROM findings")


def _redact_sql() -> str:
    out = "content"
    for pattern, put in text.SECRET_PATTERNS:
        pattern, put = pattern.replace("'", "''"), put.replace("'", "''")
        for n in "123":
            put = put.replace(f"${n}", f"\\{n}")
        out = f"regexp_replace({out}, '{pattern}', '{put}', 'g')"
    return f"SELECT id, md5({out}) AS redacted FROM chunks"


_add("redact_secrets", lambda s, d: table(s, d, "chunks").select("id", F.md5(text.redact_secrets(F.col("content"))).alias("redacted")), _redact_sql())
_add("decoded_enums", lambda s, d: table(s, d, "feedback").select("seq", verdict(F.col("verdict")).alias("v"), provenance_kind(F.col("provenance")).alias("tier"), F.when(provenance_kind(F.col("provenance")) == "external", F.substr(annotator(F.col("provenance")), F.lit(10))).alias("agent")),
     f"WITH {S.FB} SELECT seq, v, tier, agent FROM fb")
_add("identifiers_harvest", lambda s, d: table(s, d, "findings").select("id", F.array_join(text.backtick_identifiers(F.col("title")), "|").alias("names")),
     rf"""SELECT id, array_to_string(list_distinct_ordered, '|') AS names FROM (SELECT id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered FROM (
 SELECT id, list_filter(list_transform(regexp_extract_all(title, '`([^`]+)`', 1), lambda x: regexp_replace(trim(x), '\(\)$', '')), lambda x: strlen(x) >= 4 AND x NOT IN ({", ".join(f"'{w}'" for w in text.STOP_IDENTIFIERS)})) AS l FROM findings))""")
_add("token_estimates", lambda s, d: table(s, d, "chunks").select("id", text.token_estimate(F.col("content")).alias("tokens")), "SELECT id, ((strlen(content) + 3) // 4)::BIGINT AS tokens FROM chunks")
_add("merge_findings", lambda s, d: merging.merge_findings(table(s, d, "findings")))

# -- code and documents --------------------------------------------------------------


def _files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select(F.col("id").alias("path"), scanning.language(F.col("source_path")).alias("lang"), F.col("content").alias("text"))


_add("rule_scan", lambda s, d: scanning.scan(_files(s, d)))
_add("extracted_symbols", lambda s, d: documents.extract(_files(s, d)))
_add("chunk_faults", lambda s, d: logs.validate_chunks(table(s, d, "chunks")),
     r"""SELECT id, unnest(list_filter([CASE WHEN NOT regexp_matches(coalesce(id, ''), '\S') THEN 'empty id' END, CASE WHEN NOT regexp_matches(coalesce(source, ''), '\S') THEN 'empty source' END,
 CASE WHEN NOT regexp_matches(coalesce(content, ''), '\S') THEN 'empty content' END, CASE WHEN line_start < 1 OR line_end < line_start THEN 'line range' END,
 CASE WHEN isnan(confidence) OR confidence < 0 OR (confidence > 1 AND NOT isnan(confidence)) THEN 'confidence' END], lambda x: x IS NOT NULL)) AS fault FROM chunks
 UNION ALL SELECT id, 'duplicate id' FROM chunks GROUP BY id HAVING count(*) > 1""")



def _tool_outputs(s: SparkSession, d: str, tool: str) -> DataFrame:
    """Every finding as the output of a linter, one document each."""
    n = F.floor(F.length("id") + F.coalesce("line_start", F.lit(0))).cast("int")
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").when(F.col("severity") == "low", "info").otherwise("style")
    said = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"\s+", " "))
    code = F.concat(F.element_at(F.array(*[F.lit(c) for c in "FEWSBCX"]), F.pmod(n, F.lit(7)) + 1), n.cast("string"))
    first, last = F.col("line_start"), F.col("line_end")
    rank = F.when(level == "error", 2).when(level == "warning", 1).otherwise(0)
    j = lambda c: F.to_json(c)
    output = {
        "ruff": lambda: j(F.array(F.struct(code.alias("code"), said.alias("message"), F.struct(first.alias("row")).alias("location"), F.struct(last.alias("row")).alias("end_location")))),
        "clippy": lambda: j(F.struct(F.lit("compiler-message").alias("reason"), F.struct(said.alias("message"), level.alias("level"), F.struct(code.alias("code")).alias("code"), F.array(F.struct(first.alias("line_start"), last.alias("line_end"))).alias("spans")).alias("message"))),
        "eslint": lambda: j(F.array(F.struct(F.lit("f").alias("filePath"), F.array(F.struct(code.alias("ruleId"), rank.alias("severity"), said.alias("message"), first.alias("line"), last.alias("endLine"))).alias("messages")))),
        "shellcheck": lambda: j(F.struct(F.array(F.struct(n.alias("code"), level.alias("level"), said.alias("message"), first.alias("line"), last.alias("endLine"))).alias("comments"))),
        "tflint": lambda: j(F.struct(F.array(F.struct(F.struct(code.alias("name"), level.alias("severity")).alias("rule"), said.alias("message"), F.struct(F.struct(first.alias("line")).alias("start"), F.struct(last.alias("line")).alias("end")).alias("range"))).alias("issues"))),
        "yamllint": lambda: F.concat(F.lit("a b.yaml:"), F.coalesce(first.cast("string"), F.lit("")), F.lit(":1: ["), level, F.lit("] "), said),
        "hadolint": lambda: F.concat(F.lit("Dockerfile:"), F.coalesce(first.cast("string"), F.lit("")), F.lit(" "), code, F.lit(" "), level, F.lit(": "), said),
    }[tool]()
    return table(s, d, "findings").select(F.col("id").alias("run_id"), output.alias("output"))


def _linters(s: SparkSession, d: str) -> DataFrame:
    parts = [getattr(tools, t)(_tool_outputs(s, d, t)).select("run_id", F.lit(t).alias("tool"), "title", "severity", "category", "line_start", "line_end") for t in ("ruff", "clippy", "eslint", "shellcheck", "tflint", "yamllint", "hadolint")]
    return reduce(DataFrame.unionByName, parts)


_add("linter_findings", _linters, r"""
WITH f AS (SELECT id AS run_id, trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g')) AS said, length(id) + coalesce(line_start, 0) AS n, coalesce(line_start, 1) AS a, coalesce(line_end, line_start, 1) AS b, line_end,
  CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' WHEN severity = 'low' THEN 'info' ELSE 'style' END AS level FROM findings),
c AS (SELECT *, substr('FEWSBCX', (((n % 7) + 7) % 7)::INT + 1, 1) AS letter FROM f), k AS (SELECT *, letter || n AS code FROM c)
SELECT run_id, 'ruff' AS tool, code || ': ' || said AS title, CASE letter WHEN 'S' THEN 'high' WHEN 'B' THEN 'medium' WHEN 'F' THEN 'medium' WHEN 'E' THEN 'low' WHEN 'W' THEN 'low' ELSE 'info' END AS severity,
  CASE letter WHEN 'S' THEN 'security' WHEN 'B' THEN 'correctness' WHEN 'C' THEN 'performance' ELSE 'maintainability' END AS category, a AS line_start, b AS line_end FROM k
UNION ALL SELECT run_id, 'clippy', code || ': ' || said, CASE level WHEN 'error' THEN 'high' WHEN 'warning' THEN 'medium' ELSE 'low' END, 'maintainability', a, coalesce(line_end, 1) FROM k
UNION ALL SELECT run_id, 'eslint', code || ': ' || said, CASE level WHEN 'error' THEN 'high' WHEN 'warning' THEN 'medium' ELSE 'low' END, 'maintainability', a, b FROM k
UNION ALL SELECT run_id, 'shellcheck', 'SC' || n || ': ' || said, CASE level WHEN 'error' THEN 'high' WHEN 'warning' THEN 'medium' WHEN 'info' THEN 'low' ELSE 'info' END, 'maintainability', a, b FROM k
UNION ALL SELECT run_id, 'tflint', code || ': ' || said, CASE level WHEN 'error' THEN 'high' WHEN 'warning' THEN 'medium' ELSE 'low' END, 'maintainability', a, b FROM k
UNION ALL SELECT run_id, 'yamllint', 'yamllint: ' || said, CASE level WHEN 'error' THEN 'high' ELSE 'medium' END, 'maintainability', a, a FROM k WHERE level IN ('error', 'warning')
UNION ALL SELECT run_id, 'hadolint', code || ': ' || said, CASE level WHEN 'error' THEN 'high' WHEN 'warning' THEN 'medium' ELSE 'low' END, 'maintainability', a, a FROM k""")


def _answers(s: SparkSession, d: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("critical", "HIGH", "error", "warning", "warn", "note", "low", "suggestion", "hint", "info", "blocker")])
    word = F.element_at(words, F.pmod(F.coalesce("line_start", F.lit(0)), F.lit(11)) + 1)
    item = F.struct(F.coalesce("title", F.lit("")).alias("title"), word.alias("severity"), F.col("line_start"), F.col("line_end"))
    rows = table(s, d, "findings").select(F.col("id").alias("run_id"), F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(item).alias("findings"))), F.lit("\n```")).alias("output"))
    return tools.model_answers(rows).select("run_id", "title", "severity", "line_start", "line_end")


_add("model_findings", _answers, r"""
WITH f AS (SELECT id AS run_id, coalesce(title, '') AS title, ((coalesce(line_start, 0) % 11) + 11) % 11 AS k, greatest(1, coalesce(line_start, 1)) AS line_start, line_end FROM findings)
SELECT run_id, title, (['critical', 'high', 'high', 'medium', 'medium', 'low', 'low', 'info', 'info', 'info', 'medium'])[k + 1] AS severity, line_start, greatest(line_start, coalesce(line_end, 1)) AS line_end FROM f""")


def _grounded(s: SparkSession, d: str) -> DataFrame:
    """Findings against the description of the finding, as the lines of a file of their own."""
    found = table(s, d, "findings").select("id", "title", "source_kind", "severity", F.col("id").alias("file_path"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"))
    lines = table(s, d, "findings").select(F.col("id").alias("file_path"), F.split(F.coalesce("description", F.lit("")), "\n").alias("lines")).withColumn("n_lines", F.size("lines"))
    return merging.grounded(found, lines)


_add("grounding_check", _grounded, rf"""
WITH f AS (SELECT id, source_kind, severity, array_to_string(string_split(coalesce(description, ''), chr(10))[1:3], chr(10)) AS near,
  list_filter(list_transform(regexp_extract_all(title, '`([^`]+)`', 1), lambda x: regexp_replace(trim(x), '\(\)$', '')), lambda x: strlen(x) >= 4 AND x NOT IN ({", ".join(f"'{w}'" for w in text.STOP_IDENTIFIERS)})) AS names FROM findings),
t AS (SELECT *, list_bool_and(list_transform(names, lambda x: regexp_matches(near, CASE WHEN regexp_matches(x, '^[\p{{L}}\p{{N}}_]') THEN '(^|[^\p{{L}}\p{{N}}_])' ELSE '' END || regexp_escape(x) || CASE WHEN regexp_matches(x, '[\p{{L}}\p{{N}}_]$') THEN '($|[^\p{{L}}\p{{N}}_])' ELSE '' END))) AS there FROM f),
u AS (SELECT *, CASE WHEN source_kind <> 'llm' OR coalesce(len(names), 0) = 0 THEN 'not-checked' WHEN there THEN 'verified' ELSE 'symbol-not-found' END AS status FROM t)
SELECT id, status, CASE WHEN status <> 'symbol-not-found' THEN lower(severity) ELSE (['info', 'info', 'low', 'medium', 'high'])[list_position(['info', 'low', 'medium', 'high', 'critical'], lower(severity))] END AS severity FROM u""")

_add("trace_fingerprints", lambda s, d: calibration.fingerprints(table(s, d, "traces"), "trace_no"),
     "SELECT trace_no, finding_title, finding_category, input_severity, output_severity, calibrator_action, severity_change_reason, " + ", ".join(f"format('{{:.4f}}', {w}) AS {w}" for w in calibration.WEIGHTS) + ", coalesce(len(matched_precedents), 0)::INT AS n_precedents FROM traces")
_add("index_texts", lambda s, d: table(s, d, "feedback").select("seq", text.index_text(F.col("finding_title"), F.col("reason")).alias("doc")),
     r"SELECT seq, finding_title || CASE WHEN regexp_matches(coalesce(reason, ''), '\S') THEN ' ' || regexp_replace(reason, '^\s+|\s+$', '', 'g') ELSE '' END AS doc FROM feedback")
_add("match_expressions", lambda s, d: table(s, d, "chunks").select("id", text.match_expression(F.array("qualified_name", "signature")).alias("expression")),
     r"""SELECT id, CASE WHEN len(l) > 0 THEN array_to_string(list_transform(l, lambda x: '"' || replace(x, '"', '""') || '"'), ' OR ') END AS expression
 FROM (SELECT id, list_filter(list_transform([qualified_name, signature], lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM chunks)""")
_add("filtered_chunks", lambda s, d: retrieval.filtered(table(s, d, "chunks"), sources=("cobalt-scheduler", "amber-notifier"), kinds=("symbol", "doc"), exclude_paths=("README.md",)).select("id", "source", "chunk_kind"),
     "SELECT id, source, chunk_kind FROM chunks WHERE source IN ('cobalt-scheduler', 'amber-notifier') AND chunk_kind IN ('symbol', 'doc') AND coalesce(source_path <> 'README.md', true)")
_add("adaptive_threshold", lambda s, d: retrieval.passing(table(s, d, "findings").select(F.col("run_id").alias("query_id"), "id", F.when(~F.isnan("confidence"), F.col("confidence").cast("double")).alias("score"), (F.col("source_kind") != "llm").alias("is_symbol")), 0.8).select("query_id", "id", "lowered"),
     """WITH f AS (SELECT run_id AS query_id, id, CASE WHEN NOT isnan(confidence) THEN confidence::DOUBLE END AS score, source_kind <> 'llm' AS is_symbol FROM findings),
 g AS (SELECT *, coalesce(bool_or(score >= 0.8) OVER (PARTITION BY query_id), false) AS hit FROM f)
 SELECT query_id, id, coalesce(NOT hit AND NOT is_symbol AND score >= 0.8::DOUBLE - 0.1::DOUBLE, false) AS lowered FROM g WHERE score >= 0.8 OR (NOT hit AND NOT is_symbol AND score >= 0.8::DOUBLE - 0.1::DOUBLE)""")
_add("index_agreement", lambda s, d: retrieval.index_agreement(table(s, d, "chunks").dropDuplicates(["id"]), table(s, d, "chunks")),
     "WITH a AS (SELECT source, count(*) AS n_stored FROM (SELECT id, any_value(source) AS source FROM chunks GROUP BY id) GROUP BY 1), b AS (SELECT source, count(*) AS n_logged FROM chunks GROUP BY 1) SELECT b.source, n_stored, n_logged, CASE WHEN n_stored = n_logged THEN 'pass' ELSE 'warn' END AS status FROM b LEFT JOIN a ON a.source IS NOT DISTINCT FROM b.source")
_add("error_texts", lambda s, d: table(s, d, "documents").select("doc_id", text.sanitize_error(F.concat(F.lit("401: bearer "), F.col("source"), F.lit(' api key: '), F.col("repo"), F.lit(" "), F.col("text"))).alias("body")),
     r"""SELECT doc_id, substr(regexp_replace('401: bearer ' || source || ' api key: ' || repo || ' ' || text, '(?i)bearer\s+[A-Za-z0-9_\-.=]+|sk-[A-Za-z0-9_\-]+|api[\s_-]?key["'']?\s*[:=]\s*["'']?[A-Za-z0-9_\-]+|x-api-key["'']?\s*[:=]\s*["'']?[A-Za-z0-9_\-]+|"(?:token|secret|access_token)"\s*:\s*"[^"]+"', '[REDACTED]', 'g'), 1, 200) AS body FROM documents""")

_add("path_words", lambda s, d: table(s, d, "chunks").select("id", F.array_join(prompt.path_words(F.col("source_path")), "|").alias("words")),
     r"""SELECT id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(source_path, '\.[^./\\]*$', ''), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[/\\_-]+'),
 lambda x: strlen(x) >= 3 AND NOT list_contains(['src', 'lib', 'tests', 'test', 'mod', 'main', 'rs', 'py', 'ts', 'js', 'tsx', 'jsx', 'mjs', 'cjs', 'yaml', 'yml', 'sh', 'bash', 'zsh', 'tf', 'tfvars'], lower(x))), '|') AS words FROM chunks""")
_add("content_hashes", lambda s, d: table(s, d, "chunks").groupBy(F.sha2("content", 256).alias("sha256")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")),
     "SELECT sha256(content) AS sha256, count(*) AS n, min(id) AS first_id FROM chunks GROUP BY 1")
_add("display_formats", lambda s, d: table(s, d, "reviews").select("run_id", "received_at", numbers.count_text(F.col("tokens_in")).alias("tokens"), numbers.duration_text(F.col("duration_ms")).alias("took"),
     prompt.bar(F.col("tokens_out").cast("double"), F.lit(5000.0)).alias("bar"), prompt.age_text((F.lit(NOW_US) - F.unix_micros("reviewed_at")) / 1_000_000).alias("age")).drop("received_at"),
     f"""SELECT run_id, CASE WHEN tokens_in >= 1000000 THEN printf('%.1fM', tokens_in / 1000000.0) WHEN tokens_in >= 1000 THEN printf('%.1fk', tokens_in / 1000.0) ELSE tokens_in::VARCHAR END AS tokens,
 CASE WHEN duration_ms < 4000 THEN duration_ms || 'ms' ELSE printf('%.1fs', duration_ms / 1000.0) END AS took,
 repeat('█', round(least(1, tokens_out / 5000.0) * 10)::INT) || repeat('·', 10 - round(least(1, tokens_out / 5000.0) * 10)::INT) AS bar,
 CASE WHEN a < 0 THEN 'just now' WHEN a >= 86400 THEN (a // 86400)::BIGINT || 'd' WHEN a >= 3600 THEN (a // 3600)::BIGINT || 'h' WHEN a >= 120 THEN (a // 60)::BIGINT || 'm' ELSE 'just now' END AS age
 FROM (SELECT *, ({NOW_US} - epoch_us(reviewed_at)) // 1000000 AS a FROM reviews)""")
_add("severity_shift", lambda s, d: table(s, d, "findings").select("id", text.severity_name(F.least(text.severity_rank(F.col("severity")) + 1, F.lit(4))).alias("raised"), text.severity_name(F.greatest(text.severity_rank(F.col("severity")) - 1, F.lit(0))).alias("lowered")),
     "SELECT id, ['info', 'low', 'medium', 'high', 'critical'][least(list_position(['info', 'low', 'medium', 'high', 'critical'], severity) + 1, 5)] AS raised, ['info', 'low', 'medium', 'high', 'critical'][greatest(list_position(['info', 'low', 'medium', 'high', 'critical'], severity) - 1, 1)] AS lowered FROM findings")
_add("trace_filter", lambda s, d: table(s, d, "traces").filter(corpus_join.accepts(F.col("provenance"), repo="ember-console", clean_only=True)).select("trace_no"),
     "SELECT trace_no FROM traces WHERE json_extract_string(provenance, '$.repo') = 'ember-console' AND json_extract_string(provenance, '$.dirty') = 'false'")
_add("orphan_sources", lambda s, d: hydration.orphans(table(s, d, "reviews").select(F.col("repo").alias("name")).filter("name IS NOT NULL"), table(s, d, "chunks").select(F.col("source").alias("name")), "name"),
     "SELECT DISTINCT source AS name, 'orphan' AS side FROM chunks WHERE source NOT IN (SELECT repo FROM reviews WHERE repo IS NOT NULL) UNION ALL SELECT DISTINCT repo, 'missing' FROM reviews WHERE repo NOT IN (SELECT source FROM chunks)")


def _calls(s: SparkSession, d: str) -> DataFrame:
    """Calls in chunks with the function around them."""
    files = _files(s, d).filter("lang IN ('python', 'rust', 'typescript', 'go')")
    return hydration.callers(documents.calls(files), documents.definitions(files), outside=True)


_add("call_sites", _calls)


def _chunk_cards(s: SparkSession, d: str) -> DataFrame:
    """Chunks nearest to the held-out passages by hashed vectors, packed and rendered."""
    chunks = table(s, d, "chunks")
    vectors = materialize(chunks.select("id", embedding.embedding(F.col("content"), 64).alias("vec")), "vectors")
    asked = table(s, d, "bench_passages").select(F.col("passage_id").alias("query_id"), embedding.embedding(F.col("text"), 64).alias("vec"))
    hits = materialize(retrieval.knn(asked, vectors, 5), "hits")
    ranked = hits.join(chunks.select("id", "content", (F.col("chunk_kind") != "doc").alias("is_symbol")), "id")
    return context.blocks(retrieval.pack(ranked, budget=4000, most=3), chunks).select("query_id", "n_chunks", "sha256")


_add("context_blocks", _chunk_cards)

# -- streaming ---------------------------------------------------------------------


def _streamed(s: SparkSession, d: str) -> DataFrame:
    return inbox.feedback_counts_by_stream(s, table(s, d, "feedback"), f"{shared_dir(s)}/assize/stream-{uuid.uuid4().hex}")


_add("inbox_stream_counts", _streamed, f"WITH {S.FB} SELECT v, tier, count(*) AS n FROM fb GROUP BY ALL")

# -- schema drift ------------------------------------------------------------------

_add("p3_found", lambda s, d: schema_drift.changes(table(s, d, "raw_lines")), schema_drift.oracle_changes())
_add("p3_islands", lambda s, d: schema_drift.islands(table(s, d, "raw_lines")))
_add("p3_consistent", lambda s, d: schema_drift.consistent(table(s, d, "raw_lines")))
