"""Tiered joins between feedback and traces, backfill of paths, suppression rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import category, glob_regex, normalize_title
from ..storage import materialize
from .kpi import typed
from .postings import Postings

FUZZY = 0.5
MARGIN = 0.1
TIERS = ("exact_raw", "exact_normalized", "fuzzy_same_file", "raw_title_only", "normalized_title_only")


def accepts(provenance: Column, tool_version: str | None = None, repo: str | None = None, commit_sha: str | None = None, run_id: str | None = None, clean_only: bool = False) -> Column:
    """Filter on the JSON text of a trace's provenance; a missing member fails a predicate, a missing text passes only without any."""
    out = F.lit(True)
    for member, value in (("tool_version", tool_version), ("repo", repo), ("commit_sha", commit_sha), ("run_id", run_id)):
        if value is not None:
            out = out & F.coalesce(F.get_json_object(provenance, f"$.{member}") == value, F.lit(False))
    if clean_only:
        out = out & F.coalesce(F.get_json_object(provenance, "$.dirty") == "false", F.lit(False))
    return out


def _keyed(traces: DataFrame) -> DataFrame:
    return traces.filter("finding_title IS NOT NULL AND finding_title != ''").select(
        F.col("finding_title").alias("title"),
        F.coalesce("file_path", F.lit("")).alias("path"),
        normalize_title(F.col("finding_title")).alias("norm"),
        F.greatest(F.coalesce("tp_weight", F.lit(0.0)), F.lit(0.0)).alias("tp_w"),
        F.greatest(F.coalesce("fp_weight", F.lit(0.0)), F.lit(0.0)).alias("fp_w"),
    )


#: Asked and held titles of one path that one task compares, and titles of small paths in one task.
ASKED_BLOCK, HELD_BLOCK, BUCKET = 8_000, 100_000, 20_000
#: Words met up to which an asked title is compared with all that share one.
ALL_PAIRS = 4_096


def _best_two(index: Postings, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Similarity of the best and the second held title of every asked one, and the place of the best.

    A held title with copies is its own second. Titles that can't change the
    outcome are left out: those below ``FUZZY``, or ``MARGIN`` behind a best that reaches it.
    """
    best, second, at = np.zeros(len(index.sizes_a)), np.zeros(len(index.sizes_a)), np.full(len(index.sizes_a), -1)
    for a, h, j in index.pairs(np.flatnonzero((index.work > 0) & (index.work <= ALL_PAIRS))):
        order = np.lexsort((-j, a))
        a, h, j = a[order], h[order], j[order]
        top = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        after = np.minimum(top + 1, len(a) - 1)
        best[a[top]], at[a[top]] = j[top], h[top]
        second[a[top]] = np.where(copies[h[top]] > 1, j[top], np.where((after > top) & (a[after] == a[top]), j[after], 0.0))
    met = np.full(len(index.sizes_h), -1)
    for a in np.flatnonzero(index.work > ALL_PAIRS):
        words = index.words_of(a)
        index.mark[words] = 1
        first, next_, place = 0.0, 0.0, -1
        for done, word in enumerate(words):
            # Titles that share none of the words so far have at most the others.
            most = (len(words) - done) / index.sizes_a[a]
            if most < (FUZZY - MARGIN if first >= FUZZY else FUZZY) or most <= next_ or first - most >= MARGIN:
                break
            held = index.holders(word)
            held = held[met[held] != a]
            if not len(held):
                continue
            met[held] = a
            j = index.similar(a, held)
            k = int(j.argmax())
            top, of = float(j[k]), int(held[k])
            if copies[of] <= 1:
                j[k] = 0.0
            if top > first:
                first, next_, place = top, max(first, float(j.max())), of
            else:
                next_ = max(next_, top)
        index.mark[words] = 0
        best[a], second[a], at[a] = first, next_, place
    return best, second, at


def _compare(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    held = held.reset_index(drop=True)
    asked = asked[asked["path"].isin(set(held["path"]))].reset_index(drop=True)
    if asked.empty:
        return pd.DataFrame(columns=["gid", "best", "second", "weighed", "fuzzy"])
    words = lambda df: [list(dict.fromkeys(w for w in x.split(" ") if w)) for x in df["norm"]]
    best, second, at = _best_two(Postings(asked["path"], words(asked), held["path"], words(held)), held["copies"].to_numpy())
    weight, weighed = held["weight"].to_numpy(np.float64)[at], (at >= 0) & held["weighed"].to_numpy()[at]
    return pd.DataFrame({"gid": asked["gid"], "best": best, "second": second, "weighed": weighed, "fuzzy": weight})


def _fuzzy(asked: DataFrame, held: DataFrame) -> DataFrame:
    """Best title of the same path per asked ``gid, path, norm``: ``gid, best, second, fuzzy``; no row where the path holds none.

    Paths are put into buckets of which a task compares one; a path with very
    many titles is cut into blocks of both sides. Only the two best of an asked
    title leave a task, so what is shuffled grows with titles, not with pairs.
    """
    asked, held = asked.withColumn("p", F.xxhash64("path")), held.withColumn("p", F.xxhash64("path"))
    # At most as many rows as there are full blocks.
    sizes = asked.select("p", F.lit(1).alias("a"), F.lit(0).alias("h")).unionByName(held.select("p", F.lit(0).alias("a"), F.lit(1).alias("h"))).groupBy("p").agg(F.sum("a").alias("a"), F.sum("h").alias("h"))
    cut = lambda n, most: F.ceil(F.col(n) / most).cast("int").alias(f"n_{n}")
    large = F.broadcast(materialize(sizes.filter((F.col("h") > 0) & (F.col("a") > 0) & ((F.col("a") > ASKED_BLOCK) | (F.col("h") > HELD_BLOCK))).select("p", cut("a", ASKED_BLOCK), cut("h", HELD_BLOCK)), "large"))
    buckets = max(1, -(-asked.count() // BUCKET))
    one = F.lit(1)
    place = lambda df: df.join(large, "p", "left").withColumn("b", F.when(F.col("n_a").isNull(), F.pmod("p", F.lit(buckets))).otherwise(F.col("p"))).withColumns({"n_a": F.coalesce("n_a", one), "n_h": F.coalesce("n_h", one)})
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = place(asked).withColumn("i", F.pmod(F.xxhash64("norm"), F.col("n_a")).cast("int")).withColumn("j", each("n_h")).select("b", "i", "j", "gid", "path", "norm")
    right = place(held).withColumn("j", F.pmod(F.xxhash64("norm"), F.col("n_h")).cast("int")).withColumn("i", each("n_a")).select("b", "i", "j", F.col("path").alias("path"), F.col("norm").alias("norm"), "copies", "weight", F.col("weight").isNotNull().alias("weighed"))
    blocks = left.groupBy("b", "i", "j").cogroup(right.groupBy("b", "i", "j")).applyInPandas(_compare, "gid bigint, best double, second double, weighed boolean, fuzzy double")
    # One row of each block of the path.
    found = F.sort_array(F.collect_list(F.struct("best", "second", "weighed", "fuzzy")), asc=False)
    merged = blocks.groupBy("gid").agg(found.alias("found")).select("gid", F.get("found", F.lit(0)).alias("top"), F.get("found", F.lit(1))["best"].alias("other"))
    # pandas has one sign for null and NaN.
    return merged.select("gid", "top.best", F.greatest("top.second", F.coalesce("other", F.lit(0.0))).alias("second"), F.when(F.col("top.weighed"), F.coalesce("top.fuzzy", F.lit(float("nan")))).alias("fuzzy"))


def corpus_join(feedback: DataFrame, traces: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Each tp, partial or fp row with the first tier that yields a score: ``seq, positive, tier, score``.

    Tiers: same title and path; same normalised title and path; most similar
    title of the same path, if clearly ahead of the next; same title, or
    normalised title, of a trace without path. Keys that occur twice among the
    traces are no keys. A key of weight 0 falls through. ``tier`` is
    ``ambiguous_skipped``, ``below_threshold`` or ``unmatched`` without a score.

    Equal titles have equal normalised titles, so one shuffle by these brings
    together all that the exact tiers need. Only rows without an exact tier are
    compared by words, one of each path and normalised title.
    """
    asked = (
        typed(feedback)
        .filter("v IN ('tp', 'partial', 'fp') AND finding_title IS NOT NULL AND finding_title != ''")
        .select("seq", (F.col("v") != "fp").alias("positive"), F.col("finding_title").alias("title"), F.coalesce("file_path", F.lit("")).alias("path"), normalize_title(F.col("finding_title")).alias("norm"), F.lit(False).alias("held"))
    )
    keyed = _keyed(traces).select("title", "path", "norm", F.lit(True).alias("held"), F.try_divide("tp_w", F.col("tp_w") + F.col("fp_w")).alias("weight"))
    held, scoped, loose = F.col("held"), F.col("held") & (F.col("path") != ""), F.col("held") & (F.col("path") == "")
    nothing = F.lit(None).cast("double")

    def single(of: Column, by: Window, also: Column) -> Column:
        """The weight of the one trace ``of`` that a group holds."""
        return F.when((F.count_if(of).over(by) == 1) & also, F.max(F.when(of, F.col("weight"))).over(by)).otherwise(nothing)

    both = asked.unionByName(keyed, allowMissingColumns=True).withColumn("row", F.monotonically_increasing_id()).repartition("norm")
    by_path, by_title, by_norm, by_file = (Window.partitionBy("norm", *k) for k in (("title", "path"), ("title",), (), ("path",)))
    both = both.withColumn("s1", single(scoped, by_path, F.lit(True))).withColumn("s4", single(loose, by_title, F.count_if(scoped).over(by_title) == 0))
    if fuzzy:
        named = F.col("norm") != ""
        both = both.withColumn("s5", single(loose, by_norm, named & (F.count_if(scoped).over(by_norm) == 0)))
        both = both.withColumns({"s2": single(scoped, by_file, named), "copies": F.count_if(held).over(by_file)})
    else:
        both = both.withColumns({"s2": nothing, "s5": nothing})
    exact = F.when(F.col("s1").isNotNull(), TIERS[0]).when(F.col("s2").isNotNull(), TIERS[1])
    loosely = F.when(F.col("s4").isNotNull(), TIERS[3]).when(F.col("s5").isNotNull(), TIERS[4])
    rows = both.withColumns({"exact": exact, "score": F.coalesce("s1", "s2"), "loosely": loosely, "loose_score": F.coalesce("s4", "s5")})
    if not fuzzy:
        return rows.filter(~held).select("seq", "positive", F.coalesce("exact", "loosely", F.lit("unmatched")).alias("tier"), F.round(F.coalesce("score", "loose_score"), 6).alias("score"))
    # Of each side, and of the rows asked without an exact tier, one row of a path and a normalised title says them.
    open_ = ~held & F.col("exact").isNull()
    first = lambda of: F.min(F.when(of, F.col("row"))).over(by_file)
    rows = rows.withColumns({"gid": F.when(open_, first(open_)), "speaks": (F.col("path") != "") & (F.col("norm") != "") & ((held & (F.col("row") == first(held))) | (open_ & (F.col("row") == first(open_))))})
    speaks = F.col("speaks")
    said = lambda c: F.when(speaks, F.col(c)).alias(c)
    rows = materialize(
        rows.filter(~held | speaks).select("held", "seq", "positive", "exact", "score", "loosely", "loose_score", "gid", said("path"), said("norm"), F.when(held, F.col("copies")).alias("copies"), F.when(held, F.col("weight")).alias("weight")),
        "asked",
    )
    found = _fuzzy(rows.filter(~held & F.col("path").isNotNull()).select("gid", "path", "norm"), rows.filter(held).select("path", "norm", "copies", "weight"))
    done = rows.filter(~held & F.col("exact").isNotNull()).select("seq", "positive", F.col("exact").alias("tier"), "score")
    near = F.coalesce(F.col("best") >= FUZZY, F.lit(False))
    clear = F.col("best") - F.col("second") >= MARGIN
    tier = (
        F.when(near & ~clear, "ambiguous_skipped")
        .when(near & F.col("fuzzy").isNotNull(), TIERS[2])
        .when(F.col("loosely").isNotNull(), F.col("loosely"))
        .when(F.col("best") < FUZZY, "below_threshold")
        .otherwise("unmatched")
    )
    score = F.when(F.col("tier") == TIERS[2], F.col("fuzzy")).when(F.col("tier") == F.col("loosely"), F.col("loose_score"))
    rest = rows.filter(~held & F.col("exact").isNull()).select("seq", "positive", "loosely", "loose_score", "gid").join(found, "gid", "left").withColumn("tier", tier)
    return done.unionByName(rest.select("seq", "positive", "tier", score.alias("score"))).withColumn("score", F.round("score", 6))


def join_stats(feedback: DataFrame, traces: DataFrame) -> DataFrame:
    return corpus_join(feedback, traces).groupBy("tier").agg(F.count("*").alias("n"), F.count_if("positive").alias("n_positive"))


def backfill_paths(traces: DataFrame, feedback: DataFrame) -> DataFrame:
    """Paths for traces without one: ``trace_no, filled_path, source``.

    In order: feedback of the same title, of the same normalised title, the
    trace's own precedents; each only if it names exactly one path.
    """
    rows = feedback.filter("finding_title != '' AND file_path != ''").select(F.col("finding_title").alias("title"), normalize_title(F.col("finding_title")).alias("norm"), "file_path")

    def one_path(key: str, name: str) -> DataFrame:
        # min and max tell whether there is one path without collecting them
        return rows.filter(F.col(key) != "").groupBy(key).agg(F.min("file_path").alias(name), (F.min("file_path") != F.max("file_path")).alias(f"{name}_many"))

    own = F.array_distinct(F.filter(F.transform("matched_precedents", lambda p: p["file_path"]), lambda p: p.isNotNull() & (p != "")))
    asked = traces.select(
        "trace_no", F.coalesce("file_path", F.lit("")).alias("path"), F.coalesce("finding_title", F.lit("")).alias("title"),
        normalize_title(F.coalesce("finding_title", F.lit(""))).alias("norm"), F.coalesce(own, F.array().cast("array<string>")).alias("own"),
    )
    joined = asked.join(one_path("title", "exact"), "title", "left").join(one_path("norm", "similar"), "norm", "left")
    source = (
        F.when(F.col("path") != "", "already_present")
        .when(F.col("title") == "", "no_match")
        .when(F.col("exact_many") == F.lit(False), "feedback_exact")
        .when(F.col("similar_many") == F.lit(False), "feedback_normalized")
        .when(F.size("own") == 1, "precedent_inferred")
        .when(F.coalesce("exact_many", F.lit(False)) | F.coalesce("similar_many", F.lit(False)), "ambiguous")
        .otherwise("no_match")
    )
    filled = F.when(F.col("source") == "already_present", F.col("path")).when(F.col("source") == "feedback_exact", F.col("exact")).when(F.col("source") == "feedback_normalized", F.col("similar")).when(F.col("source") == "precedent_inferred", F.get("own", 0))
    return joined.withColumn("source", source).select("trace_no", filled.alias("filled_path"), "source")


#: Most suppression rules that are applied as one list of conditions.
MOST_RULES = 1_000


def suppress(findings: DataFrame, rules: list[dict]) -> DataFrame:
    """Findings with the first rule that matches: all columns and ``rule_no`` (null: kept).

    A rule ``{"pattern", "category"?, "file"?}`` matches where the title has
    the pattern as text in any case, the category is the same and the path
    fits the glob. The rules are compiled into one expression, so there is no join.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    first = F.lit(None).cast("int")
    for n, rule in reversed(list(enumerate(rules, 1))):
        hit = F.contains(F.lower("title"), F.lit(rule["pattern"].lower()))
        if rule.get("category"):
            hit = hit & (category(F.col("category")) == category(F.lit(rule["category"])))
        if rule.get("file"):
            hit = hit & F.coalesce(F.replace("file_path", F.lit("\\"), F.lit("/")).rlike(glob_regex(rule["file"])), F.lit(False))
        first = F.when(hit, n).otherwise(first)
    return findings.withColumn("rule_no", first)
