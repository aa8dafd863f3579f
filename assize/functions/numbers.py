"""Numeric expressions: ratios, intervals, decay, vectors, display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000

#: z of a two-sided interval by confidence level (fixed values).
Z = {0.99: 2.576, 0.95: 1.96, 0.90: 1.645}

#: Price per million tokens in and out by model name: kind of match, text, prices; first match wins (fixed values).
PRICES = (
    ("prefix", "gpt-5.4", 2.5, 15.0),
    ("prefix", "gpt-5.3", 1.0, 4.0),
    ("prefix", "gpt-5.2", 1.75, 14.0),
    ("prefix", "gpt-4o", 2.5, 10.0),
    ("prefix", "gpt-4.1", 2.0, 8.0),
    ("prefix", "o3", 2.0, 8.0),
    ("prefix", "o4-mini", 1.1, 4.4),
    ("within", "claude-sonnet", 3.0, 15.0),
    ("within", "claude-opus", 5.0, 25.0),
    ("within", "claude-haiku", 1.0, 5.0),
    ("prefix", "gemini-2.5-pro", 1.25, 2.50),
    ("prefix", "gemini-2.5-flash", 0.10, 0.40),
)
FALLBACK_PRICE = (3.0, 15.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def precision(tp: Column, partial: Column, fp: Column) -> Column:
    return ratio(tp + partial, tp + partial + fp)


def wilson(k: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Lower and upper Wilson bound of k of n; (0, 1) for n = 0."""
    z = Z.get(level, 1.96)
    p = F.try_divide(k, n)
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n))
    scale = 1 + F.try_divide(F.lit(z * z), n)
    mid = p + F.try_divide(F.lit(z * z / 2), n)
    low = F.greatest(F.lit(0.0), (mid - half) / scale)
    high = F.least(F.lit(1.0), (mid + half) / scale)
    return F.coalesce(low, F.lit(0.0)), F.coalesce(high, F.lit(1.0))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def age_days(now_us: int, ts: Column) -> Column:
    """Whole days between ``now_us`` and ``ts``, elapsed time, cut toward zero."""
    return ((F.lit(now_us) - micros(ts)) / DAY_US).cast("long")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for unequal lengths or a zero vector."""
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(F.size(a) == F.size(b), F.coalesce(value, F.lit(0.0))).otherwise(0.0)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, v: s + v))


def price(model: Column) -> tuple[Column, Column]:
    """Price per million tokens in and out; an unknown model has the fallback price."""
    out = []
    for k in (2, 3):
        c = None
        for row in PRICES:
            hit = model.startswith(row[1]) if row[0] == "prefix" else model.contains(row[1])
            c = F.when(hit, row[k]) if c is None else c.when(hit, row[k])
        out.append(c.otherwise(FALLBACK_PRICE[k - 2]))
    return out[0], out[1]


def count_text(n: Column) -> Column:
    """1.2k, 3.4M and the like."""
    return (
        F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000.0))
        .when(n >= 1_000, F.format_string("%.1fk", n / 1_000.0))
        .otherwise(n.cast("string"))
    )


def duration_text(ms: Column) -> Column:
    return F.when(ms < 4000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.format_string("%.1fs", ms / 1000.0))


def percent_text(share: Column) -> Column:
    """A share as whole per cent; ``n/a`` if it isn't finite."""
    return F.when(_finite(share), F.concat(F.round(share * 100).cast("bigint").cast("string"), F.lit("%"))).otherwise("n/a")


def cost_text(dollars: Column) -> Column:
    """Dollars with two places, with four under a cent."""
    return F.when((dollars > 0) & (dollars < 0.01), F.format_string("$%.4f", dollars)).otherwise(F.format_string("$%.2f", dollars))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def trend_arrow(values: Column) -> Column:
    """up, down or flat: first against last value, with a band of 5 %; flat for fewer than two and for ends that aren't finite."""
    first, last = F.element_at(values, 1), F.element_at(values, -1)
    change = (last - first) / F.greatest(F.abs(first), F.lit(1e-9))
    known = (F.size(values) >= 2) & _finite(first) & _finite(last)
    return F.when(known & (change > 0.05), "up").when(known & (change < -0.05), "down").otherwise("flat")


def sparkline(values: Column, levels: str = "▁▂▃▄▅▆▇█") -> Column:
    """A glyph per value, eight levels or those of ``levels`` (``_.-=^`` in ASCII); a flat series and values that aren't finite are lowest."""
    glyphs = F.array(*[F.lit(c) for c in levels])
    finite = F.filter(F.transform(values, lambda v: v.cast("double")), _finite)
    low, high = F.array_min(finite), F.array_max(finite)
    level = lambda v: F.when(_finite(v) & (high > low), F.round((v - low) / (high - low) * (len(levels) - 1)).cast("int")).otherwise(0)
    return F.array_join(F.transform(values, lambda v: F.element_at(glyphs, level(v.cast("double")) + 1)), "")
