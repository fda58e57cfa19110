"""Column functions for scores: composition, weights that fade, verdicts, statistics of top lists, quantised vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOOST_FLOOR = 1.0
EPSILON = 1e-6
#: Inspections over which short, mid and long memories fade.
FADING = (100.0, 1000.0, 10000.0)
DEFAULT_SEVERITY = 2


def composed(raw: Column, critical: Column | None = None, negative: Column | None = None, alpha: float = 0.0, beta: float = 0.0) -> Column:
    """raw + alpha / (1 + critical) - beta / (1 + negative); a term counts only where its distance is known."""
    out = raw
    if critical is not None and alpha:
        out = out + F.coalesce(alpha / (BOOST_FLOOR + critical), F.lit(0.0))
    if negative is not None and beta:
        out = out - F.coalesce(beta / (BOOST_FLOOR + negative), F.lit(0.0))
    return out


def clamped_severity(severity: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(3), severity))


def severity_weight(severity: Column) -> Column:
    return severity / 2.0


def freshness(now: Column, last_hit: Column, memory: Column) -> Column:
    fading = F.element_at(F.array(*[F.lit(x) for x in FADING]), memory.cast("int") + 1)
    return F.exp(-F.greatest(now - last_hit, F.lit(0)) / fading)


def multiplier(severity: Column, now: Column, last_hit: Column, memory: Column) -> Column:
    return severity_weight(severity) * freshness(now, last_hit, memory)


def weighted_distance(distance: Column, weight: Column) -> Column:
    """Far where the weight is small, so faded rows stop to be near."""
    return distance / (weight + EPSILON)


def verdict(tier: Column, value: Column, threshold: Column) -> Column:
    over = value > threshold
    return F.when(tier == "normal", F.when(over, "fp").otherwise("ok")).when(tier == "critical", F.when(over, "ng").otherwise("miss")).otherwise("neg")


def ng_degree(value: Column, low: Column, high: Column) -> Column:
    """0 to 100; null unless high is above low."""
    share = (value - low) / F.when(high > low, 2 * (high - low))
    return F.when(share.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * 100)


def mean_of_first(scores: Column, k: Column | int) -> Column:
    """Mean of the first k (all, if fewer) of a list; null for an empty one."""
    n = F.least(F.lit(k) if isinstance(k, int) else k, F.size(scores))
    return F.aggregate(F.slice(scores, 1, F.greatest(n, F.lit(1))), F.lit(0.0), lambda a, x: a + x) / F.when(n > 0, n)


def composite_list(top: Column, cmin: Column, alpha: Column | float) -> Column:
    """Top scores with alpha's boost, sorted from the largest; null where a list is missing or alpha is 0."""
    a = F.lit(alpha) if isinstance(alpha, (int, float)) else alpha
    usable = (a > 0) & (F.size(top) > 0) & (F.size(cmin) == F.size(top))
    boosted = F.zip_with(top, cmin, lambda s, c: s + a / (BOOST_FLOOR + c))
    return F.when(usable, F.reverse(F.array_sort(boosted)))


def stat_with_alpha(top: Column, cmin: Column, patches: Column, p99: Column, highest: Column, kind: str, k: Column | int, alpha: Column | float) -> Column:
    """An image's statistic (topk mean or p99) on the composite scale; the raw one without exemplar distances."""
    both = composite_list(top, cmin, alpha)
    if kind == "p99":
        at = F.least(F.size(both) - 1, F.greatest(F.lit(0), F.floor(patches * 0.01 + 0.5).cast("int")))
        return F.coalesce(F.get(both, at), p99)
    return F.coalesce(mean_of_first(both, k), mean_of_first(top, k), highest)


def patch_floor(top: Column, cmin: Column, mean: Column, alpha: float) -> Column:
    """The least composite of an image's cached rows."""
    both = composite_list(top, cmin, alpha)
    return F.coalesce(F.element_at(both, -1), F.when(F.size(top) > 0, F.element_at(top, -1)), mean)


def thresholded_class(cls: Column, confidence: Column, least: float) -> Column:
    """Foreground below the least confidence becomes background."""
    return cls if least <= 0 else F.when((cls > 0) & (confidence < least), 0).otherwise(cls)


def quantised(vector: Column, scale: Column) -> Column:
    """Codes from -127 to 127, rounded half to even."""
    return F.zip_with(vector, scale, lambda x, s: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x / s))).cast("tinyint"))


def dequantised(codes: Column, scale: Column) -> Column:
    return F.zip_with(codes, scale, lambda c, s: c * s)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def masked_logits(logits: Column, active: Column) -> Column:
    """Logits of classes that aren't active, 0 always being so, as good as impossible."""
    return F.transform(logits, lambda v, i: F.when((i == 0) | F.array_contains(active, i), v).otherwise(F.lit(-1e9)))
