"""Colours of heat maps as columns: piecewise-linear maps, a scale about a threshold, and blending over an image.

Defined cases: null heat has null colours; values outside of a scale take its ends; a scale
without extent (its ends equal) is taken as a tiny one; an image whose 99th percentile is 0
is scaled to 1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares of the image and of the heat map in an overlay.
IMAGE_SHARE, HEAT_SHARE = 0.55, 0.45
#: Red, green, blue of the level of good images, of the threshold, and of bad ones.
GOOD, LIMIT, BAD = (0, 114, 178), (235, 235, 235), (213, 94, 0)
#: Red, green, blue, alpha by kind of pixel of an error map.
KINDS = {"tp": (0, 200, 0, 200), "fp": (220, 40, 40, 200), "fn": (255, 200, 0, 200), "tn": (0, 0, 0, 40), "ignored": (0, 0, 0, 0)}
#: Coefficients of the published polynomials of the Turbo map, from the constant up.
TURBO = (
    (0.13572138, 4.61539260, -42.66032258, 132.13108234, -152.94239396, 59.28637943),
    (0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604),
    (0.10667330, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973),
)
LEAST_SPAN = 1e-6
CHANNELS = ("r", "g", "b")


def held(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def tents(x: Column) -> dict[str, Column]:
    tent = lambda middle: F.floor(held(1.5 - F.abs(4 * x - middle), 0.0, 1.0) * 255 + 0.5)
    return dict(zip(CHANNELS, (tent(3), tent(2), tent(1)), strict=True))


def jet(share: Column) -> dict[str, Column]:
    """Channels, 0 to 255, of a share of the scale cut to 255 steps: three tents with flat tops."""
    return tents(F.floor(held(share, 0.0, 1.0) * 255) / 255)


def turbo(share: Column) -> dict[str, Column]:
    """Channels, 0 to 255, of the Turbo map."""
    x = held(share, 0.0, 1.0)
    poly = lambda c: reduce(lambda a, k: a * x + F.lit(k), reversed(c[:-1]), F.lit(c[-1]))
    return {n: F.floor(held(poly(c), 0.0, 1.0) * 255) for n, c in zip(CHANNELS, TURBO, strict=True)}


def about(t: Column) -> dict[str, Column]:
    down, up = held(-t, 0.0, 1.0), held(t, 0.0, 1.0)
    return {n: m * (1 - down - up) + g * down + b * up for n, m, g, b in zip(CHANNELS, LIMIT, GOOD, BAD, strict=True)}


def diverging(heat: Column, low: Column, threshold: Column) -> dict[str, Column]:
    """Channels of a scale that has its middle at the threshold, and its ends at `low` and as far above."""
    return about(held((heat - threshold) / F.greatest(threshold - low, F.lit(LEAST_SPAN)), -1.0, 1.0))


def percentile_limits(pixels: DataFrame, by: str = "image", heat: str = "heat") -> DataFrame:
    """`by`, vmin, vmax: the interpolated 5th and 99th percentiles of each image, in one pass."""
    at = pixels.groupBy(by).agg(F.percentile(heat, F.array(F.lit(0.05), F.lit(0.99))).alias("p"))
    return at.select(by, F.col("p")[0].alias("vmin"), F.when(F.col("p")[1] == 0, F.lit(1.0)).otherwise(F.col("p")[1]).alias("vmax"))


def overlays(pixels: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """The columns, with r, g, b of the heat map over the image. pixels: image, heat, and r, g, b of the image (0 to 255); anchors: image, low, high.

    Images with anchors (low below high) get the scale about the threshold `high`, the same for every
    image; others their own percentiles.
    """
    base = pixels.join(percentile_limits(pixels).withColumnRenamed("image", "__image"), F.col("image").eqNullSafe(F.col("__image"))).drop("__image")
    if anchors is None:
        base = base.withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    else:
        base = base.join(anchors.select("image", "low", "high"), "image", "left")
    anchored = F.col("low") < F.col("high")
    share = (F.col("heat") - F.col("vmin")) / F.greatest(F.col("vmax") - F.col("vmin"), F.lit(LEAST_SPAN))
    t = held((F.col("heat") - F.col("high")) / F.greatest(F.col("high") - F.col("low"), F.lit(LEAST_SPAN)), -1.0, 1.0)
    # columns of their own, so that what colours share is worked out once
    base = base.withColumns({"__anchored": F.coalesce(anchored, F.lit(False)), "__share": F.floor(held(share, 0.0, 1.0) * 255) / 255, "__t": t})
    own, fixed = tents(F.col("__share")), about(F.col("__t"))
    heat = {n: F.when(F.col("__anchored"), fixed[n]).otherwise(own[n]) for n in CHANNELS}
    base = base.withColumns({f"__{n}": held(F.col(n) * IMAGE_SHARE + c * HEAT_SHARE, 0.0, 255.0) for n, c in heat.items()})
    cut = {n: F.when(F.col("__anchored"), F.floor(f"__{n}")).otherwise(F.rint(f"__{n}")).cast("int") for n in CHANNELS}
    return base.select(*[c if c not in cut else cut[c].alias(c) for c in pixels.columns])


def error_colors(kind: Column) -> Column:
    """red, green, blue, alpha of a kind of pixel (tp, fp, fn, tn, ignored)."""
    out = F.lit(None).cast("struct<r:int,g:int,b:int,a:int>")
    for name, color in KINDS.items():
        out = F.when(kind == name, F.struct(*[F.lit(v).alias(n) for n, v in zip((*CHANNELS, "a"), color, strict=True)])).otherwise(out)
    return out
