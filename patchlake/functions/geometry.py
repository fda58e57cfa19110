"""Column functions for the sliding-window grid: offsets, row counts, rectangles, padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW, STRIDE, PATCH = 518, 388, 14


def axis_offsets(size: Column, window: int = WINDOW, stride: int = STRIDE) -> Column:
    """Starts along one axis; the last one is held at the far edge."""
    last = (size - window).cast("int")
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def window_offsets(height: Column, width: Column, window: int = WINDOW, stride: int = STRIDE) -> Column:
    """(y, x) of all windows in row-major order; one at the origin if either side is shorter than a window."""
    origin = F.array(F.struct(F.lit(0).alias("y"), F.lit(0).alias("x")))
    tall, wide = F.greatest(height, F.lit(window)), F.greatest(width, F.lit(window))
    grid = F.flatten(F.transform(axis_offsets(tall, window, stride), lambda y: F.transform(axis_offsets(wide, window, stride), lambda x: F.struct(y.alias("y"), x.alias("x")))))
    return F.when((height < window) | (width < window), origin).otherwise(grid)


def padded(side: Column, window: int = WINDOW) -> Column:
    return F.greatest(side, F.lit(window))


def expected_rows(height: Column, width: Column, window: int = WINDOW, stride: int = STRIDE, patch: int = PATCH) -> Column:
    """Rows of an image: windows over the padded image times patches in a window."""
    side = window // patch
    return F.size(axis_offsets(padded(height, window), window, stride)) * F.size(axis_offsets(padded(width, window), window, stride)) * (side * side)


def rows_for_rects(height: Column, width: Column, rects: Column, window: int = WINDOW, stride: int = STRIDE, patch: int = PATCH) -> Column:
    """Sorted distinct grid rows whose patches meet a rectangle (x, y, w, h as shares of the image)."""
    side = window // patch
    windows = window_offsets(padded(height, window), padded(width, window), window, stride)

    def span(low: Column, high: Column, start: Column) -> tuple[Column, Column]:
        return F.greatest(F.lit(0), F.floor((low - start) / patch).cast("int")), F.least(F.lit(side - 1), F.ceil((high - start) / patch).cast("int") - 1)

    def in_window(r: Column):
        def rows(w: Column, i: Column) -> Column:
            (y0, y1), (x0, x1) = span(r["y"] * height, (r["y"] + r["h"]) * height, w["y"]), span(r["x"] * width, (r["x"] + r["w"]) * width, w["x"])
            cells = F.flatten(F.transform(F.sequence(y0, y1), lambda y: F.transform(F.sequence(x0, x1), lambda x: i * (side * side) + y * side + x)))
            return F.when((y0 <= y1) & (x0 <= x1), cells).otherwise(F.array().cast("array<int>"))

        return rows

    solid = F.filter(rects, lambda r: (r["w"] > 0) & (r["h"] > 0))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(solid, lambda r: F.flatten(F.transform(windows, in_window(r)))))))


def reflected(i: Column, size: Column) -> Column:
    """The source index of a padded one: mirrored at the edge, which isn't repeated. Pads shorter than the side only."""
    return F.when(i < size, i).otherwise(2 * (size - 1) - i)


def snapped(value: Column, stride: int, least: int = 64) -> Column:
    """Rounded up to a multiple of the stride."""
    return (F.ceil(F.greatest(F.lit(least), F.floor(value + 0.5)) / stride) * stride).cast("int")
