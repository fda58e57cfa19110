"""Table functions for SQL: windows of an image, and the rows that rectangles cover."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from patchlake.functions.geometry import PATCH, STRIDE, WINDOW, rows_for_rects, window_offsets


class WindowOffsets:
    """window_offsets(height, width): win, y, x."""

    def eval(self, height: int, width: int):
        def axis(n: int) -> list[int]:
            starts = list(range(0, n - WINDOW + 1, STRIDE))
            return starts if starts[-1] == n - WINDOW else [*starts, n - WINDOW]

        if height < WINDOW or width < WINDOW:
            yield 0, 0, 0
            return
        for i, (y, x) in enumerate((y, x) for y in axis(height) for x in axis(width)):
            yield i, y, x


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL in this session."""
    spark.udtf.register("window_offsets", F.udtf(WindowOffsets, returnType="win int, y int, x int"))


__all__ = ["PATCH", "WindowOffsets", "register", "rows_for_rects", "window_offsets"]
