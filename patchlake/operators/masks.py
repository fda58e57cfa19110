"""Masks in long form (image, y, x, class): regions, size filters, morphology, presence, error maps.

Pixels are dealt out by square tiles of an image, not by image. A task labels the parts of
all tiles that it holds at once, whatever number of small images these are; the parts of
a tile are numbered by their first pixel. Parts that meet at a border of tiles are linked,
and components over these links (star steps) join them, so a mask of any size is
labelled in bounded memory. Areas, boxes and centres are sums over parts.

Morphology gives each tile the pixels around it that its steps can reach.

Defined cases: repeated pixels of one class count once, pixels with several classes are
one of each; rows with a null place or class are left out of regions and stay as they
are elsewhere; negative places are allowed; empty tables give no rows; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake.operators.star import components
from patchlake.sources.shared import materialise

IGNORED = 255
#: Side of a tile in pixels; rows that are labelled at once, about.
TILE, TOGETHER = 512, 1 << 17
#: Pixels of masks that are morphed together.
CELLS = 1 << 20
#: Parts with another area than in their tile are sent to tasks up to this number, and joined by a shuffle beyond it.
SENT_PARTS = 500_000


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of the numbers below n that each is linked with, over any number of links a, b."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def labelled_places(tile: np.ndarray, y: np.ndarray, x: np.ndarray, cls: np.ndarray, side: int, diagonal: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pixels (tile number, place in it, class): the index of the first pixel of each one's part (-1 for background), the part's area, and whether it's the first row of its pixel."""
    wide = side + 1  # a gap after each line and tile
    key = ((tile * wide + y) * wide + x) * 256 + cls
    order = np.argsort(key, kind="stable")
    key, own = key[order], cls[order] > 0
    a, b = [], []
    same = np.flatnonzero((key[1:] == key[:-1]) & own[1:])
    a.append(same)
    b.append(same + 1)
    for dy, dx in [(0, 1), (1, 0), *([(1, 1), (1, -1)] if diagonal else [])]:
        at = np.searchsorted(key, key + (dy * wide + dx) * 256)
        near = np.flatnonzero((at < len(key)) & own)
        near = near[key[at[near]] == key[near] + (dy * wide + dx) * 256]
        if dx < 0:
            near = near[x[order[near]] > 0]
        a.append(near)
        b.append(at[near])
    label = roots(len(key), np.concatenate(a), np.concatenate(b))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    area = np.bincount(label, first, len(key)).astype(np.int64)[label]
    part = np.where(own, order[label], -1)
    out = np.empty(len(key), np.int64), np.empty(len(key), np.int64), np.empty(len(key), bool)
    for to, value in zip(out, (part, area, first), strict=True):
        to[order] = value
    return out


def whole_tiles(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows ordered by their first three columns, in tables that cut no tile, and each row's tile number in its table."""

    def ends(t: pa.Table) -> np.ndarray:
        keys = [t.column(i).to_numpy() for i in range(3)]
        return np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1

    def numbers(t: pa.Table) -> np.ndarray:
        out = np.zeros(t.num_rows, np.int64)
        out[ends(t)] = 1
        return np.cumsum(out)

    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= least:
            t = pa.Table.from_batches(held).combine_chunks()
            cut = ends(t)
            if len(cut):
                last = int(cut[-1])
                yield t.slice(0, last), numbers(t.slice(0, last))
                t = t.slice(last)
            held, size = t.to_batches(), t.num_rows
    if size:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, numbers(t)


def labelled_rows(side: int, diagonal: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kept, py, px (first pixel of the part, null for background), local (its area in the tile), first."""
    for t, tile in whole_tiles(batches, TOGETHER):
        y, x, cls = (t.column(n).to_numpy() for n in ("y", "x", "class"))
        part, area, first = labelled_places(tile, y % side, x % side, cls, side, diagonal)
        none = part < 0
        at = np.maximum(part, 0)
        columns = [t.column("kept").combine_chunks(), pa.array(y[at], mask=none), pa.array(x[at], mask=none), pa.array(area, mask=none), pa.array(first)]
        yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], ["kept", "py", "px", "local", "first"])


def in_tiles(pixels: DataFrame, side: int) -> DataFrame:
    """image, ty, tx, y, x, class as whole numbers and kept (all columns), each tile in one task, one after the other."""
    y, x = F.col("y").cast("bigint"), F.col("x").cast("bigint")
    put = pixels.select(F.col("image").cast("bigint").alias("image"), F.floor(y / side).alias("ty"), F.floor(x / side).alias("tx"), y.alias("y"), x.alias("x"), F.col("class").cast("bigint").alias("class"), F.struct(*[F.col(f"`{c}`") for c in pixels.columns]).alias("kept"))
    return put.repartition("image", "ty", "tx").sortWithinPartitions("image", "ty", "tx")


def known(pixels: DataFrame):
    return F.col("image").isNotNull() & F.col("y").isNotNull() & F.col("x").isNotNull() & F.col("class").isNotNull()


def labelled(pixels: DataFrame, diagonal: bool, side: int = TILE) -> DataFrame:
    """kept (a struct of the pixel's columns), py, px, local, first; written."""
    put = in_tiles(pixels.where(known(pixels)), side)
    schema = T.StructType([put.schema["kept"], *[T.StructField(n, T.LongType()) for n in ("py", "px", "local")], T.StructField("first", T.BooleanType())])
    return materialise(put.mapInArrow(partial(labelled_rows, side, diagonal), schema), "labelled")


def joined_parts(found: DataFrame, diagonal: bool, side: int) -> DataFrame | None:
    """id, component: parts (image, class, y, x) that go on in other tiles, and the smallest part they belong to; None if there are none."""
    place = found.where("py is not null").select(*[F.col(f"kept.{c}").cast("bigint").alias(c) for c in ("image", "y", "x", "class")], "py", "px")
    part = F.struct("image", "class", F.col("py").alias("y"), F.col("px").alias("x"))
    edge = lambda c: F.pmod(c, F.lit(side)).isin(0, side - 1)
    border = place.where(edge(F.col("y")) | edge(F.col("x"))).select("image", "class", "y", "x", part.alias("part"))
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if diagonal else [])]
    near = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps]))
    asked = border.select("image", "class", F.col("part").alias("a"), F.floor(F.col("y") / side).alias("ty"), F.floor(F.col("x") / side).alias("tx"), near.alias("at"))
    other = (F.floor(F.col("at.y") / side) != F.col("ty")) | (F.floor(F.col("at.x") / side) != F.col("tx"))
    asked = asked.where(other).select("image", "class", F.col("at.y").alias("y"), F.col("at.x").alias("x"), "a")
    links = materialise(asked.join(border, ["image", "class", "y", "x"]).select("a", F.col("part").alias("b")).distinct(), "links")
    return None if links.isEmpty() else materialise(components(links), "components")


def regions(pixels: DataFrame, side: int = TILE) -> DataFrame:
    """Parts of one class, joined over corners too, from the largest: area, box, centre, mean confidence. pixels: image, y, x, class, confidence."""
    found = labelled(pixels, True, side)
    over = joined_parts(found, True, side)
    own = [F.col(f"kept.{c}").cast("bigint").alias(c) for c in ("image", "class", "y", "x")]
    rows = found.where("first and py is not null").select(*own, "py", "px", F.col("kept.confidence").cast("double").alias("confidence"))
    sums = {"area": F.count("*"), "sy": F.sum("y"), "sx": F.sum("x"), "y0": F.min("y"), "x0": F.min("x"), "y1": F.max("y"), "x1": F.max("x"), "sure": F.sum("confidence"), "n": F.count("confidence")}
    parts = rows.groupBy("image", "class", "py", "px").agg(*[c.alias(n) for n, c in sums.items()])
    if over is not None:
        named = parts.withColumn("id", F.struct("image", "class", F.col("py").alias("y"), F.col("px").alias("x"))).join(over, "id", "left")
        named = named.withColumns({"py": F.coalesce("component.y", "py"), "px": F.coalesce("component.x", "px")})
        folds = {n: (F.min if n in ("y0", "x0") else F.max if n in ("y1", "x1") else F.sum)(n) for n in sums}
        parts = named.groupBy("image", "class", "py", "px").agg(*[c.alias(n) for n, c in folds.items()])
    tenth = lambda total: F.rint(F.col(total) / F.col("area") * 10) / 10
    rank = F.row_number().over(Window.partitionBy("image").orderBy(F.col("area").desc(), "class", "y0", "x0", "py", "px")) - 1
    whole = {n: F.col(n).cast("int") for n in ("y0", "x0", "y1", "x1")}
    return parts.select("image", F.col("class").cast("int").alias("class"), "area", *[c.alias(n) for n, c in whole.items()], tenth("sy").alias("cy"), tenth("sx").alias("cx"), (F.col("sure") / F.col("n")).alias("confidence"), rank.alias("region"))


def size_filter(pixels: DataFrame, least: int, most: int = 0, side: int = TILE) -> DataFrame:
    """Parts (joined over sides only) smaller than `least`, or larger than `most` if it is above 0, become background."""
    found = labelled(pixels, False, side)
    over, area = joined_parts(found, False, side), F.col("local")
    part = F.struct(F.col("kept.image").cast("bigint").alias("image"), F.col("kept.class").cast("bigint").alias("class"), F.col("py").alias("y"), F.col("px").alias("x"))
    if over is not None:
        sizes = found.where("first and py is not null").groupBy(part.alias("id")).agg(F.count("*").alias("n"))
        members = over.unionByName(over.select(F.col("component").alias("id"), "component").distinct()).join(sizes, "id")
        totals = members.groupBy("component").agg(F.sum("n").alias("whole"))
        wholes = materialise(members.join(totals, "component").select("id", "whole"), "wholes")
        found = found.withColumn("id", part).join(F.broadcast(wholes) if wholes.count() <= SENT_PARTS else wholes, "id", "left")
        area = F.coalesce("whole", "local")
    odd = (area < least) | ((area > most) if most > 0 else F.lit(False))
    out = found.select(*[F.when(F.coalesce(odd, F.lit(False)), F.lit(0).cast(pixels.schema[c].dataType)).otherwise(F.col("kept.class")).alias(c) if c == "class" else F.col("kept").getField(c).alias(c) for c in pixels.columns])
    return out.unionByName(pixels.where(~known(pixels)))


def spread(masks: np.ndarray, side: int, largest: bool) -> np.ndarray:
    """Largest or smallest value in a square around each pixel of each mask; outside counts as no pixel."""
    r, fold = side // 2, np.maximum if largest else np.minimum
    for axis in (1, 2):
        wide = np.pad(masks, [(r, r) if a == axis else (0, 0) for a in range(3)], constant_values=not largest)
        parts = (np.take(wide, np.arange(i, i + masks.shape[axis]), axis=axis) for i in range(side))
        out = next(parts)
        for p in parts:
            fold(out, p, out=out)
        masks = out
    return masks


def morphed(masks: np.ndarray, kind: str, square: int) -> np.ndarray:
    """The masks (number, line, column) of one shape with their new classes."""
    new = np.zeros_like(masks)
    for c in np.unique(masks[masks > 0]):  # a higher class wins
        has = np.flatnonzero((masks == c).any(axis=(1, 2)))
        here = masks[has] == c
        for step in kind.split("_"):
            here = spread(spread(here, square, step == "close"), square, step != "close")
        new[has] = np.where(here, c, new[has])
    return new


def morphed_rows(kind: str, square: int, side: int, reach: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tiles' own pixels with their new class; pixels of tiles around them only lend their class. Tiles of one shape are morphed together."""
    for t, tile in whole_tiles(batches, TOGETHER):
        y, x, cls, own, *box = (t.column(n).to_numpy(zero_copy_only=False) for n in ("y", "x", "class", "own", "ty", "tx", "y0", "x0", "y1", "x1"))
        out = np.empty(len(y), np.int64)
        first = np.flatnonzero(np.diff(tile, prepend=-1))
        ty, tx, y0, x0, y1, x1 = (v[first].astype(np.int64) for v in box)
        top, left = np.maximum(y0, ty * side - reach), np.maximum(x0, tx * side - reach)
        shape = np.stack([np.minimum(y1, (ty + 1) * side - 1 + reach) - top + 1, np.minimum(x1, (tx + 1) * side - 1 + reach) - left + 1], axis=1)
        shapes, which = np.unique(shape, axis=0, return_inverse=True)
        rows = np.argsort(which[tile], kind="stable")  # by shape, then tile
        row_ends, tiles, tile_ends = np.cumsum(np.bincount(which[tile])), np.argsort(which, kind="stable"), np.cumsum(np.bincount(which))
        for (h, w), row_end, m, tile_end, n in zip(shapes.tolist(), row_ends, np.bincount(which[tile]), tile_ends, np.bincount(which), strict=True):
            mine, at = tiles[tile_end - n : tile_end], rows[row_end - m : row_end]
            place = np.searchsorted(mine, tile[at])
            step = max(1, CELLS // (h * w))
            for i in range(0, n, step):
                lo, hi = np.searchsorted(place, [i, i + step])
                some, of = at[lo:hi], place[lo:hi] - i
                spot = of, y[some] - top[tile[some]], x[some] - left[tile[some]]
                masks = np.zeros((min(step, n - i), h, w), np.int64)
                np.maximum.at(masks, spot, cls[some])
                out[some] = morphed(masks, kind, square)[spot]
        yield pa.RecordBatch.from_arrays([t.column("kept").combine_chunks().filter(pa.array(own)), pa.array(out[own])], ["kept", "morphed"])


def morphology(pixels: DataFrame, kind: str, kernel: int, side: int = TILE) -> DataFrame:
    """kind: open, close or open_close, with a square of odd side, at least 3. An image reaches from its origin (or smallest place below) to its largest place; missing pixels are background, outside there's nothing."""
    if kind not in ("open", "close", "open_close"):
        raise ValueError(f"unknown kind: {kind!r}")
    square = max(3, kernel | 1)
    reach = square // 2 * 2 * len(kind.split("_"))
    side = max(side, 2 * reach)
    y, x = F.col("y").cast("bigint"), F.col("x").cast("bigint")
    whole = pixels.where(known(pixels)).select(F.col("image").cast("bigint").alias("image"), y.alias("y"), x.alias("x"), F.col("class").cast("bigint").alias("class"), F.struct(*[F.col(f"`{c}`") for c in pixels.columns]).alias("kept"))
    box = materialise(whole.groupBy("image").agg(F.least(F.min("y"), F.lit(0)).alias("y0"), F.least(F.min("x"), F.lit(0)).alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1")), "boxes")
    whole = whole.join(F.broadcast(box) if box.count() <= SENT_PARTS else box, "image")
    y, x = F.col("y"), F.col("x")
    tiles = F.explode(F.array_distinct(F.array(*[F.struct(F.floor((y + a) / side).alias("ty"), F.floor((x + b) / side).alias("tx")) for a in (-reach, 0, reach) for b in (-reach, 0, reach)])))
    put = whole.select("*", tiles.alias("t"))
    own = (F.col("t.ty") == F.floor(y / side)) & (F.col("t.tx") == F.floor(x / side))
    put = put.select("image", "t.ty", "t.tx", "y", "x", "class", own.alias("own"), "y0", "x0", "y1", "x1", "kept")
    dealt = put.repartition("image", "ty", "tx").sortWithinPartitions("image", "ty", "tx")
    schema = T.StructType([put.schema["kept"], T.StructField("morphed", T.LongType())])
    out = dealt.mapInArrow(partial(morphed_rows, kind, square, side, reach), schema)
    out = out.select(*[F.col("morphed").cast(pixels.schema[c].dataType).alias(c) if c == "class" else F.col("kept").getField(c).alias(c) for c in pixels.columns])
    return out.unionByName(pixels.where(~known(pixels)))


def class_presence(pixels: DataFrame, classes: DataFrame) -> DataFrame:
    """Every class with the number of images that show it, and whether it stays active (background always, others if shown)."""
    seen = pixels.where(F.col("class") != IGNORED).select("image", "class").distinct().groupBy(F.col("class").alias("id")).agg(F.count("*").alias("images"))
    out = classes.join(seen, "id", "left").na.fill(0, ["images"])
    return out.withColumn("active", (F.col("id") == 0) | (F.col("active") & (F.col("images") > 0)))


def mask_summary(pixels: DataFrame) -> DataFrame:
    """image, has_foreground, class_ids (sorted, without background and ignored)."""
    real = ~F.col("class").isin(0, IGNORED)
    ids = F.array_sort(F.collect_set(F.when(real, F.col("class"))))  # at most 254
    return pixels.groupBy("image").agg(F.max(F.col("class") > 0).alias("has_foreground"), ids.alias("class_ids"))


def purge_class(pixels: DataFrame, cls: int) -> DataFrame:
    return pixels.withColumn("class", F.when(F.col("class") == cls, 0).otherwise(F.col("class")))


def orphan_classes(pixels: DataFrame, classes: DataFrame) -> DataFrame:
    """id, name of classes that masks show and the list lacks."""
    seen = pixels.select(F.col("class").alias("id")).distinct().where(~F.col("id").isin(0, IGNORED))
    return seen.join(classes, "id", "left_anti").select("id", F.concat(F.lit("recovered-"), F.col("id").cast("string")).alias("name"))


def error_map(pairs: DataFrame) -> DataFrame:
    """pairs (gt, pred, ...) with kind: tp, fp, fn, tn, or ignored."""
    gt, pred = F.col("gt"), F.col("pred")
    kind = F.when(gt == IGNORED, "ignored").when((gt > 0) & (pred == gt), "tp").when((pred > 0) & (pred != gt), "fp").when(gt > 0, "fn").otherwise("tn")
    return pairs.withColumn("kind", kind)
