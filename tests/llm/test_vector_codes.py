"""Codes against plain loops, and the sliced search against all distances."""

import math

import numpy as np
import pytest

from patchlake.llm.vector_codes import Slices, codebooks, compress, restored

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, parts, entries, rounds):
    kept = [(i, [math.floor(1024 * np.float32(x).item()) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = len(kept[0][1]) // parts
    cut = {i: [tuple(v[p * d : (p + 1) * d]) for p in range(parts)] for i, v, _ in kept}
    ids = sorted(cut)
    books = [[cut[i][p] for i in ids[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for i in ids:
                own[near(p, cut[i][p])[1]].append(cut[i][p])
            books[p] = [tuple(sum(c) // len(m) for c in zip(*m, strict=True)) if m else e for e, m in zip(books[p], own, strict=True)]
    found = {i: [near(p, cut[i][p]) for p in range(parts)] for i in ids}
    return books, {i: ([k for _, k in f], sum(e for e, _ in f)) for i, f in found.items()}


def vectors(seed, n=300, d=12):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, d)], int(rng.integers(3))) for i in rng.permutation(n)]
    rows[3] = (rows[3][0], None, 1)
    rows[4] = (rows[4][0], [None] + rows[4][1][1:], None)
    rows[5] = (rows[5][0], [float("nan")] + rows[5][1][1:], 1)
    rows[6] = (rows[6][0], [float("-inf")] + rows[6][1][1:], 1)
    rows += [(n + i, rows[10 + i % 3][1], None) for i in range(40)]  # equal vectors
    return rows


@pytest.mark.parametrize(("entries", "parts"), [(16, 4), (256, 3), (100, 1)])
def test_brute_force(spark, entries, parts):
    rows = vectors(entries)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    books = codebooks(df, parts=parts, entries=entries)
    want, codes = brute(rows, parts, entries, 4)
    assert books.tolist() == [[list(e) for e in b] for b in want]
    got = {r.vec_id: (r.codes, r.error) for r in compress(df, books, keep=["vec_id"]).collect()}
    assert got == codes


@pytest.mark.parametrize("spread", [3, 1000, 10**6])
def test_slices_find_the_nearest(spread):
    rng = np.random.default_rng(spread)
    for k, d in ((1, 4), (63, 2), (64, 5), (200, 16), (256, 1)):
        book, x = rng.integers(-spread, spread, (k, d)), rng.integers(-2 * spread, 2 * spread, (1500, d))
        code, apart = Slices(book).nearest(x)
        every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (code == every.argmin(axis=1)).all() and (apart == every.min(axis=1)).all()


def test_lengths_extremes_and_empty_tables(spark):
    rows = [(None, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (2, [1.0], None), (2, [1.0], 1), (3, [], 1), (4, [3e38, -3e38], 2), (5, None, 1)]
    df = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", codes int")
    books = codebooks(df)
    assert books.shape == (4, 5, 2)
    got = compress(df, books)
    assert got.columns == ["vec_id", "embedding", "label", "codes", "_codes", "error"] and got.count() == 5
    assert {r.error for r in got.collect()} == {0}
    assert codebooks(df.where("false")) is None and codebooks(df.where("vec_id = 5")) is None


def test_restored():
    books = np.arange(24).reshape(2, 3, 4)
    assert restored(books, np.array([[0, 2], [1, 1]])).tolist() == [[0, 1, 2, 3, 20, 21, 22, 23], [4, 5, 6, 7, 16, 17, 18, 19]]
