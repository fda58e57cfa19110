"""Pairs that single precision leaves out of a search."""

import numpy as np
import pandas as pd
import pytest

from patchlake.operators import knn


def block_of(x, entry):
    return {"entry": pd.Series(entry), "vec": x, "norm": knn.norms(x)}


@pytest.mark.parametrize("scale, shift", [(1, 0), (1, 1e5), (1e-3, 1e3), (1e-25, 0), (1e18, 0), (1e120, 0)])
def test_no_near_pair_is_left_out(monkeypatch, scale, shift):
    monkeypatch.setattr(knn, "WIDE", 64)
    monkeypatch.setattr(knn, "TILE_BYTES", 8 * 64 * 50)
    x = (np.random.default_rng(4).normal(size=(1500, 9)) + shift) * scale
    x[1000:1100] = x[:100]  # equal rows of other entries
    entry = np.arange(1500) // 7
    monkeypatch.setattr(knn, "read_block", lambda path, b: block_of(x[b::3], entry[b::3]))
    got = pd.concat(knn.mean_rows("", 3, 5, "entry", ["id"], iter([pd.DataFrame({"id": range(1500), "entry": entry, "vec": list(x)})])))
    d = np.sqrt((((x[:, None] - x[None]) / scale) ** 2).sum(axis=2))
    d[entry[:, None] == entry[None]] = np.inf
    # pairs of a first tile are |q|^2 + |b|^2 - 2qb
    off = np.sqrt(knn.NOISE * (knn.norms(x / scale).max() + 1))
    assert np.allclose(got["score"].to_numpy(float) / scale, np.sort(d, axis=1)[:, :5].mean(axis=1), atol=max(1e-9, off))


def test_rows_that_are_no_numbers_change_no_other(monkeypatch):
    x = np.random.default_rng(6).normal(size=(4000, 8))
    odd = x.copy()
    odd[[17, 2900]] = [[np.nan] * 8, [np.inf] + [0.0] * 7]
    clean = np.delete(x, [17, 2900], axis=0)
    queries = pd.DataFrame({"id": range(50), "vec": list(clean[:50] + 0.1)})
    scores = []
    for bank in (odd, clean):
        monkeypatch.setattr(knn, "read_block", lambda path, b, bank=bank: block_of(bank[b::2], np.arange(len(bank[b::2]))))
        with np.errstate(invalid="ignore"):
            scores.append(pd.concat(knn.mean_rows("", 2, 3, "none", ["id"], iter([queries])))["score"].to_numpy(float))
    assert np.allclose(*scores)


def test_most_pairs_are_never_made_in_double_precision(monkeypatch):
    x = np.random.default_rng(7).normal(size=(20_000, 16))
    monkeypatch.setattr(knn, "read_block", lambda path, b: block_of(x, np.arange(20_000)))
    made, squares = [], knn.squares
    monkeypatch.setattr(knn, "squares", lambda q, *a: made.append(len(q) * len(a[1])) or squares(q, *a))
    list(knn.mean_rows("", 1, 5, "entry", ["entry"], iter([pd.DataFrame({"entry": range(512), "vec": list(x[:512])})])))
    assert sum(made) < 0.2 * 512 * 20_000
