"""The nearest row of each label: pairs that single precision leaves out, equal rows, odd rows, and what a task holds."""

import weakref

import numpy as np
import pandas as pd
import pytest

from patchlake.operators import knn


def searched(monkeypatch, bank: pd.DataFrame, queries: pd.DataFrame, blocks: int, leave_out: str = "entry") -> pd.DataFrame:
    def read_block(path, b):
        part = bank.iloc[b::blocks].reset_index(drop=True)
        vec = np.stack(part["vec"].tolist())
        return {c: part[c] for c in part.columns if c != "vec"} | {"vec": vec, "norm": knn.norms(vec)}

    monkeypatch.setattr(knn, "read_block", read_block)
    found = knn.label_rows("", blocks, leave_out, ["id"], iter([queries]))
    return pd.concat(found).sort_values(["label", "id"]).reset_index(drop=True)


def expected(bank: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    out = []
    for label, own in bank.sort_values("id").groupby("label"):
        weight = own["weight"].to_numpy() + 1e-6 if "weight" in own else 1.0
        d = np.sqrt(((np.stack(queries["vec"].tolist())[:, None] - np.stack(own["vec"].tolist())[None]) ** 2).sum(axis=2)) / weight
        d[queries["entry"].to_numpy()[:, None] == own["entry"].to_numpy()[None]] = np.inf
        out.append(pd.DataFrame({"id": queries["id"], "label": label, "distance": d.min(axis=1), "nearest": own["id"].to_numpy()[d.argmin(axis=1)]}))
    return pd.concat(out).sort_values(["label", "id"]).reset_index(drop=True)


def rows_of(x: np.ndarray, labels: int = 4) -> pd.DataFrame:
    n = np.arange(len(x))
    return pd.DataFrame({"id": n, "entry": n // 7, "label": [f"l{i % labels}" for i in n], "vec": list(x)})


@pytest.mark.parametrize("scale, shift", [(1, 0), (1, 30), (1e-3, 1), (1e-12, 0), (1e-25, 0), (1e13, 0), (1e120, 0)])
@pytest.mark.parametrize("weights", [None, [1.0, 0.5, 1.5], [1e-7, 1.0, 40.0], [1.0, 0.0, 2.0], [1.0, 1e9, 1e-3]])
def test_no_nearest_row_of_a_label_is_left_out(monkeypatch, scale, shift, weights):
    monkeypatch.setattr(knn, "WIDE", 64)
    monkeypatch.setattr(knn, "TILE_BYTES", 8 * 64 * 50)
    bank = rows_of((np.random.default_rng(4).normal(size=(900, 9)) + shift) * scale)
    if weights:
        bank["weight"] = [weights[i % 3] for i in range(900)]
    got, want = searched(monkeypatch, bank, bank, 3), expected(bank, bank)
    assert got[["id", "label"]].equals(want[["id", "label"]]) and np.array_equal(got["nearest"], want["nearest"])
    assert np.allclose(got["distance"] / scale, want["distance"] / scale, rtol=1e-9)


@pytest.mark.parametrize("copies", [3, 900])
def test_of_equal_rows_the_smallest_id_is_nearest(monkeypatch, copies):
    monkeypatch.setattr(knn, "WIDE", 64)
    x = np.random.default_rng(5).normal(size=(900 // copies, 31))
    bank = rows_of(np.tile(x, (copies, 1)))
    got, want = searched(monkeypatch, bank, bank, 4), expected(bank, bank)
    assert np.array_equal(got["nearest"], want["nearest"]) and np.allclose(got["distance"], want["distance"], rtol=1e-12)


def test_rows_and_queries_without_a_distance_hide_no_other(monkeypatch):
    x = np.random.default_rng(6).normal(size=(2000, 8))
    bank = rows_of(x).assign(weight=1.0)
    odd = bank.copy()
    odd["vec"] = [np.full(8, np.nan) if i == 17 else np.r_[np.inf, np.zeros(7)] if i == 900 else v for i, v in enumerate(x)]
    odd["weight"] = [np.nan if i == 1300 else 1.0 for i in range(2000)]
    clean = bank.drop([17, 900, 1300])
    queries = pd.concat([clean.iloc[:60], odd.iloc[[17, 900]]]).reset_index(drop=True)
    with np.errstate(invalid="ignore"):
        got = searched(monkeypatch, odd, queries, 2)
        want = expected(clean, queries.iloc[:60])
    assert got[["id", "label", "nearest"]].equals(want[["id", "label", "nearest"]]) and np.allclose(got["distance"], want["distance"])


def test_most_pairs_with_labels_are_never_made_in_double_precision(monkeypatch):
    bank = rows_of(np.random.default_rng(7).normal(size=(20_000, 16))).assign(weight=1.0)
    made, distances = [], knn.distances
    monkeypatch.setattr(knn, "distances", lambda q, *a: made.append(len(q) * len(a[1])) or distances(q, *a))
    searched(monkeypatch, bank, bank.iloc[:512], 1)
    assert sum(made) < 0.05 * 512 * 20_000


@pytest.mark.parametrize("by_label", [False, True])
def test_a_task_holds_one_block_at_a_time(monkeypatch, by_label):
    bank = rows_of(np.random.default_rng(8).normal(size=(3000, 16)))
    vec, held, ordered = np.stack(bank["vec"].tolist()), [], knn.ordered

    def read_block(path, b):
        assert not any(x() is not None for x in held)
        return {c: bank[c].iloc[b::3].reset_index(drop=True) for c in ("id", "entry", "label")} | {"vec": vec[b::3], "norm": knn.norms(vec[b::3])}

    def seen(*a):
        out = ordered(*a)
        held.append(weakref.ref(out["vec"]))
        return out

    monkeypatch.setattr(knn, "read_block", read_block)
    monkeypatch.setattr(knn, "ordered", seen)
    batches = iter([bank.iloc[:1500], bank.iloc[1500:]])
    n = sum(map(len, knn.label_rows("", 3, "entry", ["id"], batches) if by_label else knn.mean_rows("", 3, 5, "none", ["id"], batches)))
    assert n == 3000 * (4 if by_label else 1) and len(held) == 6
