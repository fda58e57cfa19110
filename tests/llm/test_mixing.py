"""Mixtures against plain sorting and step-by-step resharing."""

import hashlib
import math
import random

import pytest

from patchlake.llm.mixing import copies, mix, targets

SCHEMA = "doc_id bigint, text string, source string"


def reshared(sizes, shares=(1, 2, 3), most=3):
    """Targets by rounds of handing on what is too much."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    share = {s: shares[i % 3] for i, s in enumerate(names)}
    total = sum(sizes.values())
    now = {s: total * share[s] / sum(share.values()) for s in names}
    while any(now[s] > most * sizes[s] * (1 + 1e-12) for s in names):
        full = {s for s in names if now[s] >= most * sizes[s]}
        over = sum(now[s] - most * sizes[s] for s in full)
        rest = sum(share[s] for s in names if s not in full)
        now = {s: most * sizes[s] if s in full else now[s] + over * share[s] / rest for s in names}
    return now


def brute(rows, weights):
    size = lambda t: len((t or "").encode().split())
    sources = {s: sum(size(t) for _, t, own in rows if own == s) for s in {r[2] for r in rows}}
    aims, out = reshared(sources), []
    for s, n in sources.items():
        epochs = math.floor(aims[s] / n + 1e-12) if n else 0
        rest = math.floor(aims[s] - epochs * n + 0.5)
        keyed = []
        for i, t, own in rows:
            if own == s:
                h = hashlib.md5("|".join(["mix", "" if i is None else str(i), "" if t is None else hashlib.md5(t.encode()).hexdigest()]).encode()).hexdigest()
                keyed.append((-math.log((int(h[:13], 16) + 0.5) / 2**52) / weights.get(i, 1.0), i, size(t)))
        before = 0
        for _, i, k in sorted(keyed, key=lambda x: x[0]):
            out.append((i, k, n, round(aims[s], 6), epochs * k + max(0, min(k, rest - before))))
            before += k
    return sorted(out, key=repr)


def corpus(seed, n=600):
    rng = random.Random(seed)
    rows = [(None, None, "a"), (None, "x y", None), (7, "", "empty"), (7, None, "empty")]
    for i in range(n):
        source = rng.choice(["a", "b", "hot", "hot", "hot", "é", None, f"small{rng.randrange(4)}" if rng.random() < 0.1 else "c"])
        rows.append((i, " ".join("w" for _ in range(rng.choice((0, 1, 5, 40, 300)))) + rng.choice(["", "\n", "\x1c z"]), source))
    return rows + rows[50:60]


@pytest.mark.parametrize(("buckets", "most_rows"), [(4096, 100_000), (4, 3)])
def test_brute_force(spark, buckets, most_rows):
    rows = corpus(buckets)
    weights = {i: (2.0, 0.5)[i % 2] for i in range(0, 600, 3)}
    given = spark.createDataFrame(list(weights.items()), "doc_id bigint, weight double")
    got = mix(spark.createDataFrame(rows, SCHEMA), given, keep=["doc_id"], buckets=buckets, most_rows=most_rows).collect()
    assert sorted(((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in got), key=repr) == brute(rows, weights)


def test_shares_are_met_and_no_document_is_over_three_times(spark):
    got = mix(spark.createDataFrame(corpus(9), SCHEMA), keep=["source"]).collect()
    taken, aim = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        aim[r.source] = r.target
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - aim[s]) <= 1 for s in aim)
    assert abs(sum(aim.values()) - sum(r.size for r in got)) < 1e-6


def test_levels_are_those_of_step_by_step_resharing(spark):
    rng = random.Random(4)
    for _ in range(5):
        sizes = {(None if i == 0 else f"s{i}"): rng.choice((0, 1, 10, 500, 10_000)) for i in range(rng.randint(1, 12))}
        got = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
        want = reshared(sizes)
        assert {r.source: pytest.approx(r.target, abs=1e-6) for r in got} == want


def test_heavy_documents_come_first(spark):
    rows = [(i, "w " * 10, s) for i in range(400) for s in ("a", "b", "c")]
    weights = spark.createDataFrame([(i, 50.0 if i < 100 else 1.0 if i < 390 else -1.0) for i in range(400)], "doc_id bigint, weight double")
    got = mix(spark.createDataFrame(rows, SCHEMA), weights).where("source = 'a'").collect()
    assert sum(r.taken for r in got if r.doc_id < 100) > 0.95 * 1000
    assert sum(r.taken for r in got if r.doc_id >= 390) == 0


def test_copies_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 5), (2, "d", "y", 6)], SCHEMA + ", size int")
    out = mix(df)
    assert out.columns == ["doc_id", "text", "source", "size", "_size", "source_size", "target", "taken"]
    rows = {r.doc_id: (r["_size"], r.taken) for r in out.collect()}
    assert rows == {1: (3, 1), 2: (1, 3)}
    assert sorted((r.doc_id, r.copy, r.words) for r in copies(out, "_size").collect()) == [(1, 0, 1), (2, 0, 1), (2, 1, 1), (2, 2, 1)]
    assert mix(df.where("false")).count() == 0


def test_equal_rows_tie(spark):
    rows = [(None, "a b", "x")] * 50 + [(1, "a " * 400, "y")]
    got = mix(spark.createDataFrame(rows, SCHEMA), keep=["source"], buckets=4, most_rows=3).collect()
    assert abs(sum(r.taken for r in got if r.source == "x") - [r.target for r in got if r.source == "x"][0]) <= 1
