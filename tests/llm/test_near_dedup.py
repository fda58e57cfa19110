"""Components against brute force over all pairs, on groups that fill large buckets."""

import random

import pytest

from patchlake.llm.near_dedup import near_duplicates, permuted, shingle_ids, shingles, signature


def brute(rows, size, percent=80):
    sets = {i: shingles(t, size) for i, t in rows}
    ids, up = list(sets), {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def edited(rng, words, most):
    out = list(words)
    for _ in range(rng.randint(0, most)):
        at, kind = rng.randrange(len(out)), rng.random()
        if kind < 0.5:
            out[at] = rng.choice(("alpha", "beta", f"w{rng.randrange(10**6)}"))
        elif kind < 0.75:
            del out[at]
        else:
            out.insert(at, f"n{rng.randrange(10**6)}")
    return out


@pytest.mark.parametrize(("seed", "tile_ids"), [(1, 1 << 20), (2, 1 << 20), (1, 2000)])
def test_large_groups_of_near_copies(spark, seed, tile_ids):
    rng = random.Random(seed)
    rows = []
    for _ in range(2):
        base = [f"b{rng.randrange(10**6)}" for _ in range(90)]
        other = edited(rng, base, 12)
        rows += [" ".join(edited(rng, rng.choice((base, base, other)), 8)) for _ in range(160)]
    line = " ".join(f"c{i}" for i in range(30))
    rows += [line + " " + " ".join(f"r{rng.randrange(10**6)}" for _ in range(rng.randint(3, 40))) for _ in range(60)]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r[0]: (r[1], r[2]) for r in near_duplicates(df, tile_ids=tile_ids).collect()}
    want = brute(rows, 4)
    wrong = [i for i in want if got[i] != want[i]]
    assert len(set(c for _, c in want.values())) > 20
    assert not wrong


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one TWO"), (6, "é" * 50000), (7, "a b c d e f g"), (7, "a b c d e f g"), (None, "one two")]
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id bigint, text string, component_id bigint")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_duplicates(df).collect())
    assert got == [(0, 1, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 4, 7, True), (7, 4, 7, True)]
    assert near_duplicates(df.where("false")).count() == 0


def test_first_permutation_is_one():
    import numpy as np

    x = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(permuted(x, np.uint32(5)))) == len(x)


def test_signature_estimates_similarity():
    a = [b"w%d" % i for i in range(400)]
    b = a[:360] + [b"x%d" % i for i in range(40)]
    x, y = (signature(shingle_ids(w, 4, {})) for w in (a, b))
    sets = [set(shingle_ids(w, 4, {}).tolist()) for w in (a, b)]
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs((x == y).mean() - true) < 0.08


def test_one_id_with_two_texts_and_other_columns(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a), (3, b), (5, a + " x"), (4, b + " y"), (9, a), (8, " ".join(f"z{i}" for i in range(30000)) + a)]
    df = spark.createDataFrame([(i, t, "p", 1, 2, "q") for i, t in rows], "doc_id bigint, text string, part string, node int, n int, `x.y` string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(3, 3, True), (3, 3, True), (4, 3, False), (5, 3, False), (8, 8, True), (9, 3, False)]


def test_equal_sets_of_other_order_are_one(spark):
    words = [f"w{i}" for i in range(40)]
    turned = words[20:] + words[:20]  # only the shingles at the seams differ
    df = spark.createDataFrame([(2, " ".join(words * 2)), (1, " ".join(words * 3)), (7, " ".join(turned * 2))], "doc_id bigint, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(df).collect()} == {(1, 1), (2, 1), (7, 1)}
