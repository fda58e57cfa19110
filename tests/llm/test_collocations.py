"""Phrases against counting every phrase of every piece."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from patchlake.llm.collocations import collocations, counted_words, flows, graph, passages, ranked, windows, word_counts

SCHEMA = "doc_id bigint, text string, lang string"


def pieces(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", text)]


def brute(rows, least, longest=5, top=2000):
    count, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            total[lang] += len(w)
            for k in range(1, longest + 1):
                count.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {g: n for g, n in count.items() if len(g[1]) > 1 and n >= least}
    inside = {(lang, p[i:j]) for (lang, p), n in often.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and count[lang, p[i:j]] <= n}
    out = {}
    for (lang, p), a in often.items():
        if (lang, p) not in inside:
            score, _, left, right = min((1000 * a * total[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i + 1, g[2].decode(), -g[1], g[3], g[4], total[lang], -g[0]) for lang, found in out.items() for i, g in enumerate(sorted(found)[:top])}


def corpus(seed):
    rng = random.Random(seed)
    few, many = ["the", "of", "É", "New", "yOrk", "x", "\x1c", "日本"], [f"w{i}" for i in range(200)]
    line = " ".join(rng.choice(many) for _ in range(30))
    rows = [(None, None, "en"), (1, "", "en"), (1, " \t\n..", None)]
    for i in range(400):
        words = [rng.choice(few if rng.random() < 0.6 else many) for _ in range(rng.randint(0, 40))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r\n", "!"]) for w in words)
        if rng.random() < 0.2:
            text += line + rng.choice([" ", ". "])
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und"])))
    return rows + rows[5:20]


@pytest.mark.parametrize(("seed", "bits"), [(1, 26), (2, 8)])
def test_brute_force(spark, seed, bits):
    rows = corpus(seed)
    got = ranked(collocations(spark.createDataFrame(rows, SCHEMA), least=8, bits=bits), top=150).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    got = [tuple(r) for r in got.collect()]
    want = brute(rows, 8, top=150)
    assert len(got) == len(set(got)) and set(got) == want and {len(p[2].split(" ")) for p in want} >= {2, 5}


def test_paths_hold_the_edges(spark):
    rows = corpus(3)
    texts = spark.createDataFrame(rows, SCHEMA).selectExpr("coalesce(text, '') as text", "coalesce(lang, 'und') as lang")
    flow = flows(graph(texts, word_counts(texts), 8))
    often = {k: f.where("n >= 8") for k, f in flow.items()}
    paths = passages(often[5], often[4]).collect()
    assert max(p.edges for p in paths) > 15  # the line that repeats
    assert all(p.edges == len(p.passage.split(" ")) - 4 for p in paths)
    back = windows(passages(often[5], often[4]))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, often[5].collect()))


def test_one_word_in_a_row_and_long_words(spark):
    rows = [(i, "a " * 50 + "b" * 100_000, "en") for i in range(4)]
    got = ranked(collocations(spark.createDataFrame(rows, SCHEMA), least=4)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert {tuple(r) for r in got.collect()} == brute(rows, 4)


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b a b", "en", 1, 2, 3)], SCHEMA + ", gram int, n int, part int")
    assert collocations(df.where("false"), least=1).count() == 0
    assert {r.phrase for r in collocations(df, least=2).collect()} == {"a b"}
    assert collocations(df.selectExpr("doc_id", "cast(null as string) as text", "lang"), least=1).count() == 0


def test_products_beyond_64_bits(spark):
    df = spark.createDataFrame([(3 * 10**12, 9 * 10**12, 10**12, 10**12)], "a bigint, total bigint, l bigint, r bigint")
    got = df.selectExpr("cast(1000 as decimal(20, 0)) * a * total div (cast(l as decimal(20, 0)) * r) as s").first().s
    assert got == 27_000


def test_a_later_batch_with_early_words_only():
    batches = [pa.RecordBatch.from_pydict({"text": [t], "lang": ["en"]}) for t in ("a b c d e", "b a b", "f", "")]
    found = [r for b in counted_words(iter(batches)) for r in b.to_pylist()]
    assert {r["word"]: r["n"] for r in found} == {"a": 2, "b": 3, "c": 1, "d": 1, "e": 1, "f": 1} and len(found) == 6
