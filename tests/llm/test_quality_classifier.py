"""The model against a plain Kneser-Ney one, and what it rejects."""

import math
import random
from collections import Counter, defaultdict

import pytest

from patchlake.llm import quality_classifier as q


def codes(text):
    out = [q.START] * (q.ORDER - 1)
    for c in q.repeats_marked(text or ""):
        x = ord(c)
        out.append(q.FIRST_FOLDED + x % ((1 << q.BITS) - q.FIRST_FOLDED) if x >= q.FIRST_FOLDED else x)
    return out


def grams(text):
    c = codes(text)
    apart = (q.APART,) * (q.ORDER - 1)
    return [(*apart, q.REPEAT) if c[i] == q.REPEAT else tuple(c[i - q.ORDER + 1 : i + 1]) for i in range(q.ORDER - 1, len(c))]


class Plain:
    """Interpolated modified Kneser-Ney, by the book, over dictionaries."""

    def __init__(self, texts):
        top = Counter(g for t in texts for g in grams(t))
        other = (*(q.APART,) * (q.ORDER - 1), q.OTHER)
        top[other] = sum(n for g, n in top.items() if g[-1] != q.REPEAT)
        self.counts = {q.ORDER: top}
        for k in range(q.ORDER - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.cut, self.sums = {}, {}
        for k, t in self.counts.items():
            n = [max(1, sum(c == i for c in t.values())) for i in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1])
            raw = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2])
            self.cut[k] = raw if all(0 < d <= i for i, d in enumerate(raw, 1)) else (0.5, 1.0, 1.5)
            sums = defaultdict(lambda: [0, 0.0, 0])
            for g, c in t.items():
                s = sums[g[:-1]]
                s[0], s[1], s[2] = s[0] + c, s[1] + self.cut[k][min(c, 3) - 1], s[2] + 1
            self.sums[k] = dict(sums)

    def p(self, g):
        k = len(g)
        s = self.sums[k].get(g[:-1])
        if k == 1:
            c = self.counts[1].get(g, 0)
            own = (c - self.cut[1][min(c, 3) - 1]) / s[0] if c else 0.0
            return own + s[1] / s[0] / (s[2] + 1)
        low = self.p(g[1:])
        if s is None:
            return low
        c = self.counts[k].get(g, 0)
        return ((c - self.cut[k][min(c, 3) - 1]) / s[0] if c else 0.0) + s[1] / s[0] * low

    def log_p(self, text):
        return sum(math.log(self.p(g)) for g in grams(text))


def corpus(rng, n):
    words = "the a small river runs over stones and under trees while birds sing of summer days in north country été 日本".split()
    return [" ".join(rng.choice(words) for _ in range(rng.randint(5, 40))) for _ in range(n)]


@pytest.mark.parametrize(("shard_rows", "moved"), [(1_000_000, False), (300, False), (300, True)])
def test_scores_equal_the_plain_model(spark, tmp_path, shard_rows, moved):
    rng = random.Random(2)
    trusted = corpus(rng, 40)
    plain = Plain(trusted)
    texts = [*trusted[:5], *corpus(rng, 5), "zzz qqq xxx", "word word word word", "Ω new ß", "x", "", None]
    rows = [(i, t, False) for i, t in enumerate(texts)] + [(100 + i, t, True) for i, t in enumerate(trusted)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, taught boolean").repartition(3)
    df.write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    model = q.fitted(df, shard_rows)
    assert (model[2] > 1) == (shard_rows == 300)
    if moved:  # to other partitions than those the 5-grams were counted in
        df = df.orderBy("text").repartition(5, "text")
    got = {r.doc_id: r.s for r in q.score(df, model, ["doc_id"]).where("doc_id < 100").collect()}
    for i, t in enumerate(texts):
        assert got[i].n_chars == len(grams(t))
        assert got[i].log_p == pytest.approx(plain.log_p(t), rel=1e-9, abs=1e-9), t


def test_probabilities_add_up():
    plain = Plain(corpus(random.Random(3), 30))
    for context in list(plain.sums[5])[:20]:
        seen = {g[0] for g in plain.counts[1]}
        total = sum(plain.p((*context, c)) for c in seen)
        assert 0.9 < total <= 1 + 1e-9  # what is left is for characters never seen


def test_junk_goes_and_clean_stays(spark):
    rng = random.Random(7)
    clean = corpus(rng, 300)
    junk = ["".join(rng.choice("qxzjkvw#$%&0123456789 ") for _ in range(200)) for _ in range(40)] + ["buy " * 80] * 10
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + junk)] + [(900, None, "en"), (901, " ", None), (None, clean[0], "en")], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(300 + i, 0, 0) for i in range(20)] + [(5, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.found.kept for r in q.classify(docs, labels, keep=["doc_id"]).collect()}
    assert all(got[i] for i in range(200, 300))  # not labelled
    assert not any(got[i] for i in range(300, 350))
    assert not got[900] and not got[901] and got[None]


def test_no_trusted_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "some text", "en", 3), (2, "", "en", 3)], "doc_id bigint, text string, lang string, found int")
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert {r.doc_id: (r.found, r["_found"].kept) for r in q.classify(docs, labels).collect()} == {1: (3, True), 2: (3, False)}
    assert q.classify(docs.where("false"), labels).count() == 0
