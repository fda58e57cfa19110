"""Hit words and items against all windows by brute force."""

import random
import re

from patchlake.llm.decontaminate import decontaminate, without_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    windows = {}
    for item, t in items:
        w = words_of(t)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    out = {}
    for d, t in docs:
        w, hit, found = words_of(t), set(), set()
        for i in range(len(w)):
            for n in {len(x) for x in windows}:
                own = windows.get(tuple(w[i : i + n])) if i + n <= len(w) else None
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        out[d] = (len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit) and 20 * len(hit) >= len(w))
    return out


def tables():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "naïve", "日本", "A1"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(13, 30))) for i in range(25)] + [(50, "only three words"), (51, "w1"), (52, ""), (53, None), (54, "é"), (None, text(15))]
    items.append((60, items[0][1]))
    docs = [(i, text(rng.randint(0, 80))) for i in range(60)]
    for i in range(60, 120):
        a = rng.choice(items)[1] or ""
        docs.append((i, f"{text(rng.randint(0, 200))}-{a.upper()}! {text(rng.randint(0, 200))}"))
    return docs + [(200, None), (201, ""), (202, "only THREE, words"), (203, "İ only three words")], items


def check(spark, items, **more):
    docs, all_items = tables()
    items = all_items if items is None else items
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, found int")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r[0]: (r[1].n_words, r[1].n_hit, r[1]["items"], r[1].contaminated) for r in decontaminate(d, b, keep=["doc_id"], **more).collect()}
    assert got == brute(docs, items)


def test_one_block(spark):
    check(spark, None)


def test_blocks_are_merged(spark):
    check(spark, None, block_bytes=600)


def test_no_windows(spark):
    check(spark, [])
    check(spark, [(1, None), (2, "..")])


def test_names_that_clash_and_empty_table(spark):
    d = spark.createDataFrame([(1, "a b c", 5)], "doc_id bigint, text string, found int")
    b = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    r = decontaminate(d, b).first()
    assert r["found"] == 5 and r["_found"]["n_hit"] == 2
    assert decontaminate(d.where("false"), b).count() == 0


def test_spans_removed():
    assert without_spans("One two, three four.", [{"first": 1, "last": 3}]) == "One  four."
