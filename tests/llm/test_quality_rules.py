"""Line rules and base measures against plain Python."""

import random
import re

import pytest

from patchlake.llm.quality_rules import judge, quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    rng = random.Random(3)
    vocabulary = ["a", "bé", "c#", "<d>", "日本", "x y", "!?", "|"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))).replace(" a ", rng.choice((" a ", "\n", "\t", "\x0b", " a\n\n"))) for _ in range(150)]
    texts += [None, "", " \n\t", "same line\nsame line\n other", "w " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in quality_rules(df, keep=("doc_id",)).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(t)
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_lines_that_fail_go():
    good = "This is a plain sentence of the article, long enough to stay."
    menu = "Home | About | News | Contact"
    shout = "BUY!!! NOW!!! CHEAP!!!"
    legal = "Copyright 2020, All Rights Reserved by the owner"
    out = judge("\n".join([good, menu, shout, legal, good + " More."]))
    assert out[-1] == good + "\n" + good + " More."
    assert judge(good)[-1] == good


def test_documents_that_lose_too_much(spark):
    good = " ".join(f"word{i}" for i in range(30))
    bad = "\n".join(f"Home{i} | About{i} | News{i} | Contact{i}" for i in range(20))
    df = spark.createDataFrame([(1, good), (2, good + "\n" + bad), (3, bad)], "doc_id bigint, text string")
    assert {r.doc_id: r.kept for r in quality_rules(df, keep=("doc_id",)).collect()} == {1: True, 2: False, 3: False}


@pytest.mark.parametrize("name", ["n_words", "kept"])
def test_empty_table_and_extra_columns(spark, name):
    df = spark.createDataFrame([(1, "x", 7)], f"doc_id bigint, text string, {name} int")
    assert quality_rules(df.where("false"), keep=("doc_id",)).count() == 0
    both = quality_rules(df, keep=("doc_id", name)).first()
    assert both[name] == 7 and both["_" + name] == {"n_words": 1, "kept": False}[name] and both["base_failed"]
