"""Ids and texts against the library, with long unsplit texts."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from patchlake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(8)
    odd = ["<|endoftext|>", "don't", "'LL", "日本語", "é́", "‍👩‍👩", " ", "　", "\x1c", "\x85", "a" * 300, "12345678", "...", "\x00", "\ufeff", "ß"]
    out = [None, "", " ", "\n\n\t ", "plain words here", "trailing  ", "<|endoftext|>", "x<|endoftext|> y"]
    out += ["".join(rng.choice(odd) + rng.choice(["", " ", "\n", "  "]) for _ in range(rng.randint(1, 25))) for _ in range(250)]
    letters = "abcdefghijklmnop"
    out += ["".join(rng.choice(letters) for _ in range(n)) for n in (2047, 2049, 5000, 70_000, 140_000)]
    out += ["ab" * 60_000, "日本" * 40_000, "9" * 70_001, "-=" * 40_000, " " * 70_000, ("word " * 20_000), "x" * 66_000 + " <|endoftext|> tail", "".join(rng.choice(letters + " ") for _ in range(90_000)), "the" * 30_000 + "\n" + "é" * 3000]
    return out


def test_equal_to_the_library(spark, library):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, found int")
    got = {r.doc_id: r["_found"] for r in bpe.encode(df, PATH, keep=["doc_id", "found"]).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert list(got[i].ids) == want, (i, (t or "")[:60])
        assert got[i].decoded == library.decode(want, skip_special_tokens=False), i


def test_windows_grow_around_joins(library):
    rng = random.Random(1)
    own = bpe.Coder(PATH)
    for _ in range(60):
        t = "".join(rng.choice("etaoinshr") for _ in range(rng.randint(20, 400)))
        at = rng.randint(1, len(t) - 1)
        assert own.join(*own.plain([t[:at], t[at:]])) == library.encode(t, add_special_tokens=False).ids


def test_tree(library, monkeypatch):
    monkeypatch.setattr(bpe, "LEAF", 50)
    monkeypatch.setattr(bpe, "REACH", 5)
    own, rng = bpe.Coder(PATH), random.Random(2)
    for n in (60, 500, 3001):
        t = "".join(rng.choice("abcdé日") for _ in range(n))
        assert own.long_piece(t) == library.encode(t, add_special_tokens=False).ids


def test_decode_and_empty_table(spark, library):
    df = spark.createDataFrame([(1, "some text é"), (2, None), (2, None)], "doc_id bigint, text string")
    coded = bpe.encode(df, PATH, decode=False).select("doc_id", "text", "found.ids")
    assert {r.doc_id: r.decoded for r in bpe.decode_ids(coded, PATH).collect()} == {1: "some text é", 2: ""}
    assert bpe.encode(df.where("false"), PATH).count() == 0
    partial = spark.createDataFrame([([library.encode("日").ids[0]],), (None,)], "ids array<int>")
    assert [r.decoded for r in bpe.decode_ids(partial, PATH).collect()] == ["\ufffd", None]


def test_long_texts_of_an_input_that_is_dealt_anew(spark, library):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abcdef") for _ in range(66_000 + i))) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").orderBy(F.rand()).repartition(4)
    got = {r.doc_id: r.found.decoded for r in bpe.encode(df, PATH, keep=["doc_id"]).collect()}
    assert got == dict(rows)
