"""Counts against the library on whole texts."""

import random
import unicodedata

import public_tokenizers
from tokenizers import Tokenizer

from patchlake.llm.token_counts import PieceCounter, count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(5)
    odd = ["<|startoftext|>", "<|endoftext|>", "<|endoftext|>x", "don't", "I'LL", "a,b.c!", "12345", "日本語テキスト", "é́", "‍", " ", "\x1c", "\x85", "İstanbul", "ﬁ", "…", "a" * 500, "'s", "''ll", "ß"]
    out = [None, "", " ", "\n\t ", "plain words here", "x" * 70_000, "é " * 5000]
    for _ in range(300):
        out.append("".join(rng.choice(odd) + rng.choice(["", " ", "\n", "　", "  ", "\r\n"]) for _ in range(rng.randint(1, 30))))
    return out


def test_equal_to_the_library(spark):
    rows = list(enumerate(texts()))
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in count_tokens(df, PATH, keep=("doc_id",)).collect()}
    for i, t in rows:
        assert got[i] == (len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)), repr(t)[:200]


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 9), (1, "a b", 9)], "doc_id bigint, text string, n_tokens int")
    assert count_tokens(df.where("false"), PATH, keep=("doc_id",)).count() == 0
    assert [tuple(r) for r in count_tokens(df, PATH, keep=("doc_id", "n_tokens")).collect()] == [(1, 9, 3, 2)] * 2


def test_every_letter_that_changes_its_form_before_and_after_marks():
    """All characters whose lower case or normal form has another length, and some others."""
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    odd = [c for c in map(chr, range(0x80, 0x110000)) if not 0xD800 <= ord(c) < 0xE000 and any(len(unicodedata.normalize(form, x)) != 1 for x in (c, c.lower(), c.upper()) for form in ("NFC", "NFD", "NFKC", "NFKD"))]
    assert "İ" in odd and len(odd) > 10_000
    texts = [f"kayser{c}{m} {m}{c}x ab{c}" for c in odd for m in ".,!"]
    want = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    counter = PieceCounter(PATH)
    got = [n for i in range(0, len(texts), 2000) for n in counter.count(texts[i : i + 2000])]
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []
