"""Line-first cleaning.

Each line with a word is judged by three rules: punctuation (a third or more of
its words end in a run of marks), navigation (its words are mostly held apart by
menu separators) and boilerplate (a licence, cookie or sign-up phrase in a line of
at most `PHRASE_LINE` words). Lines
that fail are removed; a document that loses more than `max_lost` of its word
characters is rejected.

Defined cases: a null or blank text has no words and is rejected by the base
rule; repeated rows are judged one by one; kept columns pass through unread, and
a measure named like one of them gets underscores before its name.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake.llm.common import fresh, map_texts

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
MAX_LOST_PERCENT = 50
#: Phrases of boilerplate lines, lower case.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "released under the",
    "this work is licensed",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "sign up for our newsletter",
    "subscribe to our",
    "click here",
    "lorem ipsum",
)
#: A phrase in a longer line is part of prose.
PHRASE_LINE = 40
SYMBOLS = b"#*$%&|<>"
MARKED = re.compile(rb"[!?#*$%&]{2,}(?=[\x20\x09-\x0D]|$)")
SEPARATOR = re.compile(rb"(?<![^\x20\x09-\x0D])(?:[|>]|\xc2\xbb|\xe2\x80\xba|\xe2\x80\xa2|\xc2\xb7)(?=[\x20\x09-\x0D]|$)")
PHRASES = re.compile("|".join(map(re.escape, BOILERPLATE)).encode())
SUSPECT = re.compile(rb"[!?#*$%&]{2,}|[|>\xbb\xba\xa2\xb7]|" + PHRASES.pattern)
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

STATS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_chars")]
    + [T.StructField("cleaned_text", T.StringType())]
)


def characters(raw: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(raw) if raw.isascii() else len(raw.decode())


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows that occur twice or more; windows are told apart by joining ranks of halves."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    span = 1
    while span < window:
        step = min(span, window - span)
        paired = rank[:-step] * len(words) + rank[step:]
        _, rank, count = np.unique(paired, return_inverse=True, return_counts=True)
        span += step
        if len(count) == len(rank):  # every shorter window is its own already
            return 0
    starts = np.flatnonzero(count[rank] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def bad_line(line: bytes, n_words: int) -> bool:
    if not SUSPECT.search(line.translate(LOWER)):
        return False
    if 3 * len(MARKED.findall(line)) >= n_words:
        return True
    separators = len(SEPARATOR.findall(line))
    return separators >= 2 and 4 * separators >= n_words or n_words <= PHRASE_LINE and bool(PHRASES.search(line.translate(LOWER)))


def judge(text: str | None, with_text: bool = True) -> tuple:
    """The measures of one text and what is left of it."""
    if not text:
        return 0, 0, 0, 0, 0, 0, text
    raw = text.encode()
    words = raw.split()
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = raw.split(b"\n")
    filled = [x for x in lines if x and not x.isspace()]
    duplicates = len(filled) - len(set(filled))
    kept, cleaned = chars, text
    if SUSPECT.search(raw.translate(LOWER)):
        left = []
        for line in lines:
            here = line.split()
            if here and bad_line(line, len(here)):
                kept -= sum(map(characters, here))
            else:
                left.append(line)
        cleaned = b"\n".join(left).decode() if with_text else None
    return len(words), chars, symbols, duplicates, repeated_words(words), kept, cleaned


def judger(with_text: bool):
    def work(texts: list) -> list:
        rows = [judge(t, with_text) for t in texts]
        return [list(c) for c in zip(*rows, strict=True)][: len(STATS) - (not with_text)]

    return work


def quality_rules(df: DataFrame, text: str = "text", keep: tuple[str, ...] = (), with_text: bool = True) -> DataFrame:
    """`keep` columns, the measures, base_failed, kept, and (with_text) cleaned_text; a name that `keep` has gets underscores before it."""
    found = STATS.fields if with_text else STATS.fields[:-1]
    out = map_texts(df, partial(judger, with_text), T.StructType(found), text, list(keep), "found")
    result = F.col(out.columns[-1])
    n_words, repeated, chars, left = (result[n] for n in ("n_words", "n_repeat_words", "word_chars", "kept_chars"))
    base = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n_words)
    lost = 100 * (chars - left) > MAX_LOST_PERCENT * chars
    named = {f.name: result[f.name] for f in found} | {"base_failed": base, "kept": ~base & ~lost}
    return out.select(*[F.col(f"`{c}`") for c in keep], *[c.alias(fresh(n, list(keep))) for n, c in named.items()])
