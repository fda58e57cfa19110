"""Token counts without the tokens.

Arrow batches are dealt anew by bytes, long texts are cut at safe boundaries,
and only lengths come back. A safe boundary lies between a character that isn't
white space and one that is: the tokenizer's patterns never match across it, so
the count of a text is the sum over its pieces. Pieces met before are looked up
in a table of bounded size; the others are encoded together in batches.

Defined cases: null counts as empty (0 tokens, 0 bytes); a text without white
space is one piece, encoded whole; equal rows get equal counts.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections import Counter
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake.llm.common import fresh, map_texts

BATCH_BYTES = 1 << 20
CACHED_PIECES = 400_000
LONGEST_CACHED = 64
LENGTHS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
PIECE = re.compile(r"\s*\S+|\s+")
#: White space to one library and not to the other: such texts aren't cut.
UNSAFE = re.compile("[\x1c-\x1f]")


class Letters(dict):
    """Whether a character stays nothing but letters in lower case and every normal form: then no mark after it joins it."""

    def __missing__(self, c: str) -> bool:
        found = self[c] = c.isalpha() and all(unicodedata.normalize(form, c.lower()).isalpha() and len(unicodedata.normalize(form, c.lower())) == 1 for form in ("NFC", "NFD", "NFKD"))
        return found


LETTER = Letters()


class PieceCounter:
    """Counts tokens by pieces; `known` is emptied when it is full."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def lengths(self, pieces: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        """One batch: find the pieces of all texts, encode the new ones at once, then add up."""
        known = self.known
        if len(known) > CACHED_PIECES:
            known.clear()
        cut, new = [], {}
        for t in texts:
            pieces = [t] if UNSAFE.search(t) else PIECE.findall(t)
            cut.append(pieces)
            for p in pieces:
                if p not in known:
                    new[p] = None
        halves: dict[str, tuple[str, str]] = {}
        for p in list(new):
            if len(p) > 2 and p[-1] in ".,!" and LETTER[p[-2]]:  # letters and marks never share a token
                halves[p] = p[:-1], p[-1]
                del new[p]
                new.update((x, None) for x in halves[p] if x not in known)
        fresh = dict(zip(new, self.lengths(list(new)), strict=True))
        known.update((p, n) for p, n in fresh.items() if len(p) <= LONGEST_CACHED)
        find = lambda p: known[p] if p in known else fresh[p]
        for p, (a, b) in halves.items():
            fresh[p] = find(a) + find(b)
            if len(p) <= LONGEST_CACHED:
                known[p] = fresh[p]
        return [sum([known[p] if p in known else fresh[p] for p in pieces]) for pieces in cut]


COUNTERS: dict[str, PieceCounter] = {}


def counted(tokenizer: str):
    counter = COUNTERS.get(tokenizer) or COUNTERS.setdefault(tokenizer, PieceCounter(tokenizer))

    def work(texts: list) -> list:
        return [[len(t.encode()) if t else 0 for t in texts], counter.count([t or "" for t in texts])]

    return work


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """`keep` columns, n_bytes and n_tokens (underscores before a name that `keep` has). `tokenizer`: path of the vocabulary file, the same on every executor."""
    out = map_texts(df, partial(counted, tokenizer), LENGTHS, text, list(keep), "found", BATCH_BYTES)
    found = F.col(out.columns[-1])
    return out.select(*[F.col(f"`{c}`") for c in keep], *[found[n].alias(fresh(n, list(keep))) for n in LENGTHS.names])
