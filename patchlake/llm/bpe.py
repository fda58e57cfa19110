"""BPE encoding and decoding, with tree concatenation for long unsplit text.

A text is cut where its tokenizer always splits: between a character that isn't
white space and one that is. Where no such place comes for `LEAF` characters the
cut is made between two kinds of characters (letters, numbers, others) if one is
near, else through the middle of a pre-token. Only cuts of that last kind can
change tokens, and there the halves are put together by re-encoding a growing
window around the join, until its first and last tokens are those of the two
sides. BPE keeps a sequence of tokens exactly if it keeps each pair of
neighbours, and every pair then lies in one of three encodings, so the whole is
what encoding at once gives; if the sides don't agree within `WIDEST` tokens
both are encoded as one.

Texts over `LONG_TEXT` characters become rows of parts, encoded in parallel and
put together again; all others are encoded where they are.

Defined cases: null is encoded like an empty text (no ids, decoded empty);
special strings in a text become their own ids, as the library does by default;
repeated rows are encoded each, pieces met before are looked up in a table of
bounded size.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake.llm.common import fresh, map_texts, materialise, small_batches

LEAF = 2048
REACH = 256
WIDEST = 512
LONG_TEXT = 1 << 16
PART = 1 << 15
CACHED_PIECES = 300_000
LONGEST_CACHED = 64
#: Unicode's white space.
SPACE = "\t-\r \x85\xa0  -     　"
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
EDGE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def kind(c: str) -> str:
    return unicodedata.category(c)[0] if unicodedata.category(c)[0] in "LN" else "other"


def cut_long(text: str, size: int) -> list[tuple[str, bool]]:
    """Parts of about `size` characters without white space between them, each with whether its cut from the one before is unsafe."""
    out, start, unsafe = [], 0, False
    while len(text) - start > size + REACH:
        target, at, hard = start + size, None, False
        for i in range(target, target + REACH):
            a, b = kind(text[i - 1]), kind(text[i])
            if a != b and a != "other":  # letters and numbers end where another kind begins
                at = i
                break
        if at is None:
            at, hard = target, True
        out.append((text[start:at], unsafe))
        start, unsafe = at, hard
    out.append((text[start:], unsafe))
    return out


def parts_of(text: str, size: int) -> list[tuple[str, bool]]:
    """The whole text in parts: cut at white space where it comes within `size` more characters."""
    out, start = [], 0
    while len(text) - start > 2 * size:
        found = EDGE.search(text, start + size, start + 2 * size)
        if not found:
            later = EDGE.search(text, start + 2 * size)
            end = later.start() if later else len(text)
            out += cut_long(text[start:end], size)
        else:
            end = found.start()
            out.append((text[start:end], False))
        start = end
    if start < len(text):
        out.append((text[start:], False))
    return out


def byte_of() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added.values(), key=len, reverse=True))) + ")") if added else None
        back = byte_of()
        self.bytes = [added[i].encode() if i in added else bytes(back[c] for c in self.tokenizer.id_to_token(i)) for i in range(self.tokenizer.get_vocab_size())]
        self.known: dict[str, list[int]] = {}

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """Two encodings side by side as that of their whole text: a window around the join grows till both sides agree."""
        wide = 4
        while wide <= WIDEST and (wide < len(a) or wide < len(b)):
            n, m = min(wide, len(a)), min(wide, len(b))
            try:
                window = self.plain([b"".join(self.bytes[i] for i in (*a[-n:], *b[:m])).decode()])[0]
            except UnicodeDecodeError:  # a token ends inside a character
                window = []
            if len(window) > 3 and (n == len(a) or window[:2] == a[-n:][:2]) and (m == len(b) or window[-2:] == b[:m][-2:]):
                return [*a[:-n], *window, *b[m:]]
            wide *= 2
        return self.plain([self.text([*a, *b])])[0]

    def put_together(self, parts: list[list[int]], unsafe: list[bool]) -> list[int]:
        """Neighbours two by two, as a tree, until one encoding is left."""
        while len(parts) > 1:
            pairs = range(0, len(parts) - 1, 2)
            merged = [self.join(parts[i], parts[i + 1]) if unsafe[i + 1] else [*parts[i], *parts[i + 1]] for i in pairs]
            flags = [unsafe[i] for i in pairs]
            if len(parts) % 2:
                merged.append(parts[-1])
                flags.append(unsafe[-1])
            parts, unsafe = merged, flags
        return parts[0] if parts else []

    def long_piece(self, piece: str) -> list[int]:
        cut = cut_long(piece, LEAF)
        return self.put_together(self.plain([p for p, _ in cut]), [u for _, u in cut])

    def encode(self, texts: list[str]) -> list[list[int]]:
        """One batch: the pieces of all texts are found, new ones are encoded at once, and ids are looked up."""
        known = self.known
        if len(known) > CACHED_PIECES:
            known.clear()
        cut: list[list[str]] = []
        new: dict[str, None] = {}
        for t in texts:
            if self.special and self.special.search(t):
                pieces = [p for i, s in enumerate(self.special.split(t)) for p in ([s] if i % 2 else PIECE.findall(s))]
            else:
                pieces = PIECE.findall(t)
            cut.append(pieces)
            for p in pieces:
                if p not in known:
                    new[p] = None
        halves: dict[str, tuple[str, str]] = {}
        for p in list(new):
            if 2 < len(p) <= LEAF and p[-1] in ".,!" and p[-2].isalpha():  # letters and marks never share a token
                halves[p] = p[:-1], p[-1]
                del new[p]
                new.update((x, None) for x in halves[p] if x not in known)
        short = [p for p in new if len(p) <= LEAF]
        got = dict(zip(short, self.plain(short), strict=True))
        got.update((p, self.long_piece(p)) for p in new if len(p) > LEAF)
        known.update((p, ids) for p, ids in got.items() if len(p) <= LONGEST_CACHED)
        for p, (a, b) in halves.items():
            got[p] = [*(got[a] if a in got else known[a]), *(got[b] if b in got else known[b])]
            if len(p) <= LONGEST_CACHED:
                known[p] = got[p]
        out = []
        for pieces in cut:
            ids: list[int] = []
            for p in pieces:
                ids += known[p] if p in known else got[p]
            out.append(ids)
        return out

    def text(self, ids: list[int]) -> str:
        table = self.bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    return CODERS.get(path) or CODERS.setdefault(path, Coder(path))


def lists(ids: list[list[int]]) -> pa.Array:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((x for i in ids for x in i), np.int32, int(sizes.sum()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))


def worker(path: str, decode: bool):
    own = coder(path)

    def work(texts: list) -> list:
        ids = own.encode([t or "" for t in texts])
        return [lists(ids), [own.text(i) for i in ids] if decode else [None] * len(ids)]

    return work


def part_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for row, text in zip(b["row"], b["text"], strict=True):
            cut = parts_of(text, PART)
            yield pd.DataFrame({"row": row, "part": range(len(cut)), "text": [p for p, _ in cut], "unsafe": [u for _, u in cut]})


def merged_rows(path: str, decode: bool, group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("part")
    ids = coder(path).put_together([[int(x) for x in i] for i in group["ids"]], group["unsafe"].tolist())
    return pd.DataFrame({"row": [group["row"].iloc[0]], "ids": [ids], "decoded": [coder(path).text(ids) if decode else None]})


def special_strings(path: str) -> list[str]:
    from tokenizers import Tokenizer

    return [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()]


def encode(df: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None, into: str = "found", decode: bool = True) -> DataFrame:
    """`keep` columns and a struct: ids, and decoded (the text that these ids give; null without `decode`)."""
    keep = list(df.columns if keep is None else keep)
    small_batches(df.sparkSession)
    name = fresh(into, keep)
    body = F.col(f"`{text}`")
    special = F.lit(False)
    for s in special_strings(tokenizer):
        special = special | body.contains(s)
    long = F.coalesce((F.char_length(body) > LONG_TEXT) & ~special, F.lit(False))  # texts with special strings are cut at these, where they are
    near = map_texts(df.where(~long), partial(worker, tokenizer, decode), IDS, text, keep, name)
    # written, as it is read twice and its numbers must be the same both times
    far = materialise(df.where(long).select(F.monotonically_increasing_id().alias("row"), body.alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")), "long")
    parts = far.select("row", "text").mapInPandas(part_rows, "row bigint, part int, text string, unsafe boolean").repartition("row", "part")
    coded = map_texts(parts, partial(worker, tokenizer, False), IDS, "text", ["row", "part", "unsafe"], "found", PART).select("row", "part", "unsafe", "found.ids")
    whole = coded.groupBy("row").applyInPandas(partial(merged_rows, tokenizer, decode), "row bigint, ids array<int>, decoded string")
    back = far.select("row", "kept").join(whole, "row").select(*[F.col("kept").getField(c).alias(c) for c in keep], F.struct("ids", "decoded").alias(name))
    return near.unionByName(back)


def decode_ids(df: DataFrame, tokenizer: str, ids: str = "ids", keep: list[str] | None = None, into: str = "decoded") -> DataFrame:
    """`keep` columns and the text of each row's ids (null for null)."""
    keep = list(df.columns if keep is None else keep)

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else coder(tokenizer).text(list(x)))

    return df.select(*[F.col(f"`{c}`") for c in keep], text_of(F.col(f"`{ids}`")).alias(fresh(into, keep)))


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.concat_ws(",", ids.cast("array<string>")), 256)
