"""Digests of multisets of rows that don't depend on order or partitioning.

Each row's text is hashed to 256 bits, which are added up as four numbers of 64 bits. Sums
of parts can be added, and a row's taken away again, so digests merge and are kept up to
date; equal rows count as often as they occur. A digest is the hash of the sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 4
SUMS = ("n", *(f"s{i}" for i in range(WORDS)))


def row_sums(line: Column) -> dict[str, Column]:
    """Aggregates over rows, whose null lines don't count."""
    hashed = F.sha2(line, 256)
    word = lambda i: F.conv(F.substring(hashed, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)").cast("decimal(38,0)")
    return {"n": F.count(line).cast("decimal(38,0)"), **{f"s{i}": F.coalesce(F.sum(word(i)), F.lit(0).cast("decimal(38,0)")) for i in range(WORDS)}}


def sums_of(rows: DataFrame, line: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """`by`, n and s0 to s3."""
    return rows.groupBy(*by).agg(*[c.alias(n) for n, c in row_sums(line).items()])


def merged(parts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sums of sums."""
    return parts.groupBy(*by).agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("decimal(38,0)").alias(n) for n in SUMS])


def digest(length: int = 64) -> Column:
    """The digest of a row's sums (n, s0 to s3)."""
    return F.substring(F.sha2(F.concat_ws(",", *[F.col(n).cast("string") for n in SUMS]), 256), 1, length)


def digest_sql(line: str, length: int = 64) -> str:
    """The same as text of SQL: an aggregate over rows."""
    words = [f"coalesce(sum(('0x' || substr(sha256({line}), {16 * i + 1}, 16))::ubigint), 0)" for i in range(WORDS)]
    return f"left(sha256(concat_ws(',', count({line})::varchar, {', '.join(f'{w}::hugeint::varchar' for w in words)})), {length})"
