"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by id, and by digest within an id, into shards of about
`shard_bytes` of payload; the shards' bounds come from running totals of bytes in
that order, so equal input gives equal files however ids are spread. Each shard is written as gzip members, one for each record, in files that
roll when their compressed size reaches `roll_bytes`. Headers and digests are
made anew from the payload; ids and dates depend on content only. A file is
written under a temporary name of its task attempt and moved to its own name
when it is whole; a task that runs again writes the same bytes. The manifest
(file, records, bytes, sha256) is written last, by Spark's committer, and
readers take only the files it names.

Of records with equal payloads of at least `least_bytes`, the one with the
smallest id is a response, the others are revisits that refer to it.

Defined cases: a null payload is empty; a null id sorts first and is never
referred to while another id holds the payload; repeated rows (one id, one
payload) are responses all, as none has a larger id; an empty table gives an
empty manifest; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlake.llm.common import materialise, scratch_path, small_batches
from patchlake.operators.ordered import totals_before

SHARD_BYTES = 32 << 20
ROLL_BYTES = 8 << 20
LEAST_BYTES = 100
#: Archives to a reading task, once there are enough for all cores.
READ_BYTES = 64 << 20
#: So many shards at most, as their bounds go to the driver and to every task; beyond that shards grow, and as they are streamed, memory doesn't.
MOST_SHARDS = 100_000
LEVEL = 4
#: No clock: the same input gives the same bytes.
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "shard int, file string, records bigint, bytes bigint, sha256 string"
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, file string, offset bigint"


def revisits(rows: DataFrame, least_bytes: int) -> DataFrame:
    """key, digest, first: the records that repeat the payload of one with a smaller id. No payload is shuffled for this."""
    large = rows.where(F.octet_length("body") >= least_bytes).select("key", "digest")
    firsts = large.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null")
    return large.join(firsts.select("digest", "first"), "digest").where("key is null or key > first").select("key", "digest", "first").distinct()


def shard_cuts(rows: DataFrame, shard_bytes: int) -> list[tuple[int | None, str]]:
    """Key and digest of the first record of all shards but the first, by running totals of bytes. rows: key, digest, size.

    Shards hold `shard_bytes`, or the whole over `MOST_SHARDS` where that is more; what
    the driver gets is one key and digest for each shard.
    """
    sizes = rows.groupBy("key", "digest").agg(F.sum("size").alias("size"))
    sizes = materialise(sizes, "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    width = max(shard_bytes, -(-total // MOST_SHARDS))
    keys = sizes.groupBy("key").agg(F.sum("size").alias("all"))
    nulls = keys.where("key is null").agg(F.sum("all")).first()[0] or 0
    before = totals_before(keys.where("key is not null"), "key", {"before": F.col("all")})
    before = before.select("key", (F.col("before") + F.lit(nulls)).alias("before"), "all").unionByName(keys.where("key is null").select("key", F.lit(0).cast("bigint").alias("before"), "all"))
    # only keys within which a shard begins are looked at by digest
    opens = before.where(F.floor((F.col("before") + F.col("all")) / width) > F.floor(F.col("before") / width))
    inside = sizes.join(opens.select(F.col("key").alias("k"), "before"), F.col("key").eqNullSafe(F.col("k")))
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("key").orderBy("digest")))
    first = inside.withColumn("shard", F.floor(F.col("upto") / width)).where(F.col("shard") > F.floor((F.col("upto") - F.col("size")) / width))
    return [(r[0], r[1]) for r in first.select("key", "digest").orderBy(F.col("key").asc_nulls_first(), "digest").collect()]


def shard_of(cuts: list[tuple[int | None, str]]) -> Column:
    """How many cuts lie before or at a record, by key and digest."""
    low = -(1 << 63)  # a null key sorts first
    keys, digests = np.array([low if k is None else k for k, _ in cuts], np.int64), [d for _, d in cuts]

    @F.pandas_udf("int")
    def find(key: pd.Series, digest: pd.Series) -> pd.Series:
        own = np.array([low if pd.isna(k) else int(k) for k in key], np.int64)
        at, end = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        for i in np.flatnonzero(end > at):  # a shard begins within this key
            at[i] = bisect.bisect_right(digests, digest.iloc[i], at[i], end[i])
        return pd.Series(at, dtype="int32")

    return find(F.col("key"), F.col("digest")) if cuts else F.lit(0)


def record_id(digest: str, key) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{key} {digest}'.encode()).hexdigest()[:32])}>"


def one_line(x: str) -> str:
    return x.replace("\r", "%0D").replace("\n", "%0A")


def record(key, url: str, body: bytes, digest: str, kind: str, first) -> bytes:
    """A WARC/1.1 record as one gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http if kind == "revisit" else http + body
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(digest, key)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {one_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Page-ID: {'' if key is None else key}",
        f"X-Payload-Length: {len(body)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(digest, first)}", f"X-Refers-To-Page-ID: {first}"]
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


class Roller:
    """The files of one shard: a temporary name while open, the own name once whole."""

    def __init__(self, root: str, shard: int, roll_bytes: int) -> None:
        self.fs, self.root = fs.FileSystem.from_uri(root)
        self.shard, self.roll_bytes, self.files, self.out = shard, roll_bytes, 0, None
        context = TaskContext.get()
        self.attempt = context.taskAttemptId() if context else 0

    def write(self, data: bytes) -> dict | None:
        """Add a record; what the manifest says of a file that this closed, if any."""
        done = self.close() if self.out and self.held + len(data) > self.roll_bytes else None
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.files:06d}.warc.gz"
            self.temporary = f"{self.root}/_temporary-{self.attempt}-{uuid.uuid4().hex}-{self.name}"
            self.out, self.held, self.records, self.hash = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.hash.update(data)
        self.held += len(data)
        self.records += 1
        return done

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.fs.move(self.temporary, f"{self.root}/{self.name}")
        self.out, self.files = None, self.files + 1
        return {"shard": self.shard, "file": self.name, "records": self.records, "bytes": self.held, "sha256": self.hash.hexdigest()}


def write_shards(root: str, roll_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    roller, done, note = None, [], None
    kinds = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
    for b in batches:
        for shard, key, digest, url, body, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if body is None:  # a note that comes before its records
                note = key, digest, first
                continue
            kind, first = ("revisit", note[2]) if note and note[:2] == (key, digest) else ("response", None)
            if roller is None or roller.shard != shard:
                done.append(roller.close() if roller else None)
                roller = Roller(root, shard, roll_bytes)
            done.append(roller.write(record(key, url, body, digest, kind, first)))
        yield pa.RecordBatch.from_pylist([x for x in done if x], schema=kinds)
        done = []
    if roller:
        yield pa.RecordBatch.from_pylist([roller.close()], schema=kinds)


def write_warc(pages: DataFrame, root: str, key: str = "page_id", payload: str = "html", url: str = "url", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write the archives below `root` (a URI that the executors share) and return the manifest, read from `root`/manifest."""
    spark = pages.sparkSession
    small_batches(spark)
    where, path = fs.FileSystem.from_uri(root)
    where.create_dir(path, recursive=True)
    body = F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(key).cast("bigint").alias("key"), F.sha2(body, 256).alias("digest"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("body"))
    cuts = shard_cuts(rows.select("key", "digest", (F.octet_length("body") + 512).cast("bigint").alias("size")), shard_bytes)
    notes = revisits(rows, least_bytes).select("key", "digest", F.lit("").alias("url"), F.lit(None).cast("binary").alias("body"), "first")
    whole = notes.unionByName(rows.withColumn("first", F.lit(None).cast("bigint"))).select(shard_of(cuts).alias("shard"), "key", "digest", "url", "body", "first")
    # a note sorts before the records it is about: its body is null
    dealt = whole.repartition(2 * len(cuts) + 2, "shard").sortWithinPartitions("shard", "key", "digest", F.col("body").isNotNull(), "url")
    manifest = dealt.mapInArrow(partial(write_shards, root, roll_bytes), MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{root}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Each gzip member's offset and content; only one is held."""
    inflate, parts, start, at = zlib.decompressobj(31), [], 0, 0
    while data := stream.read(chunk):
        while data:
            parts.append(inflate.decompress(data))
            at += len(data) - len(inflate.unused_data)
            data = b""
            if inflate.eof:
                yield start, b"".join(parts)
                data, start, parts = inflate.unused_data, at, []
                inflate = zlib.decompressobj(31)
    if parts and any(parts):
        raise ValueError("the archive ends inside a record")


def parse(content: bytes) -> dict:
    """Headers and digests of a record, checked against its block."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} differs")
    body = block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and hashlib.sha256(body).hexdigest() != digest:
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} differs")
    number = lambda x: int(x) if x else None
    return {"page_id": number(fields["X-Page-ID"]), "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("X-Refers-To-Page-ID")), "url": fields["WARC-Target-URI"], "body": body}


def read_files(root: str, with_body: bool, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    where, path = fs.FileSystem.from_uri(root)
    for b in batches:
        for name in b["file"]:
            rows, held = [], 0
            with where.open_input_stream(f"{path}/{name}", compression=None) as stream:
                for offset, content in members(stream):
                    rows.append(parse(content) | {"file": name, "offset": offset})
                    held += len(content)
                    if not with_body:
                        rows[-1].pop("body")
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield typed_frame(rows)
                        rows, held = [], 0
            if rows:
                yield typed_frame(rows)


def typed_frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows)
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_warc(manifest: DataFrame, root: str, with_body: bool = False) -> DataFrame:
    """Every record of the files that the manifest names; with_body adds body (empty for revisits)."""
    n, size = manifest.agg(F.count("*"), F.sum("bytes")).first()
    tasks = max(1, min(n, max(4 * manifest.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // READ_BYTES))))
    files = manifest.select("file").repartition(tasks)
    return files.mapInPandas(partial(read_files, root, with_body), RECORD + (", body binary" if with_body else ""))


def new_root(spark, name: str = "warc") -> str:
    """A URI below the shared folder."""
    path = scratch_path(spark, name)
    return path if "://" in path else "file://" + path.removeprefix("file:")
