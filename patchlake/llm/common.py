"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from patchlake.sources.shared import materialise, scratch_path, shared_dir
from patchlake.sources.shared import table as plain_table

__all__ = ["dealt_by_bytes", "fresh", "map_texts", "materialise", "scratch_path", "shared_dir", "small_batches", "table"]


#: Arrow batches hold about so many bytes at most: what a task has in Python and off the heap follows from it.
ARROW_BYTES = 8 << 20
#: A table of fewer bytes isn't dealt out.
SPREAD_BYTES = 1 << 20
#: Up to so many ids (32 bytes each or so) are sent to executors.
SENT_IDS = 2_000_000
#: Spark's own bound.
DEFAULT_ARROW_BYTES = "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of this session by ARROW_BYTES, unless a bound was set."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == DEFAULT_ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose few small files (one split each) would leave cores idle is dealt out to all of them; the rows are the same."""
    found = plain_table(spark, sf_dir, name)
    cores, files = spark.sparkContext.defaultParallelism, len(found.inputFiles())
    size = int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found.repartition(cores) if files < cores and SPREAD_BYTES < size <= files << 27 else found


def fresh(name: str, taken: list[str]) -> str:
    """`name`, with underscores before it while a column has it."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def sent(ids: DataFrame, most: int = SENT_IDS) -> DataFrame:
    """A written table of ids, to be sent to every executor if it has at most `most` rows, so that texts stay where they are; else joins deal out both sides."""
    return F.broadcast(ids) if ids.count() <= most else ids


def dealt_by_bytes(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of column 0."""
    for b in batches:
        start, held = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(0)), 0).to_pylist()):
            if held and held + n > limit:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < b.num_rows:
            yield b.slice(start)


def map_texts(df: DataFrame, make: Callable[[], Callable[[list], list]], result: T.StructType, text: str = "text", keep: list[str] | None = None, into: str = "found", batch_bytes: int = 1 << 20) -> DataFrame:
    """`keep` columns (all by default) and a struct column of results.

    `make` is called once in each task and gives a function from a list of texts
    (None where null) to a list of columns, one for each field of `result`. The
    kept columns stay in Arrow. If a kept column is named like `into`, the
    struct's name gets underscores before it.
    """
    small_batches(df.sparkSession)
    keep = list(df.columns if keep is None else keep)
    put = df.select(F.col(f"`{text}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"))
    schema = T.StructType([put.schema["kept"], T.StructField("result", result)])
    kinds = to_arrow_schema(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in dealt_by_bytes(batches, batch_bytes):
            columns = [c if isinstance(c, pa.Array) else pa.array(c, k.type) for c, k in zip(work(b.column(0).to_pylist()), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.StructArray.from_arrays(columns, fields=list(kinds))], ["kept", "result"])
        pa.default_memory_pool().release_unused()

    out = put.mapInArrow(run, schema)
    return out.select(*[F.col("kept").getField(c).alias(c) for c in keep], F.col("result").alias(fresh(into, keep)))
