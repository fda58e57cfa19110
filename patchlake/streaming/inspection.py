"""Streams of inspections: hits by row with state, a capped log, ingest into a store, and an index that grows.

Order is the count of inspections, so no late data exist and no watermark is
needed. Sinks that rewrite a table write each batch under its own id, so a batch
that runs again leaves the same rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from patchlake.operators.clusters import assign, needs_rebuild
from patchlake.sources.shared import materialise

SAFE_FILE = re.compile(r"[A-Za-z0-9_][A-Za-z0-9._\-]*")

HITS = "tier string, label string, entry bigint, row bigint, hit_count bigint, last_hit bigint"


def counted(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    count, last = state.get if state.exists else (0, 0)
    seen = pd.concat([b[["inspection"]] for b in batches])["inspection"].drop_duplicates()
    count, last = count + len(seen), max(last, int(seen.max()))
    state.update((count, last))
    yield pd.DataFrame([(*key, count, last)], columns=["tier", "label", "entry", "row", "hit_count", "last_hit"])


def hit_counts(hits: DataFrame) -> DataFrame:
    """Each row's hits so far, once for each inspection, and the last one. hits: tier, label, entry, row, inspection.

    A row is hit once by an inspection; all hits of one inspection come in one batch.
    """
    return hits.groupBy("tier", "label", "entry", "row").applyInPandasWithState(counted, HITS, "hit_count bigint, last_hit bigint", "update", GroupStateTimeout.NoTimeout)


def with_hits(bank: DataFrame, counts: DataFrame) -> DataFrame:
    """A bank with counts from the stream: of several updates of a row the largest counts."""
    key = ["tier", "label", "entry", "row"]
    latest = counts.groupBy(*key).agg(F.max("hit_count").alias("__hits"), F.max("last_hit").alias("__last"))
    out = bank.join(latest, key, "left")
    return out.withColumns({"hit_count": F.col("hit_count") + F.coalesce("__hits", F.lit(0)), "last_hit": F.coalesce("__last", "last_hit")}).select(bank.columns)


LOG = "log string, id string, ts bigint, file string, change string"


def logged(cap: int, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A log's newest `cap` records, which are its state, after a batch's events."""
    events = sorted((tuple(r) for b in batches for r in b[["seq", "kind", "id", "ts", "file"]].itertuples(index=False)), key=lambda r: r[0])
    held = {r[0]: r for r in json.loads(state.get[0])} if state.exists else {}
    dropped: list = []
    for seq, kind, id_, ts, file in events:
        if kind == "add" and id_ not in held:
            held[id_] = (id_, int(ts), int(seq), file)
        elif kind == "delete" and id_ in held:
            dropped.append(held.pop(id_))
        elif kind == "clear":
            dropped += held.values()
            held = {}
    kept = sorted(held.values(), key=lambda r: (r[1], r[2]))
    dropped += kept[: max(0, len(kept) - cap)]
    kept = kept[max(0, len(kept) - cap) :]
    state.update((json.dumps(kept),))
    rows = [(key[0], r[0], r[1], r[3], "dropped") for r in dropped] + [(key[0], r[0], r[1], r[3], "kept") for r in kept]
    if not kept:
        rows.append((key[0], None, None, None, "empty"))
    yield pd.DataFrame(rows, columns=["log", "id", "ts", "file", "change"]).astype({"ts": "Int64"})


def log_changes(events: DataFrame, cap: int) -> DataFrame:
    """Changes (log, id, ts, file, change) of capped logs. events: log, seq (their order), kind (add, delete, clear), id, ts, file.

    `dropped`: a record that fell out, was deleted or cleared; `kept`: one that the log holds after
    the batch; `empty`: it holds none. An id that the log holds isn't added again; deleting an
    unknown one does nothing.
    """
    return events.groupBy("log").applyInPandasWithState(partial(logged, cap), LOG, "records string", "update", GroupStateTimeout.NoTimeout)


def removed_files(folder: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Deletes files that lie in the folder; names that lead elsewhere are left alone."""
    where, root = pa_fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
    for b in batches:
        for name in b["file"]:
            path = f"{root}/{name}"
            if SAFE_FILE.fullmatch(name or "") and where.get_file_info(path).type == pa_fs.FileType.File:
                where.delete_file(path)
        yield b[["file"]]


def capped_log(events: DataFrame, path: str, cap: int, checkpoint: str, files: str | None = None):
    """A query that keeps each log's newest `cap` records below `path`, read by read_log, and deletes the files (in the folder `files`) of records that fell out. A batch writes the logs that it touched and replaces what they had; nothing else grows."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        held = materialise(batch, "changes")
        held.where("change = 'kept'").select("id", "ts", "file", "log").repartition("log").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log").parquet(path)
        spark = batch.sparkSession
        for r in held.where("change = 'empty'").select("log").distinct().toLocalIterator():  # logs cleared in this batch
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/log={r.log}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        if files is not None:
            held.where("change = 'dropped'").select("file").mapInPandas(partial(removed_files, files), "file string").write.format("noop").mode("overwrite").save()

    return log_changes(events, cap).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """id, ts, file, log of all records; no rows before the first batch."""
    schema = "id string, ts bigint, file string, log string"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def ingest(stream: DataFrame, path: str, checkpoint: str):
    """A query that appends new rows, unassigned, to a store."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def extend_index(stream: DataFrame, centroids: DataFrame, built_rows: int, path: str, checkpoint: str, on_rebuild=None):
    """A query that assigns new rows to clusters; on_rebuild(rows so far) is called when they are too many for the index."""

    def extend(batch: DataFrame, batch_id: int) -> None:
        assign(batch, centroids).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        rows = batch.sparkSession.read.parquet(path).count()
        if on_rebuild and needs_rebuild(rows, built_rows):
            on_rebuild(rows)

    return stream.writeStream.foreachBatch(extend).option("checkpointLocation", checkpoint)
