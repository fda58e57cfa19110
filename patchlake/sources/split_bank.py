"""A bank as two bucketed tables: vectors, which stay, and metadata, which change.

Both tables are bucketed and sorted alike by tier, label, entry and row, so that putting
them together needs no shuffle of the vectors. Hits, marks and decay write the metadata
anew and nothing else; which metadata hold now is said by the root's newest version
(`patchlake.sources.versions`), and a change is made again if another writer was faster.
Rows that a change drops stay in the vectors' files, unread by any join, until `compact`.

Defined cases: rows without metadata get defaults; an empty bank has no rows; a change may
drop rows but neither add them nor change their keys (checked); extra columns of the
bank are metadata.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake.operators.memory import KEY, with_defaults
from patchlake.sources.versions import commit, version

#: Bytes of vectors in a bucket, about.
BUCKET_BYTES = 128 << 20
VECTOR_COLUMNS = (*KEY, "vec")


class SplitBank:
    """The bank below a root that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def create(cls, bank: DataFrame, root: str, now: int = 0, buckets: int | None = None) -> SplitBank:
        """bank: tier, label, entry, row (a key), vec, and metadata where known."""
        self = cls(bank.sparkSession, root)
        if buckets is None:
            size = bank.agg(F.sum(8 * F.size("vec") + 64)).first()[0] or 0
            buckets = max(1, -(-size // BUCKET_BYTES))
        whole = with_defaults(bank, now)
        vectors, meta = whole.select(*VECTOR_COLUMNS), whole.drop("vec")
        new = {"buckets": buckets, "vectors": self.written(vectors, "vectors", buckets), "meta": self.written(meta, "meta", buckets)}
        new |= {"vector_schema": vectors.schema.jsonValue(), "meta_schema": meta.schema.jsonValue()}
        commit(self.spark, self.root, lambda _: new)
        return self

    def table_name(self, folder: str) -> str:
        return f"patchlake_{hashlib.sha256(f'{self.root}/{folder}'.encode()).hexdigest()[:24]}"

    def written(self, df: DataFrame, kind: str, buckets: int) -> str:
        """A bucketed table in a new folder; each bucket is one file."""
        folder = f"{kind}-{uuid.uuid4().hex}"
        put = df.repartition(buckets, *KEY)
        put.write.bucketBy(buckets, *KEY).sortBy(*KEY).option("path", f"{self.root}/{folder}").format("parquet").saveAsTable(self.table_name(folder))
        return folder

    def opened(self, folder: str, schema: dict, buckets: int) -> DataFrame:
        """The table of a folder, made known to this session's catalog if it isn't."""
        name = self.table_name(folder)
        if not self.spark.catalog.tableExists(name):
            kinds = T.StructType.fromJson(schema)
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.fields)
            key = ", ".join(KEY)
            self.spark.sql(f"create table if not exists {name} ({columns}) using parquet clustered by ({key}) sorted by ({key}) into {buckets} buckets location '{self.root}/{folder}'")
        return self.spark.table(name)

    def meta_of(self, now: dict) -> DataFrame:
        return self.opened(now["meta"], now["meta_schema"], now["buckets"])

    def meta(self, number: int | None = None) -> DataFrame:
        """All but the vectors."""
        return self.meta_of(version(self.spark, self.root, number))

    def rows(self, number: int | None = None) -> DataFrame:
        """The whole bank: buckets meet buckets."""
        now = version(self.spark, self.root, number)
        vectors = self.opened(now["vectors"], now["vector_schema"], now["buckets"])
        return self.meta_of(now).join(vectors.hint("merge"), list(KEY))

    def change(self, make: Callable[[DataFrame], DataFrame]) -> int:
        """Make make(metadata) the metadata; the number of the version."""

        def next_version(base: dict) -> dict:
            old = self.meta_of(base)
            folder = self.written(make(old).select(old.columns), "meta", base["buckets"])
            new = self.opened(folder, base["meta_schema"], base["buckets"])
            if new.join(old, list(KEY), "left_anti").limit(1).count():
                raise ValueError("the change makes rows that the bank doesn't have")
            return base | {"meta": folder}

        return commit(self.spark, self.root, next_version)["number"]

    def compact(self) -> int:
        """Write the vectors anew, without rows that have no metadata any more."""

        def next_version(base: dict) -> dict:
            vectors = self.opened(base["vectors"], base["vector_schema"], base["buckets"])
            left = vectors.hint("merge").join(self.meta_of(base).select(*KEY), list(KEY), "left_semi").select(*VECTOR_COLUMNS)
            return base | {"vectors": self.written(left, "vectors", base["buckets"])}

        return commit(self.spark, self.root, next_version)["number"]
