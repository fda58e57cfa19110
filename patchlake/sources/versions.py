"""Versions of a table of folders, swapped by optimistic commits.

What a root holds now is said by its newest version, a small JSON file with a growing
number. A writer reads the newest version, writes its data into new folders, and then
creates the next number's file, which succeeds for one writer only. The others read
what is newest then, and either add their folders to that (appends don't depend on each
other) or do their work again, after a pause that is drawn and grows. So
readers see the old state or the new one, two writers lose nothing, and a crash before
the commit leaves the old state and a folder that nothing names.

`FeatureStore` keeps images and their rows so. Ids are numbers with at least six digits;
the last one given is part of the version and is raised by a commit of its own before
rows are written, so ids are never given twice, also not those of removed images or of
writers that crashed. Removing adds ids to a list that readers leave out; `compact`
writes the rest anew. `sweep` deletes old versions, and folders that none of the kept
versions names, once they are over an hour old.

Defined cases: a root without versions is empty; unknown ids are ignored; an empty batch
commits nothing; images of one name are different images; removing twice is once; null
vectors are kept; extra columns stay with the rows.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake.operators.ordered import totals_before
from patchlake.operators.upkeep import padded_id

#: Attempts of one commit, and the first pause in seconds.
ATTEMPTS, PAUSE = 30, 0.05
#: Versions that a sweep keeps, and the age in seconds from which it deletes.
KEPT, STALE = 3, 3600
VERSIONS = "_versions"


class Conflict(Exception):
    """Other writers were faster each time."""


def system(spark: SparkSession, path: str):
    """The path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists_already(e: Py4JJavaError) -> bool:
    return "FileAlreadyExistsException" in e.java_exception.getClass().getName()


def created(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole text at once; False if it is there already."""
    jvm = spark.sparkContext._jvm
    target, files = system(spark, path)
    files.mkdirs(target.getParent())
    temporary = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}.tmp")
    out = files.create(temporary, False)
    try:
        out.write(text.encode())
        out.hsync()
    finally:
        out.close()
    try:
        qualified = files.makeQualified(target)
        if qualified.toUri().getScheme() == "file":  # a link is created or not, its rename would replace
            get = lambda p: jvm.java.nio.file.Paths.get(files.makeQualified(p).toUri())
            jvm.java.nio.file.Files.createLink(get(target), get(temporary))
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
            none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            context.rename(files.makeQualified(temporary), qualified, none)
        return True
    except Py4JJavaError as e:
        if exists_already(e):
            return False
        raise
    finally:
        files.delete(temporary, False)


def numbers(spark: SparkSession, root: str) -> list[int]:
    folder, files = system(spark, f"{root}/{VERSIONS}")
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def version(spark: SparkSession, root: str, number: int | None = None) -> dict:
    """A version's content, with its number; the newest by default. Without versions, number 0 and nothing else."""
    found = numbers(spark, root)
    n = (found[-1] if found else 0) if number is None else number
    if not n:
        return {"number": 0}
    path, files = system(spark, f"{root}/{VERSIONS}/{n:020d}.json")
    stream = files.open(path)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return json.loads(text) | {"number": n}


def commit(spark: SparkSession, root: str, change: Callable[[dict], dict | None], attempts: int = ATTEMPTS) -> dict:
    """Make change(newest) the next version; it is called again, with what is newest then, whenever another writer was faster. None: nothing to commit."""
    for k in range(attempts):
        base = version(spark, root)
        new = change({**base})
        if new is None:
            return base
        new = {**{a: b for a, b in new.items() if a != "number"}, "committed": time.time()}
        if created(spark, f"{root}/{VERSIONS}/{base['number'] + 1:020d}.json", json.dumps(new)):
            return new | {"number": base["number"] + 1}
        time.sleep(random.uniform(0, PAUSE * min(2**k, 64)))
    raise Conflict(f"{root}: {attempts} attempts")


def sweep(spark: SparkSession, root: str, kept: int = KEPT, older_than: float = STALE) -> list[str]:
    """Delete all but the newest versions, and folders and temporary files that no kept version names; only what is older. Returns the names."""
    found = numbers(spark, root)
    keep = found[-kept:]
    named = json.dumps([version(spark, root, n) for n in keep])
    gone, limit = [], (time.time() - older_than) * 1000
    folder, files = system(spark, root)
    if not files.exists(folder):
        return []
    candidates = [s for s in files.listStatus(folder) if s.getPath().getName() != VERSIONS and f'"{s.getPath().getName()}"' not in named]
    inside, _ = system(spark, f"{root}/{VERSIONS}")
    old = {f"{n:020d}.json" for n in found[:-kept]}
    if files.exists(inside):
        candidates += [s for s in files.listStatus(inside) if s.getPath().getName() in old or s.getPath().getName().endswith(".tmp")]
    for s in candidates:
        if s.getModificationTime() < limit or older_than <= 0:
            files.delete(s.getPath(), True)
            gone.append(s.getPath().getName())
    return gone


class FeatureStore:
    """Images (id, name, rows, ...) and their rows (id, row, vec, ...) below one root."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def read(self, kind: str, now: dict) -> DataFrame:
        schema = T.StructType.fromJson(now["schemas"][kind])
        found = self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in now[kind]])
        if now.get("removed"):
            gone = self.spark.read.schema("id string").parquet(*[f"{self.root}/{f}" for f in now["removed"]])
            found = found.join(gone.distinct(), "id", "left_anti").select(schema.names)
        return found

    def entries(self, number: int | None = None) -> DataFrame | None:
        """id, name, rows; None for a store that is empty still."""
        now = version(self.spark, self.root, number)
        return self.read("entries", now) if now.get("entries") else None

    def features(self, number: int | None = None) -> DataFrame | None:
        """id, row, vec and what else came with them."""
        now = version(self.spark, self.root, number)
        return self.read("features", now) if now.get("features") else None

    def reserve(self, n: int) -> int:
        """n ids that nobody else gets: the number before the first one."""
        return commit(self.spark, self.root, lambda now: now | {"last_id": now.get("last_id", 0) + n})["last_id"] - n

    def add(self, rows: DataFrame, image: str = "image", name: str = "name") -> DataFrame | None:
        """Store images and give them ids. rows: `image` (a number, distinct for each image of this batch), `name`, row, vec, ...; returns image, id, name, rows of the batch, None if it's empty."""
        from patchlake.sources.shared import materialise

        sizes = materialise(rows.groupBy(F.col(image).alias("image")).agg(F.first(name).alias("name"), F.count("*").alias("rows")), "sizes")
        n = sizes.count()
        if not n:
            return None
        last = self.reserve(n)
        placed = totals_before(sizes, "image", {"before": F.lit(1)})
        placed = materialise(placed.select("image", padded_id(F.col("before") + F.lit(last + 1)).alias("id"), "name", "rows"), "placed")
        data = rows.withColumnRenamed(image, "image").join(placed.select("image", "id"), "image").drop("image", name)
        data = data.select("id", *[c for c in data.columns if c != "id"])
        folders = {k: f"{k}-{uuid.uuid4().hex}" for k in ("entries", "features")}
        data.write.parquet(f"{self.root}/{folders['features']}")
        placed.select("id", "name", "rows").write.parquet(f"{self.root}/{folders['entries']}")
        schemas = {"entries": placed.select("id", "name", "rows").schema.jsonValue(), "features": data.schema.jsonValue()}
        self.append(folders, schemas)
        return placed

    def append(self, folders: dict, schemas: dict) -> dict:
        def change(now: dict) -> dict:
            known = now.get("schemas", schemas)
            if {k: sorted(f["name"] for f in s["fields"]) for k, s in known.items()} != {k: sorted(f["name"] for f in s["fields"]) for k, s in schemas.items()}:
                raise ValueError("the store's rows have other columns")
            return now | {k: now.get(k, []) + [f] for k, f in folders.items()} | {"schemas": known}

        return commit(self.spark, self.root, change)

    def remove(self, ids: DataFrame) -> int:
        """Leave out images (id); how many of them were there."""
        now = self.entries()
        if now is None:
            return 0
        found = now.join(ids.select("id").distinct(), "id", "left_semi").select("id")
        folder = f"removed-{uuid.uuid4().hex}"
        found.write.parquet(f"{self.root}/{folder}")
        n = self.spark.read.schema("id string").parquet(f"{self.root}/{folder}").count()
        if n:
            commit(self.spark, self.root, lambda base: base | {"removed": base.get("removed", []) + [folder]})
        return n

    def of(self, ids: DataFrame) -> DataFrame | None:
        """Rows of the wanted images."""
        found = self.features()
        return None if found is None else found.join(ids.select("id").distinct(), "id", "left_semi").select(found.columns)

    def compact(self) -> dict:
        """Write what is there anew, without what was removed; done again if anything was committed meanwhile."""

        def make(base: dict) -> dict | None:
            if not base.get("features"):
                return None
            folders = {k: f"{k}-{uuid.uuid4().hex}" for k in ("entries", "features")}
            for k, f in folders.items():
                self.read(k, base).write.parquet(f"{self.root}/{f}")
            return base | {k: [f] for k, f in folders.items()} | {"removed": []}

        return commit(self.spark, self.root, make)
