"""Banks kept as folders of saved arrays: the Spark data source `bank_folder`.

The normal tier is one array of rows; labelled tiers have an array and, beside it,
five arrays of metadata for each label; a JSON manifest says which image each range
of rows came from. This layout is for exchange with other tools: a label is one file
and so is written by one task, in a stream. Large banks live in versions
(`patchlake.sources.versions`).

Reading: a partition for each tier, label and range of rows, each with its part of the
arrays only. Which tiers and labels are wanted are options, so that others' files aren't
opened; they aren't taken from the query's filters, as Spark 4.1 keeps what a Python source was
pushed once for each relation: with one DataFrame filtered two ways in a query, both would
read what the last filter left.
Metadata that is missing, or whose length isn't that of the features, is made anew
(`healed` is true then): default severity, registered at the manifest's count. Rows of no
image have null name and entry. The normal tier has no metadata.

Writing: rows go to temporary names; only when all tasks are done are these moved into
place, labels that aren't there any more deleted, and the manifest written last. If the
job fails, temporary files go and the old bank stays. Tiers that aren't named stay as
they are. `write_metadata` replaces the metadata of one tier and no features.

Defined cases: an empty tier deletes its labels; null labels are `_default`; null or
missing metadata get defaults; a tier in one file of the older layout is its `_default`
label, and that file goes with the next save; vectors of several lengths fail the job;
extra columns are ignored.
"""

from __future__ import annotations

import json
import time
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from patchlake.functions.scoring import DEFAULT_SEVERITY

TIERS = ("normal", "critical", "negative")
LABELLED = TIERS[1:]
#: Names of files and fields of the format.
NORMAL_FILE, MANIFEST, META_END = "bank.npy", "bank_meta.json", ".meta.npz"
OLDER_FILES = {"critical": "critical_bank.npy", "negative": "negative_bank.npy"}
DEFAULT_LABEL = "_default"
#: A metadata array's name, its type, and the column here.
META = (("severity", "uint8", "severity"), ("registered_at_inspection", "uint64", "registered_at"), ("last_hit_at_inspection", "uint64", "last_hit"), ("hit_count", "uint32", "hit_count"), ("tier", "uint8", "memory"))
STORED = np.float16
#: Rows of a partition, and of a batch.
PART_ROWS, BATCH_ROWS = 1 << 16, 1 << 12
#: Temporary files older than this, in seconds, were left by a writer that died.
STALE = 3600
SCHEMA = "tier string, label string, row bigint, entry string, name string, place bigint, severity int, registered_at bigint, last_hit bigint, hit_count bigint, memory int, healed boolean, vec array<float>"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (file:/x as well) and the path on it."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def header(f) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, order and type of a saved array; the file is at its first element then."""
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, kind = read(f)
    if kind.hasobject:
        raise ValueError("saved objects aren't read")
    return shape, by_column, kind


def manifest_of(where: fs.FileSystem, root: str) -> dict:
    path = f"{root}/{MANIFEST}"
    if where.get_file_info(path).type != fs.FileType.File:
        return {}
    with where.open_input_stream(path) as f:
        return json.loads(f.read())


def image_index(manifest: dict, tier: str, label: str) -> list[dict]:
    found = manifest.get(f"{tier}_image_index") or ([] if tier == "normal" else {})
    return found if tier == "normal" else found.get(label, [])


def names_in(where: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return sorted((i for i in where.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.type == fs.FileType.File), key=lambda i: i.base_name)


def label_files(where: fs.FileSystem, root: str) -> list[tuple[str, str, str]]:
    """tier, label, path of each array of features."""
    out = [("normal", "", f"{root}/{NORMAL_FILE}")] if where.get_file_info(f"{root}/{NORMAL_FILE}").type == fs.FileType.File else []
    for tier in LABELLED:
        own = [(tier, i.base_name.removesuffix(".npy"), i.path) for i in names_in(where, f"{root}/{tier}") if i.base_name.endswith(".npy")]
        older = f"{root}/{OLDER_FILES[tier]}"
        if DEFAULT_LABEL not in {label for _, label, _ in own} and where.get_file_info(older).type == fs.FileType.File:
            own.append((tier, DEFAULT_LABEL, older))
        out += own
    return out


@dataclass
class Part(InputPartition):
    tier: str
    label: str
    path: str
    meta: str
    first: int
    last: int
    rows: int
    registered_at: int
    #: name, entry, first row, rows and grid places (None: their order) of the images in this range
    images: list[tuple[str, str | None, int, int, list[int] | None]]

    def __post_init__(self) -> None:
        self.value = None


def meta_slice(where: fs.FileSystem, part: Part) -> dict[str, np.ndarray] | None:
    """This range of the five arrays; None if there's no file or a length is another."""
    if where.get_file_info(part.meta).type != fs.FileType.File:
        return None
    out = {}
    with where.open_input_file(part.meta) as f, zipfile.ZipFile(f) as z:
        for name, _, column in META:
            with z.open(f"{name}.npy") as m:
                shape, _, kind = header(m)
                if shape != (part.rows,):
                    return None
                m.seek(part.first * kind.itemsize, 1)
                out[column] = np.frombuffer(m.read((part.last - part.first) * kind.itemsize), kind).astype(np.int64)
    return out


class FolderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.part_rows = options["path"], int(options.get("rows", PART_ROWS))
        self.only = {c: set(json.loads(options[o])) for c, o in (("tier", "tiers"), ("label", "labels")) if o in options}

    def partitions(self) -> list[Part]:
        where, root = located(self.path)
        manifest, out = manifest_of(where, root), []
        for tier, label, path in label_files(where, root):
            if tier not in self.only.get("tier", {tier}) or label not in self.only.get("label", {label}):
                continue
            with where.open_input_file(path) as f:
                rows = header(f)[0][0]
            index = sorted((e for e in image_index(manifest, tier, label) if e.get("start", -1) >= 0), key=lambda e: e["start"])
            for first in range(0, rows, self.part_rows):
                last = min(rows, first + self.part_rows)
                own = [(e.get("name") or None, str(e["entry_id"]) if e.get("entry_id") else None, e["start"], e["count"], e.get("kept")) for e in index if e["start"] < last and e["start"] + e["count"] > first]
                out.append(Part(tier, label, path, f"{root}/{tier}/{label}{META_END}", first, last, rows, int(manifest.get("inspection_count", 0)), own))
        return out or [Part("", "", "", "", 0, 0, 0, 0, [])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.last == part.first:
            return
        where, _ = located(self.path)
        n = part.last - part.first
        columns: dict[str, np.ndarray | None] = {c: None for _, _, c in META}
        healed = False
        if part.tier != "normal":
            found = meta_slice(where, part)
            healed = found is None
            if found is None:
                at = np.full(n, part.registered_at)
                found = {"severity": np.full(n, DEFAULT_SEVERITY), "registered_at": at, "last_hit": at, "hit_count": np.zeros(n, np.int64), "memory": np.zeros(n, np.int64)}
            columns = found
        image, place = np.full(n, -1), np.full(n, -1)
        for k, (_, _, start, count, kept) in enumerate(part.images):
            a, b = max(start, part.first), min(start + count, part.last)
            image[a - part.first : b - part.first] = k
            place[a - part.first : b - part.first] = np.arange(a - start, b - start) if kept is None else kept[a - start : b - start]
        name, entry = (pa.array([x[k] for x in part.images], pa.string()) for k in (0, 1))
        with where.open_input_file(part.path) as f:
            shape, by_column, kind = header(f)
            if len(shape) != 2 or by_column:
                raise ValueError(f"{part.path} isn't an array of rows")
            wide = shape[1] * kind.itemsize
            f.seek(f.tell() + part.first * wide)
            for at in range(0, n, BATCH_ROWS):
                size = min(BATCH_ROWS, n - at)
                x = np.frombuffer(f.read(size * wide), kind).astype(np.float32)
                which = pa.array(image[at : at + size], mask=image[at : at + size] < 0)
                numbers = [pa.nulls(size, k) if columns[c] is None else pa.array(columns[c][at : at + size]).cast(k) for c, k in (("severity", pa.int32()), ("registered_at", pa.int64()), ("last_hit", pa.int64()), ("hit_count", pa.int64()), ("memory", pa.int32()))]
                vec = pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * shape[1], pa.int32()), pa.array(x))
                arrays = [pa.array([part.tier] * size), pa.array([part.label] * size), pa.array(np.arange(part.first + at, part.first + at + size)), entry.take(which), name.take(which), pa.array(place[at : at + size], mask=place[at : at + size] < 0), *numbers, pa.array([healed] * size), vec]
                yield pa.RecordBatch.from_arrays(arrays, ["tier", "label", "row", "entry", "name", "place", "severity", "registered_at", "last_hit", "hit_count", "memory", "healed", "vec"])


@dataclass
class Written(WriterCommitMessage):
    #: temporary and final paths, and for each tier and label its rows, dimension and image index
    files: list[tuple[str, str]] = field(default_factory=list)
    labels: dict[tuple[str, str], tuple[int, int, list[dict]]] = field(default_factory=dict)


class LabelWriter:
    """One tier and label: features in a stream, metadata gathered (26 bytes a row)."""

    def __init__(self, where: fs.FileSystem, root: str, tier: str, label: str, rows: int, vectors: bool) -> None:
        self.where, self.tier, self.label, self.rows, self.vectors = where, tier, label, rows, vectors
        self.final = f"{root}/{NORMAL_FILE}" if tier == "normal" else f"{root}/{tier}/{label}.npy"
        self.meta_final = f"{root}/{tier}/{label}{META_END}"
        where.create_dir(root if tier == "normal" else f"{root}/{tier}", recursive=True)
        self.out, self.dim, self.seen = None, None, 0
        self.meta: list[list[np.ndarray]] = [[] for _ in META]
        self.images: list[dict] = []
        self.files: list[tuple[str, str]] = []

    def temporary(self, final: str) -> str:
        path = f"{final}.{uuid.uuid4().hex}.tmp"
        self.files.append((path, final))
        return path

    def add(self, b: pa.RecordBatch) -> None:
        if self.vectors:
            vec = b.column("vec")
            length = pc.list_value_length(vec)
            dim = length[0].as_py()
            if vec.null_count or (self.dim or dim) != dim or pc.any(pc.not_equal(length, dim)).as_py():
                raise ValueError("null vectors, or vectors of several lengths")
            if self.out is None:
                self.dim, self.out = dim, self.where.open_output_stream(self.temporary(self.final))
                np.lib.format.write_array_header_1_0(self.out, {"descr": np.lib.format.dtype_to_descr(np.dtype(STORED)), "fortran_order": False, "shape": (self.rows, dim)})
            self.out.write(vec.flatten().to_numpy(zero_copy_only=False).astype(STORED).tobytes())
        n = b.num_rows
        for held, (_, kind, column) in zip(self.meta, META, strict=True):
            held.append(b.column(column).to_numpy(zero_copy_only=False).astype(kind))
        entry, name, place = (b.column(c).to_pylist() for c in ("entry", "name", "place"))
        for i in range(n):
            last = self.images[-1] if self.images else None
            if entry[i] is None and name[i] is None:
                continue
            if last is None or (last["name"], last["entry_id"]) != (name[i] or "", entry[i] or "") or last["start"] + last["count"] != self.seen + i:
                last = {"name": name[i] or "", "entry_id": entry[i] or "", "start": self.seen + i, "count": 0, "kept": []}
                self.images.append(last)
            last["kept"].append(place[i])
            last["count"] += 1
        self.seen += n

    def close(self) -> tuple[int, int, list[dict]]:
        if self.out is not None:
            self.out.close()
        if self.seen != self.rows:
            raise ValueError(f"{self.tier}/{self.label}: {self.seen} rows, not {self.rows}; were rows of one label in several tasks?")
        if self.tier != "normal":
            with self.where.open_output_stream(self.temporary(self.meta_final)) as f:
                np.savez(f, **{name: np.concatenate(held) for held, (name, _, _) in zip(self.meta, META, strict=True)})
        for image in self.images:
            if image["kept"] == list(range(image["count"])) or None in image["kept"]:
                del image["kept"]
            if not image["entry_id"]:
                del image["entry_id"]
        return self.seen, self.dim or 0, self.images


class FolderWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.parts = options.get("parts", ",".join(TIERS)).split(",")
        self.rows = {tuple(k.split("/", 1)): n for k, n in json.loads(options["counts"]).items()}
        self.vectors = options.get("vectors", "true") == "true"
        self.count = options.get("inspection_count")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        where, root = located(self.path)
        done, now = Written(), None
        try:
            for b in batches:
                keys = list(zip(b.column("tier").to_pylist(), b.column("label").to_pylist(), strict=True))
                start = 0
                while start < b.num_rows:
                    end = start + 1
                    while end < b.num_rows and keys[end] == keys[start]:
                        end += 1
                    if now is None or (now.tier, now.label) != keys[start]:
                        if now is not None:
                            done.labels[now.tier, now.label] = now.close()
                            done.files += now.files
                        now = LabelWriter(where, root, *keys[start], self.rows[keys[start]], self.vectors)
                    now.add(b.slice(start, end - start))
                    start = end
            if now is not None:
                done.labels[now.tier, now.label] = now.close()
                done.files += now.files
        except BaseException:
            remove(where, [t for t, _ in [*done.files, *(now.files if now else [])]])
            raise
        return done

    def commit(self, messages: list[Written | None]) -> None:
        where, root = located(self.path)
        written = [m for m in messages if m is not None]
        for m in written:
            for temporary, final in m.files:
                where.move(temporary, final)
        labels = {k: v for m in written for k, v in m.labels.items()}
        manifest = manifest_of(where, root)
        where.create_dir(root, recursive=True)
        if self.vectors:
            self.swept(where, root, labels)
            self.indexed(manifest, labels)
        if self.count is not None:
            manifest["inspection_count"] = int(self.count)
        text = json.dumps(manifest, indent=2, ensure_ascii=False).encode()
        temporary = f"{root}/{MANIFEST}.{uuid.uuid4().hex}.tmp"
        with where.open_output_stream(temporary) as f:
            f.write(text)
        where.move(temporary, f"{root}/{MANIFEST}")

    def swept(self, where: fs.FileSystem, root: str, labels: dict) -> None:
        """Files of labels that are gone, of the older layout, and of writers that died."""
        gone = [f"{root}/{OLDER_FILES[t]}" for t in self.parts if t in OLDER_FILES]
        if "normal" in self.parts and ("normal", "") not in labels:
            gone.append(f"{root}/{NORMAL_FILE}")
        for tier in set(self.parts) & set(LABELLED):
            for i in names_in(where, f"{root}/{tier}"):
                stem = i.base_name.removesuffix(META_END).removesuffix(".npy")
                if i.base_name.endswith((".npy", META_END)) and (tier, stem) not in labels:
                    gone.append(i.path)
        for folder in (root, *(f"{root}/{t}" for t in LABELLED)):
            gone += [i.path for i in names_in(where, folder) if i.base_name.endswith(".tmp") and i.mtime is not None and i.mtime.timestamp() < time.time() - STALE]
        remove(where, gone)

    def indexed(self, manifest: dict, labels: dict) -> None:
        first = lambda images: list(dict.fromkeys(e["name"] for e in images if e["name"]))
        for tier in self.parts:
            own = {label: images for (t, label), (_, _, images) in labels.items() if t == tier}
            manifest[f"{tier}_image_index"] = own.get("", []) if tier == "normal" else own
            manifest["bank_images" if tier == "normal" else f"{tier}_images"] = first(own.get("", [])) if tier == "normal" else {k: first(v) for k, v in own.items()}
        if "normal" in self.parts:
            manifest["n_patches"] = labels.get(("normal", ""), (0,))[0]
        dims = {d for _, d, _ in labels.values()}
        if dims:
            manifest["dim"] = max(dims)

    def abort(self, messages: list[Written | None]) -> None:
        where, _ = located(self.path)
        remove(where, [t for m in messages if m is not None for t, _ in m.files])


def remove(where: fs.FileSystem, paths: list[str]) -> None:
    for p in paths:
        if where.get_file_info(p).type == fs.FileType.File:
            where.delete_file(p)


class BankFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bank_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        return FolderWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(BankFolder)


def read_folder(spark: SparkSession, path: str, tiers: Sequence[str] | None = None, labels: Sequence[str] | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """The folder's rows; with tiers and labels only their files are opened."""
    register(spark)
    only = {n: json.dumps(list(v)) for n, v in (("tiers", tiers), ("labels", labels)) if v is not None}
    return spark.read.format("bank_folder").option("rows", part_rows).options(**only).load(path)


def put(bank: DataFrame, parts: tuple[str, ...], vectors: bool) -> tuple[DataFrame, str]:
    """Rows as the writer wants them, each label in one task and in order, and the number of rows of each."""
    kinds = {"entry": "string", "name": "string", "place": "bigint", "severity": "int", "registered_at": "bigint", "last_hit": "bigint", "hit_count": "bigint", "memory": "int"}
    defaults = {"severity": DEFAULT_SEVERITY, "registered_at": 0, "last_hit": 0, "hit_count": 0, "memory": 0}
    given = {c: F.col(c).cast(k) if c in bank.columns else F.lit(None).cast(k) for c, k in kinds.items()}
    given |= {c: F.coalesce(given[c], F.lit(d).cast(kinds[c])) for c, d in defaults.items()}
    label = F.when(F.col("tier") == "normal", "").otherwise(F.coalesce("label", F.lit(DEFAULT_LABEL)))
    vec = F.col("vec").cast("array<float>") if vectors else F.lit(None).cast("array<float>")
    order = [F.col(c).alias(f"__{c}") for c in ("entry", "row") if c in bank.columns]
    rows = bank.where(F.col("tier").isin(*parts)).select("tier", label.alias("label"), *[c.alias(n) for n, c in given.items()], vec.alias("vec"), *order)
    counts = {f"{r.tier}/{r.label}": r["count"] for r in rows.groupBy("tier", "label").count().collect()}  # one for each label
    sorted_rows = rows.repartition("tier", "label").sortWithinPartitions("tier", "label", *[f"__{c}" for c in ("entry", "row") if c in bank.columns])
    return sorted_rows.drop("__entry", "__row"), json.dumps(counts)


def write_folder(bank: DataFrame, path: str, parts: tuple[str, ...] = TIERS, inspection_count: int | None = None) -> None:
    """Save the named tiers. bank: tier, label, vec and, where known, entry, row, name, place and metadata."""
    register(bank.sparkSession)
    rows, counts = put(bank, parts, True)
    options = {"path": path, "parts": ",".join(parts), "counts": counts} | ({} if inspection_count is None else {"inspection_count": str(inspection_count)})
    rows.write.format("bank_folder").mode("append").options(**options).save()


def write_metadata(bank: DataFrame, path: str, tier: str, inspection_count: int | None = None) -> None:
    """Save one labelled tier's metadata and no features; each label must have as many rows as its saved features."""
    if tier not in LABELLED:
        raise ValueError("the normal tier has no metadata")
    register(bank.sparkSession)
    rows, counts = put(bank, (tier,), False)
    where, root = located(path)
    for t, label, file in label_files(where, root):
        n = json.loads(counts).get(f"{t}/{label}")
        if t == tier and n is not None:
            with where.open_input_file(file) as f:
                saved = header(f)[0][0]
            if saved != n:
                raise ValueError(f"{t}/{label} has {n} rows of metadata for {saved} of features")
    options = {"path": path, "parts": tier, "counts": counts, "vectors": "false"} | ({} if inspection_count is None else {"inspection_count": str(inspection_count)})
    rows.write.format("bank_folder").mode("append").options(**options).save()
