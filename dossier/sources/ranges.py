"""Archives read by ranges: listing, entry directories, and tasks dealt by entries.

Tasks list the folders. Of every archive a task reads the directory at its end, which tells where
the entries lie; its CSV entries are packed into chunks of about ``CHUNK_BYTES``. The chunks are
dealt to tasks of about ``TASK_BYTES``, so many small archives share a task, a large one spreads over
many, and neither the other entries (pictures, say) nor, with ``tables``, other tables are read.
Nothing limits the size of an archive.

An archive counts only if all that is to be read of it is readable. One chunk proves that while it
is read; the chunks of a larger archive are first read through, each by its own task, and only
archives without a fault are read again for their rows.
"""

from __future__ import annotations

import zipfile
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.sources import entries
from dossier.sources.raw import RAW_SCHEMA
from dossier.sources.stores import file_system, opened

#: Compressed bytes of CSV entries in a chunk and in a task.
CHUNK_BYTES = 32 << 20
TASK_BYTES = 64 << 20

LISTING = "path string, length long, modified timestamp"
CHUNKS = (
    "export_id string, path string, chunk int, chunks int, entries array<int>, bytes long, "
    "error string"
)
_CHUNKS = pa.schema(
    [
        ("export_id", pa.string()),
        ("path", pa.string()),
        ("chunk", pa.int32()),
        ("chunks", pa.int32()),
        ("entries", pa.list_(pa.int32())),
        ("bytes", pa.int64()),
        ("error", pa.string()),
    ]
)


def located(path: str, root: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of ``root`` and the path in it of a listed file, which begins with ``root``."""
    fs, base = file_system(root)
    return fs, base.rstrip("/") + path[len(root.rstrip("/")) :]


def _shown(name: str) -> bool:
    return not any(part.startswith(("_", ".")) for part in name.split("/"))


def listed_files(
    fs: arrow_fs.FileSystem, base: str, folder: str, root: str, deep: bool
) -> list[tuple]:
    """(path, length, modified) of the files in a folder; the paths begin with ``root``."""
    base = base.rstrip("/")
    found = fs.get_file_info(arrow_fs.FileSelector(folder, recursive=deep))
    return [
        (root.rstrip("/") + x.path[len(base) :], x.size, x.mtime)
        for x in found
        if x.type == arrow_fs.FileType.File and _shown(x.path[len(base) + 1 :])
    ]


def _list(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(root)
        for batch in batches:
            for folder, deep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files = listed_files(fs, base, folder, root, deep)
                for start in range(0, len(files), 10_000):
                    some = files[start : start + 10_000]
                    yield pa.record_batch(
                        [
                            pa.array([x[0] for x in some], pa.string()),
                            pa.array([x[1] for x in some], pa.int64()),
                            pa.array([x[2] for x in some], pa.timestamp("us", tz="UTC")),
                        ],
                        names=["path", "length", "modified"],
                    )

    return run


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root``, those without a byte too; hidden ones (``_``, ``.``) are left out.

    The driver names the folders directly below ``root``; each is listed by a task.
    """
    fs, base = file_system(root)
    first = fs.get_file_info(arrow_fs.FileSelector(base))
    folders = [(base, False)]
    folders += [(x.path, True) for x in first if x.type == arrow_fs.FileType.Directory]
    rows = spark.createDataFrame(folders, "folder string, deep boolean")
    return rows.repartition(min(len(folders), 1000), "folder").mapInArrow(_list(root), LISTING)


def _chunked(archive: zipfile.ZipFile, tables: Collection[str] | None, most: int) -> list[tuple]:
    """(entry numbers, compressed bytes) of the chunks of an archive."""
    chunks: list[tuple[list[int], int]] = [([], 0)]
    for i, info in enumerate(archive.infolist()):
        if not info.filename.endswith(".csv"):
            continue
        if tables is not None and entries.entry_key(info.filename) not in tables:
            continue
        numbers, size = chunks[-1]
        if numbers and size + info.compress_size > most:
            chunks.append(([i], info.compress_size))
        else:
            numbers.append(i)
            chunks[-1] = (numbers, size + info.compress_size)
    return chunks


def _directories(root: str, tables: Collection[str] | None, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for export_id, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with opened(*located(path, root)) as file, zipfile.ZipFile(file) as archive:
                        chunks = _chunked(archive, tables, most)
                except Exception as error:
                    rows.append((export_id, path, 0, 1, [], 0, entries.unreadable(error)))
                    continue
                for k, (numbers, size) in enumerate(chunks):
                    rows.append((export_id, path, k, len(chunks), numbers, size, None))
            yield pa.record_batch(
                [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_CHUNKS)],
                schema=_CHUNKS,
            )

    return run


def chunks(
    files: DataFrame,
    root: str,
    tables: Collection[str] | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """The chunks of archives (export_id, path), from their directories alone."""
    context = files.sparkSession.sparkContext
    dealt = files.select("export_id", "path").repartition(4 * context.defaultParallelism, "path")
    return dealt.mapInArrow(_directories(root, tables, chunk_bytes), CHUNKS)


def _opener(path: str, root: str):
    return lambda: zipfile.ZipFile(opened(*located(path, root)))


def _faults(root: str):
    """(path, chunk, error) of chunks that cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    with _opener(row["path"], root)() as archive:
                        for _ in entries.entry_batches(archive, row["export_id"], row["entries"]):
                            pass
                except Exception as error:
                    yield pa.record_batch(
                        [
                            pa.array([row["path"]], pa.string()),
                            pa.array([row["chunk"]], pa.int32()),
                            pa.array([entries.unreadable(error)], pa.string()),
                        ],
                        names=["path", "chunk", "fault"],
                    )

    return run


def _read(root: str):
    def parts(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                export_id, first = row["export_id"], row["chunk"] == 0
                if row["error"] is not None:
                    if first:
                        yield entries.marker(entries.REJECTED, export_id, row["error"])
                elif row["chunks"] == 1:
                    yield from entries.archive_batches(
                        export_id, _opener(row["path"], root), row["entries"]
                    )
                else:  # known to be readable
                    if first:
                        yield entries.marker(entries.ARCHIVE, export_id)
                    with _opener(row["path"], root)() as archive:
                        yield from entries.entry_batches(archive, export_id, row["entries"])

    return lambda batches: entries.shared_batches(parts(batches))


def rows_of_chunks(dealt: DataFrame, root: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Raw rows of chunks that have been stored, or a marker with the reason per bad archive."""
    total = dealt.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    tasks = max(dealt.sparkSession.sparkContext.defaultParallelism, -(-total // task_bytes))
    several = dealt.filter("chunks > 1")
    faults = (
        several.repartition(tasks, "path", "chunk")
        .mapInArrow(_faults(root), "path string, chunk int, fault string")
        .groupBy("path")
        .agg(F.min_by("fault", "chunk").alias("fault"))
    )
    checked = several.join(faults, "path", "left").withColumn("error", F.col("fault")).drop("fault")
    known = dealt.filter("chunks = 1").unionByName(checked)
    return known.repartition(tasks, "path", "chunk").mapInArrow(_read(root), RAW_SCHEMA)
