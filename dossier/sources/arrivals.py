"""Archives as Spark data sources, in batches and in streams.

``archive_files`` gives the files below a folder (path, length, modified), those without a byte too.
``archive_rows`` gives the raw rows of the archives among them; a filter on ``table_key`` reaches the
reader, which then fetches those tables only::

    spark.read.format("archive_rows").load(root).filter("table_key = 'skills'")
    spark.readStream.format("archive_rows").option("log", folder).load(root)

A stream takes a file up when its (path, modification time, length) is new, so one that is written
over is read again and one that arrives with an old date is not missed. What was taken up is kept in
``log``, one Parquet file per offset, written before Spark records the offset: a query that starts
again finds the same files under the same offset.
"""

from __future__ import annotations

import sys
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
)

from dossier.sources import entries
from dossier.sources.ranges import LISTING, TASK_BYTES, listed_files, located
from dossier.sources.raw import RAW_SCHEMA
from dossier.sources.stores import file_system, opened

FILES, ROWS = "archive_files", "archive_rows"

#: Most files of a task.
TASK_FILES = 10_000

_LISTED = pa.schema(
    [("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", tz="UTC"))]
)


@dataclass
class Share(InputPartition):
    """The files of one task: (path, length, modified in microseconds)."""

    files: list[tuple[str, int, int]]


def shares(files: list[tuple[str, int, int]], most: int = TASK_BYTES) -> list[Share]:
    """Files dealt to tasks, in order, each of about ``most`` bytes."""
    out: list[Share] = []
    size = most
    for file in files:
        if size + file[1] > most or len(out[-1].files) >= TASK_FILES:
            out.append(Share([]))
            size = 0
        out[-1].files.append(file)
        size += file[1]
    return out


def everything(root: str) -> list[tuple[str, int, int]]:
    fs, base = file_system(root)
    return sorted(
        (path, size, int(changed.timestamp() * 1_000_000) if changed else 0)
        for path, size, changed in listed_files(fs, base, base, root, deep=True)
    )


def export_name(path: str, root: str) -> str:
    """As :func:`dossier.sources.archives.export_id_of`."""
    return path[len(root.rstrip("/")) + 1 :].removesuffix(".zip")


def _file_batches(share: Share) -> Iterator[pa.RecordBatch]:
    columns = list(zip(*share.files, strict=True)) or [(), (), ()]
    yield pa.record_batch(
        [pa.array(c, pa.int64()).cast(f.type) if i == 2 else pa.array(c, f.type)
         for i, (c, f) in enumerate(zip(columns, _LISTED, strict=True))],
        schema=_LISTED,
    )


def _row_batches(share: Share, root: str, tables: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    """Rows of the archives of a task, or a marker with the reason."""

    def parts():
        for path, length, _ in share.files:
            if not path.lower().endswith(".zip"):
                continue
            export_id = export_name(path, root)
            if not length:
                yield entries.marker(entries.REJECTED, export_id, "empty file")
                continue

            def archive(path: str = path) -> zipfile.ZipFile:
                return zipfile.ZipFile(opened(*located(path, root)))

            chosen = None
            if tables is not None:
                try:
                    with archive() as found:
                        names = enumerate(found.namelist())
                        chosen = {i for i, n in names if entries.entry_key(n) in tables}
                except Exception as error:
                    yield entries.marker(entries.REJECTED, export_id, entries.unreadable(error))
                    continue
            yield from entries.archive_batches(export_id, archive, chosen)

    return entries.shared_batches(parts())


class _Reader(DataSourceReader):
    def __init__(self, root: str, rows: bool):
        self.root, self.rows, self.tables = root, rows, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Table keys limit what is fetched; Spark still applies every filter itself."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("table_key",):
                keys = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                if not keys & {entries.ARCHIVE, entries.REJECTED}:
                    self.tables = keys if self.tables is None else self.tables & keys
            yield f

    def partitions(self) -> list[Share]:
        return shares(everything(self.root)) or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        if self.rows:
            return _row_batches(partition, self.root, self.tables)
        return _file_batches(partition)


class Log:
    """What a stream has taken up, per offset."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        self.last, self.seen = 0, None

    def _path(self, number: int) -> tuple[arrow_fs.FileSystem, str]:
        fs, base = file_system(self.folder)
        return fs, f"{base}/{number:012d}.parquet"

    def files(self, number: int) -> list[tuple[str, int, int]]:
        fs, path = self._path(number)
        table = pq.read_table(path, filesystem=fs)
        columns = [table.column("path"), table.column("length"), table.column("modified").cast(pa.int64())]
        return list(zip(*(c.to_pylist() for c in columns), strict=True))

    def _load(self) -> None:
        fs, base = file_system(self.folder)
        fs.create_dir(base, recursive=True)
        names = [x.base_name for x in fs.get_file_info(arrow_fs.FileSelector(base))]
        numbers = sorted(int(n[:12]) for n in names if n.endswith(".parquet") and n[:12].isdigit())
        self.last = numbers[-1] if numbers else 0
        self.seen = {f for number in numbers for f in self.files(number)}

    def take_up(self, root: str) -> int:
        """Logs the files that are new; the last offset."""
        if self.seen is None:
            self._load()
        new = [f for f in everything(root) if f not in self.seen]
        if new:
            fs, path = self._path(self.last + 1)
            draft = f"{path}.{uuid.uuid4().hex}"
            pq.write_table(pa.Table.from_batches(list(_file_batches(Share(new)))), draft, filesystem=fs)
            fs.move(draft, path)
            self.last += 1
            self.seen.update(new)
        return self.last


class _StreamReader(DataSourceStreamReader):
    def __init__(self, root: str, rows: bool, log: str):
        self.root, self.rows, self.log = root, rows, Log(log)

    def initialOffset(self) -> dict:
        return {"log": 0}

    def latestOffset(self) -> dict:
        return {"log": self.log.take_up(self.root)}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        files = [f for k in range(start["log"] + 1, end["log"] + 1) for f in self.log.files(k)]
        return shares(files)

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        if self.rows:
            return _row_batches(partition, self.root, None)
        return _file_batches(partition)


class ArchiveFiles(DataSource):
    """Files below ``path``; a stream needs the option ``log``, a folder of its own."""

    rows = False

    @classmethod
    def name(cls) -> str:
        return FILES

    def schema(self):
        return LISTING

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"].rstrip("/"), self.rows)

    def streamReader(self, schema) -> _StreamReader:
        if "log" not in self.options:
            raise ValueError("a stream of archives needs the option 'log'")
        return _StreamReader(self.options["path"].rstrip("/"), self.rows, self.options["log"])


class ArchiveRows(ArchiveFiles):
    """Raw rows of the archives below ``path``."""

    rows = True

    @classmethod
    def name(cls) -> str:
        return ROWS

    def schema(self):
        return RAW_SCHEMA


def register(spark: SparkSession) -> None:
    """Makes both sources known to a session, and lets filters reach the reader."""
    spark.dataSource.register(ArchiveFiles)
    spark.dataSource.register(ArchiveRows)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
