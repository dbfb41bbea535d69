"""Reads one archive inside a task: ZIP entries to CSV rows to Arrow batches.

Everything streams: an entry is decompressed, decoded and split line by line, and rows leave in
batches, so memory does not follow the decompressed size.
"""

from __future__ import annotations

import csv
import io
import sys
import zipfile
from collections.abc import Callable, Collection, Iterator
from itertools import chain
from pathlib import PurePosixPath

import pyarrow as pa

ARCHIVE = "_archive"
REJECTED = "_rejected"

BATCH_ROWS = 8192
BATCH_CHARACTERS = 8 * 1024 * 1024
# Rows of an archive wait here until its last entry has been read without error.
PENDING_BYTES = 64 * 1024 * 1024

STRINGS = pa.list_(pa.string())
BATCH_SCHEMA = pa.schema(
    [
        ("table_key", pa.string()),
        ("export_id", pa.string()),
        ("entry_idx", pa.int32()),
        ("row_no", pa.int64()),
        ("header", STRINGS),
        ("cells", pa.map_(pa.string(), pa.string())),
        ("overflow", STRINGS),
        ("defect", pa.string()),
    ]
)


def entry_key(name: str) -> str:
    return PurePosixPath(name).stem.lower().replace(" ", "_")


def entry_lines(archive: zipfile.ZipFile, name: str) -> Iterator[str]:
    """Lines of an entry, strict UTF-8 without byte order mark, split at line feeds only."""
    with archive.open(name) as handle:
        yield from io.TextIOWrapper(handle, encoding="utf-8-sig", newline="\n")


def csv_lines(archive: zipfile.ZipFile, name: str) -> Iterator[str]:
    """Lines from the CSV header on, past a ``Notes`` preamble if one is there."""
    rest = entry_lines(archive, name)
    first = next(rest, "")
    if not first.strip().startswith("Notes"):
        return chain([first], rest)
    for line in chain([first], rest):
        text = line.strip()
        if "," in text and not text.startswith('"'):
            return chain([line], rest)
    return entry_lines(archive, name)


class _Rows:
    """Rows on their way into one Arrow batch."""

    def __init__(self):
        self.keys: list[str] = []
        self.exports: list[str] = []
        self.entries: list[int] = []
        self.numbers: list[int] = []
        self.offsets: list[int] = [0]
        self.names: list[str] = []
        self.values: list[str | None] = []
        self.overflow: list[list[str] | None] = []
        self.defects: list[str | None] = []
        self.characters = 0

    def add(self, export_id, key, entry_idx, row_no, header, values, overflow, defect):
        self.keys.append(key)
        self.exports.append(export_id)
        self.entries.append(entry_idx)
        self.numbers.append(row_no)
        self.names.extend(header)
        self.values.extend(values)
        self.offsets.append(len(self.values))
        self.overflow.append(overflow)
        self.defects.append(defect)

    def full(self) -> bool:
        return len(self.keys) >= BATCH_ROWS or self.characters >= BATCH_CHARACTERS

    def arrow(self) -> pa.RecordBatch:
        offsets = pa.array(self.offsets, pa.int32())
        names = pa.array(self.names, pa.string())
        arrays = [
            pa.array(self.keys, pa.string()),
            pa.array(self.exports, pa.string()),
            pa.array(self.entries, pa.int32()),
            pa.array(self.numbers, pa.int64()),
            pa.ListArray.from_arrays(offsets, names),
            pa.MapArray.from_arrays(offsets, names, pa.array(self.values, pa.string())),
            pa.array(self.overflow, STRINGS),
            pa.array(self.defects, pa.string()),
        ]
        return pa.RecordBatch.from_arrays(arrays, schema=BATCH_SCHEMA)

    def take(self, other: _Rows) -> None:
        """Append all rows of ``other``."""
        start = len(self.values)
        self.offsets.extend(start + o for o in other.offsets[1:])
        for name in ("keys", "exports", "entries", "numbers", "names", "values", "overflow", "defects"):
            getattr(self, name).extend(getattr(other, name))
        self.characters += other.characters


def entry_rows(archive: zipfile.ZipFile, name: str) -> Iterator[tuple]:
    """Rows of one CSV entry as (row_no, header, values, overflow, defect).

    The first record is the header; blank lines are skipped, short rows have null cells, cells
    beyond the header go to ``overflow``, a repeated column keeps its last value.
    """
    csv.field_size_limit(sys.maxsize)  # cells have any length
    reader = csv.reader(csv_lines(archive, name))
    columns = next(reader, None)
    if columns is None:
        return
    width = len(columns)
    header = list(dict.fromkeys(columns))
    repeated = len(header) < width
    row_no = 0
    for record in reader:
        if not record:
            continue
        overflow, defect = None, None
        if len(record) > width:
            defect = "extra cells" if width else "blank header"
            record, overflow = record[:width], record[width:]
        elif len(record) < width:
            defect = "short row"
            record = record + [None] * (width - len(record))
        if repeated:
            record = list(dict(zip(columns, record)).values())
        yield row_no, header, record, overflow, defect
        row_no += 1


Part = "pa.RecordBatch | _Rows"


def entry_batches(
    archive: zipfile.ZipFile, export_id: str, chosen: Collection[int] | None = None
) -> Iterator[Part]:
    """Rows of the CSV entries (those whose number is ``chosen``): full Arrow batches, then the rest
    as plain rows. Of entries with one table key the last one counts; the others are read all the
    same, because an unreadable one makes the archive unreadable."""
    rows = _Rows()
    tables = [(i, n) for i, n in enumerate(archive.namelist()) if n.endswith(".csv")]
    last = {entry_key(n): i for i, n in tables}
    for i, name in tables:
        if chosen is not None and i not in chosen:
            continue
        key = entry_key(name)
        for row_no, header, values, overflow, defect in entry_rows(archive, name):
            if last[key] != i:
                continue
            rows.add(export_id, key, i, row_no, header, values, overflow, defect)
            rows.characters += sum(len(v) for v in chain(header, values, overflow or ()) if v)
            if rows.full():
                yield rows.arrow()
                rows = _Rows()
    yield rows


def marker(key: str, export_id: str, defect: str | None = None) -> _Rows:
    rows = _Rows()
    rows.add(export_id, key, -1, -1, [], [], None, defect)
    return rows


def unreadable(error: Exception) -> str:
    return f"invalid or corrupted archive: {error}"


def archive_batches(
    export_id: str,
    open_archive: Callable[[], zipfile.ZipFile],
    chosen: Collection[int] | None = None,
) -> Iterator[Part]:
    """Every row of an archive, or one marker with the reason if any part of it is unreadable.

    Rows wait until the whole archive has proved readable. An archive too large to wait in memory
    is read a second time instead.
    """
    pending: list[pa.RecordBatch | _Rows] | None = []
    size = 0
    try:
        with open_archive() as archive:
            for batch in entry_batches(archive, export_id, chosen):
                if pending is not None:
                    pending.append(batch)
                    size += batch.nbytes if isinstance(batch, pa.RecordBatch) else 0
                    if size > PENDING_BYTES:
                        pending = None
    except Exception as error:
        yield marker(REJECTED, export_id, unreadable(error))
        return
    yield marker(ARCHIVE, export_id)
    if pending is not None:
        yield from pending
        return
    with open_archive() as archive:
        yield from entry_batches(archive, export_id, chosen)


def shared_batches(parts: Iterator[Part]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of the parts; small archives share one."""
    shared = _Rows()
    for part in parts:
        if isinstance(part, pa.RecordBatch):
            yield part
            continue
        shared.take(part)
        if shared.full():
            yield shared.arrow()
            shared = _Rows()
    if shared.keys:
        yield shared.arrow()


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``mapInArrow`` body over (export_id, content)."""

    def parts() -> Iterator[Part]:
        for batch in batches:
            for export_id, content in zip(batch.column("export_id"), batch.column("content")):
                held = content.as_buffer()
                yield from archive_batches(
                    export_id.as_py(), lambda held=held: zipfile.ZipFile(pa.BufferReader(held))
                )

    yield from shared_batches(parts())
    # The worker is reused; what this task leaves would stay beside those after it.
    pa.default_memory_pool().release_unused()
