"""Token ids in binary files: bit planes of fixed-size blocks, each compressed, with an index.

A shard file holds whole documents in ascending order of id. Its ids are cut into blocks of
``BLOCK`` ids. A block is transposed: plane ``k`` holds bit ``k`` of all its ids, so the planes of
high bits are runs of zeros. Every plane is compressed with zstandard by itself; a plane without a
set bit takes no bytes. Layout, all numbers little-endian:

* ``TOKPLAN1``
* the planes of block 0, those of block 1, ...
* index: per block the number of ids (uint32) and the sizes of its 32 planes (uint32 each)
* documents: ids (int64; a null id as the smallest number) and token counts (uint64), compressed
* footer: number of blocks, compressed size of the documents, number of documents (uint64 each),
  ``TOKPLAN1``

Files are written under another name and then renamed, so a repeated task leaves one whole file.
Null text is empty and has just the end id. An empty table gives no files. Rows with equal ids are
ordered by a hash of their text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.common import partitions, shared_folder, stored, text_batches
from dossier.llm.encoding import kept_encoder

MAGIC = b"TOKPLAN1"
BLOCK = 65_536
#: Ids after which a shard is closed (a document is never split).
SHARD_IDS = 2_000_000
_NO_ID = -(2**63)


def planes(ids: np.ndarray) -> list[bytes]:
    """The 32 bit planes of a block of ids, compressed; empty for a plane without a set bit."""
    packer = zstandard.ZstdCompressor(level=1)
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    used = int(np.bitwise_or.reduce(ids)) if len(ids) else 0
    rows = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return [packer.compress(rows[k].tobytes()) if used >> k & 1 else b"" for k in range(32)]


def from_planes(parts: list[bytes], n: int) -> np.ndarray:
    """The block's ids."""
    ids = np.zeros(n, np.uint32)
    for k, part in enumerate(parts):
        if part:
            row = np.frombuffer(zstandard.decompress(part), np.uint8)
            ids |= np.unpackbits(row, count=n, bitorder="little").astype(np.uint32) << np.uint32(k)
    return ids


class ShardWriter:
    """Collects documents and compresses each block as soon as it is full."""

    def __init__(self):
        self._parts: list[bytes] = [MAGIC]
        self._index: list[int] = []
        self._pending: list[np.ndarray] = []
        self._held = 0
        self.doc_ids: list[int] = []
        self.counts: list[int] = []
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        values = np.frombuffer(ids, "<u4")
        self.doc_ids.append(_NO_ID if doc_id is None else doc_id)
        self.counts.append(len(values))
        self.n_ids += len(values)
        self._pending.append(values)
        self._held += len(values)
        if self._held >= BLOCK:
            joined = np.concatenate(self._pending)
            whole = len(joined) // BLOCK * BLOCK
            for start in range(0, whole, BLOCK):
                self._block(joined[start : start + BLOCK])
            self._pending, self._held = [joined[whole:]], len(joined) - whole

    def _block(self, ids: np.ndarray) -> None:
        parts = planes(ids)
        self._parts += parts
        self._index += [len(ids), *map(len, parts)]

    def content(self) -> bytes:
        if self._held:
            self._block(np.concatenate(self._pending))
        documents = zstandard.compress(
            np.array(self.doc_ids, "<i8").tobytes() + np.array(self.counts, "<u8").tobytes(), 1
        )
        footer = np.array([len(self._index) // 33, len(documents), len(self.doc_ids)], "<u8")
        index = np.array(self._index, "<u4").tobytes()
        return b"".join([*self._parts, index, documents, footer.tobytes(), MAGIC])


def read_shard(content: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a shard file with their ids, block by block."""
    if content[:8] != MAGIC or content[-8:] != MAGIC:
        raise ValueError("not a token file")
    blocks, size, n_docs = map(int, np.frombuffer(content[-32:-8], "<u8"))
    documents = zstandard.decompress(content[-32 - size : -32])
    doc_ids = np.frombuffer(documents[: 8 * n_docs], "<i8")
    counts = np.frombuffer(documents[8 * n_docs :], "<u8").astype(np.int64)
    end = len(content) - 32 - size
    index = np.frombuffer(content[end - 132 * blocks : end], "<u4").reshape(blocks, 33)
    at, block, held, rest = 8, 0, [], 0
    for doc_id, count in zip(doc_ids.tolist(), counts.tolist(), strict=True):
        while rest < count:
            sizes = index[block, 1:].tolist()
            ends = np.cumsum([at, *sizes])
            parts = [content[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            held.append(from_planes(parts, int(index[block, 0])))
            rest += len(held[-1])
            at, block = int(ends[-1]), block + 1
        joined = held[0] if len(held) == 1 else np.concatenate(held) if held else np.empty(0, np.uint32)
        yield (None if doc_id == _NO_ID else doc_id), joined[:count]
        held, rest = [joined[count:]], rest - count


def _write(folder: str, name: str, content: bytes) -> None:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
    store.create_dir(path, recursive=True)
    attempt = TaskContext.get().taskAttemptId()
    with store.open_output_stream(f"{path}/_{name}.{attempt}") as out:
        out.write(content)
    store.move(f"{path}/_{name}.{attempt}", f"{path}/{name}")


def _shards(path: str, end_id: int, folder: str, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_encoder(path)
        end = int(end_id).to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        shard, number = ShardWriter(), 0

        def closed() -> pa.RecordBatch:
            name = f"part-{part:08d}-{number:06d}.tok"
            _write(folder, name, shard.content())
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([len(shard.counts)]), pa.array([shard.n_ids])],
                names=["shard", "n_docs", "n_ids"],
            )

        for batch, texts in text_batches(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                shard.add(doc_id, encoder.ids(text.decode()) + end)
                if shard.n_ids >= shard_ids:
                    yield closed()
                    shard, number = ShardWriter(), number + 1
        if shard.counts:
            yield closed()

    return run


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    end_id: int = 1,
    id_column: str = "doc_id",
    text: str = "text",
    shard_ids: int = SHARD_IDS,
) -> DataFrame:
    """Writes the shard files into ``folder`` (shared) and returns their list, itself a table:
    ``shard``, ``n_docs``, ``n_ids``. The names ascend with the ids of the documents.
    """
    narrow = docs.select(
        F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text")
    )
    n = partitions(docs.sparkSession)
    dealt = narrow.repartitionByRange(n, "id", F.xxhash64("text"))
    ordered = dealt.sortWithinPartitions("id", F.xxhash64("text"))
    return stored(
        ordered.mapInArrow(
            _shards(tokenizer, end_id, folder, shard_ids), "shard string, n_docs long, n_ids long"
        ),
        "shards",
    )


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            content, start, rows = batch.column(1)[k].as_py(), 0, []
            for doc_id, ids in read_shard(content):
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column(0)[k].as_py()] * len(rows), pa.string())]
                + [pa.array(list(c), pa.int64()) for c in columns],
                names=["shard", "id", "at", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """One row per document of the files: id, ``start``, ``n_tokens``, ``ids_crc32``."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "part-*.tok")
        .load(folder)
        .select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")
    )
    found = files.mapInArrow(
        _documents, "shard string, id long, at long, n_tokens long, ids_crc32 long"
    )
    return found.join(starts, "shard").select(
        F.col("id").alias("doc_id"), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes the documents into a new shared folder and reads the files back."""
    folder = f"{shared_folder(docs.sparkSession)}/tokens"
    shards = write_token_files(docs, tokenizer, folder, **options)
    if shards.isEmpty():
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, start long, n_tokens long, ids_crc32 long"
        )
    return read_token_files(docs.sparkSession, folder, shards)
