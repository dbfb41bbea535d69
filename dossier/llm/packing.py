"""Best-fit packing of documents into token sequences by the sum-of-squares rule.

A document is its token ids and an end id. A longer one than a sequence is cut into pieces of the
sequence length, the first of which may be shorter. A piece goes where, after it, the squared
counts of open sequences per remaining gap sum to the least (a new sequence included).

A task packs what it encodes, in chunks, longest pieces first, without a shuffle. The pieces of
the sequences that are left with a gap are then packed again, across all tasks and in chunks of the
same size, by the same rule in other orders. So a few sequences per chunk of the second round stay
badly filled, whatever the size of the input.

:func:`packed_in_mix` keeps the order of a mix of sources: sequences are packed within stretches of
the mix and numbered by their place in it, so that reading them in order of ``sequence_id`` meets
the sources at their target weights. Each stretch leaves a few badly filled sequences of its own.
The mix is that of columns the documents come with, or else made for them.

Null text is empty and has just the end id. Null and repeated ids are allowed: places are carried
with the rows, nothing is joined by id. An empty table gives no pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import mixing
from dossier.llm.common import named, released, stored, text_batches
from dossier.llm.encoding import Encoder

LENGTH = 2048
#: Items that one chunk packs at once.
CHUNK = 65_536
#: Slots of the mix that are packed as one stretch (each slot is a block of documents).
STRETCH = 64
#: Times the badly filled sequences of a chunk are packed again; four times as often at the end.
ROUNDS = 2
_PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, bin long, "
    "at long, fill long"
)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item (in the given order), and the filled size of every bin.

    Placing an item of size ``s`` in a gap ``g`` changes the sum of squares by
    ``2 * (count[g - s] - count[g]) + 2``, where count[0] and a new bin's own gap stay out.
    Among equal changes the smallest gap wins.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        left = count[s:] * -2
        left[1:] += 2 * count[1 : capacity - s + 1] + 2
        if s == capacity:
            left[0] = 1
        else:
            left[0] += 1
            left[:-1][count[s:-1] == 0] = np.iinfo(np.int64).max
            left[-1] = 2 * count[capacity - s] + 1
        gap = s + int(left.argmin())
        if gap == capacity:
            b = len(fill)
            fill.append(0)
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets, np.array(fill, np.int64)


def _pack(
    sizes: np.ndarray, capacity: int, rounds: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packs longest first, then repacks the items of the bins that have a gap, ``rounds`` times.

    A round places them in another order by the same rule and stays if it needs no more bins.
    """
    generator = np.random.default_rng(0)
    half = capacity // 2
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    bins[order], offsets[order], fill = sum_of_squares(sizes[order], capacity)
    for r in range(rounds):
        gap = fill < capacity
        items = np.flatnonzero(gap[bins])
        if len(items) < 2:
            break
        if r % 2:
            order = items[np.argsort(-sizes[items], kind="stable")]
        else:
            order = generator.permutation(items)
            order = np.concatenate([order[sizes[order] > half], order[sizes[order] <= half]])
        again, at, filled = sum_of_squares(sizes[order], capacity)
        if len(filled) <= gap.sum():
            number = np.cumsum(~gap) - 1
            full = int((~gap).sum())
            bins = number[bins]
            bins[order], offsets[order] = again + full, at
            fill = np.concatenate([fill[~gap], filled])
    return bins, offsets, fill


def _cut(ids: bytes, length: int) -> Iterator[tuple[int, int, bytes]]:
    """Number, start and ids of a document's pieces; all but the first are of full length."""
    n = len(ids) // 4
    pieces = math.ceil(n / length)
    start = 0
    for k in range(pieces):
        stop = n - (pieces - k - 1) * length
        yield k, start, ids[4 * start : 4 * stop]
        start = stop


def _packed_pieces(path: str, end_id: int, length: int, chunk: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        end = int(end_id).to_bytes(4, "little")
        first_bin = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal first_bin
            sizes = np.array([r[3] for r in rows], np.int64)
            bins, offsets, fill = _pack(sizes, length, ROUNDS)
            columns = [list(c) for c in zip(*rows, strict=True)]
            for start in range(0, len(rows), 4096):
                part = slice(start, start + 4096)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns[0][part], pa.int64()),
                        pa.array(columns[1][part], pa.int32()),
                        *(pa.array(c[part], pa.int64()) for c in columns[2:5]),
                        pa.array(columns[5][part], pa.binary()),
                        pa.array(bins[part] + first_bin),
                        pa.array(offsets[part]),
                        pa.array(fill[bins[part]]),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                    + ["bin", "at", "fill"],
                )
            first_bin += len(fill)
            rows.clear()

        held = 0
        for batch, texts in text_batches(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                for k, start, part in _cut(encoder.ids(text.decode()) + end, length):
                    kept = part if with_ids else None
                    rows.append((doc_id, k, start, len(part) // 4, zlib.crc32(part), kept))
                    held += len(part) if with_ids else 0
                    if len(rows) >= chunk or held > 2**26:
                        held = 0
                        yield from packed()
        if rows:
            yield from packed()

    return released(run)


def _second_round(length: int):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["bin", "at"], kind="stable").reset_index(drop=True)
        into, offsets, fill = _pack(pieces["length"].to_numpy(), length, 4 * ROUNDS)
        # A sequence takes the number of one of the bins whose pieces these are; there are no more
        # sequences than bins before.
        numbers = pieces["bin"].unique()
        if len(fill) > len(numbers):
            into, offsets = np.searchsorted(numbers, pieces["bin"]), pieces["at"].to_numpy()
        return pd.DataFrame(
            {
                "bin": pieces["bin"],
                "at": pieces["at"],
                "sequence_id": numbers[into],
                "offset": offsets,
            }
        )

    return run


def packed(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    length: int = LENGTH,
    id_column: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
    chunk: int = CHUNK,
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``,
    ``offset``; ``with_ids`` adds the ids (little-endian unsigned 32-bit) for :func:`sequences`.
    """
    narrow = docs.select(F.col(id_column).cast("long"), F.col(text).cast("string"))
    pieces = stored(
        narrow.mapInArrow(_packed_pieces(tokenizer, end_id, length, chunk, with_ids), _PIECES),
        "pieces",
    )
    loose = pieces.filter(F.col("fill") < length).select("bin", "at", "length")
    groups = max(1, math.ceil(loose.count() / chunk))
    moved = (
        loose.withColumn("group", F.pmod(F.xxhash64("bin"), F.lit(groups)))
        .groupBy("group")
        .applyInPandas(_second_round(length), "bin long, at long, sequence_id long, offset long")
    )
    columns = [
        F.col("doc_id").alias(id_column),
        "piece",
        "start",
        "length",
        "ids_crc32",
        *(["ids"] if with_ids else []),
    ]
    whole = pieces.filter(F.col("fill") == length).select(
        *columns, F.col("bin").alias("sequence_id"), F.col("at").alias("offset")
    )
    joined = pieces.filter(F.col("fill") < length).join(moved, ["bin", "at"])
    return whole.unionByName(joined.select(*columns, "sequence_id", "offset"))


_CUT = pa.list_(
    pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())])
)
_CUT_DDL = "pieces array<struct<piece: int, start: long, length: long, crc: long>>"


def _documents_cut(path: str, end_id: int, length: int, carried: dict[str, pa.DataType]):
    """Rows of id, text and what is carried: the texts become the places and checksums of their
    pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        end = int(end_id).to_bytes(4, "little")
        for batch, texts in text_batches(batches):
            cut = [
                [
                    {"piece": k, "start": start, "length": len(part) // 4, "crc": zlib.crc32(part)}
                    for k, start, part in _cut(encoder.ids(text.decode()) + end, length)
                ]
                for text in texts
            ]
            others = [batch.column(2 + i).cast(kind) for i, kind in enumerate(carried.values())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *others, pa.array(cut, _CUT)], names=["doc_id", *carried, "pieces"]
            )

    return released(run)


def _stretch(length: int):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("place", kind="stable").reset_index(drop=True)
        bins, offsets, _ = _pack(pieces["length"].to_numpy(), length, ROUNDS)
        # The piece that comes first in the mix names its sequence.
        pieces["sequence_id"] = pieces.groupby(bins)["place"].transform("min")
        pieces["offset"] = offsets
        return pieces.drop(columns="stretch")

    return run


def packed_in_mix(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    length: int = LENGTH,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
    stretch: int = STRETCH,
    block_rows: int = mixing.BLOCK_ROWS,
    places: tuple[str, str] | None = None,
    **mix,
) -> DataFrame:
    """As :func:`packed`, with sequences in the order of the mix of sources.

    ``places`` names the columns with the slot and the place of a mix made before, in blocks of at
    most ``block_rows``; nothing is mixed again then. Otherwise the places are those of
    :func:`mixing.mixed` with ``mix`` on the same rows; only ids, sources and the pieces' places are
    shuffled for them, not texts. ``sequence_id`` is made of the place of
    the first of its documents and grows with the mix. A piece of full length is a sequence by
    itself, so what one task packs is bounded by the documents of a stretch (one piece of each).
    """
    narrow = [named(id_column).cast("long").alias("doc_id"), named(text).cast("string").alias("text")]
    if places is None:
        carried, ddl = {"source": pa.string(), "tie": pa.int64()}, "source string, tie long"
        narrow += [named(source).cast("string").alias("source"), mixing.tie_of(docs).alias("tie")]
    else:
        carried, ddl = {"mix_slot": pa.int64(), "mix_place": pa.int64()}, "mix_slot long, mix_place long"
        narrow += [named(c).cast("long").alias(n) for c, n in zip(places, carried, strict=True)]
    cutting = _documents_cut(tokenizer, end_id, length, carried)
    cut = stored(docs.select(*narrow).mapInArrow(cutting, f"doc_id long, {ddl}, {_CUT_DDL}"), "cut")
    placed = cut
    if places is None:
        kept = ["doc_id", "pieces"]
        placed = mixing.mixed(cut, tie=F.col("tie"), block_rows=block_rows, keep=kept, **mix)
    # A place is the document's in the mix, then the piece's number, in 24 bits of 2,048 tokens each.
    pieces = placed.select(
        "doc_id",
        F.expr(f"mix_slot div {stretch}").alias("stretch"),
        (F.col("mix_slot") * block_rows + F.col("mix_place")).alias("document"),
        F.explode("pieces").alias("p"),
    ).select(
        "stretch",
        "doc_id",
        "p.piece",
        "p.start",
        "p.length",
        F.col("p.crc").alias("ids_crc32"),
        F.shiftleft("document", 24).bitwiseOR(F.col("p.piece").cast("long")).alias("place"),
    )
    pieces = stored(pieces, "places")
    whole = pieces.filter(F.col("length") == length).withColumns(
        {"sequence_id": F.col("place"), "offset": F.lit(0).cast("long")}
    )
    shorter = (
        pieces.filter(F.col("length") < length)
        .groupBy("stretch")
        .applyInPandas(
            _stretch(length),
            "doc_id long, piece int, start long, length long, ids_crc32 long, place long, "
            "sequence_id long, offset long",
        )
    )
    columns = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    both = whole.select("doc_id", *columns).unionByName(shorter.select("doc_id", *columns))
    return both.withColumnRenamed("doc_id", id_column)


def sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves, of pieces made ``with_ids``: sequence_id, n_tokens, ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return (
        pieces.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
        .select(
            "sequence_id",
            "n_tokens",
            F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"),
        )
    )
