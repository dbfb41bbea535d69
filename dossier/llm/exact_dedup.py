"""Exact dedup: two-pass Bloom filtering; only rows whose hash may repeat are shuffled.

The first pass makes a Bloom filter per task with, for every bit, whether it was set once or more
often. The filters are merged slice by slice. The second pass looks every row up: a hash that
occurs again has all its bits set more than once, so a row with any other bit cannot have a copy
and goes straight through. The few others (copies, and false positives) meet by hash.

Null text counts as empty. Equal texts with a null id: ids come first, null last. An empty table
gives an empty result. Other columns play no part in ``copies`` and may have any name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import BLANK, as_row, from_row, named, stored, whole_text

#: A slice of the filter: three parts of 2^13 bits, one bit of each for a hash.
PART_BITS = 13
PARTS = 3
SLICE_BYTES = PARTS * 2**PART_BITS // 8
#: Rows per slice at which about one of a thousand single rows is taken for a copy.
SLICE_ROWS = 900
#: One round's filter is broadcast, so its size is bounded: 2^16 slices are 192 MB at most.
MAX_SLICES = 2**16


def _positions(hashes: np.ndarray) -> np.ndarray:
    """Bit positions inside a slice, one row for each part."""
    mask = np.int64(2**PART_BITS - 1)
    return np.stack([(hashes >> np.int64(PART_BITS * k)) & mask for k in range(PARTS)]) + (
        np.arange(PARTS, dtype=np.int64)[:, None] << PART_BITS
    )


def _task_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and slice: the bits set, and those set more than once."""
    slices: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        hashes = batch.column(1).to_numpy(zero_copy_only=False)
        numbers = batch.column(0).to_numpy(zero_copy_only=False)
        order = np.argsort(numbers, kind="stable")
        numbers, hashes = numbers[order], hashes[order]
        starts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]]) if len(numbers) else []
        for start, end in zip(starts, [*starts[1:], len(numbers)], strict=True):
            once, more = slices.setdefault(
                int(numbers[start]),
                (np.zeros(SLICE_BYTES * 8, bool), np.zeros(SLICE_BYTES * 8, bool)),
            )
            bits, counts = np.unique(_positions(hashes[start:end]), return_counts=True)
            more[bits] |= once[bits] | (counts > 1)
            once[bits] = True
        if len(slices) >= 2048:
            yield _filter_rows(slices)
            slices = {}
    yield _filter_rows(slices)


def _filter_rows(slices: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    def packed(bits: np.ndarray) -> bytes:
        return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)

    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(slices), pa.int64()),
            pa.array([packed(once) for once, _ in slices.values()], pa.binary()),
            pa.array([packed(more) for _, more in slices.values()], pa.binary()),
        ],
        names=["slice", "once", "more"],
    )


def _merged_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slice: folds each slice's rows into the bits set more than once."""
    return _merged(batches, lambda once, more: more)


def _merged_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for the bits set at all."""
    return _merged(batches, lambda once, more: once)


def _merged(batches: Iterator[pa.RecordBatch], kept) -> Iterator[pa.RecordBatch]:

    def bits(data: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(data), np.uint8)

    current, once, more = None, None, None
    done: list[tuple[int, bytes]] = []
    for batch in batches:
        for number, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if number != current:
                if current is not None and kept(once, more).any():
                    done.append((current, kept(once, more).tobytes()))
                current, once, more = number, bits(a).copy(), bits(b).copy()
            else:
                more |= bits(b) | (once & bits(a))
                once |= bits(a)
        yield _repeats(done)
        done = []
    if current is not None and kept(once, more).any():
        yield _repeats([(current, kept(once, more).tobytes())])


def _repeats(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([n for n, _ in rows], pa.int64()),
            pa.array([m for _, m in rows], pa.binary()),
        ],
        names=["slice", "repeats"],
    )


def repeat_filter(hashes: DataFrame, merge=_merged_filter) -> DataFrame:
    """The merged filter of ``hashes`` (slice, hash): slice, repeats."""
    tasks = hashes.mapInArrow(_task_filter, "slice long, once binary, more binary")
    merged = tasks.repartition("slice").sortWithinPartitions("slice")
    return stored(merged.mapInArrow(merge, "slice long, repeats binary"), "filter")


def _may_repeat(hash_name: str, bits: str) -> Column:
    """Whether all bits of the hash are set in the slice ``bits``; false where there is none."""
    tests = []
    for k in range(PARTS):
        at = f"(shiftright({hash_name}, {PART_BITS * k}) & {2**PART_BITS - 1}) + {k << PART_BITS}"
        byte = f"cast(conv(hex(substring({bits}, cast(({at}) div 8 as int) + 1, 1)), 16, 10) as int)"
        tests.append(f"(shiftright({byte}, cast(({at}) % 8 as int)) & 1) = 1")
    return F.coalesce(F.expr(" AND ".join(tests)), F.lit(False))


def text_hash(text: str = "text") -> Column:
    """SHA-256 of the text with each run of white space as one space, as lowercase hex."""
    return F.sha2(F.regexp_replace(whole_text(text), BLANK, " "), 256)


def _marked(rows: DataFrame, hashes: DataFrame, n: int, merge=_merged_filter) -> DataFrame:
    """``rows`` (with ``__hash``) and whether each may have a copy (``__again``).

    ``hashes`` is the narrow table the filter is made from. The hash space is cut into as many
    rounds as keep one round's filter within its bound; nearly always that is one.
    """
    slices = max(1, math.ceil(n / SLICE_ROWS))
    rounds = math.ceil(slices / MAX_SLICES)
    number = F.pmod(F.shiftright("__hash", PART_BITS * PARTS), F.lit(slices))
    parts = []
    for r in range(rounds):
        mine = number % rounds == r
        bits = repeat_filter(hashes.filter(mine).select(number.alias("slice"), "__hash"), merge)
        joined = rows.filter(mine).withColumn("__slice", number)
        found = joined.join(
            F.broadcast(bits.withColumnRenamed("slice", "__slice")), "__slice", "left"
        )
        parts.append(
            found.withColumn("__again", _may_repeat("__hash", "repeats")).drop("__slice", "repeats")
        )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _hashes(
    docs: DataFrame, id_column: str, text: str, rank: Column | None = None
) -> tuple[DataFrame, int]:
    narrow = docs.select(
        F.col(id_column).alias("id"),
        F.unhex(text_hash(text)).alias("sha"),
        *([] if rank is None else [rank.alias("rank")]),
    ).withColumn("__hash", F.xxhash64("sha"))
    table = stored(narrow, "hashes")
    return table, table.count()


def copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Rows that repeat an id and its text count towards ``group_size`` and share their decision.
    """
    table, n = _hashes(docs, id_column, text)
    marked = _marked(table, table, n)
    single = marked.filter(~F.col("__again")).select(
        "id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    )
    again = marked.filter("__again").select("id", "sha")
    groups = again.groupBy("sha").agg(
        F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    shared = again.join(groups, "sha").select("id", "sha", "keep_id", "group_size")
    return single.unionByName(shared).select(
        F.col("id").alias(id_column),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def first_of_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of equal texts the row with the smallest id.

    Texts that cannot have a copy are not shuffled. Among rows with equal text and id, one stays.
    """
    names = docs.columns

    def rank(of) -> Column:
        rest = F.xxhash64(F.to_json(F.struct(*[of(c).alias(c) for c in names if c != text])))
        return F.struct(of(id_column).isNull(), of(id_column), rest)

    table, n = _hashes(docs, id_column, text, rank(named))
    rows = docs.select(
        as_row(docs), F.unhex(text_hash(text)).alias("__sha")
    ).withColumn("__hash", F.xxhash64("__sha"))
    # The ranks are compared in the narrow table; a group's text is shuffled to find its first row.
    smallest = (
        _marked(table, table, n)
        .filter("__again")
        .groupBy(F.col("sha").alias("__sha"))
        .agg(F.min("rank").alias("__rank"))
    )
    marked = _marked(rows, table, n)
    again = marked.filter("__again").withColumn("__rank", rank(lambda c: F.col("row")[c]))
    kept = again.join(smallest, ["__sha", "__rank"], "left_semi").dropDuplicates(["__sha"])
    return from_row(marked.filter(~F.col("__again")).select("row").unionByName(kept.select("row")), names)


def members_of(rows: DataFrame, keys: DataFrame, key: str, apart: bool = False):
    """The rows whose ``key`` (a long) is in ``keys`` (written before), and perhaps a few others.

    Found by a filter, without a shuffle. ``apart`` also returns the other rows, as a second table.
    """
    known = keys.select(F.col(key).alias("__key")).filter("__key IS NOT NULL")
    known = known.withColumn("__hash", F.xxhash64("__key"))
    hashed = rows.select(as_row(rows), F.xxhash64(named(key).cast("long")).alias("__hash"))
    marked = _marked(hashed, known, known.count(), _merged_members)
    hit = from_row(marked.filter("__again"), rows.columns)
    return (hit, from_row(marked.filter(~F.col("__again")), rows.columns)) if apart else hit


def without(docs: DataFrame, gone: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not in ``gone`` (the id column, written before).

    Rows whose id is not in a filter of the ids that go are not shuffled; the others meet them.
    """
    hit, rest = members_of(docs, gone, id_column, apart=True)
    keys = gone.select(F.col(id_column).alias("__gone"))
    return rest.unionByName(hit.join(keys, F.col(id_column) == F.col("__gone"), "left_anti"))
