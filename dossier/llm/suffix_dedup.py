"""Removal of repeated substrings by a distributed merge sort of truncated suffixes.

Every byte that a string of ``LENGTH`` bytes covers which also starts somewhere else (in another
document or in the same one) is removed. Sorting all suffixes of a corpus would move each byte
``LENGTH`` times, so most are ruled out first, without loss:

* Equal texts are one class. A class of several documents is repeated throughout.
* Every window of ``LENGTH`` bytes has an anchor, the part of ``GRAM`` bytes with the least hash, so
  equal windows have equal anchors at the same place. Anchors are dealt to fragments of the hash
  order (see :mod:`dossier.llm.jaccard_join`); windows whose anchor is nowhere else are single.
* The windows of one anchor form a block. If a block occurs again whole, it is sorted as one string.
  Where the blocks of an anchor differ, their windows are looked at one by one, and those whose hash
  occurs again are sorted.

What is left is sorted: a task sorts its suffixes (cut to their window or block) into runs, equal
ones once with all their places, cuts the runs at common splitters, and sends them front-coded: the
length of the prefix shared with the string before, and the rest. A receiver merges the runs of its
range with a loser tree that carries shared lengths, so known prefixes are never compared again and
equal neighbours are known by their shared length alone. Only this sort decides; hashes rule out.

Null text is empty. Texts under ``LENGTH`` bytes keep all. Repeated rows are copies. An empty table
gives an empty result. Classes are told apart by 64 bits of a hash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import delete, discard, shared_folder, stored, text_batches, whole_text
from dossier.llm.exact_dedup import members_of
from dossier.llm.jaccard_join import _SETS, HASH_BITS, _by_class, _postings, _shared, _tokens_of

LENGTH = 200
GRAM = 150
#: Anchors or window hashes, and bytes of strings, that a task holds before it sends them.
HELD = 1_000_000
HELD_BYTES = 24_000_000
#: Anchors per fragment, and strings per range, for which the tasks of a stage are sized.
FRAGMENT_BYTES = 40_000_000
RANGE_STRINGS = 60_000
_SEGMENT = 1 << 16
_HEAD = 7
#: A number per byte, and the powers by which their places weigh in a hash.
_CODES = np.random.default_rng(0).integers(0, 2**64, 256, np.uint64)
_POWERS = np.cumprod(np.full(_SEGMENT + LENGTH, 0x9E3779B97F4A7C15, np.uint64))


def _sums(data: bytes) -> np.ndarray:
    """Running sums of the bytes' numbers, each weighed by its place (modulo 2^64)."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[np.frombuffer(data, np.uint8)] * _POWERS[: len(data)], out=sums[1:])
    return sums


def _hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the strings of ``size`` bytes at every place, weighed as if they ended alike."""
    found = sums[size:] - sums[:-size]
    found *= _POWERS[::-1][: len(found)]
    return found


def _anchors(grams: np.ndarray) -> np.ndarray:
    """For each window the place of its anchor: the least hash of its grams, the first of equals."""
    width = LENGTH - GRAM + 1
    low = np.uint64(_SEGMENT * 2 - 1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    rest = width - span
    if rest:
        key = np.minimum(key[:-rest], key[rest:])
    return (key & low).astype(np.int64)


def _segments(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Places and running sums of overlapping stretches that hold every window once."""
    for first in range(0, max(0, len(text) - LENGTH + 1), _SEGMENT):
        yield first, _sums(text[first : first + _SEGMENT + LENGTH - 1])


def _window_hashes(text: bytes) -> np.ndarray:
    """The hash of the window at every place."""
    parts = [_hashes(sums, LENGTH) for _, sums in _segments(text)]
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)) >> np.uint64(64 - HASH_BITS)


class Windows:
    """The windows of a text in blocks of equal anchors."""

    def __init__(self, text: bytes):
        starts, sizes, anchors = [], [], []
        for first, sums in _segments(text):
            grams = _hashes(sums, GRAM)
            at = _anchors(grams)
            cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            starts.append(cut + first)
            sizes.append(np.diff(np.r_[cut, len(at)]))
            anchors.append(grams[at[cut]])
        none = np.empty(0, np.int64)
        self.starts = np.concatenate(starts) if starts else none
        self.sizes = np.concatenate(sizes) if sizes else none
        self.tokens = (np.concatenate(anchors) if anchors else none.astype(np.uint64)) >> np.uint64(64 - HASH_BITS)


def _sent(rows: Iterator[tuple[int, np.ndarray]], fragments: int) -> Iterator[pa.RecordBatch]:
    """Postings of hashes per class: those repeated within the class, then those to be dealt."""
    sets: dict[bytes, np.ndarray] = {}
    held = 0
    for name, tokens in rows:
        distinct, counts = np.unique(tokens, return_counts=True)
        again = distinct[counts > 1]
        if len(again):
            yield from _by_class(np.full(len(again), name), again, kind=2)
        key = int(name).to_bytes(8, "little", signed=True)
        if key not in sets:
            sets[key] = distinct
            held += len(distinct)
        if held > HELD:
            yield from _postings(sets, fragments)
            sets, held = {}, 0
    yield from _postings(sets, fragments)


def _anchor_postings(fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            seen: set[int] = set()
            for batch, texts in text_batches(batches, rows=200):
                for name, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                    if len(text) >= LENGTH and name not in seen:
                        seen.add(name)
                        yield name, Windows(text).tokens

        yield from _sent(rows(), fragments)

    return run


def _shared_tokens(found: DataFrame, name: str) -> DataFrame:
    """Per class the hashes that occur elsewhere: class, tokens."""
    spark = found.sparkSession
    folder = f"{shared_folder(spark)}/{name}"
    found.write.partitionBy("kind").parquet(folder)
    sets = spark.read.schema(found.schema).parquet(folder)
    alone = sets.filter("kind = 1").select("fragment", "sig", "data", "refs")
    both = (
        sets.filter("kind = 2")
        .select("class", "data")
        .unionByName(alone.groupBy("fragment").applyInArrow(_shared, "class long, data binary"))
    )
    tokens = both.mapInArrow(_tokens_of, "class long, token long").distinct()
    table = stored(tokens.groupBy("class").agg(F.collect_list("token").alias("tokens")), name)
    delete(spark, folder)
    return table


def _lists(column: pa.Array) -> list[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with a shared anchor: anchor, block (hash of place and bytes), head, class, start, n."""
    for batch, texts in text_batches(batches, rows=100):
        columns: list[list] = [[], [], [], [], [], []]
        shared = _lists(batch.column(2))
        for name, text, tokens in zip(batch.column(0).to_pylist(), texts, shared, strict=True):
            w = Windows(text)
            some = np.flatnonzero(np.isin(w.tokens, tokens.astype(np.uint64)))
            for b in some.tolist():
                start, n = int(w.starts[b]), int(w.sizes[b])
                part = text[start : start + n + LENGTH - 1]
                code = hashlib.blake2b(part, digest_size=8).digest()
                for c, value in zip(
                    columns,
                    (int(w.tokens[b]), int.from_bytes(code, "little", signed=True),
                     int.from_bytes(part[:_HEAD], "big"), name, start, n),
                    strict=True,
                ):
                    c.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns],
            names=["anchor", "block", "head", "class", "start", "n"],
        )


def _window_postings(fragments: int):
    """Hashes of the windows of blocks to be looked at one by one (column 2: starts, 3: sizes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch, texts in text_batches(batches, rows=100):
                for name, text, starts, sizes in zip(
                    batch.column(0).to_pylist(), texts, _lists(batch.column(2)), _lists(batch.column(3)), strict=True
                ):
                    yield name, _window_hashes(text)[_places(starts, sizes)]

        yield from _sent(rows(), fragments)

    return run


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    parts = [np.arange(a, a + n) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


_RUNS = "range long, data binary"


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Of sorted strings: the lengths shared with the string before, of the rests, and the rests."""
    shared, before = [], b""
    rests = []
    for s in strings:
        k = _common(before, s, 0)
        shared.append(k)
        rests.append(s[k:])
        before = s
    return np.array(shared, np.uint16), np.array([len(r) for r in rests], np.uint16), b"".join(rests)


def _common(a: bytes, b: bytes, k: int) -> int:
    """The length of the common prefix, known to be ``k`` at least."""
    end = min(len(a), len(b))
    x, y = a[k:end], b[k:end]
    if x == y:
        return end
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return end - (differ.bit_length() + 7) // 8


def _encoded(strings: dict[bytes, list[tuple[int, int, int]]], names: list[bytes]) -> bytes:
    shared, rests, data = front_coded(names)
    places = [strings[s] for s in names]
    counts = np.array([len(p) for p in places], np.uint32)
    flat = np.array([x for p in places for x in p], np.int64).reshape(-1, 3)
    parts = [shared.tobytes(), rests.tobytes(), data, counts.tobytes(), np.ascontiguousarray(flat.T).tobytes()]
    sizes = np.array([len(p) for p in parts], "<u8").tobytes()
    return zstandard.compress(sizes + b"".join(parts), 3)


class Run:
    """A front-coded run, read string by string."""

    def __init__(self, data: bytes):
        raw = zstandard.decompress(data)
        ends = np.cumsum([40, *np.frombuffer(raw[:40], "<u8").tolist()]).tolist()
        a, b, self._data, c, d = (raw[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True))
        self._shared, self._rests = np.frombuffer(a, np.uint16).tolist(), np.frombuffer(b, np.uint16).tolist()
        self._places = np.frombuffer(d, np.int64).reshape(3, -1)
        self._at = np.cumsum(np.r_[0, np.frombuffer(c, np.uint32)]).tolist()
        self._i, self._from = 0, 0
        self.string, self.shared = b"", 0

    def advance(self) -> bool:
        if self._i == len(self._shared):
            self.string = None
            return False
        self.shared, n = self._shared[self._i], self._rests[self._i]
        self.string = self.string[: self.shared] + self._data[self._from : self._from + n]
        self._from += n
        self._i += 1
        return True

    def places(self) -> np.ndarray:
        return self._places[:, self._at[self._i - 1] : self._at[self._i]]


class LoserTree:
    """Merges front-coded runs; of every loser the length it shares with its winner is known."""

    def __init__(self, runs: list[Run]):
        self.runs = runs
        self._size = 1
        while self._size < len(runs):
            self._size *= 2
        self._known = [0] * self._size
        for r in runs:
            r.advance()
        self._losers = [-1] * self._size
        self._winner = self._play(1)

    def _play(self, node: int) -> int:
        if node >= self._size:
            return node - self._size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        winner, self._losers[node] = self._match(a, b)
        return winner

    def _string(self, r: int) -> bytes | None:
        return self.runs[r].string if r < len(self.runs) else None

    def _match(self, a: int, b: int) -> tuple[int, int]:
        x, y = self._string(a), self._string(b)
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        k, m = self._known[a], self._known[b]
        if k != m:
            # Both follow the last string sent out; the one sharing more with it comes first.
            return (a, b) if k > m else (b, a)
        k = _common(x, y, k)
        if k == len(x) or (k < len(y) and x[k] < y[k]):
            self._known[b] = k
            return a, b
        self._known[a] = k
        return b, a

    def __iter__(self) -> Iterator[tuple[bool, np.ndarray]]:
        """In order: whether the string equals the one before, and its places."""
        before = -1
        while (string := self._string(self._winner)) is not None:
            w = self._winner
            yield self._known[w] == len(string) == before, self.runs[w].places()
            before = len(string)
            self.runs[w].advance()
            self._known[w] = self.runs[w].shared
            node = (w + self._size) // 2
            while node:
                w, self._losers[node] = self._match(w, self._losers[node])
                node //= 2
            self._winner = w


def _runs(splitters: list[int]):
    """Sorts the strings of whole blocks (columns 2, 3) and of the windows of others (4, 5) whose
    hash occurs again (6), and sends them by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings: dict[bytes, list[tuple[int, int, int]]] = {}
        held = 0
        heads = np.array(splitters, np.int64)

        def sent() -> Iterator[pa.RecordBatch]:
            names = sorted(strings)
            ranges = np.searchsorted(heads, [int.from_bytes(s[:_HEAD], "big") for s in names], side="right")
            cuts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]) if names else []
            for a, b in zip(cuts, [*cuts[1:], len(names)], strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(ranges[a])], pa.int64()), pa.array([_encoded(strings, names[a:b])], pa.binary())],
                    names=["range", "data"],
                )
            strings.clear()

        for batch, texts in text_batches(batches, rows=100):
            columns = [_lists(batch.column(c)) for c in range(2, 7)]
            for name, text, starts, sizes, starts_1, sizes_1, tokens in zip(
                batch.column(0).to_pylist(), texts, *columns, strict=True
            ):
                for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
                    s = text[a : a + n + LENGTH - 1]
                    strings.setdefault(s, []).append((name, a, n))
                    held += len(s)
                places = _places(starts_1, sizes_1)
                if len(places) and len(tokens):
                    again = np.isin(_window_hashes(text)[places], tokens.astype(np.uint64))
                    for a in places[again].tolist():
                        strings.setdefault(text[a : a + LENGTH], []).append((name, a, 1))
                        held += LENGTH
                if held > HELD_BYTES:
                    yield from sent()
                    held = 0
        yield from sent()

    return run


def _merged(table: pa.Table) -> pa.Table:
    """One range: the places of strings that occur more than once."""
    found: list[np.ndarray] = []
    group: list[np.ndarray] = []

    def close() -> None:
        places = np.concatenate(group, axis=1) if len(group) > 1 else group[0] if group else None
        if places is not None and places.shape[1] > 1:
            found.append(places)

    for equal, places in LoserTree([Run(d) for d in table["data"].to_pylist()]):
        if not equal:
            close()
            group = []
        group.append(places)
    close()
    flat = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
    return pa.table({"class": flat[0], "start": flat[1], "n": flat[2]})


def repeated_windows(classes: DataFrame, n_bytes: int) -> DataFrame:
    """Stretches of windows that occur again: class, start, n. ``classes``: class, text (copies of
    a class may come in any number); ``n_bytes``: of all texts, to size the tasks.
    """
    fragments = max(16, n_bytes // FRAGMENT_BYTES)
    found = classes.mapInArrow(_anchor_postings(fragments), _SETS)
    shared = _shared_tokens(found, "anchors")
    texts = stored(
        members_of(classes, shared.select("class"), "class")
        .join(shared, "class")
        .dropDuplicates(["class"])
        .select("class", "text", "tokens"),
        "texts",
    )
    blocks = stored(
        texts.mapInArrow(_blocks, "anchor long, block long, head long, class long, start long, n long"),
        "blocks",
    )
    same = blocks.groupBy("anchor", "block", "n").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("class", "start")).alias("first")
    )
    kinds = stored(same, "kinds")
    mixed = kinds.groupBy("anchor").agg((F.count(F.lit(1)) > 1).alias("mixed"))
    judged = kinds.join(mixed, "anchor").filter("mixed OR copies > 1")
    told = blocks.join(judged, ["anchor", "block", "n"])
    single = F.col("mixed") & (
        (F.col("copies") == 1) | (F.struct("class", "start") == F.col("first"))
    )

    def listed(rows, name: str) -> DataFrame:
        return rows.groupBy("class").agg(
            F.collect_list("start").alias(f"starts{name}"), F.collect_list("n").alias(f"sizes{name}")
        )

    actions = stored(told.select("class", "start", "n", "head", (F.col("copies") > 1).alias("whole"), single.alias("single")), "actions")
    apart = stored(listed(actions.filter("single"), "_1"), "apart")
    text = texts.select("class", "text")
    hashes = _shared_tokens(
        text.join(apart, "class").select("class", "text", "starts_1", "sizes_1").mapInArrow(
            _window_postings(fragments), _SETS
        ),
        "windows",
    )
    none = F.array().cast("array<long>")
    work = text.join(
        listed(actions.filter("whole"), "").join(apart, "class", "full"), "class"
    ).join(hashes, "class", "left")
    size = actions.agg(F.count(F.lit(1)).alias("rows")).first()["rows"]
    ranges = max(1, math.ceil(size / RANGE_STRINGS))
    cuts = [k / ranges for k in range(1, ranges)]
    heads = actions.agg(F.percentile_approx("head", cuts, 10_000).alias("h")).first()["h"] if cuts else []
    runs = work.select(
        "class", "text", *[F.coalesce(c, none).alias(c) for c in ("starts", "sizes", "starts_1", "sizes_1", "tokens")]
    ).mapInArrow(_runs(sorted(set(heads or []))), _RUNS)
    result = stored(
        runs.groupBy("range").applyInArrow(_merged, "class long, start long, n long"), "repeated"
    )
    discard(shared, texts, blocks, kinds, actions, apart, hashes)
    return result


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row: number of removed bytes and runs, and the hash of the bytes kept."""
    for batch, texts in text_batches(batches, rows=200):
        rows = []
        for text, starts, sizes in zip(texts, _lists(batch.column(2)), _lists(batch.column(3)), strict=True):
            change = np.zeros(len(text) + 1, np.int64)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + sizes + LENGTH - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            spans = int((gone & ~np.r_[False, gone[:-1]]).sum())
            rows.append((int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t) for t in texts], pa.int64())]
            + [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def without_repeats(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", with_kept: bool = False
) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``;
    ``with_kept`` adds the remaining bytes.
    """
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"), whole_text(text).alias("text")
    ).withColumn("class", F.xxhash64("text"))
    sizes = rows.select("class", F.octet_length("text").cast("long").alias("n_bytes"))
    counted = stored(
        sizes.groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.max("n_bytes").alias("n_bytes")),
        "classes",
    )
    total = counted.agg(F.sum("n_bytes")).first()[0] or 0
    found = repeated_windows(rows.select("class", "text"), total)
    copied = counted.filter((F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)).select("class")
    part = stored(
        found.join(copied, "class", "left_anti")
        .groupBy("class")
        .agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("sizes"))
        .withColumn("copied", F.lit(False))
        .unionByName(
            copied.select(
                "class", F.array().cast("array<long>").alias("starts"),
                F.array().cast("array<long>").alias("sizes"), F.lit(True).alias("copied"),
            )
        ),
        "removals",
    )
    discard(found)
    touched, rest = members_of(rows, part.select("class"), "class", apart=True)
    met = touched.join(part, "class", "left")
    zero = F.lit(0).cast("long")
    size = F.octet_length("text").cast("long")
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    alone = rest.unionByName(met.filter("copied IS NULL").select(*rest.columns)).select(
        "id", size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), F.encode("text", "utf-8").alias("kept"),
    )
    whole = met.filter("copied").select(
        "id", size.alias("n_bytes"), size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
        F.sha2(F.lit(""), 256).alias("kept_sha256"), F.lit(b"").alias("kept"),
    )
    cut = met.filter("NOT copied").select("id", "text", "starts", "sizes").mapInArrow(
        _cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    result = alone.select(names).unionByName(whole.select(names)).unionByName(cut.select(names))
    return result.select(F.col("id").alias(id_column), *names[1 : 6 if with_kept else 5])
