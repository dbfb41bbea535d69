"""How far the sources of a language depart from each other and from the language, term by term.

Terms are runs of ASCII letters (lower-cased) and of characters beyond ASCII. A language keeps the
terms of at least ``least`` of its documents. A group (language, source), and each language, gives a
kept term with ``n`` occurrences the smoothed share ``p = 1 + floor(10^9 (n + 2) / (N + 2 V))``; the
distance of two shares is ``floor((p - q)^2 / (p + q))``. All of it is whole numbers, computed
exactly.

Terms are counted in the tasks that read the texts and merged by key, so nothing is shuffled per
occurrence. Distances of sources are summed over blocks of terms, each a dense table of sources by
terms; a block sends one sum per pair of sources. The terms that set a group apart are found by a
dominance skyband: a term that ``k`` others of its group beat in every respect (as many occurrences
or more in the group, as few or fewer in the language, earlier in UTF-8) cannot rank among the first
``k``, so every partition keeps only those beaten by fewer, the skybands are merged in the same way,
and what is left is ranked exactly.

Null texts, languages and sources count as empty; an empty language or source is one like others.
Groups without terms have their pairs, with the distance of the bare shares. Repeated rows are
documents of their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import stored, whole_text

LEAST = 10
TOP = 10

#: Cells (sources by terms) of a block, bytes of texts counted at a time, and bytes from which a text
#: is counted piece by piece (each up to the end of a term).
CELLS = 1 << 18
_CHUNK = 24 << 20
_LONG = 4 << 20

#: Bytes of terms, lower-cased; all others become blanks.
_AS_TERM = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_TERM_BYTES = np.frombuffer(_AS_TERM, np.uint8)


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece."""
    start = 0
    while start < len(text):
        end = start + _LONG
        piece = text[start:end].translate(_AS_TERM)
        while end < len(text) and piece[-1] != 32:  # up to the end of a term, however long
            more = text[end : end + _LONG].translate(_AS_TERM)
            blank = more.find(b" ")
            cut = len(more) if blank < 0 else blank + 1
            piece, end = piece + more[:cut], end + cut
        yield piece.split()
        start = end


_COUNTED = pa.schema(
    [
        ("lang", pa.string()),
        ("term", pa.string()),
        ("n", pa.int64()),
        ("docs", pa.int64()),
        ("sources", pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))),
    ]
)
_COUNTED_DDL = (
    "lang string, term string, n long, docs long, sources array<struct<source: string, n: bigint>>"
)


def _count_one(lang: str, source: str, text: bytes) -> pa.RecordBatch:
    """The row of every term of one very long text."""
    found: Counter = Counter()
    for terms in _terms(text):
        found.update(terms)
    counts = pa.array(found.values(), pa.int64())
    size = len(counts)
    entries = pa.StructArray.from_arrays([pa.array([source] * size, pa.string()), counts],
                                         fields=list(_COUNTED.field("sources").type.value_type))
    return pa.record_batch(
        [
            pa.array([lang] * size, pa.string()),
            pa.array(found.keys(), pa.binary()).cast(pa.string()),
            counts,
            pa.array([1] * size, pa.int64()),
            pa.ListArray.from_arrays(pa.array(range(size + 1), pa.int32()), entries),
        ],
        schema=_COUNTED,
    )


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else keys


def _count_chunk(langs: pa.Array, sources: pa.Array, texts: list[bytes]) -> pa.RecordBatch | None:
    """One row per language and term of some documents, with the occurrences per source."""
    data = _TERM_BYTES[np.frombuffer(b"\n".join(texts), np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])  # a line feed parts two documents
    inside = data != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, stops = edges[::2], edges[1::2]
    if not len(starts):
        return None
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
    doc = np.searchsorted(ends, starts, side="right")
    terms = pa.StringArray.from_buffers(
        len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside])
    ).dictionary_encode()
    del data, inside, edges, stops
    width = len(terms.dictionary)
    # occurrences per document, then per (language, term, source)
    pairs = np.sort(doc * width + terms.indices.to_numpy())
    first = _runs(pairs)
    times = np.diff(first, append=len(pairs))
    pairs = pairs[first]
    langs, sources = langs.dictionary_encode(), sources.dictionary_encode()
    lang_of, source_of = langs.indices.to_numpy(), sources.indices.to_numpy()
    kinds, doc = len(sources.dictionary), pairs // width
    keys = (lang_of[doc] * width + pairs % width) * kinds + source_of[doc]
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = _runs(keys)
    n, docs, keys = np.add.reduceat(times, first), np.diff(first, append=len(times)), keys[first]
    lists = _runs(keys // kinds)
    of = keys[lists] // kinds
    entries = pa.StructArray.from_arrays(
        [sources.dictionary.take(pa.array(keys % kinds)), pa.array(n, pa.int64())],
        fields=list(_COUNTED.field("sources").type.value_type),
    )
    return pa.record_batch(
        [
            langs.dictionary.take(pa.array(of // width)),
            terms.dictionary.take(pa.array(of % width)),
            pa.array(np.add.reduceat(n, lists), pa.int64()),
            pa.array(np.add.reduceat(docs, lists), pa.int64()),
            pa.ListArray.from_arrays(pa.array([*lists, len(keys)], pa.int32()), entries),
        ],
        schema=_COUNTED,
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents per language and term, of as many documents as fit a chunk."""
    langs: list[str] = []
    sources: list[str] = []
    texts: list[bytes] = []
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        nonlocal size
        counted = _count_chunk(pa.array(langs, pa.string()), pa.array(sources, pa.string()), texts)
        langs.clear(), sources.clear(), texts.clear()
        size = 0
        for start in range(0, counted.num_rows if counted else 0, 50_000):
            yield counted.slice(start, 50_000)

    for batch in batches:
        column = batch.column(2).cast(pa.binary())
        for i, (lang, source) in enumerate(
            zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        ):
            text = column[i].as_py()
            if len(text) > _LONG:
                yield _count_one(lang, source, text)
                continue
            langs.append(lang)
            sources.append(source)
            texts.append(text)
            size += len(text)
            if size >= _CHUNK:
                yield from sent()
    if texts:
        yield from sent()


def term_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Occurrences (``n``) of the kept terms per (lang, source), and in the language (``in_lang``).

    Until a term is known to be kept, its sources stay in one list per task.
    """
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        whole_text().alias("text"),
    )
    term = Window.partitionBy("lang", "term")
    return (
        texts.mapInArrow(_count, _COUNTED_DDL)
        .withColumn("in_lang", F.sum("n").over(term))
        .withColumn("docs", F.sum("docs").over(term))
        .filter(F.col("docs") >= least)
        .select("lang", "term", "in_lang", F.inline("sources"))
        .groupBy("lang", "source", "term", "in_lang")
        .agg(F.sum("n").alias("n"))
    )


def _share(n: str, total: str, terms: str) -> Column:
    """The smoothed share, exact beyond 64 bits."""
    return F.expr(
        f"1 + (cast(1000000000 as decimal(10,0)) * cast({n} + 2 as decimal(19,0)))"
        f" div cast({total} + 2 * {terms} as decimal(20,0))"
    )


def _distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _groups(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Per (lang, source) its ``total``, the language's total and number of terms, and ``bare``,
    the share of a kept term it does not have."""
    occurring = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
    ).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = (
        counts.groupBy("lang", "term")
        .agg(F.max("in_lang").alias("in_lang"))
        .groupBy("lang")
        .agg(F.count(F.lit(1)).alias("terms"), F.sum("in_lang").alias("lang_total"))
    )
    zero = {"total": 0, "terms": 0, "lang_total": 0}
    joined = occurring.join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
    bare = F.when(F.col("terms") > 0, _share("0L", "total", "terms")).otherwise(F.lit(1))
    return joined.fillna(zero).withColumn("bare", bare.cast("long"))


_SUMS = "lang string, source string, other string, value long"


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distances of every two sources, summed over the terms of one block.

    Rows without a term name the sources and their bare shares; they come for every block.
    """
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    lang = table.column("lang")[0].as_py()
    bare = table.filter(pa.compute.is_null(table.column("term")))
    found = table.filter(pa.compute.is_valid(table.column("term")))
    names = sorted(bare.column("source").to_pylist())
    at = {s: i for i, s in enumerate(names)}
    first = dict(zip(bare.column("source").to_pylist(), bare.column("p").to_pylist(), strict=True))
    codes = found.column("term").combine_chunks().dictionary_encode()
    width = len(codes.dictionary)
    shares = np.empty((len(names), width), np.int64)
    shares[:] = np.array([first[s] for s in names], np.int64)[:, None]
    rows = np.array([at[s] for s in found.column("source").to_pylist()], np.int64)
    shares[rows, codes.indices.to_numpy()] = found.column("p").to_numpy()
    for i in range(len(names) - 1):
        gap = shares[i + 1 :] - shares[i]
        sums = (gap * gap // (shares[i + 1 :] + shares[i])).sum(axis=1)
        n = len(sums)
        yield pa.record_batch(
            [
                pa.array([lang] * n, pa.string()),
                pa.array([names[i]] * n, pa.string()),
                pa.array(names[i + 1 :], pa.string()),
                pa.array(sums, pa.int64()),
            ],
            names=["lang", "source", "other", "value"],
        )


def _apart(_: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _block(batches)


def source_pairs(groups: DataFrame, shares: DataFrame, cells: int = CELLS) -> DataFrame:
    """Per group, every other source of its language (``item``) and their distance (``value``).

    ``shares``: lang, source, term, p for the terms a group has. A block holds about ``cells``
    shares; its sums, one per pair of sources, are added up by pair.
    """
    blocks = groups.groupBy("lang").agg(
        F.greatest(
            F.lit(1).cast("long"), F.ceil(F.max("terms") * F.count(F.lit(1)) / cells)
        ).alias("blocks")
    )
    named = (
        groups.join(blocks, "lang")
        .withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("lang", "block", "source", F.lit(None).cast("string").alias("term"),
                F.col("bare").alias("p"))
    )
    dealt = shares.join(blocks, "lang").select(
        "lang", F.expr("pmod(xxhash64(term), blocks)").alias("block"), "source", "term", "p"
    )
    sums = (
        named.unionByName(dealt)
        .groupBy("lang", "block")
        .applyInArrow(_apart, _SUMS)
        .groupBy("lang", "source", "other")
        .agg(F.sum("value").alias("value"))
    )
    ends = F.array(F.struct("source", F.col("other").alias("item")),
                   F.struct(F.col("other").alias("source"), F.col("source").alias("item")))
    return sums.select("lang", F.explode(ends).alias("e"), "value").select(
        "lang", "e.source", "e.item", "value"
    )


class Skyband:
    """The terms seen so far that fewer than ``k`` others dominate, from rows in the order
    (occurrences in the group descending, in the language ascending, term)."""

    def __init__(self, k: int):
        self.k, self.terms, self.langs = k, [], np.empty(64, np.int64)

    def keeps(self, term: str, in_lang: int) -> bool:
        """Takes the next row in, unless ``k`` rows before it dominate it.

        Those that come earlier have as many occurrences or more. If ``k`` rows dominate a term,
        ``k`` of the band do, so the rows left out need no looking at.
        """
        here, n = bisect_left(self.terms, term), len(self.terms)
        if here >= self.k and int(np.count_nonzero(self.langs[:here] <= in_lang)) >= self.k:
            return False
        if n == len(self.langs):
            self.langs = np.concatenate([self.langs, np.empty(n, np.int64)])
        self.langs[here + 1 : n + 1] = self.langs[here:n]
        self.langs[here] = in_lang
        self.terms.insert(here, term)
        return True


def _skybands(k: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, band = None, Skyband(k)
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "term", "in_lang")),
                       strict=True)
            kept = []
            for lang, source, term, in_lang in rows:
                if group != (lang, source):
                    group, band = (lang, source), Skyband(k)
                kept.append(band.keeps(term, in_lang))
            yield batch.filter(pa.array(kept, pa.bool_()))

    return keep


def skyband(rows: DataFrame, k: int = TOP) -> DataFrame:
    """The rows (lang, source, term, n, in_lang, ...) that fewer than ``k`` of their group dominate:
    a skyband of every partition, then of what a group's partitions have kept."""
    order = ["lang", "source", F.desc("n"), "in_lang", "term"]
    keep = _skybands(k)
    local = rows.sortWithinPartitions(*order).mapInArrow(keep, rows.schema)
    merged = local.repartition("lang", "source").sortWithinPartitions(*order)
    return merged.mapInArrow(keep, rows.schema)


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Per group (lang, source) and part, the ranked items.

    Part ``pair``: the other sources of the language, all of them. Part ``term``: the ``top`` terms
    whose share in the group most exceeds that in the language. Columns: lang, source, part, item,
    value (the distance), rank (from 1, value descending, item ascending in UTF-8).
    """
    counts = stored(term_counts(docs, least), "term_counts")
    groups = stored(_groups(docs, counts), "groups")
    shares = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "n", "in_lang",
        _share("n", "total", "terms").alias("p"),
        _share("in_lang", "lang_total", "terms").alias("q"),
    )
    pairs = source_pairs(groups, shares.select("lang", "source", "term", "p"))
    above = skyband(shares.filter("p > q"), top)
    terms = above.select("lang", "source", F.col("term").alias("item"), _distance("p", "q").alias("value"))
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [
        part.select(
            "lang", "source", F.lit(name).alias("part"), "item", "value",
            F.row_number().over(ranks).alias("rank"),
        )
        for name, part in (("pair", pairs), ("term", terms))
    ]
    return ranked[0].unionByName(ranked[1].filter(F.col("rank") <= top))
