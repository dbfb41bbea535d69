"""N-gram Jaccard join by vertical partitioning, and the groups of documents it links.

Equal sets are one class. The n-grams (hashed) are dealt to fragments of the hash order, where each
is found to be shared between classes or not; a task sends an n-gram once, whatever the number of
its documents that hold it. A class can only have a partner if the shared n-grams are ``percent``
of its set, so the few classes left go on with their shared n-grams alone.

Of these, the global order (rarest first) is cut into fragments at powers of four of the frequency.
Pairs come from the n-grams of each class's prefix; a pair's overlap is counted in each fragment
separately and the partial overlaps are summed. Within a bucket of one n-gram, pairs of classes
known to be in one group are not tried (see :func:`dossier.llm.linking.linked_groups`), so a
large group of near copies costs a few pairs per member.

Null or empty text, and text without a word: an empty set, linked with nothing. Equal texts are
linked. A null id is carried along, and never is a group's smallest id unless all are null. Rows
that repeat an id count as documents of their own. N-grams are told apart by 48 bits of a hash and
sets by 128, which makes a wrong count less likely than one in 10^9 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import as_row, delete, discard, from_row, named, release, released
from dossier.llm.common import shared_folder, stored, text_batches
from dossier.llm.exact_dedup import members_of, without
from dossier.llm.linking import linked_groups

WORDS = 4
PERCENT = 85
#: N-grams that a task holds before it sends them, and documents per fragment of the hash order.
HELD = 1_000_000
FRAGMENT_DOCS = 6144
HASH_BITS = 48
_SETS = "kind int, doc_id long, n long, sig binary, class long, fragment long, data binary, refs binary"
_MANY = np.uint32(0xFFFFFFFF)


class _Words(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingles(text: bytes, width: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams (of all words, where there are fewer)."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(width, len(words))
    value = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        value = _mix(value * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - k + 1 + i])
    return np.unique(value)


def _planes(values: np.ndarray) -> bytes:
    """Bytes of the differences of sorted values, alike bytes side by side, compressed."""
    steps = np.diff(values, prepend=np.zeros(1, values.dtype))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(len(steps), -1).T), 1)


def _from_planes(data: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(dtype).ravel(), dtype=dtype)


def _sets(width: int, fragments: int):
    """Per document its set's size and hash (kind 0); per task and fragment the distinct n-grams
    with the class of each, or a mark where several classes hold it (kind 1); and for a class its
    n-grams that another class of the same task holds (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        sets: dict[bytes, np.ndarray] = {}
        held = 0
        for batch, texts in text_batches(batches):
            ids, sizes, sigs = batch.column(0), [], []
            for text in texts:
                found = shingles(text, width, known)
                sizes.append(len(found))
                sig = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
                sigs.append(sig)
                if sig is not None and sig not in sets:
                    sets[sig] = found >> np.uint64(64 - HASH_BITS)
                    held += len(found)
            classes = [None if s is None else _class(s) for s in sigs]
            yield _rows(len(ids), kind=0, doc_id=ids, n=sizes, sig=sigs, **{"class": classes})
            if held > HELD:
                yield from _postings(sets, fragments)
                sets, held = {}, 0
        yield from _postings(sets, fragments)

    return released(run)


def _class(sig: bytes) -> int:
    return int.from_bytes(sig[:8], "little", signed=True)


_TYPES = {
    "kind": pa.int32(), "doc_id": pa.int64(), "n": pa.int64(), "sig": pa.binary(),
    "class": pa.int64(), "fragment": pa.int64(), "data": pa.binary(), "refs": pa.binary(),
}


def _rows(size: int, kind: int, **columns) -> pa.RecordBatch:
    arrays = {"kind": pa.array(np.full(size, kind, np.int32))}
    for name, kind_of in _TYPES.items():
        if name != "kind":
            given = columns.get(name)
            arrays[name] = (
                pa.nulls(size, kind_of) if given is None
                else given.cast(kind_of) if isinstance(given, pa.Array)
                else pa.array(given, kind_of)
            )
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


def _postings(sets: dict[bytes, np.ndarray], fragments: int) -> Iterator[pa.RecordBatch]:
    if not sets:
        return
    classes = np.array([_class(s) for s in sets], np.int64)
    sizes = np.array([len(x) for x in sets.values()])
    tokens = np.concatenate(list(sets.values()))
    owner = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    counts = np.diff(np.r_[starts, len(tokens)])
    shared = np.repeat(counts > 1, counts)
    yield from _by_class(classes[owner[shared]], tokens[shared], kind=2)
    distinct, refs = tokens[starts], np.where(counts > 1, _MANY, owner[starts])
    cuts = np.searchsorted(distinct, _starts(fragments))
    ends = np.r_[cuts[1:], len(distinct)]
    names = classes.tobytes()
    for first in range(0, fragments, 16):
        some = [f for f in range(first, min(first + 16, fragments)) if ends[f] > cuts[f]]
        yield _rows(
            len(some), kind=1, fragment=some, sig=[names] * len(some),
            data=[_planes(distinct[cuts[f] : ends[f]]) for f in some],
            refs=[_plain(refs[cuts[f] : ends[f]]) for f in some],
        )


def _starts(fragments: int) -> np.ndarray:
    return np.array([-(-(k << HASH_BITS) // fragments) for k in range(fragments)], np.uint64)


def _plain(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 4).T), 1)


def _by_class(classes: np.ndarray, tokens: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    """Rows of a class and its n-grams as bytes."""
    order = np.argsort(classes, kind="stable")
    classes, tokens = classes[order], np.ascontiguousarray(tokens[order])
    starts = np.flatnonzero(np.r_[True, classes[1:] != classes[:-1]]) if len(classes) else []
    ends = [*starts[1:], len(classes)]
    for first in range(0, len(starts), 4096):
        some = list(zip(starts[first : first + 4096], ends[first : first + 4096], strict=True))
        data = [tokens[a:b].tobytes() for a, b in some]
        yield _rows(len(some), kind=kind, data=data, **{"class": classes[starts[first : first + 4096]]})


#: A fragment is looked through in so many parts, which bounds the copies made at once.
_PARTS = 16


def _shared(table: pa.Table) -> pa.Table:
    """One fragment: the n-grams that several classes hold, for each class sent with it alone."""
    found = _shared_rows(table)
    release()
    return found


def _shared_rows(table: pa.Table) -> pa.Table:
    sent = []
    for names, data, refs in zip(*(table[c].to_pylist() for c in ("sig", "data", "refs")), strict=True):
        planes = np.frombuffer(zstandard.decompress(refs), np.uint8).reshape(4, -1)
        owner = np.ascontiguousarray(planes.T).view(np.uint32).ravel()
        sent.append((np.frombuffer(names, np.int64), _from_planes(data, np.uint64), owner))
    low, high = min(t[0] for _, t, _ in sent), max(t[-1] for _, t, _ in sent)
    step = (high - low) // np.uint64(_PARTS) + np.uint64(1)
    parts = []
    for k in range(_PARTS):
        ends = (low + step * np.uint64(k), low + step * np.uint64(k + 1))
        parts += _shared_part(sent, *ends)
    return pa.Table.from_batches(parts or [_rows(0, kind=2)]).select(["class", "data"])


def _shared_part(sent: list, low: np.uint64, high: np.uint64) -> list[pa.RecordBatch]:
    tokens, classes, many = [], [], []
    for names, found, owner in sent:
        a, b = np.searchsorted(found, [low, high])
        several = owner[a:b] == _MANY
        tokens.append(found[a:b])
        many.append(several)
        classes.append(names[np.where(several, 0, owner[a:b])])
    tokens, classes, many = np.concatenate(tokens), np.concatenate(classes), np.concatenate(many)
    if not len(tokens):
        return []
    order = np.lexsort((classes, tokens))
    tokens, classes, many = tokens[order], classes[order], many[order]
    starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    other = np.r_[False, (tokens[1:] == tokens[:-1]) & (classes[1:] != classes[:-1])]
    shared = np.add.reduceat(many | other, starts) > 0
    keep = np.repeat(shared, np.diff(np.r_[starts, len(tokens)])) & ~many
    tokens, classes = tokens[keep], classes[keep]
    if not len(tokens):
        return []
    # The same class may have been sent by several tasks; its n-gram counts once.
    first = np.r_[True, (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1])]
    return list(_by_class(classes[first], tokens[first], kind=2))


def _tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = batch.column(1).to_pylist()
        lengths = np.array([len(x) // 8 for x in data])
        values = np.frombuffer(b"".join(data), np.int64)
        names = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), lengths)
        for start in range(0, len(values), 100_000):
            part = slice(start, start + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[part]), pa.array(values[part])], names=["class", "token"]
            )


def _enough(overlap: Column, sizes: Column, percent: int) -> Column:
    """``100 * overlap >= percent * union`` without the union."""
    return overlap * (100 + percent) >= sizes * percent


def similarity_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    width: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (smallest id in its group)."""
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string"))
    fragments = max(16, narrow.count() // FRAGMENT_DOCS)
    found = narrow.mapInArrow(_sets(width, fragments), _SETS)
    folder = f"{shared_folder(docs.sparkSession)}/sets"
    found.write.partitionBy("kind").parquet(folder)
    sets = docs.sparkSession.read.schema(found.schema).parquet(folder)
    # The set rows outlive this call in a table of their own.
    sized = stored(sets.filter("kind = 0").select("doc_id", "n", "sig", "class"), "sized")
    classes = (
        sized.filter("n > 0")
        .groupBy("sig", "class", "n")
        .agg(F.min("doc_id").alias("least"))
        .select(F.col("class").alias("node"), "n", "least")
    )
    candidates = _candidates(sets, folder, classes, percent)
    linking, parts = _linking(candidates, percent)
    groups = linked_groups(**linking)
    least = groups.join(classes, "node", "right").select(
        "node", F.coalesce("group", "node").alias("group"), "least"
    )
    ids = least.groupBy("group").agg(F.min("least").alias("component_id"))
    named = stored(
        least.join(ids, "group").select(F.col("node").alias("class"), "component_id"), "named"
    )
    discard(candidates, linking["members"], parts, groups)
    full = sized.filter("n > 0").join(named, "class")
    empty = sized.filter("n = 0").withColumn("component_id", F.col("doc_id"))
    return full.select("doc_id", "n", "component_id").unionByName(
        empty.select("doc_id", "n", "component_id")
    ).select(F.col("doc_id").alias(id_column), F.col("n").alias("n_shingles"), "component_id")


def _candidates(sets: DataFrame, folder: str, classes: DataFrame, percent: int) -> DataFrame:
    """Classes that may have a partner: node, n, m (shared n-grams), tokens (rarest first)."""
    alone = sets.filter("kind = 1").select("fragment", "sig", "data", "refs")
    found = (
        sets.filter("kind = 2")
        .select("class", "data")
        .unionByName(alone.groupBy("fragment").applyInArrow(_shared, "class long, data binary"))
    )
    shared = stored(found.withColumn("k", F.length("data") / 8), "shared")
    delete(sets.sparkSession, folder)
    # A class in several tasks may be sent an n-gram more than once; this count is a bound.
    counted = shared.groupBy("class").agg(F.sum("k").cast("long").alias("m"))
    hopeful = (
        counted.join(classes, F.col("class") == F.col("node"))
        .filter(F.col("m") * 100 >= F.col("n") * percent)
        .select("class", "n")
    )
    hopeful = stored(hopeful, "hopeful")
    tokens = stored(
        shared.join(hopeful.select("class"), "class")
        .select("class", "data")
        .mapInArrow(released(_tokens_of), "class long, token long")
        .distinct(),
        "tokens",
    )
    discard(shared)
    frequency = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    candidates = stored(
        tokens.join(frequency, "token")
        .groupBy("class")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"))
        .join(hopeful, "class")
        .withColumn("m", F.size("tokens").cast("long"))
        .filter(F.col("m") * 100 >= F.col("n") * percent)
        .select(F.col("class").alias("node"), "n", "m", "tokens"),
        "candidates",
    )
    discard(tokens, hopeful)
    return candidates


def _linking(candidates: DataFrame, percent: int) -> tuple[dict, DataFrame]:
    # N-grams of no other class come first in the order, so they fill the first of the prefix.
    needed = F.expr(f"(n * {percent} + 99) div 100")
    prefix = F.slice("tokens", F.lit(1), (F.col("m") - needed + 1).cast("int"))
    members = stored(
        candidates.select("node", "n", "m", F.posexplode(prefix).alias("at", "t")).select(
            F.col("t.token").alias("bucket"), "node", "n", "m", "at"
        ),
        "members",
    )

    def fits(a: str, b: str) -> Column:
        """At a pair's first common n-gram, no more can follow than either has left."""
        left = F.least(
            F.col(f"{a}m") - F.col(f"{a}at"), F.col(f"{b}m") - F.col(f"{b}at")
        )
        return _enough(left, F.col(f"{a}n") + F.col(f"{b}n"), percent)

    parts = candidates.select(
        "node", "n", F.explode("tokens").alias("t")
    ).groupBy("node", "n", F.floor(F.log(4.0, F.col("t.df"))).alias("fragment")).agg(
        F.collect_list("t.token").alias("part")
    )
    parts = stored(parts, "parts")

    def verified(pairs: DataFrame) -> DataFrame:
        mine = parts.select(F.col("node").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("part").alias("x"))
        other = parts.select(F.col("node").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("part").alias("y"))
        partial = (
            pairs.join(mine, "a")
            .join(other, ["b", "fragment"])
            .select("a", "b", "n_a", "n_b", F.size(F.array_intersect("x", "y")).alias("overlap"))
        )
        summed = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))
        return summed.filter(_enough(F.col("overlap"), F.col("n_a") + F.col("n_b"), percent))

    rank = F.lit(1.0) - F.col("m") / F.col("n")
    return {"members": members, "rank": rank, "fits": fits, "verified": verified}, parts


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each group the row with the smallest id.

    A row is known by 64 bits of a hash of its id and text, so rows that repeat an id or have none
    are decided one by one: null ids come last, equal ids in order of the hash, and of rows equal in
    both one stays.
    """
    id_ = named(id_column).cast("long")
    key = F.xxhash64(id_.isNull(), id_, named(text).cast("string")).alias("__row")
    narrow = docs.select(key, id_.alias("id"), named(text).alias("text"))
    grouped = similarity_groups(narrow, "__row", "text", **options).filter("n_shingles > 0")
    counted = stored(
        grouped.groupBy("__row", "component_id").agg(F.count(F.lit(1)).alias("n")), "rows"
    )
    linked = counted.groupBy("component_id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = stored(
        narrow.select("__row", "id")
        .distinct()
        .join(counted.join(linked, "component_id").select("__row", "component_id"), "__row"),
        "linked",
    )
    rank = F.struct(F.col("id").isNull(), F.col("id"), F.col("__row").alias("__row"))
    firsts = members.groupBy("component_id").agg(F.min(rank).alias("first"))
    firsts = firsts.select(F.col("first.__row").alias("__row"))
    gone = stored(members.select("__row").join(firsts, "__row", "left_anti").distinct(), "dropped")
    repeated = stored(counted.filter("n > 1").select("__row"), "repeated")
    discard(counted, members)
    keyed = docs.select(as_row(docs), key)
    hit, rest = members_of(without(keyed, gone, "__row"), repeated, "__row", apart=True)
    once = hit.join(repeated, "__row", "left_semi").dropDuplicates(["__row"])
    other = hit.join(repeated, "__row", "left_anti")
    kept = rest.unionByName(once).unionByName(other)
    return from_row(kept, docs.columns)
