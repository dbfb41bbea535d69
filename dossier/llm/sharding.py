"""Sharding by jump consistent hashing, with DataFrame functions only.

A key seeds a linear congruential generator; every draw lets the key jump from its bucket ``b`` to
``floor((b + 1) * 2^31 / r)``, ``r`` the draw's upper 31 bits plus one. The buckets a key visits do
not depend on the number of shards: among ``n`` shards it rests in the last one below ``n``. So there
is no ring and no table, one more shard takes a row in ``n + 1`` and no row moves between old shards,
and one walk gives the place among ``n`` and among ``n + 1`` shards.

Spark's arithmetic is checked, so the generator's state modulo 2^64 is kept in two halves of 32 bits.

Slots number the rows of a shard from 0, by key (null last) and then by the other kept columns. They
come from counts of spans of 2^16 keys, of spans of spans and so on: no window holds more than the
rows of 2^16 keys of one shard, whatever the keys look like. Rows equal in all kept columns are
counted before any shuffle and are interchangeable. The kept columns with their shard are written
once, so that the texts are read once.

Null keys form one key of their own (seed 0). Rows that repeat a key share its shard. An empty table
gives an empty result. A kept column named like one of the results (``shard``, ``slot``,
``grown_shard``) is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import stored, whole_text

SHARDS = 24

#: The multiplier 2862933555777941757 of the generator as its upper 32, middle 16 and
#: lower 16 bits; the bits of a half, and of a piece.
_UPPER, _MIDDLE, _LOWER = 666578662, 34736, 45309
_HALF, _PIECE = 0xFFFFFFFF, 0xFFFF

#: Draws before the first look whether a key is done, and bits of a span of keys.
_DRAWS = 32
SPAN_BITS = 16
_LEVELS = (SPAN_BITS, 2 * SPAN_BITS, 3 * SPAN_BITS)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _drawn(state: Column) -> Column:
    """The generator's next state, as its upper and lower half."""
    low = state["low"] * _LOWER + 1
    middle = state["low"] * _MIDDLE + F.shiftright(low, 16)
    high = (
        state["high"] * _LOWER
        + F.shiftleft((state["high"] * _MIDDLE).bitwiseAND(_PIECE), 16)
        + state["low"] * _UPPER
        + F.shiftright(middle, 16)
    )
    return F.struct(
        high.bitwiseAND(_HALF).alias("high"),
        F.shiftleft(middle.bitwiseAND(_PIECE), 16).bitwiseOR(low.bitwiseAND(_PIECE)).alias("low"),
    )


def _jumped(state: Column) -> Column:
    """The state after one more jump; ``next`` is the bucket the key goes to."""
    return _let(
        _drawn(state),
        lambda k: F.struct(
            F.concat(state["visited"], F.array(state["next"].cast("int"))).alias("visited"),
            F.floor(
                (state["next"] + 1) * (F.lit(2.0**31) / (F.shiftright(k["high"], 1) + 1))
            ).alias("next"),
            k["high"].alias("high"),
            k["low"].alias("low"),
        ),
    )


def _walk(draws: int, shards: int):
    """Up to ``draws`` further jumps, none for a state that is past the last shard."""

    def step(state: Column, _: Column) -> Column:
        return F.when(state["next"] >= shards, state).otherwise(_jumped(state))

    def walk(state: Column) -> Column:
        further = F.aggregate(F.sequence(F.lit(1), F.lit(draws)), state, step)
        return F.when(state["next"] >= shards, state).otherwise(further)

    return walk


def visited(key: Column, shards: int) -> Column:
    """The buckets below ``shards`` that a 64-bit key visits, ascending, the first one 0."""
    if shards < 1:
        raise ValueError("there must be a shard")
    seed = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    state = F.struct(
        F.array().cast("array<int>").alias("visited"),
        F.lit(0).cast("long").alias("next"),
        F.shiftrightunsigned(seed, 32).alias("high"),
        seed.bitwiseAND(_HALF).alias("low"),
    )
    done, draws = 0, _DRAWS
    while done < shards:  # a key jumps shards times at most, nearly all fewer than _DRAWS
        state = _let(state, _walk(min(draws, shards - done), shards))
        done, draws = done + draws, 4 * draws
    return state["visited"]


def shard_of(key: Column, shards: int = SHARDS) -> Column:
    """The shard, from 0, of a 64-bit integer key among ``shards``."""
    return F.element_at(visited(key, shards), -1)


def _numbered(rows: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``start``, the rows of the same shard before this one of ``n`` equal rows.

    ``rows``: shard, missing (null key), key, n and ``names``. Spans of keys are shifted by the
    counts of the spans before them, these by those of the larger spans before them.
    """

    def span(level: int) -> Column:
        return F.shiftright("key", _LEVELS[level]).alias(f"span{level}")

    spans = [span(level) for level in range(len(_LEVELS))]
    counts = rows.groupBy("shard", "missing", *spans).agg(F.sum("n").alias("n"))
    shifts = None
    for level in reversed(range(len(_LEVELS))):
        above = [f"span{k}" for k in range(level + 1, len(_LEVELS))]
        here = counts.groupBy("shard", "missing", f"span{level}", *above).agg(F.sum("n").alias("n"))
        inside = ["shard", "missing", *above] if above else ["shard"]
        before = Window.partitionBy(*inside).orderBy("missing", f"span{level}")
        before = before.rowsBetween(Window.unboundedPreceding, -1)
        placed = here.withColumn("by", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
        if shifts is not None:
            placed = placed.join(
                shifts.withColumnRenamed("by", "more"), ["shard", "missing", *above]
            ).select("shard", "missing", f"span{level}", *above, (F.expr("by + more")).alias("by"))
        shifts = placed
    inside = Window.partitionBy("shard", "missing", "span0").orderBy("key", *names)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("span0", spans[0]).withColumn(
        "inside", F.coalesce(F.sum("n").over(inside), F.lit(0))
    )
    return numbered.join(
        shifts.select("shard", "missing", "span0", "by"), ["shard", "missing", "span0"]
    ).select(*rows.columns, F.expr("by + inside").alias("start"))


def sharded(
    docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, keep: list[str] | None = None
) -> DataFrame:
    """Every row's kept columns with ``shard``, ``slot`` (from 0 in its shard) and ``grown_shard``.

    ``grown_shard`` is the shard among ``shards + 1``: the same one, or the new one. ``keep`` names
    the columns that go along (all of them unless given; all must be of types that can be ordered).
    An integer key is its own 64-bit seed, any other type is hashed to one.
    """
    own = {"shard", "slot", "grown_shard"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in own]
    names = [f"kept{i}" for i in range(len(keep))]
    given = F.col(f"`{key}`")
    whole = docs.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    seed = given.cast("long") if whole else F.when(given.isNotNull(), F.xxhash64(given))
    rows = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], seed.alias("seed")
    )
    counted = rows.groupBy("seed", *names).agg(F.count(F.lit(1)).alias("n"))
    # a null key is spread over the spans by its other columns
    spread = F.xxhash64(*names) if names else F.lit(0).cast("long")
    walk = counted.withColumn("walk", visited(F.col("seed"), shards + 1)).select(
        F.expr(f"element_at(filter(walk, b -> b < {shards}), -1)").alias("shard"),
        F.element_at("walk", -1).alias("grown_shard"),
        F.col("seed").isNull().alias("missing"),
        F.coalesce("seed", spread).alias("key"),
        "n",
        *names,
    )
    walked = stored(walk, "walked")  # one walk a row, however many counts read it
    return _numbered(walked, names).select(
        *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)],
        "shard",
        F.explode(F.expr("sequence(start, start + n - 1)")).alias("slot"),
        "grown_shard",
    )


def shard_list(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per document its size, the CRC-32 of its text and its place; a null text is empty.

    Columns: doc_id, size (bytes of the text plus 8), text_crc32, law (``key``), shard, slot,
    grown_shard.
    """
    text = whole_text()
    sized = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(8).cast("long")).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return sharded(sized, shards=shards).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
