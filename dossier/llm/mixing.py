"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

The documents of a source are numbered and cut into blocks. A source of weight ``w`` (of all that
have blocks left) gives its block ``i`` (from 0) the release time ``floor(i / w)`` and the deadline
``ceil((i + 1) / w)``; the earliest deadline among the released blocks takes each slot. The times
come from the weights themselves over the whole phase, so every block meets its window and no source
is ever a whole block ahead of or behind its weight, however long the table. One task places the
blocks (not the documents) one after another.

Every document is placed exactly once. A phase ends when a source runs out; the next phase shares
the slots among the others in proportion to their weights. With ``slots``, the weights are rounded
to whole slots of a period that repeats, at least one each, and a phase ends with its period: the
mix then departs from the weights by the rounding, in every period.

Null source: a source of its own. Null ids come last in their source. Rows that repeat an id are
told apart by ``tie``; full repeats are interchangeable. An empty table gives an empty result.
Sources are categories: their number (not their size) must fit one row, thousands at most.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents per block, slots per rounded period (at least four per source) and per step of the
#: exact schedule, ids per numbering span.
BLOCK_ROWS = 64
SLOTS = 256
_STEP_SLOTS = 256
SPAN_BITS = 10


def _numbered(rows: DataFrame, span_bits: int) -> DataFrame:
    """Adds ``number``, from 0 within each ``key``, in order of (``id``, ``tie``), nulls last.

    A source is numbered in spans of its ids, each shifted by the counts of the spans before it,
    so that a source with most of the rows is spread over many tasks.
    """
    last = F.lit(2**62) + F.pmod("tie", F.lit(4096))
    spans = rows.withColumn("span", F.coalesce(F.shiftright("id", span_bits), last))
    counts = spans.groupBy("key", "span").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("key", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("by"))
    inside = Window.partitionBy("key", "span").orderBy("id", "tie")
    numbered = spans.withColumn("inside", F.row_number().over(inside) - 1)
    return numbered.join(shifts, ["key", "span"]).select(
        *rows.columns, (F.col("by") + F.col("inside")).alias("number")
    )


def _weighted(sources: DataFrame, weights: Mapping[str, float] | None, exponent: float) -> DataFrame:
    """Adds each source's target weight: the given one, else its size to the ``exponent``."""
    if weights is None:
        return sources.withColumn("weight", F.pow("rows", F.lit(exponent)))
    pairs = [x for k, w in weights.items() for x in (F.lit(f"={k}"), F.lit(float(w)))]
    given = F.create_map(*pairs)[F.col("key")] if pairs else F.lit(None).cast("double")
    return sources.withColumn("weight", F.greatest(F.coalesce(given, F.lit(0.0)), F.lit(1e-9)))


#: One phase after another: the sources that have blocks left share the slots, ``T`` in all, for as
#: many periods as the first of them to run out needs.
_PHASES = """
aggregate(
  sequence(1, size(sources)),
  named_struct('taken', transform(sources, s -> 0L), 'base', 0L,
    'phases', cast(array() as array<struct<phase: int, base: bigint, shares: array<int>,
                                           first: array<bigint>, periods: bigint>>)),
  (st, k) -> if(
    forall(zip_with(sources, st.taken, (s, x) -> s.blocks <= x), x -> x), st,
    transform(
      array(zip_with(sources, st.taken, (s, x) -> if(s.blocks > x, s.weight, 0D))),
      w -> transform(
        array(transform(w, x -> if(x > 0, cast(greatest(1D,
          round({slots} * x / aggregate(w, 0D, (a, b) -> a + b))) as int), 0))),
        share -> transform(
          array(array_min(filter(zip_with(share, zip_with(sources, st.taken,
            (s, x) -> s.blocks - x), (a, left) -> if(a > 0, (left + a - 1) div a, null)),
            x -> x is not null))),
          periods -> named_struct(
            'taken', zip_with(st.taken, share, (x, a) -> x + a * periods),
            'base', st.base + periods * aggregate(share, 0, (a, b) -> a + b),
            'phases', concat(st.phases, array(named_struct('phase', k, 'base', st.base,
              'shares', share, 'first', st.taken, 'periods', periods))))
        )[0])[0])[0]),
  st -> st.phases)
"""

#: The period of one phase: in every slot the released block with the earliest deadline.
_SCHEDULE = """
aggregate(
  sequence(0, slots - 1),
  named_struct('done', transform(shares, a -> 0), 'order', cast(array() as array<int>)),
  (st, t) -> transform(
    array(array_min(filter(zip_with(sequence(0, size(shares) - 1), shares, (j, a) -> if(
      st.done[j] < a and (st.done[j] * cast(slots as bigint)) div a <= t,
      named_struct('deadline', ((st.done[j] + 1) * cast(slots as bigint) + a - 1) div a, 'j', j),
      null)), x -> x is not null)).j),
    pick -> named_struct(
      'done', transform(st.done, (d, j) -> if(j = pick, d + 1, d)),
      'order', concat(st.order, array(pick))))[0],
  st -> st.order)
"""


def schedule(sources: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Per source key, its phases: first block, share, first slot, period, and its slots in it.

    ``sources``: key, blocks, weight. The result has a row per source and at most
    ``max(slots, 4 * sources)`` numbers per phase, which bounds what is broadcast.
    """
    period = F.expr(f"greatest({slots}, 4 * size(sources))")
    one = sources.agg(
        F.sort_array(F.collect_list(F.struct("key", "blocks", "weight"))).alias("sources")
    ).filter("size(sources) > 0")
    phases = one.withColumn("period", period).select(
        F.transform("sources", lambda s: s["key"]).alias("keys"),
        F.explode(F.expr(_PHASES.format(slots="period"))).alias("p"),
    )
    parts = phases.select(
        "keys",
        "p.phase",
        "p.base",
        "p.shares",
        "p.first",
        F.expr("aggregate(p.shares, 0, (a, b) -> a + b)").alias("slots"),
    )
    placed = parts.withColumn("order", F.expr(_SCHEDULE)).select(
        "keys", "phase", "base", "shares", "first", "slots", F.posexplode("order").alias("slot", "j")
    )
    return (
        placed.groupBy("phase", "j")
        .agg(
            F.first(F.expr("keys[j]")).alias("key"),
            F.first(F.expr("first[j]")).alias("first"),
            F.first(F.expr("shares[j]")).alias("share"),
            F.first("base").alias("base"),
            F.first("slots").alias("slots"),
            F.sort_array(F.collect_list("slot")).alias("at"),
        )
        .groupBy("key")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("first", "phase", "share", "base", "slots", "at"))
            ).alias("phases")
        )
    )


#: Slots to the next block of each source with blocks left, were it alone at its weight.
_GAPS = """transform(array(zip_with(sources, {done}, (s, x) -> if(x < s.blocks, s.weight, 0D))),
  w -> transform(w, x -> if(x > 0, aggregate(w, 0D, (a, b) -> a + b) / x, null)))[0]"""

#: Slot after slot, the released block with the earliest deadline; a source that runs out starts a
#: phase. Equal times that division leaves a hair apart count as equal.
_EXACT = """
aggregate(
  sequence(0L, (total - 1) div {step}),
  named_struct('done', zeros, 'first', zeros, 'base', 0L, 'phase', 1, 'gaps', {gaps},
    'steps', cast(array() as array<array<struct<phase: int, j: int, block: bigint>>>)),
  (st, p) -> transform(
    array(aggregate(
      sequence(p * {step}, least(total, (p + 1) * {step}) - 1),
      named_struct('done', st.done, 'first', st.first, 'base', st.base, 'phase', st.phase,
        'gaps', st.gaps, 'order', cast(array() as array<struct<phase: int, j: int, block: bigint>>)),
      (x, t) -> transform(
        array(array_min(filter(transform(x.gaps, (g, j) -> if(g is null, null, named_struct(
          'waits', floor((x.done[j] - x.first[j]) * g + 1e-9D) > t - x.base,
          'deadline', ceil((x.done[j] - x.first[j] + 1) * g - 1e-9D), 'j', j))),
          y -> y is not null)).j),
        j -> transform(
          array(transform(x.done, (d, i) -> if(i = j, d + 1, d))),
          done -> transform(
            array(done[j] = sources[j].blocks),
            out -> named_struct('done', done, 'first', if(out, done, x.first),
              'base', if(out, t + 1, x.base), 'phase', if(out, x.phase + 1, x.phase),
              'gaps', if(out, {next_gaps}, x.gaps),
              'order', concat(x.order, array(named_struct('phase', x.phase, 'j', j,
                'block', x.done[j])))))[0])[0])[0])),
    x -> named_struct('done', x.done, 'first', x.first, 'base', x.base, 'phase', x.phase,
      'gaps', x.gaps, 'steps', concat(st.steps, array(x.order))))[0],
  st -> st.steps)
"""


def exact_schedule(sources: DataFrame) -> DataFrame:
    """One row per block: ``key``, ``block``, ``phase`` and its slot (``at``), from the weights as
    they are. ``sources``: key, blocks, weight.
    """
    one = sources.agg(
        F.sort_array(F.collect_list(F.struct("key", "blocks", "weight"))).alias("sources")
    ).filter("size(sources) > 0")
    steps = _EXACT.format(
        step=f"{_STEP_SLOTS}L", gaps=_GAPS.format(done="zeros"), next_gaps=_GAPS.format(done="done")
    )
    ready = one.withColumn("zeros", F.expr("transform(sources, s -> 0L)")).withColumn(
        "total", F.expr("aggregate(sources, 0L, (a, s) -> a + s.blocks)")
    )
    order = ready.select("sources", F.posexplode(F.expr(steps)).alias("step", "order"))
    return order.select("sources", "step", F.posexplode("order").alias("nth", "b")).select(
        F.expr("sources[b.j].key").alias("key"),
        F.col("b.block").alias("block"),
        F.col("b.phase").alias("phase"),
        (F.col("step").cast("long") * _STEP_SLOTS + F.col("nth")).alias("at"),
    )


def mixed(
    docs: DataFrame,
    id_column: str = "doc_id",
    source: str = "source",
    tie: Column | None = None,
    weights: Mapping[str, float] | None = None,
    exponent: float = 0.5,
    block_rows: int = BLOCK_ROWS,
    slots: int | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per document with its place in the mix, to be read in order of (slot, place).

    Columns: the id and source columns (or those of ``keep``), ``mix_block`` (of its source, from
    0), ``mix_phase``, ``mix_slot`` (of the whole mix) and ``mix_place`` (within the block).
    ``weights`` maps sources to target weights, those it leaves out come last; without it, a source
    weighs its number of documents to the power ``exponent``. ``slots`` rounds the weights to whole
    slots of a period.
    """
    names = [id_column, source] if keep is None else keep
    key = F.when(F.col(source).isNull(), F.lit("null")).otherwise(
        F.concat(F.lit("="), F.col(source).cast("string"))
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.col(id_column).cast("long").alias("id"),
        key.alias("key"),
        (F.lit(0).cast("long") if tie is None else tie).alias("tie"),
    )
    sources = (
        rows.groupBy("key")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("blocks", F.ceil(F.col("rows") / block_rows).cast("long"))
    )
    weighted = _weighted(sources, weights, exponent)
    numbered = _numbered(rows, SPAN_BITS).withColumn("block", F.expr(f"number div {block_rows}"))
    place = F.expr(f"cast(number % {block_rows} as int)").alias("mix_place")
    if slots is None:
        return numbered.join(exact_schedule(weighted), ["key", "block"]).select(
            "row.*",
            F.col("block").alias("mix_block"),
            F.col("phase").alias("mix_phase"),
            F.col("at").alias("mix_slot"),
            place,
        )
    plan = schedule(weighted, slots)
    placed = (
        numbered.join(F.broadcast(plan), "key")
        .withColumn("p", F.expr("element_at(filter(phases, x -> x.first <= block), -1)"))
        .withColumn("nth", F.expr("block - p.first"))
    )
    return placed.select(
        "row.*",
        F.col("block").alias("mix_block"),
        F.col("p.phase").alias("mix_phase"),
        F.expr(
            "p.base + (nth div p.share) * p.slots + p.at[cast(nth % p.share as int)]"
        ).alias("mix_slot"),
        place,
    )


def tie_of(docs: DataFrame) -> Column:
    """What tells rows of one id apart: a hash of the whole row."""
    return F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))


def in_mixed_order(docs: DataFrame, with_places: bool = False, **options) -> DataFrame:
    """The rows and columns of ``docs`` in the order of the mix, so files hold it when written.

    ``with_places`` adds ``mix_slot`` and ``mix_place``, for steps that go by the mix.
    """
    placed = mixed(docs, tie=tie_of(docs), keep=docs.columns, **options)
    names = [*docs.columns, *(["mix_slot", "mix_place"] if with_places else [])]
    return placed.orderBy("mix_slot", "mix_place").select(*[f"`{c}`" for c in names])
