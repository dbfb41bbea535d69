"""Merging of entries that exist once per language."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import is_present

#: What a slot of an entry is: the entry itself, a bullet, or (from 0) one of the text fields.
ENTRY, BULLET = -2, -1

SLOTS = "array<struct<field: int, pos: int, code: string, text: string>>"


def _slot(field: int, pos: Column | int, code: Column | None = None, text: Column | None = None):
    none = F.lit(None).cast("string")
    pos = F.lit(pos) if isinstance(pos, int) else pos
    return F.struct(
        F.lit(field).alias("field"),
        pos.cast("int").alias("pos"),
        (none if code is None else code).alias("code"),
        (none if text is None else text).alias("text"),
    )


def _texts(text: Column, field: int, pos: Column | int, languages: Sequence[str] | None) -> Column:
    """A slot per language with a text that is not blank; none for a null map."""

    def counts(code: Column, value: Column) -> Column:
        shown = is_present(value)
        return shown if languages is None else shown & code.isin(*languages)

    entries = F.map_entries(F.map_filter(text, counts))
    slots = F.transform(entries, lambda e: _slot(field, pos, e["key"], e["value"]))
    return F.coalesce(slots, F.array().cast(SLOTS))


def _bullets(bullets: Column, languages: Sequence[str] | None) -> Column:
    """The slots of a list: one that only tells the position, and one per language."""
    each = F.transform(
        bullets,
        lambda b, i: F.concat(
            F.array(_slot(BULLET, i)).cast(SLOTS), _texts(b["text"], BULLET, i, languages)
        ),
    )
    return F.coalesce(F.flatten(each), F.array().cast(SLOTS))


def _as_text(entries: Column) -> Column:
    """The map of (code, text) pairs, in order of the codes."""
    return F.map_from_entries(F.array_sort(entries))


def merge_bilingual(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    texts: Sequence[str],
    bullets: str | None = None,
    languages: Sequence[str] | None = None,
) -> DataFrame:
    """One row per key group: multilingual fields merged, all others from the group's first row.

    Per language the first non-empty text wins, of ``languages`` or, without them, of any that
    occur. ``bullets`` (``ARRAY<STRUCT<text: MAP>>``) merges position by position and is as long as
    the longest list. Null key parts are equal.

    Every text becomes a row (field, position, language), so nothing about the languages need be
    known beforehand and ``df`` is computed once. The first of each is found before the shuffle;
    only what a merged entry itself holds is collected.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in (*keys, order, *texts, bullets)]
    slots = [F.array(_slot(ENTRY, 0)).cast(SLOTS)]
    slots += [_texts(F.col(t), i, 0, languages) for i, t in enumerate(texts)]
    if bullets is not None:
        slots.append(_bullets(F.col(bullets), languages))
    rows = df.select(
        *keys,
        F.col(order).alias("_order"),
        F.struct(F.lit(0).alias("_"), *rest).alias("_rest"),
        F.explode(F.concat(*slots)).alias("_slot"),
    )
    entry = F.col("_slot.field") == ENTRY
    found = rows.groupBy(
        *keys,
        F.col("_slot.field").alias("_field"),
        F.col("_slot.pos").alias("_pos"),
        F.col("_slot.code").alias("_code"),
    ).agg(
        F.min("_order").alias("_order"),
        F.min_by(F.col("_slot.text"), F.col("_order")).alias("_text"),
        F.min_by(F.when(entry, F.col("_rest")), F.col("_order")).alias("_rest"),
    )
    pair = F.when(F.col("_code").isNotNull(), F.struct("_code", "_text"))
    merged = found.groupBy(*keys, "_field", "_pos").agg(
        _as_text(F.collect_list(pair)).alias("_text"),
        F.min("_order").alias("_order"),
        F.first("_rest").alias("_rest"),
    )
    is_entry = F.col("_field") == ENTRY
    groups = merged.groupBy(*keys).agg(
        F.min(F.when(is_entry, F.col("_order"))).alias("_order"),
        F.first(F.when(is_entry, F.col("_rest")), ignorenulls=True).alias("_rest"),
        *[
            F.first(F.when(F.col("_field") == i, F.col("_text")), ignorenulls=True).alias(f"_text{i}")
            for i in range(len(texts))
        ],
        F.array_sort(
            F.collect_list(F.when(F.col("_field") == BULLET, F.struct("_pos", F.struct(F.col("_text").alias("text")).alias("b")))),
            lambda a, b: a["_pos"] - b["_pos"],
        ).alias("_bullets"),
    )
    none = F.create_map().cast("map<string,string>")
    columns = {order: F.col("_order")} | {c: F.col(f"_rest.{c}") for c in rest}
    columns |= {t: F.coalesce(F.col(f"_text{i}"), none) for i, t in enumerate(texts)}
    if bullets is not None:
        columns[bullets] = F.transform("_bullets", lambda b: b["b"])
    columns |= {k: F.col(k) for k in keys}
    return groups.select(*[columns[c].alias(c) for c in df.columns])
