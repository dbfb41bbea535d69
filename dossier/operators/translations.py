"""Dedup of names that may repeat as ``translation (name)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import has_paren, paren_extract, strip
from dossier.operators.skew import spread_hot_keys


def dedup_translations(df: DataFrame, by: Sequence[str], order: str, name: Column) -> DataFrame:
    """Ordered, case-insensitive dedup in which ``X (Y)`` stands for ``Y``.

    1. Of equal full names, the first survives.
    2. A surviving ``X (Y)`` is dropped when a plain ``Y`` survived before it; otherwise it reads
       ``Y``. What is remembered of it is its full name, so a later plain ``Y`` stays too.

    Returns the ``by`` columns, ``order`` and ``name``.
    """
    by = list(by)
    survivors = (
        df.select(*by, order, strip(name).alias("_full"))
        .filter(F.col("_full") != "")
        .groupBy(*by, F.lower("_full").alias("_key"))
        .agg(F.min(order).alias(order), F.min_by("_full", order).alias("_full"))
    )
    is_pair = has_paren(F.col("_full"))
    plain = survivors.filter(~is_pair)
    pairs = survivors.filter(is_pair).select(
        *by,
        order,
        paren_extract(F.col("_full")).alias("name"),
        F.lower(paren_extract(F.col("_full"))).alias("_target"),
    )
    known = plain.select(*by, F.col("_key").alias("_target"), F.col(order).alias("_known_at"))
    left, right, keys = spread_hot_keys(pairs, known, [*by, "_target"], F.col(order))
    same = [left[k] == right[k] for k in keys]
    kept = left.join(right, [*same, right["_known_at"] < left[order]], "left_anti")
    return plain.select(*by, order, F.col("_full").alias("name")).unionByName(
        kept.select(*by, order, "name")
    )
