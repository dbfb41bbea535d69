"""Order-aware aggregates. All of them combine rows before the shuffle, so a group of any size
moves at most one row per map task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_row(
    df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """The first row of every group, as the group's columns, ``order`` and the chosen columns."""
    columns = columns or [c for c in df.columns if c not in (*by, order)]
    picked = df.groupBy(*by).agg(
        F.min(order).alias(order),
        F.min_by(F.struct(*columns), order).alias("_first"),
    )
    return picked.select(*by, order, "_first.*")


def preferred_else_first(
    df: DataFrame, by: Sequence[str], order: str, preferred: Column, value: Column, name: str
) -> DataFrame:
    """``value`` of the first preferred row of a group, or of its first row if none is preferred."""
    rank = F.struct(F.when(preferred, 0).otherwise(1), F.col(order))
    # Only what is compared is sorted, not the whole rows.
    rows = df.select(*by, rank.alias("_rank"), value.alias("_value"))
    return rows.groupBy(*by).agg(F.min_by("_value", "_rank").alias(name))


def count_rows(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def first_per_key(df: DataFrame, by: Sequence[str], key: Column, order: str) -> DataFrame:
    """Order-preserving dedup: of the rows of a group with equal ``key`` the first survives whole."""
    columns = [c for c in df.columns if c not in (*by, order)]
    return first_row(
        df.withColumn("_key", key), [*by, "_key"], order, columns
    ).drop("_key")


def keep_last_entry(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Of the rows of a group the one with the greatest ``order`` survives."""
    columns = [c for c in df.columns if c not in (*by, order)]
    picked = df.groupBy(*by).agg(
        F.max(order).alias(order), F.max_by(F.struct(*columns), order).alias("_last")
    )
    return picked.select(*by, order, "_last.*")
