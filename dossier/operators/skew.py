"""Helpers for joins whose left side may hold one very frequent key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1 / 1024
SPREAD = 64


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold at least ``share`` of all rows.

    There can be no more than ``1 / share`` of them whatever the size of ``df``, so the result may
    be broadcast. The counts are combined before the shuffle.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    total = counts.agg(F.sum("_rows"))
    return counts.filter(F.col("_rows") >= total.scalar() * F.lit(share)).select(*keys)


def spread_hot_keys(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    by: Column,
    share: float = HOT_SHARE,
    spread: int = SPREAD,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both join sides with a salt that splits the hot keys of ``left``.

    Rows of ``right`` are repeated for hot keys only; all other keys keep salt 0.
    """
    hot = F.broadcast(hot_keys(left, keys, share).withColumn("_hot", F.lit(True)))
    salted_left = (
        left.withColumn("_spread", F.pmod(by, F.lit(spread)).cast("int"))
        .join(hot, list(keys), "left")
        .withColumn("_salt", F.when(F.col("_hot"), F.col("_spread")).otherwise(0))
        .drop("_hot", "_spread")
    )
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(
        F.array(F.lit(0))
    )
    salted_right = (
        right.join(hot, list(keys), "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    )
    return salted_left, salted_right, [*keys, "_salt"]
