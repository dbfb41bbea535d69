"""Row numbers within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPAN_BITS = 16


def number_rows(
    df: DataFrame, by: Sequence[str], order: str, name: str, span_bits: int = SPAN_BITS
) -> DataFrame:
    """Number the rows of every group from 1 in ``order`` (a unique whole number per group).

    A group is cut into spans of ``2 ** span_bits`` order values. Rows are numbered inside their
    span and shifted by the row count of the spans before it, so one huge group is spread over
    many tasks and only its span counts meet in one.
    """
    by = list(by)
    spans = df.withColumn("_span", F.shiftright(F.col(order), span_bits))
    counts = spans.groupBy(*by, "_span").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *by, "_span", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*by, "_span").orderBy(order)
    numbered = spans.withColumn("_inside", F.row_number().over(inside))
    return (
        numbered.join(offsets, [*by, "_span"])
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_span", "_offset", "_inside")
    )
