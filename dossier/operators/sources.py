"""Tables that arrive split over several files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCE_BITS = 48


def source_order(table_key: Column, keys: Sequence[str], row_no: Column) -> Column:
    """One whole-number order over all sources: list position first, row number second."""
    if len(keys) == 1:
        return row_no
    position = F.array_position(F.array(*[F.lit(k) for k in keys]), table_key) - 1
    return F.shiftleft(position, SOURCE_BITS) + row_no


def union_sources(
    frames: Sequence[DataFrame], row_no: str, order: str = "ord"
) -> DataFrame:
    """UNION ALL of frames with equal columns; ``order`` keeps list order, then row order."""
    tagged = [
        frame.withColumn(order, F.lit(i << SOURCE_BITS).cast("long") + F.col(row_no))
        for i, frame in enumerate(frames)
    ]
    result = tagged[0]
    for frame in tagged[1:]:
        result = result.unionByName(frame)
    return result
