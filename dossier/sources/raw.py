"""The long table every plan reads: one row per CSV row of any archive or any other source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.operators.sources import source_order
from dossier.sources.entries import REJECTED

RAW_SCHEMA = T.StructType(
    [
        T.StructField("table_key", T.StringType()),
        T.StructField("export_id", T.StringType()),
        T.StructField("entry_idx", T.IntegerType()),
        T.StructField("row_no", T.LongType()),
        T.StructField("header", T.ArrayType(T.StringType())),
        T.StructField("cells", T.MapType(T.StringType(), T.StringType())),
        T.StructField("overflow", T.ArrayType(T.StringType())),
        T.StructField("defect", T.StringType()),
    ]
)

RawRows = DataFrame | Mapping[str, DataFrame]


def as_raw_rows(
    df: DataFrame,
    table_key: str,
    export_id: Column,
    row_no: Column,
    cells: Mapping[str, Column],
) -> DataFrame:
    """Any DataFrame in the raw shape: ``cells`` maps CSV column names to expressions."""
    pairs = [c for name, value in cells.items() for c in (F.lit(name), value)]
    return df.select(
        F.lit(table_key).alias("table_key"),
        export_id.cast("string").alias("export_id"),
        F.lit(0).alias("entry_idx"),
        row_no.cast("long").alias("row_no"),
        F.array(*[F.lit(name) for name in cells]).alias("header"),
        F.create_map(*pairs).alias("cells"),
        F.lit(None).cast("array<string>").alias("overflow"),
        F.lit(None).cast("string").alias("defect"),
    )


def get_table(raw: RawRows, keys: Sequence[str]) -> DataFrame:
    """Rows of one table, or of several split files in the order of ``keys``.

    ``ord`` orders the rows of an export. On the partitioned raw table the key filter prunes
    directories; a mapping of table key to DataFrame is picked from directly.
    """
    if isinstance(raw, Mapping):
        frames = [raw[k] for k in keys if k in raw]
        if not frames:
            frames = [next(iter(raw.values())).filter(F.lit(False))]
        rows = frames[0]
        for frame in frames[1:]:
            rows = rows.unionByName(frame)
    else:
        rows = raw.filter(F.col("table_key").isin(*keys))
    return rows.select(
        "export_id",
        "table_key",
        source_order(F.col("table_key"), keys, F.col("row_no")).alias("ord"),
        "header",
        "cells",
    )


def export_ids(raw: RawRows) -> DataFrame:
    """The export of every raw row (not distinct), unreadable archives left out; an archive
    without any table still has its marker row. Reads no other column."""
    if isinstance(raw, Mapping):
        frames = [frame.select("export_id") for frame in raw.values()]
        result = frames[0]
        for frame in frames[1:]:
            result = result.unionByName(frame)
        return result
    return raw.filter(F.col("table_key") != REJECTED).select("export_id")
