"""Open records: whatever columns a row has filled, as an ordered list of key and value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import is_present, normalise_key


def open_record(header: Column, cells: Column) -> Column:
    """``ARRAY<STRUCT<key, value>>`` of the filled cells in header order.

    Where two headers normalise to one key, the last value stands at the first position.
    """
    filled = F.filter(
        F.transform(
            header,
            lambda h: F.struct(
                normalise_key(h).alias("key"), cells[h].alias("value")
            ),
        ),
        lambda e: is_present(e["value"]),
    )

    def last_of_each(entries: Column) -> Column:
        keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
        unique = F.transform(
            keys,
            lambda k: F.struct(
                k.alias("key"),
                F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value"),
            ),
        )
        return F.when(F.size(keys) == F.size(entries), entries).otherwise(unique)

    # As the variable of a lambda, the filled cells are found once and not at every mention.
    return F.transform(F.array(filled), last_of_each)[0]


def has_record(header: Column, cells: Column) -> Column:
    """Whether any cell is filled."""
    return F.exists(header, lambda h: is_present(cells[h]))
