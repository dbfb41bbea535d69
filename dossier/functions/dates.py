"""Partial-date functions (string in, string out). Nothing is cast to a date: exports hold
years, year-months and free text side by side, and all of them must survive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.fixed import MONTH_LABELS
from dossier.functions.text import blank_to_null, strip, text_or_blank, word_count


def _integer(c: Column, kind: str) -> Column:
    """The whole number a text spells, or null. Sign and digit-group underscores are allowed."""
    digits = strip(c)
    value = F.replace(digits, F.lit("_"), F.lit("")).try_cast(kind)
    return F.when(digits.rlike(r"^[+-]?[0-9]+(_[0-9]+)*\z"), value)


def _month_label(c: Column) -> Column:
    """Label of a month number 0..12, null for anything else."""
    labels = F.array(*[F.lit(m) for m in MONTH_LABELS])
    return F.get(labels, _integer(c, "int"))


def format_date(c: Column) -> Column:
    """``2020-01-15`` -> ``Jan 2020``; two-word dates and bare years stay as they are."""
    text = text_or_blank(c)
    parts = F.split(text, "-")
    year = F.get(parts, F.lit(0))
    label = _month_label(F.get(parts, F.lit(1)))
    return (
        F.when(text.contains(" ") & (word_count(text) == 2), text)
        .when(~text.contains("-"), text)
        .otherwise(F.coalesce(F.concat(label, F.lit(" "), year), year))
    )


def parse_us_datetime(c: Column) -> Column:
    """``08/19/24, 11:04 PM`` -> ``Aug 2024``; otherwise the text before the first comma."""
    day = F.substring_index(c, ",", 1)
    parts = F.split(day, "/")
    year = F.get(parts, F.lit(2))
    number = _integer(year, "decimal(38,0)")
    century = F.when(number < 50, "20").when(number >= 50, "19")
    label = _month_label(F.get(parts, F.lit(0)))
    formatted = F.when(
        F.size(parts) == 3, F.concat(label, F.lit(" "), century, year)
    )
    return F.when(c != "", F.coalesce(formatted, day))


def parse_utc_date(c: Column) -> Column:
    """``2022/01/16 02:51:39 UTC`` -> ``Jan 2022``; anything else is null."""
    parts = F.split(F.substring_index(c, " ", 1), "/")
    label = _month_label(F.get(parts, F.lit(1)))
    return F.when(
        F.size(parts) == 3, F.concat(label, F.lit(" "), F.get(parts, F.lit(0)))
    )


def year_of(c: Column) -> Column:
    return F.substring_index(text_or_blank(c), "-", 1)


def end_year_of(c: Column) -> Column:
    """Like :func:`year_of`, but null when there is no date at all."""
    return F.substring_index(blank_to_null(c), "-", 1)


def open_range(start: Column, end: Column) -> Column:
    """``start - end``; a missing end reads ``Present``, a missing start is left out."""
    return F.concat_ws(
        " - ", blank_to_null(start), F.coalesce(blank_to_null(end), F.lit("Present"))
    )


def started_range(start: Column, end: Column) -> Column:
    """``start - end``; null when there is no start."""
    return F.when(
        start != "", F.concat_ws(" - ", start, blank_to_null(end))
    )


def closed_range(start: Column, end: Column) -> Column:
    """The known ends joined by a dash; null when neither is known."""
    return blank_to_null(F.concat_ws(" - ", blank_to_null(start), blank_to_null(end)))


__all__ = [
    "closed_range",
    "end_year_of",
    "format_date",
    "open_range",
    "parse_us_datetime",
    "parse_utc_date",
    "started_range",
    "year_of",
]
