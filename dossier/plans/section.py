"""Declarations of sections and documents, and the two plans that run them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import text as tx
from dossier.functions.language import Detector, create_text
from dossier.operators.merge import merge_bilingual
from dossier.operators.select_first import first_row
from dossier.sources.raw import RawRows, get_table

Field = Callable[[Detector], Column]


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def cell(name: str) -> Column:
    """A CSV cell of the raw row; an absent column or a short row reads blank."""
    return F.expr(f"coalesce(cells[{quoted(name)}], '')")


def plain(name: str) -> Field:
    return lambda _: cell(name)


def optional(name: str) -> Field:
    return lambda _: F.expr(f"nullif(cells[{quoted(name)}], '')")


def multilingual(name: str) -> Field:
    def build(detector: Detector) -> Column:
        text = cell(name)
        return create_text(text, detector.detect(text))

    return build


def derived(expression: Callable[[], Column]) -> Field:
    return lambda _: expression()


@dataclass(frozen=True)
class Merge:
    keys: Sequence[str]
    texts: Sequence[str]
    bullets: str | None = None


@dataclass(frozen=True)
class Section:
    """How rows of some tables become a typed section.

    ``keep`` filters raw rows; ``fields`` projects them; ``first_only`` keeps one row per export;
    ``finish`` is any further DataFrame step.
    """

    key: str
    tables: Sequence[str]
    fields: Mapping[str, Field]
    keep: Callable[[], Column] | None = None
    merge: Merge | None = None
    first_only: bool = False
    finish: Callable[[DataFrame], DataFrame] | None = None
    build: Callable[[RawRows, Detector], DataFrame] | None = None


@dataclass(frozen=True)
class Style:
    """Rendering switches.

    ``clean`` prints a blank where the default prints a missing value as ``None``; ``safe``
    escapes pipes in every table cell and sanitises every link.
    """

    clean: bool = False
    safe: bool = False

    def shown(self, c: Column) -> Column:
        return F.coalesce(c, F.lit("" if self.clean else "None"))

    def cell(self, c: Column) -> Column:
        return tx.escape_pipe(c) if self.safe else c

    def url(self, c: Column) -> Column:
        return tx.blank_to_null(tx.sanitize_url(c)) if self.safe else c


@dataclass(frozen=True)
class Document:
    """How the rows of a section become one document: a line (or block) per row, in row order."""

    section: str
    header: str
    line: Callable[[Style, str], Column]
    footer: str = ""
    separator: str = "\n"
    multilingual: bool = False
    prepare: Callable[[DataFrame], DataFrame] | None = field(default=None)


def extract(section: Section, raw: RawRows, detector: Detector | None = None) -> DataFrame:
    """The typed rows of a section: ``export_id``, ``ord`` and the declared fields."""
    detector = detector or Detector()
    if section.build is not None:
        return section.build(raw, detector)
    rows = get_table(raw, section.tables)
    if section.keep is not None:
        rows = rows.filter(section.keep())
    if section.first_only:
        # Fields are built of the rows that stay.
        rows = first_row(rows.select("export_id", "ord", "header", "cells"), ["export_id"], "ord")
    rows = rows.select(
        "export_id",
        "ord",
        *[make(detector).alias(name) for name, make in section.fields.items()],
    )
    if section.merge is not None:
        rows = merge_bilingual(
            rows,
            ["export_id", *section.merge.keys],
            "ord",
            section.merge.texts,
            section.merge.bullets,
            detector.languages,
        )
    return section.finish(rows) if section.finish else rows


# Language tag of lines that read the same in every output language.
ANY_LANGUAGE = "*"


def document_lines(
    document: Document, rows: DataFrame, languages: Sequence[str], style: Style
) -> DataFrame:
    """Rendered rows, before any shuffle: ``export_id, section, lang, ord, text``."""
    if document.prepare is not None:
        rows = document.prepare(rows)
    codes = languages if document.multilingual else [ANY_LANGUAGE]
    if len(codes) == 1:
        return rows.select(
            "export_id",
            F.lit(document.section).alias("section"),
            F.lit(codes[0]).alias("lang"),
            "ord",
            document.line(style, codes[0]).alias("text"),
        )
    rendered = F.array(
        *[
            F.struct(F.lit(code).alias("lang"), document.line(style, code).alias("text"))
            for code in codes
        ]
    )
    return rows.select(
        "export_id",
        F.lit(document.section).alias("section"),
        "ord",
        F.inline(rendered),
    ).select("export_id", "section", "lang", "ord", "text")
