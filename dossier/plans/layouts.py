"""Document layouts: tables, lists and blocks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions import text as tx
from dossier.functions.language import get_text
from dossier.plans.section import Document, Style

CellBuilder = Callable[[Style], Column]

BLANK = ""
RULE = "---"


def value(name: str) -> Column:
    """A section field as text; a missing value reads blank."""
    return F.expr(f"coalesce(`{name}`, '')")


def localised(name: str, language: str) -> Column:
    return get_text(F.col(name), language)


def table_header(title: str, headings: Sequence[str]) -> str:
    rule = "|".join("-" * max(5, len(h) + 2) for h in headings)
    return f"# {title}\n\n| {' | '.join(headings)} |\n|{rule}|\n"


def table(section: str, title: str, columns: Mapping[str, str | CellBuilder]) -> Document:
    """One ``| a | b |`` row per entry. A column is a field name or a builder of its cell."""

    def line(style: Style, _: str) -> Column:
        parts = [F.lit("| ")]
        for i, source in enumerate(columns.values()):
            if i:
                parts.append(F.lit(" | "))
            parts.append(style.cell(value(source)) if isinstance(source, str) else source(style))
        return F.concat(*parts, F.lit(" |"))

    return Document(section, table_header(title, list(columns)), line, footer="\n")


def shown(name: str) -> CellBuilder:
    """A cell that prints a missing value the way :meth:`Style.shown` says."""
    return lambda style: style.cell(style.shown(F.col(name)))


def link(name: str) -> CellBuilder:
    return lambda style: tx.link_cell(style.url(F.col(name)))


def escaped(name: str) -> CellBuilder:
    return lambda _: tx.escape_pipe(value(name))


def bullet_list(section: str, title: str, item: Callable[[], Column]) -> Document:
    return Document(
        section,
        f"# {title}\n\n",
        lambda _style, _lang: F.concat(F.lit("- "), item()),
        footer="\n",
    )


def when_present(c: Column, *line: Column | str) -> Column:
    """A line that only stands where ``c`` has a value (null lines are skipped)."""
    parts = [F.lit(p) if isinstance(p, str) else p for p in line]
    return F.when(tx.is_present(c), F.concat(*parts))


def lines(*parts: Column | str | None) -> Column:
    """Lines of a block joined by newlines; null lines are skipped, blank ones are kept."""
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("\n", *columns)


def blocks(
    section: str,
    title: str,
    block: Callable[[Style, str], Column],
    multilingual: bool = False,
    prepare: Callable | None = None,
) -> Document:
    """A multi-line block per entry; every block ends with a line break."""
    return Document(
        section,
        f"# {title}\n\n",
        lambda style, lang: F.concat(block(style, lang), F.lit("\n")),
        multilingual=multilingual,
        prepare=prepare,
    )
