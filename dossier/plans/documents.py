"""Documents of all sections in one plan."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.language import Detector
from dossier.functions.text import markdown_file_name, strip
from dossier.operators.assemble import PART_BYTES, assemble
from dossier.plans.catalog import DOCUMENT_SOURCES, DOCUMENTS, SECTIONS
from dossier.plans.section import (
    ANY_LANGUAGE,
    Document,
    Section,
    Style,
    document_lines,
    extract,
)
from dossier.sources.raw import RawRows


def sections_by_key(sections: Iterable[Section] = SECTIONS) -> dict[str, Section]:
    return {s.key: s for s in sections} | DOCUMENT_SOURCES


def _of_section(values: Mapping[str, object]) -> Column:
    """The catalog value of a row's section, from a literal map of catalog size."""
    pairs = [F.lit(v) for pair in values.items() for v in pair]
    return F.create_map(*pairs)[F.col("section")]


def all_lines(
    raw: RawRows,
    languages: Sequence[str] = ("en",),
    detector: Detector | None = None,
    style: Style | None = None,
    catalog: Sequence[Document] = tuple(DOCUMENTS),
    sections: Iterable[Section] = tuple(SECTIONS),
) -> DataFrame:
    """Rendered rows of all catalog documents; each branch reads only its own tables."""
    known, style = sections_by_key(sections), style or Style()
    branches = [
        document_lines(d, extract(known[d.section], raw, detector), languages, style)
        for d in catalog
    ]
    return reduce(DataFrame.unionByName, [_with_text(lines) for lines in branches])


def _with_text(lines: DataFrame) -> DataFrame:
    """Rendered rows without null texts.

    A plain filter would be pushed below the projections, with all of a text's expression (language
    detection too) written out at every mention in it; a generator's rows are filtered where they are.
    """
    if not lines.schema["text"].nullable:
        return lines
    others = [c for c in lines.columns if c != "text"]
    present = F.when(F.col("text").isNotNull(), F.array("text"))
    return lines.select(*others, F.explode(present).alias("text")).select(*lines.columns)


def documents(
    raw: RawRows,
    languages: Sequence[str] = ("en",),
    detector: Detector | None = None,
    style: Style | None = None,
    catalog: Sequence[Document] = tuple(DOCUMENTS),
    sections: Iterable[Section] = tuple(SECTIONS),
    part_bytes: int = PART_BYTES,
    lines_path: str | None = None,
) -> DataFrame:
    """``export_id, section_rank, section, lang, file_name, part_no, whole, content``.

    Rows are rendered before the shuffle, and one ordered aggregation assembles the documents of
    all sections. Lazy: the sizes of the documents are a second pass over the rendered rows. With
    ``lines_path``, a new folder, the rendered rows are stored there at once, so that rendering
    (language detection and merges above all) happens once, as in a conversion
    (:func:`dossier.plans.convert.convert`).
    """
    lines = all_lines(raw, languages, detector, style, catalog, sections)
    if lines_path is None:
        return assemble_lines(lines, languages, catalog, part_bytes)
    sized = with_bytes(lines)
    sized.write.parquet(lines_path)
    stored = sized.sparkSession.read.schema(sized.schema).parquet(lines_path)
    return assemble_stored(stored, languages, catalog, part_bytes)


def with_bytes(lines: DataFrame) -> DataFrame:
    """Rendered rows with their size, to be stored."""
    return lines.withColumn("bytes", F.octet_length("text"))


def assemble_stored(
    stored: DataFrame,
    languages: Sequence[str],
    catalog: Sequence[Document] = tuple(DOCUMENTS),
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Documents of rendered rows that are stored with their size."""
    # Each line adds a separator of at most two bytes.
    total = stored.agg(F.coalesce(F.sum(F.col("bytes") + 2), F.lit(0))).first()[0]
    return assemble_lines(stored, languages, catalog, part_bytes, size="bytes", total_bytes=total)


def assemble_lines(
    lines: DataFrame,
    languages: Sequence[str],
    catalog: Sequence[Document] = tuple(DOCUMENTS),
    part_bytes: int = PART_BYTES,
    size: str | None = None,
    total_bytes: int | None = None,
) -> DataFrame:
    """Documents of rendered rows. Sections without multilingual fields are assembled once and
    repeated per language afterwards. See :func:`dossier.operators.assemble.assemble` for
    ``part_no``."""
    by_section = {d.section: d for d in catalog}
    assembled = assemble(
        lines,
        ["export_id", "section", "lang"],
        separator=_of_section({k: d.separator for k, d in by_section.items()}),
        header=_of_section({k: d.header for k, d in by_section.items()}),
        footer=_of_section({k: d.footer for k, d in by_section.items()}),
        part_bytes=part_bytes,
        size=size,
        total_bytes=total_bytes,
    )
    every_language = F.array(*[F.lit(code) for code in languages])
    spoken = F.when(F.col("lang") == ANY_LANGUAGE, every_language).otherwise(F.array("lang"))
    # Stripping goes through a whole text, so it is left to those that begin with many blanks.
    begun = strip(F.substring("content", 1, 256)) != ""
    return (
        assembled.filter(~F.col("whole") | begun | (strip(F.col("content")) != ""))
        .select(
            "export_id",
            _of_section({d.section: i for i, d in enumerate(catalog)}).alias("section_rank"),
            "section",
            F.explode(spoken).alias("lang"),
            markdown_file_name(F.col("section")).alias("file_name"),
            "part_no",
            "whole",
            "content",
        )
    )


def document(raw: RawRows, section: str, languages: Sequence[str] = ("en",), **options) -> DataFrame:
    """The documents of one catalog section."""
    catalog = [d for d in options.pop("catalog", DOCUMENTS) if d.section == section]
    return documents(raw, languages, catalog=catalog, **options)


def manifest(docs: DataFrame, by: Sequence[str] = ("export_id",)) -> DataFrame:
    """How many files each export produced, and which. At most one name per catalog section."""
    return docs.groupBy(*by).agg(F.sort_array(F.collect_set("file_name")).alias("files")).select(
        *by, F.size("files").cast("long").alias("n_files"), "files"
    )
