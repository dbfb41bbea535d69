"""A directory of archives to raw table, documents, manifest and issues."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.fixed import READABLE_BYTES
from dossier.operators.assemble import PART_BYTES
from dossier.plans.catalog import DOCUMENTS, SECTIONS
from dossier.plans.documents import (
    all_lines,
    assemble_stored,
    manifest,
    sections_by_key,
    with_bytes,
)
from dossier.plans.isolation import section_issues, write_lines
from dossier.plans.section import Document, Section
from dossier.sinks.files import unsafe_documents, write_documents, write_issues
from dossier.sources.archives import (
    ExportId,
    accepted,
    archive_files,
    export_id_of,
    listed_archives,
    read_raw,
    rejected,
    rejected_files,
    row_issues,
    write_raw,
    write_raw_by_ranges,
)
from dossier.sources.ranges import LISTING, listing
from dossier.sources.stores import file_system


@dataclass(frozen=True)
class Output:
    """Where a conversion wrote its tables."""

    files: str
    chunks: str
    raw: str
    lines: str
    documents: str
    manifest: str
    issues: str

    @classmethod
    def under(cls, root: str, below: str = "") -> Output:
        """``root/<table><below>`` for every table."""
        root = root.rstrip("/")
        return cls(*[f"{root}/{f.name}{below}" for f in fields(cls)])


def present_documents(
    raw: DataFrame, catalog: Sequence[Document], sections: Sequence[Section]
) -> list[Document]:
    """Catalog documents whose tables occur at all. Looks at partition keys only, and at no more
    of them than the catalog names."""
    known = sections_by_key(sections)
    tables = {d.section: known[d.section].tables if d.section in known else () for d in catalog}
    named = sorted({t for keys in tables.values() for t in keys})
    keys = raw.filter(F.col("table_key").isin(named)).select("table_key").distinct().collect()
    found = {row.table_key for row in keys}
    unknown = [d for d in catalog if d.section not in known]  # these fail, and are told
    return unknown + [d for d in catalog if found.intersection(tables[d.section])] or list(catalog[:1])


def convert_raw(
    spark: SparkSession,
    output: Output,
    languages: Sequence[str],
    catalog: Sequence[Document] = tuple(DOCUMENTS),
    sections: Sequence[Section] = tuple(SECTIONS),
    part_bytes: int = PART_BYTES,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Lines, documents and manifest of a raw table that has been written; returns the documents
    and the issues of sections that failed.

    Rendered rows are stored with their size: rendering (language detection above all) happens
    once, and the passes over sizes read a few narrow columns. Groups of sections are rendered side
    by side, and one that fails stops no other (:mod:`dossier.plans.isolation`).
    """
    raw = read_raw(spark, output.raw)
    present = present_documents(raw, catalog, sections)
    known = sections_by_key(sections)
    tables = {d.section: known[d.section].tables for d in present if d.section in known}

    def render(some: Sequence[Document], rows: DataFrame) -> DataFrame:
        return with_bytes(all_lines(rows, languages, catalog=some, sections=sections, **options))

    stored, failures = write_lines(raw, present, tables, render, output.lines)
    docs = assemble_stored(stored, languages, catalog, part_bytes)
    write_documents(docs, output.documents)
    # A run without documents leaves no file to take the schema from.
    written = spark.read.schema(docs.schema).parquet(output.documents)
    manifest(written).write.mode("overwrite").parquet(output.manifest)
    return written, section_issues(raw, failures, tables)


def convert(
    spark: SparkSession,
    root: str,
    out: str,
    languages: Sequence[str] = ("en",),
    max_bytes: int | None = None,
    export_id: ExportId = export_id_of,
    tables: Collection[str] | None = None,
    **options,
) -> Output:
    """Convert every archive below ``root``. ``tables`` limits the raw table to some table keys.

    Archives are read by ranges (:mod:`dossier.sources.ranges`) where Arrow knows the file system,
    and have any size there; elsewhere Spark reads them whole, up to the 2 GB of a row.

    Archives are opened once: the raw table is written to ``out`` and every later step reads that,
    so a lost executor costs a re-read of its splits and never another unpacking of all archives.
    Unreadable inputs and failing sections become rows of the issues table; the other archives and
    sections are not affected.
    """
    output = Output.under(out)
    try:
        file_system(root)
    except ValueError:
        bound = READABLE_BYTES if max_bytes is None else min(max_bytes, READABLE_BYTES)
        archives = accepted(archive_files(spark, root), root, bound, export_id)
        write_raw(spark, archives, output.raw, tables=tables)
        left_out = rejected_files(spark, root, bound, export_id)
    else:
        listing(spark, root).write.mode("overwrite").parquet(output.files)
        files = spark.read.schema(LISTING).parquet(output.files)
        archives = listed_archives(files, root, max_bytes, export_id)
        write_raw_by_ranges(spark, archives, root, output.raw, output.chunks, tables=tables)
        left_out = rejected(files, root, max_bytes, export_id)
    docs, failed = convert_raw(spark, output, languages, **options)
    issues = (
        left_out.unionByName(row_issues(read_raw(spark, output.raw)))
        .unionByName(unsafe_documents(docs))
        .unionByName(failed)
    )
    write_issues(issues, output.issues)
    return output
