"""Spark side of the section and document checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier_checks.bindings import raw_tables
from dossier import DOCUMENTS, SECTIONS, document, extract
from dossier.functions.fixed import OUTPUT_LANGUAGES

Query = Callable[[SparkSession, str], DataFrame]

PROFILE_TABLES = ["profile", "email_addresses", "phonenumbers"]


def _bullet_texts(name: str, code: str) -> Column:
    texts = F.transform(F.col(name), lambda b: F.coalesce(b["text"][code], F.lit("")))
    return F.when(F.size(name) > 0, F.array_join(texts, "\n")).alias(f"{name}_{code}")


def flatten(df: DataFrame) -> DataFrame:
    """Scalar columns only: one column per language of a text, lists as joined text."""
    columns = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.MapType):
            columns += [F.col(f.name)[code].alias(f"{f.name}_{code}") for code in OUTPUT_LANGUAGES]
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            if f.dataType.elementType.names == ["text"]:
                columns += [_bullet_texts(f.name, code) for code in OUTPUT_LANGUAGES]
            else:
                pairs = F.transform(F.col(f.name), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
                columns.append(F.array_join(pairs, "\n").alias(f.name))
        elif isinstance(f.dataType, T.ArrayType):
            columns.append(F.array_join(f.name, "|").alias(f.name))
        else:
            columns.append(F.col(f.name))
    return df.select(*columns)


def _section(section) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flatten(extract(section, raw_tables(spark, sf_dir, section.tables)))

    return run


def _document(entry) -> Query:
    tables = (
        PROFILE_TABLES
        if entry.section == "profile"
        else next(s.tables for s in SECTIONS if s.key == entry.section)
    )
    languages = OUTPUT_LANGUAGES if entry.multilingual else OUTPUT_LANGUAGES[:1]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = document(raw_tables(spark, sf_dir, tables), entry.section, languages)
        return docs.select("export_id", "lang", "content")

    return run


def section_queries() -> dict[str, Query]:
    sections = {f"section_{s.key}": _section(s) for s in SECTIONS}
    documents = {f"document_{d.section}": _document(d) for d in DOCUMENTS}
    return sections | documents


def section_sql() -> dict[str, str]:
    from dossier_checks.sql_sections import DOCUMENT_SQL, SECTION_SQL

    return {f"section_{k}": v for k, v in SECTION_SQL.items()} | {
        f"document_{k}": v for k, v in DOCUMENT_SQL.items()
    }
