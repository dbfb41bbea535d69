"""Rendered rows of all sections, where a section that fails stops no other.

The catalog is dealt into groups, each a job of its own, several side by side. A group that fails is
run again section by section. A section that fails on its own is narrowed down by the hash of the
export, so that one export's rows cost that export the section and no other; one that also fails
without rows, or in every part of the exports, is left out whole. What is left out is told as issues.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from dossier.plans.section import Document
from dossier.sinks.files import remove

#: Rendered rows and the bytes of their text, as they are stored.
LINE_SCHEMA = "export_id string, section string, lang string, ord long, text string, bytes int"

#: Jobs of the catalog, and how many of them run side by side.
GROUPS = 6
SIDE_BY_SIDE = 3

#: Parts into which the exports of a failing section are dealt, again and again until a part holds
#: one export; after so many levels (16^6 parts) all exports of a part are left out.
PARTS = 16
LEVELS = 6

Render = Callable[[Sequence[Document], DataFrame], DataFrame]


@dataclass(frozen=True)
class Failure:
    """A section left out: whole, or for the exports of one part (``part`` of ``PARTS ** level``)."""

    section: str
    message: str
    level: int = 0
    part: int = 0


def reason(error: BaseException) -> str:
    """One line that says what went wrong: the last error of a Python traceback, if there is one."""
    lines = [line.strip() for line in str(error).splitlines() if line.strip()]
    raised = [x for x in lines if re.match(r"[\w.]*(Error|Exception)\b.*: ", x)]
    if "Traceback (most recent call last):" in lines and raised:
        return raised[-1]
    return f"{type(error).__name__}: {lines[0] if lines else ''}"


def _part(level: int, part: int) -> Column:
    return F.pmod(F.xxhash64("export_id"), F.lit(PARTS**level)) == part


class _Writer:
    """Writes rendered rows below ``path``, one folder per job that succeeds."""

    def __init__(self, raw: DataFrame, tables: dict[str, Sequence[str]], render: Render, path: str):
        self.raw, self.tables, self.render, self.path = raw, tables, render, path
        self.spark = raw.sparkSession

    def _write(self, catalog: Sequence[Document], raw: DataFrame, name: str) -> str | Exception:
        """The folder written, or why there is none."""
        folder = f"{self.path}/{name}"
        try:
            self.render(catalog, raw).write.mode("overwrite").parquet(folder)
        except Exception as error:
            if self.spark.sparkContext._jsc.sc().isStopped():
                raise
            return error
        return folder

    def _one_export(self, section: str, raw: DataFrame) -> bool:
        keys = list(self.tables.get(section, ()))
        rows = raw.filter(F.col("table_key").isin(keys)) if keys else raw
        return rows.select("export_id").distinct().limit(2).count() < 2

    def _narrow(self, document: Document, level: int, part: int) -> tuple[list[str], list[Failure]]:
        """What a failing section yields for the exports of one part, its own parts apart."""
        below, parts = level + 1, [part + k * PARTS**level for k in range(PARTS)]

        def write(at: int) -> str | Exception:
            raw = self.raw.filter(_part(below, at))
            return self._write([document], raw, f"section={document.section}-{below}-{at}")

        with ThreadPoolExecutor(max_workers=SIDE_BY_SIDE) as pool:
            done = list(pool.map(inheritable_thread_target(self.spark)(write), parts))
        written = [x for x in done if isinstance(x, str)]
        failures = [
            Failure(document.section, reason(x), below, at)
            for at, x in zip(parts, done, strict=True)
            if not isinstance(x, str)
        ]
        if level == 0 and len(failures) == PARTS:
            return [], [Failure(document.section, failures[0].message)]
        found: list[Failure] = []
        for failure in failures:
            raw = self.raw.filter(_part(failure.level, failure.part))
            if failure.level >= LEVELS or self._one_export(document.section, raw):
                found.append(failure)
                continue
            more, left = self._narrow(document, failure.level, failure.part)
            written += more
            found += left
        return written, found

    def section(self, document: Document) -> tuple[list[str], list[Failure]]:
        done = self._write([document], self.raw, f"section={document.section}")
        if isinstance(done, str):
            return [done], []
        without = self._write([document], self.raw.filter(F.lit(False)), f"none={document.section}")
        if not isinstance(without, str):
            return [], [Failure(document.section, reason(done))]
        return self._narrow(document, 0, 0)

    def group(self, number: int, catalog: Sequence[Document]) -> tuple[list[str], list[Failure]]:
        # with fair scheduling, groups side by side share the executors
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"sections-{number}")
        done = self._write(catalog, self.raw, f"group={number}")
        if isinstance(done, str):
            return [done], []
        results = [self.section(document) for document in catalog]
        return [p for paths, _ in results for p in paths], [f for _, fs in results for f in fs]


def write_lines(
    raw: DataFrame,
    catalog: Sequence[Document],
    tables: dict[str, Sequence[str]],
    render: Render,
    path: str,
    groups: int = GROUPS,
    side_by_side: int = SIDE_BY_SIDE,
) -> tuple[DataFrame, list[Failure]]:
    """Stores what ``render`` makes of the catalog's documents; the stored rows, and what failed.

    ``tables`` names the tables of each section. A run that fails at one place leaves no rows of
    it: a folder counts only if its job succeeded.
    """
    spark = raw.sparkSession
    remove(spark, path)
    writer = _Writer(raw, tables, render, path)
    dealt = [catalog[k::groups] for k in range(groups) if catalog[k::groups]]
    with ThreadPoolExecutor(max_workers=max(1, side_by_side)) as pool:
        run = inheritable_thread_target(spark)(writer.group)
        results = list(pool.map(run, range(len(dealt)), dealt))
    written = [p for paths, _ in results for p in paths]
    failures = [f for _, fs in results for f in fs]
    if not written:
        return spark.createDataFrame([], LINE_SCHEMA), failures
    return spark.read.schema(LINE_SCHEMA).parquet(*written), failures


def section_issues(
    raw: DataFrame, failures: Sequence[Failure], tables: dict[str, Sequence[str]]
) -> DataFrame:
    """Issues of the sections that were left out; of a part of the exports, one per export."""
    spark: SparkSession = raw.sparkSession
    schema = "export_id string, stage string, section string, row_no long, message string"
    whole = [(None, "section", f.section, None, f.message) for f in failures if not f.level]
    issues = spark.createDataFrame(whole, schema)
    for failure in failures:
        if failure.level:
            keys = list(tables.get(failure.section, ()))
            rows = raw.filter(F.col("table_key").isin(keys)) if keys else raw
            exports = rows.filter(_part(failure.level, failure.part)).select("export_id").distinct()
            issues = issues.unionByName(
                exports.select(
                    "export_id",
                    F.lit("section").alias("stage"),
                    F.lit(failure.section).alias("section"),
                    F.lit(None).cast("long").alias("row_no"),
                    F.lit(failure.message).alias("message"),
                )
            )
    return issues
