"""Archives derived from the documents table: one ZIP per document, built where its row is.

Every document's archive is whole. Some documents have a second, damaged one under a name of its own.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier_checks.bindings import read

# Documents whose id is divisible by this have a damaged archive too.
DAMAGED_EVERY = 9
COLUMNS = ["First", "Second", "Third"]


def _archive(text: str) -> bytes:
    table = io.StringIO()
    writer = csv.writer(table)
    writer.writerow(COLUMNS)
    for line in text.split("\n"):
        writer.writerow(line.split("."))
    target = io.BytesIO()
    with zipfile.ZipFile(target, "w") as archive:
        archive.writestr("old/Text Lines.csv", "First\nshadowed by the later entry\n")
        archive.writestr("readme.txt", "not a table")
        archive.writestr("Text Lines.csv", 'Notes:\n"skipped, quoted"\n\n' + table.getvalue())
    return target.getvalue()


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("export_id"), batch.column("text")
        for export_id, text in zip(ids, texts):
            built = [(export_id.as_py(), _archive(text.as_py()))]
            if int(built[0][0]) % DAMAGED_EVERY == 0:
                content = built[0][1]
                built.append((f"damaged-{built[0][0]}", content[: len(content) // 2]))
            names, contents = zip(*built)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(contents, pa.binary())],
                names=["export_id", "content"],
            )


def document_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").selectExpr("CAST(doc_id AS STRING) AS export_id", "text")
    return docs.repartition(F.col("export_id")).mapInArrow(_build, "export_id string, content binary")


cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])
