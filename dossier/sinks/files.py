"""Sinks: document tables, file trees, issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.text import is_safe_file_name
from dossier.sinks.tree import NAME, DocumentTree

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Documents that enter Python at a time; each is at most one part long.
BATCH_DOCUMENTS = "8"


def write_documents(docs: DataFrame, path: str) -> None:
    """Parquet, partitioned by section; adaptive execution sizes the files of each section."""
    docs.hint("rebalance", "section").write.mode("overwrite").partitionBy("section").parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that an earlier run wrote, in whatever store it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def folders(spark: SparkSession, path: str, marker: str | None = None) -> list[str]:
    """Names of the folders in a folder, of those that hold a file ``marker`` if one is given."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(hadoop(path)) if s.isDirectory()]
    return [n for n in names if marker is None or fs.exists(hadoop(f"{path}/{n}/{marker}"))]


def write_issues(issues: DataFrame, path: str) -> None:
    issues.write.mode("overwrite").parquet(path)


def unsafe_documents(docs: DataFrame) -> DataFrame:
    """Issues for documents whose export or file name would leave the output directory."""
    safe = is_safe_file_name(F.col("export_id")) & is_safe_file_name(F.col("file_name"))
    return docs.filter(~safe).select(
        "export_id",
        F.lit("write").alias("stage"),
        "section",
        F.lit(None).cast("long").alias("row_no"),
        F.lit("unsafe file name").alias("message"),
    )


def export_files(docs: DataFrame, root: str, language: str = "en") -> None:
    """One ``<export_id>/<file_name>`` per document of one language, below a path or URI of any file
    system Arrow reaches (:mod:`dossier.sinks.tree`). A document of many parts is one file: its
    parts meet in one task, which streams them in order. Files that are there already are replaced.
    """
    spark = docs.sparkSession
    chosen = docs.filter(F.col("lang") == language).filter(
        is_safe_file_name(F.col("export_id")) & is_safe_file_name(F.col("file_name"))
    )
    ordered = (
        chosen.select("export_id", "file_name", "part_no", "content")
        .repartition("export_id", "file_name")
        .sortWithinPartitions("export_id", "file_name", "part_no")
    )
    spark.dataSource.register(DocumentTree)
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, BATCH_DOCUMENTS)
    try:
        ordered.write.format(NAME).mode("append").save(root)
    finally:
        spark.conf.set(ARROW_ROWS, before)
