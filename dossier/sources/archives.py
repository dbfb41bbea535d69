"""Archive ingest: a directory of ZIP files of CSV tables to the partitioned raw table."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.fixed import READABLE_BYTES
from dossier.functions.text import is_safe_file_name
from dossier.sources import entries, ranges, stores
from dossier.sources.raw import RAW_SCHEMA

# Executors need no installed copy of the readers.
for module in (entries, ranges, stores):
    cloudpickle.register_pickle_by_value(module)

ZIP_GLOB = "*.[zZ][iI][pP]"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of archives that enter Python at once (a larger archive alone).
ARCHIVE_BYTES = "4m"


def export_id_of(path: Column, root: str) -> Column:
    """Path below ``root`` without ``.zip``; unique, because any other spelling is kept."""
    base = root.rstrip("/").replace("file://", "") + "/"
    start = F.instr(path, base)
    below = F.when(start > 0, path.substr(start + len(base), F.length(path))).otherwise(
        F.substring_index(path, "/", -1)
    )
    return F.regexp_replace(below, r"\.zip$", "")


# Names the export of a path below a root. Two files of one batch must not share a name.
ExportId = Callable[[Column, str], Column]


def archive_files(spark: SparkSession, root: str) -> DataFrame:
    """ZIP files below ``root``; ``content`` is only read when it is selected."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", ZIP_GLOB)
        .load(root)
    )


def accepted(
    files: DataFrame,
    root: str,
    max_bytes: int | None = READABLE_BYTES,
    export_id: ExportId = export_id_of,
    column: str = "content",
) -> DataFrame:
    """Files within the size limit under a safe name. The size filter reaches the scan."""
    small = files if max_bytes is None else files.filter(F.col("length") <= max_bytes)
    return small.select(
        export_id(F.col("path"), root).alias("export_id"), column
    ).filter(is_safe_file_name(F.col("export_id")))


def listed_archives(
    files: DataFrame,
    root: str,
    max_bytes: int | None = None,
    export_id: ExportId = export_id_of,
) -> DataFrame:
    """Of listed files (path, length), the archives to read: export_id and path."""
    zips = files.filter(F.col("path").rlike(r"(?i)\.zip$") & (F.col("length") > 0))
    return accepted(zips, root, max_bytes, export_id, "path")


def raw_rows(archives: DataFrame) -> DataFrame:
    """CSV rows of (export_id, content). One archive is the unit of work of a task.

    Sets the session's bytes per Arrow batch, so that a worker's memory follows neither the rows of
    a partition nor those of a batch.
    """
    archives.sparkSession.conf.set(ARROW_BYTES, ARCHIVE_BYTES)
    return archives.select("export_id", "content").mapInArrow(
        entries.read_batches, RAW_SCHEMA
    )


def _empty_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Files of no length, which a scan leaves out. The paths come from the file index, which the
    driver holds for the scan in any case; they are percent-encoded there."""
    listed = spark.createDataFrame([(p,) for p in files.inputFiles()], "uri string")
    decoded = F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B")))
    paths = listed.select(F.regexp_replace(decoded, "^([^:/]+):/+", "$1:/").alias("path"))
    scanned = files.select(F.regexp_replace("path", "^([^:/]+):/+", "$1:/").alias("path"))
    return paths.join(scanned, "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"))


def rejected_files(
    spark: SparkSession,
    root: str,
    max_bytes: int | None = READABLE_BYTES,
    export_id: ExportId = export_id_of,
) -> DataFrame:
    """Issues of files that are never opened, from the listing alone (no content is read)."""
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ).select("path", "length")
    return rejected(listing.unionByName(_empty_files(spark, listing)), root, max_bytes, export_id)


def rejected(
    files: DataFrame,
    root: str,
    max_bytes: int | None = READABLE_BYTES,
    export_id: ExportId = export_id_of,
) -> DataFrame:
    """Issues of the files (path, length) that are not opened."""
    reason = (
        F.when(~F.col("path").rlike(r"(?i)\.zip$"), "not a .zip file")
        .when(
            F.lit(False) if max_bytes is None else F.col("length") > max_bytes,
            "archive exceeds the size limit",
        )
        .when(F.col("length") == 0, "empty file")
        .when(~is_safe_file_name(export_id(F.col("path"), root)), "unsafe export name")
    )
    return files.select(
        export_id(F.col("path"), root).alias("export_id"),
        F.lit("file").alias("stage"),
        F.lit(None).cast("string").alias("section"),
        F.lit(None).cast("long").alias("row_no"),
        reason.alias("message"),
    ).filter(F.col("message").isNotNull())


def write_raw(
    spark: SparkSession,
    archives: DataFrame,
    path: str,
    compact: bool = True,
    tables: Collection[str] | None = None,
) -> None:
    """Write the raw table of archives (export_id, content), partitioned by table key.

    ``tables`` keeps those tables only, which bounds the number of directories where archives
    carry many CSV files no section reads.

    Archives enter Python one per Arrow batch. The batch size is a session setting and is put back.
    """
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, "1")
    try:
        _write_rows(raw_rows(archives), path, compact, tables)
    finally:
        spark.conf.set(ARROW_ROWS, before)


def _write_rows(rows: DataFrame, path: str, compact: bool, tables: Collection[str] | None) -> None:
    """``compact`` moves rows by table key first, so a table is few large files instead of one small
    file per task; adaptive execution splits the tables that hold most of the rows."""
    if tables is not None:
        kept = [*tables, entries.ARCHIVE, entries.REJECTED]
        rows = rows.filter(F.col("table_key").isin(*kept))
    if compact:
        rows = rows.hint("rebalance", "table_key")
    rows.write.mode("overwrite").partitionBy("table_key").parquet(path)


def write_raw_by_ranges(
    spark: SparkSession,
    archives: DataFrame,
    root: str,
    path: str,
    chunks_path: str,
    compact: bool = True,
    tables: Collection[str] | None = None,
    chunk_bytes: int = ranges.CHUNK_BYTES,
) -> None:
    """The same from archives (export_id, path) below ``root``, of which only the ranges that hold
    CSV entries (with ``tables``, of those) are read. The chunks are stored, so that directories are
    read once."""
    found = ranges.chunks(archives, root, tables, chunk_bytes)
    found.write.mode("overwrite").parquet(chunks_path)
    dealt = spark.read.schema(ranges.CHUNKS).parquet(chunks_path)
    _write_rows(ranges.rows_of_chunks(dealt, root), path, compact, tables)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMA).parquet(path)


def row_issues(raw: DataFrame) -> DataFrame:
    """Unreadable archives and defective rows, from the flag set while reading."""
    return raw.filter(F.col("defect").isNotNull()).select(
        "export_id",
        F.when(F.col("table_key") == entries.REJECTED, "archive").otherwise("row").alias("stage"),
        F.when(F.col("table_key") != entries.REJECTED, F.col("table_key")).alias("section"),
        F.when(F.col("table_key") != entries.REJECTED, F.col("row_no")).alias("row_no"),
        F.col("defect").alias("message"),
    )
