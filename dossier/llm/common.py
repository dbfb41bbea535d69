"""What the operators share: the shared folder, written tables, and reading text columns."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts name it: blank, and tab to carriage return.
BLANK = r"[\x20\x09-\x0D]+"

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors see alike.

    Only a local session without that setting gets a temporary folder of its own, which goes with
    the driver; elsewhere the setting is required, since executors do not share local disks.
    """
    global _own_folder
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if _own_folder is None:
            _own_folder = tempfile.mkdtemp(prefix="dossier-llm-")
            atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
        base = _own_folder
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder: cuts the lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of :func:`stored` that nothing returned to the caller reads any more."""
    for table in tables:
        delete(table.sparkSession, table._stored_at)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder below the shared one, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def without_spent_shuffles(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``run(docs, ...)``, of whose jobs the shuffle files go when a job ends.

    Else they stay until the driver happens to collect its garbage. The setting is put back.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    @functools.wraps(run)
    def tidy(docs: DataFrame, *arguments, **options):
        conf = docs.sparkSession.conf
        before = conf.get(name)
        conf.set(name, "true")
        try:
            return run(docs, *arguments, **options)
        finally:
            conf.set(name, before)

    return tidy


def small_batches(spark: SparkSession) -> None:
    """Lets Python workers get texts in batches of few MB, so that a task's memory stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def release() -> None:
    """Gives memory that this process no longer uses back to the system.

    Python workers are reused, so what a task leaves would stay beside the tasks after it.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """``run``, with :func:`release` after its last row."""

    @functools.wraps(run)
    def whole(*arguments):
        yield from run(*arguments)
        release()

    return whole


def named(column: str) -> Column:
    """A column by its name, whatever characters that holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def as_row(df: DataFrame) -> Column:
    """All columns in one, ``row``, so that no name of theirs meets a name of an operator."""
    return F.struct(*[named(c).alias(c) for c in df.columns]).alias("row")


def from_row(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns that :func:`as_row` put into one."""
    return df.select(*[F.col("row")[c].alias(c) for c in names])


def whole_text(text: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def text_batches(
    batches: Iterator[pa.RecordBatch], text: int = 1, rows: int = 1000
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of at most ``rows`` rows with their texts as UTF-8 bytes, null as empty."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            column = part.column(text).cast(pa.binary())
            yield part, [x or b"" for x in column.to_pylist()]


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
