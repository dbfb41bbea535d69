"""Incremental conversion of archives as they arrive.

Every operator works per export and an archive arrives whole, so a micro-batch runs the batch plan
on its new archives and writes its tables under its batch id. Which batch holds an export's newest
archive, by (modification time, path), is the stream's only state: a snapshot per batch, one narrow
row per export, written when the batch's documents are. So

* of several archives of an export in a batch the newest one is converted, and one that is older than
  what has been converted is not; both are told as issues,
* a replayed batch starts from the snapshot before it and writes the same tables again,
* readers need the newest whole snapshot alone, whatever number of batches there were; a batch of
  which nothing is current any more can be dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dossier.plans.convert import Output, convert_raw
from dossier.sinks.files import folders, remove, unsafe_documents, write_issues
from dossier.sources import arrivals
from dossier.sources.archives import (
    ExportId,
    export_id_of,
    listed_archives,
    read_raw,
    rejected,
    row_issues,
    write_raw_by_ranges,
)
from dossier.sources.ranges import LISTING

BATCH = "batch"
VERSION = "version"

#: Per export the newest archive that was converted, and the batch that did.
CURRENT = f"export_id string, modified timestamp, path string, {BATCH} long"


def _current_path(out: str) -> str:
    return f"{out.rstrip('/')}/current"


def _versions(spark: SparkSession, out: str) -> list[int]:
    """Batches whose snapshot is whole, in order."""
    found = folders(spark, _current_path(out), marker="_SUCCESS")
    return sorted(int(f.removeprefix(f"{VERSION}=")) for f in found if f.startswith(f"{VERSION}="))


def current_exports(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """The newest snapshot, or the newest of those before a batch."""
    versions = [v for v in _versions(spark, out) if before is None or v < before]
    if not versions:
        return spark.createDataFrame([], CURRENT)
    return spark.read.schema(CURRENT).parquet(f"{_current_path(out)}/{VERSION}={versions[-1]}")


def _newest(archives: DataFrame, current: DataFrame) -> DataFrame:
    """Marks the archives (export_id, modified, path) with ``state``: ``new``, ``older`` than another
    of the batch or ``stale``, older than the one converted before."""
    rank = F.struct("modified", "path")
    best = archives.groupBy("export_id").agg(F.max(rank).alias("_best"))
    known = current.select("export_id", F.struct("modified", "path").alias("_known"))
    state = (
        F.when(rank < F.col("_best"), "older").when(F.col("_known") > rank, "stale").otherwise("new")
    )
    return (
        archives.join(best, "export_id")
        .join(known, "export_id", "left")
        .select("export_id", "path", "modified", state.alias("state"))
    )


def _passed_over(marked: DataFrame) -> DataFrame:
    message = F.when(
        F.col("state") == "older", "a newer archive of the export arrived with it"
    ).when(F.col("state") == "stale", "a newer archive of the export has been converted")
    return marked.filter(F.col("state") != "new").select(
        "export_id",
        F.lit("file").alias("stage"),
        F.lit(None).cast("string").alias("section"),
        F.lit(None).cast("long").alias("row_no"),
        F.concat(message, F.lit(": "), F.col("path")).alias("message"),
    )


def convert_stream(
    spark: SparkSession,
    root: str,
    out: str,
    checkpoint: str,
    languages: Sequence[str] = ("en",),
    max_bytes: int | None = None,
    export_id: ExportId = export_id_of,
    **options,
) -> StreamingQuery:
    """Start the query; it converts everything that is there and stops.

    A file is taken up when it is new or has been written over. ``export_id`` names the export of a
    path, so a newer archive may also arrive under another path (below dated folders, say).
    """
    arrivals.register(spark)
    files = (
        spark.readStream.format(arrivals.FILES)
        .option("log", f"{checkpoint.rstrip('/')}/arrivals")
        .load(root)
    )

    def convert_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        output = Output.under(out, f"/{BATCH}={batch_id}")
        batch.write.mode("overwrite").parquet(output.files)
        listed = session.read.schema(LISTING).parquet(output.files)
        known = current_exports(session, out, batch_id)
        archives = listed_archives(listed, root, max_bytes, export_id).join(
            listed.select("path", "modified"), "path"
        )
        marked = _newest(archives, known)
        new = marked.filter("state = 'new'")
        write_raw_by_ranges(
            session, new.select("export_id", "path"), root, output.raw, output.chunks
        )
        docs, failed = convert_raw(session, output, languages, **options)
        issues = (
            rejected(listed.select("path", "length"), root, max_bytes, export_id)
            .unionByName(_passed_over(marked))
            .unionByName(row_issues(read_raw(session, output.raw)))
            .unionByName(unsafe_documents(docs))
            .unionByName(failed)
        )
        write_issues(issues, output.issues)
        # readable or not, the newest archive replaces the export's documents
        added = new.select("export_id", "modified", "path", F.lit(batch_id).cast("long").alias(BATCH))
        kept = known.join(added, "export_id", "left_anti")
        kept.unionByName(added).write.mode("overwrite").parquet(
            f"{_current_path(out)}/{VERSION}={batch_id}"
        )
        for version in _versions(session, out)[:-2]:  # a replay needs the one before
            remove(session, f"{_current_path(out)}/{VERSION}={version}")

    return (
        files.writeStream.foreachBatch(convert_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_documents(spark: SparkSession, out: str) -> DataFrame:
    """The documents of every export's newest archive."""
    docs = spark.read.parquet(f"{out.rstrip('/')}/documents")
    current = current_exports(spark, out).select("export_id", BATCH)
    return docs.join(current, ["export_id", BATCH], "left_semi")


def drop_replaced(spark: SparkSession, out: str) -> list[int]:
    """Deletes the tables of batches of which no export is current, and names these batches."""
    held = {r[BATCH] for r in current_exports(spark, out).select(BATCH).distinct().collect()}
    tables = vars(Output.under(out)).values()
    written = {
        int(f.removeprefix(f"{BATCH}="))
        for table in tables
        for f in folders(spark, table)
        if f.startswith(f"{BATCH}=")
    }
    versions = _versions(spark, out)
    gone = sorted(b for b in written - held if versions and b <= versions[-1])
    for batch in gone:
        for table in tables:
            remove(spark, f"{table}/{BATCH}={batch}")
    return gone
