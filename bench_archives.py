"""Archives per second of the whole conversion.

Exports are derived from the test tables: one archive per document of ``$BENCH_SF_DIR``, with
profile, position, post, skill and message tables. ``python bench_archives.py [work_dir]``.
"""

from __future__ import annotations

import csv
import io
import json
import os
import sys
import tempfile
import time
import zipfile

from dossier import convert
from pyspark.sql import SparkSession



def _table(header, rows) -> str:
    out = io.StringIO()
    csv.writer(out).writerows([header, *rows])
    return out.getvalue()


def _write_archives(root: str):
    def write(rows):
        for r in rows:
            lines = [line for line in r.text.split("\n") if line]
            words = r.text.split()
            with zipfile.ZipFile(f"{root}/{r.doc_id}.zip", "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("Profile.csv", _table(["First Name", "Last Name", "Headline", "Summary"], [[r.source, r.lang, r.source, r.text]]))
                z.writestr("Skills.csv", _table(["Name"], [[w] for w in words]))
                z.writestr("Positions.csv", _table(["Company Name", "Title", "Description", "Started On"], [[r.source, line, line, "2020-01"] for line in lines]))
                z.writestr("Shares.csv", _table(["Date", "ShareCommentary"], [["2024", line] for line in lines]))
                z.writestr("messages.csv", _table(["DATE", "FROM", "TO", "CONTENT"], [[str(i), "a", "b", line] for i, line in enumerate(lines)]))

    return write


def main(work: str) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    os.makedirs(f"{work}/in", exist_ok=True)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(int(cpus)).foreachPartition(_write_archives(f"{work}/in"))
    n = docs.count()
    started = time.perf_counter()
    out = convert(spark, f"{work}/in", f"{work}/out", ("en", "es"))
    seconds = time.perf_counter() - started
    made = spark.read.parquet(out.documents).count()
    spark.stop()
    print(json.dumps({"metric": "archives_per_sec", "value": round(n / seconds, 1), "unit": "1/sec", "archives": n, "documents": made, "sec": round(seconds, 1)}))


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else tempfile.mkdtemp(prefix="run-", dir="/tmp"))
