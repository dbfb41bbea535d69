"""Archives read by ranges: any size, only what is needed, dealt by entries."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from dossier import DOCUMENTS, convert
from dossier.sources import ranges, stores
from dossier.sources.archives import (
    accepted,
    archive_files,
    listed_archives,
    read_raw,
    write_raw,
    write_raw_by_ranges,
)

RANDOM = random.Random(5)


def zipped(files, method=zipfile.ZIP_DEFLATED):
    target = io.BytesIO()
    with zipfile.ZipFile(target, "w", method) as archive:
        for name, text in files:
            archive.writestr(name, text)
    return target.getvalue()


def noise(n):
    return "".join(RANDOM.choices("abcdefghij klmnop,", k=n))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("in dir")
    many = [(f"d{k}/Table {k % 12}.csv", f"A,B\n{k},{noise(200)}\n" * 20) for k in range(2000)]
    (root / "many.zip").write_bytes(zipped([*many, ("Skills.csv", "Name\nof many\n")]))
    (root / "sub").mkdir()
    (root / "sub" / "small.zip").write_bytes(zipped([("Skills.csv", "Name\nsmall\n")]))
    (root / "sub" / "deeper").mkdir()
    (root / "sub" / "deeper" / "x.zip").write_bytes(zipped([("Skills.csv", "Name\ndeep\n")]))
    (root / "_hidden").mkdir()
    (root / "_hidden" / "y.zip").write_bytes(zipped([("Skills.csv", "Name\nhidden\n")]))
    late = [(f"{k}/T{k % 6}.csv", f"A\n{noise(3000)}\n") for k in range(30)]
    (root / "late.zip").write_bytes(zipped([*late, ("Bad.csv", b"A\n\xff\n"), ("Worse.csv", b"A\n\xfe\n")]))
    damaged = bytearray(zipped([(f"{k}/T{k % 6}.csv", f"A\n{noise(3000)}\n") for k in range(30)], zipfile.ZIP_STORED))
    damaged[40_000] ^= 1
    (root / "crc.zip").write_bytes(damaged)
    (root / "junk.zip").write_bytes(b"junk")
    (root / "void.zip").write_bytes(b"")
    return root


@pytest.mark.parametrize("chunk_bytes", [4000, ranges.CHUNK_BYTES])
def test_same_rows_as_whole_archives(spark, root, tmp_path, chunk_bytes):
    whole = archive_files(spark, str(root)).filter(~F.col("path").contains("_hidden"))
    write_raw(spark, accepted(whole.filter("length > 0"), str(root)), str(tmp_path / "whole"))
    files = ranges.listing(spark, str(root))
    write_raw_by_ranges(
        spark, listed_archives(files, str(root)), str(root), str(tmp_path / "raw"),
        str(tmp_path / "chunks"), chunk_bytes=chunk_bytes,
    )
    dealt = spark.read.parquet(str(tmp_path / "chunks"))
    found = {r.export_id: r["n"] for r in dealt.groupBy("export_id").agg(F.count("*").alias("n")).collect()}
    assert (found["many"] > 20 and found["late"] > 10) if chunk_bytes == 4000 else set(found.values()) == {1}

    def rows(name):
        shown = read_raw(spark, str(tmp_path / name)).withColumn("cells", F.to_json("cells"))
        return sorted(shown.collect(), key=repr)

    got, want = rows("raw"), rows("whole")
    assert got == want and len(got) > 240
    rejected = {r.export_id: r.defect for r in got if r.table_key == "_rejected"}
    assert set(rejected) == {"late", "crc", "junk"} and "0xff" in rejected["late"]
    assert not [r for r in got if r.export_id in rejected and r.table_key != "_rejected"]


def test_listing_names_empty_files(spark, root):
    base = f"file://{root}"  # as Spark reads it, nothing is decoded
    listed = {r.path: r.length for r in ranges.listing(spark, base).collect()}
    assert listed[f"{base}/void.zip"] == 0 and f"{base}/sub/deeper/x.zip" in listed
    assert not any("_hidden" in p for p in listed) and len(listed) == 7


def test_only_what_is_needed_is_fetched(root, tmp_path, monkeypatch):
    made = []

    class Counted(stores.Ranges):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

    monkeypatch.setattr(stores, "Ranges", Counted)
    monkeypatch.setattr(stores, "FETCH", 4096)
    pictures = [(f"p{k}.jpg", RANDOM.randbytes(100_000)) for k in range(20)]
    path = tmp_path / "a.zip"
    path.write_bytes(zipped([*pictures[:10], ("Big.csv", "A\n" + noise(400_000)), *pictures[10:],
                             ("Skills.csv", "Name\nx\n")]))
    fs, name = stores.file_system(str(path))

    def chunks(tables):
        with zipfile.ZipFile(stores.opened(fs, name)) as archive:
            return ranges._chunked(archive, tables, 1 << 20)

    assert [n for n, _ in chunks(None)] == [[10, 21]] and [n for n, _ in chunks(["skills"])] == [[21]]
    assert sum(f.fetched for f in made) < 60_000  # directories only
    made.clear()
    with zipfile.ZipFile(stores.opened(fs, name)) as archive:
        list(ranges.entries.entry_batches(archive, "a", [21]))
    assert sum(f.fetched for f in made) < 60_000  # neither pictures nor the other table


def test_archive_beyond_two_gigabytes(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    with open(source / "huge.zip", "wb") as f:
        f.seek(2_300_000_000)  # a sparse file; archives may follow other data
        f.write(zipped([("Skills.csv", "Name\nGo\n"), ("Profile.csv", "First Name,Last Name\nA,B\n")]))
    catalog = [d for d in DOCUMENTS if d.section in ("profile", "skills")]
    out = convert(spark, str(source), str(tmp_path / "out"), catalog=catalog)
    docs = {(r.export_id, r.section): r.content for r in spark.read.parquet(out.documents).collect()}
    assert docs == {("huge", "skills"): "# Skills\n\nGo\n", ("huge", "profile"): "# A B\n"}
    assert spark.read.parquet(out.issues).count() == 0


def test_named_tables_alone_are_read(spark, root, tmp_path):
    """A fault in a table that is not asked for does not matter."""
    files = ranges.listing(spark, str(root)).filter("path like '%late.zip'")
    write_raw_by_ranges(
        spark, listed_archives(files, str(root)), str(root), str(tmp_path / "raw"),
        str(tmp_path / "chunks"), tables=["t3", "t4"],
    )
    assert {r.table_key for r in read_raw(spark, str(tmp_path / "raw")).collect()} == {"t3", "t4", "_archive"}
