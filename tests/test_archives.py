"""Ingest, conversion, sinks and incremental runs on generated archives."""

import io
import os
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dossier import DOCUMENTS, convert
from dossier.sinks.files import export_files
from dossier.sources import entries
from dossier.sources.archives import accepted, archive_files, raw_rows, read_raw, row_issues, write_raw
from dossier.streaming.incremental import (
    convert_stream,
    current_exports,
    drop_replaced,
    latest_documents,
)

SMALL = [d for d in DOCUMENTS if d.section in ("profile", "skills", "connections")]


def pack(path, files):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in files:
            archive.writestr(name, text)


def profile(first, last="García"):
    return ("Profile.csv", f"First Name,Last Name,Headline,Summary\n{first},{last},Dev,\"a, b\"\n")


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    pack(root / "ana.zip", [
        profile("José 🚀"),
        ("x/y/Connections.csv", "Notes:\n\"skip, this\"\n\nFirst Name,Last Name,Company\nA,B,\"C\nD\"\n\nE,F\n,,G,extra\n"),
        ("old/Skills.csv", "Name\nshadowed\n"),
        ("Skills.csv", "﻿Name,Name\r\nx,Go\r\ny,Rust (go)\r\n"),
        ("Notes.csv", "Notes: only\nnothing here\n"),
        ("Ignored.CSV", "Name\nno\n"),
        ("readme.txt", "no"),
    ])
    pack(root / "team" / "bo.ZIP", [profile("Bo"), ("Blank.csv", "\nName\nv\n")])
    pack(root / "empty.zip", [("Skills.csv", "Name\n")])
    pack(root / "none.zip", [])
    pack(root / "large.zip", [("Profile.csv", "First Name,Last Name,Summary\nL,M," + "A" * 100_000 + "\n")])
    pack(root / "latin.zip", [("Skills.csv", "Name\nn\xf1".encode("latin-1"))])
    pack(root / "shadow.zip", [("a/Skills.csv", b"\xff\xfe"), ("Skills.csv", "Name\nok\n")])
    (root / "junk.zip").write_bytes(b"not a zip")
    (root / "void.zip").write_bytes(b"")
    (root / "cut.zip").write_bytes((root / "large.zip").read_bytes()[:40])
    (root / "note.txt").write_text("x")
    (root / "sub +dir%20").mkdir()
    (root / "sub +dir%20" / "nil.zip").write_bytes(b"")
    pack(root / "a..b.zip", [profile("Dots")])
    pack(root / "heavy.zip", [("Skills.csv", "Name\n" + "\n".join(str(i * i * 7919) for i in range(20_000)))])
    return root


@pytest.fixture(scope="module")
def converted(spark, root, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    return convert(spark, str(root), out, ("en", "es"), max_bytes=50_000, catalog=SMALL)


def rows(spark, converted, export, key):
    raw = read_raw(spark, converted.raw)
    found = raw.filter((F.col("export_id") == export) & (F.col("table_key") == key)).orderBy("row_no")
    return found.collect()


def test_rows_follow_csv_rules(spark, converted):
    found = rows(spark, converted, "ana", "connections")
    assert [(r.row_no, dict(r.cells), r.overflow, r.defect) for r in found] == [
        (0, {"First Name": "A", "Last Name": "B", "Company": "C\nD"}, None, None),
        (1, {"First Name": "E", "Last Name": "F", "Company": None}, None, "short row"),
        (2, {"First Name": "", "Last Name": "", "Company": "G"}, ["extra"], "extra cells"),
    ]
    assert found[0].header == ["First Name", "Last Name", "Company"]
    skills = rows(spark, converted, "ana", "skills")
    assert [dict(r.cells) for r in skills] == [{"Name": "Go"}, {"Name": "Rust (go)"}]
    assert {r.entry_idx for r in skills} == {3}
    assert [dict(r.cells) for r in rows(spark, converted, "ana", "notes")] == [{"Notes: only": "nothing here"}]
    blank = rows(spark, converted, "team/bo.ZIP", "blank")
    assert [(r.overflow, r.defect) for r in blank] == [(["Name"], "blank header"), (["v"], "blank header")]


def test_documents_of_all_readable_archives(spark, converted):
    docs = spark.read.parquet(converted.documents).collect()
    by = {(r.export_id, r.section, r.lang): r.content for r in docs}
    assert by["ana", "profile", "en"] == "# José 🚀 García\n\n**Dev**\n\n## Summary\n\na, b\n"
    assert by["ana", "skills", "es"] == "# Skills\n\nGo\n"
    assert by["ana", "connections", "en"] == (
        "# Connections\n\n| Name | Company | Position | Connected |\n|------|---------|----------|-----------|\n"
        "| A B | C\nD |  |  |\n| E F |  |  |  |\n"
    )
    assert "A" * 100_000 in by["large", "profile", "en"]
    assert {e for e, _, _ in by} == {"ana", "team/bo.ZIP", "large"}
    assert all(r.whole and r.part_no == 0 for r in docs)


def test_issues_cover_what_was_left_out(spark, converted):
    issues = {(r.export_id, r.stage, r.section, r.row_no): r.message for r in spark.read.parquet(converted.issues).collect()}
    for export in ("junk", "cut", "latin", "shadow"):
        assert issues[export, "archive", None, None].startswith("invalid or corrupted archive")
    assert issues["note.txt", "file", None, None] == "not a .zip file"
    assert issues["a..b", "file", None, None] == "unsafe export name"
    assert issues["void", "file", None, None] == "empty file"
    assert issues["heavy", "file", None, None] == "archive exceeds the size limit"
    assert issues["ana", "row", "connections", 1] == "short row"
    assert issues["ana", "row", "connections", 2] == "extra cells"
    assert issues["team/bo.ZIP", "row", "blank", 0] == "blank header"
    assert issues["sub +dir%20/nil", "file", None, None] == "empty file"
    assert len(issues) == 13


def test_manifest_lists_files(spark, converted):
    listed = {r.export_id: (r.n_files, r.files) for r in spark.read.parquet(converted.manifest).collect()}
    assert listed == {
        "ana": (3, ["connections.md", "profile.md", "skills.md"]),
        "team/bo.ZIP": (1, ["profile.md"]),
        "large": (1, ["profile.md"]),
    }


def test_file_tree_and_repeat(spark, converted, tmp_path):
    docs = spark.read.parquet(converted.documents)
    for _ in range(2):
        export_files(docs, str(tmp_path / "deep" / "tree"), "en")
    files = {str(p.relative_to(tmp_path / "deep" / "tree")): p for p in (tmp_path / "deep").rglob("*") if p.is_file()}
    assert sorted(files) == [
        "ana/connections.md", "ana/profile.md", "ana/skills.md", "large/profile.md", "team/bo.ZIP/profile.md",
    ]
    assert files["ana/skills.md"].read_text(encoding="utf-8") == "# Skills\n\nGo\n"


def test_unsafe_names_are_not_written(spark, tmp_path):
    docs = spark.createDataFrame(
        [("../up", "s", "en", "s.md", 0, True, "x"), ("ok", "s", "en", "/s.md", 0, True, "x")],
        "export_id string, section string, lang string, file_name string, part_no long, whole boolean, content string",
    )
    export_files(docs, str(tmp_path / "in"), "en")
    assert not list(tmp_path.rglob("*.md"))


def test_size_limit_reaches_the_scan_and_content_is_pruned(spark, root):
    files = archive_files(spark, str(root))
    plan = accepted(files, str(root), 1000)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,1000)" in plan
    listing = files.select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in listing


def test_table_filter_prunes_partitions(spark, converted):
    from dossier.sources.raw import get_table

    plan = get_table(read_raw(spark, converted.raw), ["skills"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(table_key" in plan


def test_archives_too_large_to_wait_are_read_twice(spark, root, monkeypatch):
    content = (root / "heavy.zip").read_bytes()

    def counts(parts):
        return [p.num_rows if hasattr(p, "num_rows") else len(p.keys) for p in parts]

    def opened():
        return zipfile.ZipFile(io.BytesIO(content))

    kept = counts(entries.archive_batches("h", opened))
    monkeypatch.setattr(entries, "PENDING_BYTES", 10)
    assert counts(entries.archive_batches("h", opened)) == kept
    assert sum(kept) == 20_001 and len(kept) > 3


def test_arrow_batch_setting_is_put_back(spark, root, tmp_path):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    files = archive_files(spark, str(root)).filter(F.col("path").contains("junk"))
    write_raw(spark, accepted(files, str(root)), str(tmp_path / "raw"))
    assert spark.conf.get(name) == before
    assert row_issues(read_raw(spark, str(tmp_path / "raw"))).count() == 1


def test_only_named_tables_are_kept(spark, root, tmp_path):
    files = archive_files(spark, str(root)).filter(F.col("path").rlike("(ana|junk)\\.zip$"))
    write_raw(spark, accepted(files, str(root)), str(tmp_path / "raw"), tables=["skills"])
    keys = {r.table_key for r in read_raw(spark, str(tmp_path / "raw")).collect()}
    assert keys == {"skills", entries.ARCHIVE, entries.REJECTED}


def stream(spark, tmp_path, **options):
    """Runs the stream over what is there; the documents by export."""
    query = convert_stream(
        spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"),
        catalog=[d for d in DOCUMENTS if d.section == "profile"],
        export_id=lambda path, _: F.regexp_extract(path, r"([^/]+)\.zip$", 1), **options,
    )
    query.awaitTermination(300)
    assert query.exception() is None
    return profiles(spark, tmp_path)


def profiles(spark, tmp_path):
    docs = latest_documents(spark, str(tmp_path / "out")).collect()
    assert len({(r.export_id, r.section, r.lang, r.part_no) for r in docs}) == len(docs)
    return {r.export_id: r.content.splitlines()[0] for r in docs}


def dated(path, seconds):
    os.utime(path, (seconds, seconds))


def test_stream_converts_new_archives_and_replaces_old_ones(spark, tmp_path):
    source = tmp_path / "in"
    for name, first, at in (("may/a", "One", 100), ("may/b", "Two", 100), ("june/b", "Two newer", 200)):
        pack(source / f"{name}.zip", [profile(first, ""), *([("Skills.csv", "Name\nx\n")] if at == 100 else [])])
        dated(source / f"{name}.zip", at)
    (source / "void.zip").write_bytes(b"")
    assert stream(spark, tmp_path) == {"a": "# One", "b": "# Two newer"}  # two of b at once: not mixed
    issues = spark.read.parquet(str(tmp_path / "out" / "issues")).collect()
    assert {(r.export_id, r.message.split(":")[0]) for r in issues} == {
        ("void", "empty file"), ("b", "a newer archive of the export arrived with it"),
    }
    pack(source / "june 1+2" / "c.zip", [profile("Three", "")])
    pack(source / "june 1+2" / "a.zip", [profile("One again", "")])
    pack(source / "late" / "b.zip", [profile("Two stale", "")])
    dated(source / "late" / "b.zip", 150)
    expected = {"a": "# One again", "b": "# Two newer", "c": "# Three"}
    assert stream(spark, tmp_path) == expected
    assert stream(spark, tmp_path) == expected
    pack(source / "june" / "b.zip", [profile("Two written over", "")])
    assert stream(spark, tmp_path) == expected | {"b": "# Two written over"}
    assert drop_replaced(spark, str(tmp_path / "out")) == [0]
    assert profiles(spark, tmp_path) == expected | {"b": "# Two written over"}
    current = current_exports(spark, str(tmp_path / "out"))
    assert {(r.export_id, r.batch) for r in current.collect()} == {("a", 1), ("b", 2), ("c", 1)}


def test_replayed_batches_and_unreadable_replacements(spark, tmp_path):
    source = tmp_path / "in"
    pack(source / "a.zip", [profile("One", "")])
    pack(source / "b.zip", [profile("Two", "")])
    assert stream(spark, tmp_path) == {"a": "# One", "b": "# Two"}
    pack(source / "b.zip", [profile("Two again", "")])
    assert stream(spark, tmp_path) == {"a": "# One", "b": "# Two again"}
    (tmp_path / "state" / "commits" / "1").unlink()  # the batch is run once more
    (tmp_path / "state" / "commits" / ".1.crc").unlink(missing_ok=True)
    assert stream(spark, tmp_path) == {"a": "# One", "b": "# Two again"}
    (source / "a.zip").write_bytes(b"broken now")
    assert stream(spark, tmp_path) == {"b": "# Two again"}


def test_cells_of_any_length(spark, tmp_path):
    (tmp_path / "in").mkdir()
    summary = "First Name,Last Name,Summary\nL,M," + "A" * 200_000 + "\n"
    pack(tmp_path / "in" / "wide.zip", [("Profile.csv", summary), ("Skills.csv", "Name\nkept\n")])
    out = convert(spark, str(tmp_path / "in"), str(tmp_path / "out"), catalog=SMALL)
    raw = {r.table_key: dict(r.cells) for r in read_raw(spark, out.raw).collect() if r.cells}
    assert raw["profile"]["Summary"] == "A" * 200_000 and raw["skills"] == {"Name": "kept"}


def test_run_without_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "junk.zip").write_bytes(b"not a zip")
    out = convert(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert [r.export_id for r in spark.read.parquet(out.issues).collect()] == ["junk"]


def test_archives_enter_python_in_batches_of_few_bytes(spark, tmp_path):
    for k in range(20):
        pack(tmp_path / f"a{k}.zip", [("skills.csv", f"name\n{os.urandom(400_000).hex()}\n")])
    files = archive_files(spark, str(tmp_path))
    archives = accepted(files, str(tmp_path)).repartition(1)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        rows = raw_rows(archives).filter("row_no >= 0")

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

        assert rows.count() == 20
        entering = archives.mapInArrow(sizes, "n long").collect()
        assert len(entering) > 1 and sum(r.n for r in entering) == 20
    finally:
        spark.conf.set(name, before)
