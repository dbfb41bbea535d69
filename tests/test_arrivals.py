"""Archives as data sources."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from dossier import document
from dossier.sources import arrivals, entries, stores
from dossier.sources.archives import accepted, archive_files, raw_rows


def pack(path, files):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in files:
            archive.writestr(name, text)


@pytest.fixture
def root(tmp_path):
    root = tmp_path / "in"
    pack(root / "a.zip", [("Skills.csv", "Name\nGo\nSQL\n"), ("Profile.csv", "First Name,Last Name\nA,B\n")])
    pack(root / "x" / "b.ZIP", [("Skills.csv", "Name\nRust,more\n"), ("Broken.csv", b"A\n\xff\n")])
    pack(root / "x" / "c.zip", [("Skills.csv", "Name\nC\n")])
    (root / "void.zip").write_bytes(b"")
    (root / "junk.zip").write_bytes(b"junk")
    (root / "note.txt").write_text("no archive")
    return root


def shown(df):
    return sorted(df.withColumn("cells", F.to_json("cells")).collect(), key=repr)


def test_batch_gives_the_rows_of_the_archives(spark, root):
    arrivals.register(spark)
    got = shown(spark.read.format(arrivals.ROWS).load(str(root)))
    whole = raw_rows(accepted(archive_files(spark, str(root)), str(root)))
    void = [r for r in got if r.export_id == "void"]
    assert [r for r in got if r.export_id != "void"] == shown(whole)
    assert [(r.table_key, r.defect) for r in void] == [(entries.REJECTED, "empty file")]
    files = spark.read.format(arrivals.FILES).load(str(root)).collect()
    assert sorted(os.path.basename(f.path) for f in files) == ["a.zip", "b.ZIP", "c.zip", "junk.zip", "note.txt", "void.zip"]
    assert all(f.modified is not None for f in files)


def test_table_keys_reach_the_reader(spark, root):
    arrivals.register(spark)
    raw = spark.read.format(arrivals.ROWS).load(str(root))
    skills = raw.filter(F.col("table_key").isin("skills", "none"))
    assert {r.export_id for r in skills.collect()} == {"a", "x/b.ZIP", "x/c"}  # b's fault lies elsewhere
    assert document(raw, "skills").filter("export_id = 'a'").first().content == "# Skills\n\nGo, SQL\n"
    reader = arrivals._Reader(str(root), True)
    filters = [arrivals.In(("table_key",), ("skills", "profile")), arrivals.EqualTo(("table_key",), "skills")]
    assert list(reader.pushFilters(filters)) == filters and reader.tables == {"skills"}
    marked = arrivals._Reader(str(root), True)
    list(marked.pushFilters([arrivals.In(("table_key",), ("skills", entries.REJECTED))]))
    assert marked.tables is None


def test_stream_takes_up_what_is_new(spark, root, tmp_path):
    arrivals.register(spark)

    def run():
        query = (
            spark.readStream.format(arrivals.ROWS).option("log", str(tmp_path / "log")).load(str(root))
            .writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        query.awaitTermination(300)
        assert query.exception() is None
        return shown(spark.read.parquet(str(tmp_path / "out")))

    first = run()
    assert first == shown(spark.read.format(arrivals.ROWS).load(str(root)))
    assert run() == first
    pack(root / "a.zip", [("Skills.csv", "Name\nwritten over\n")])
    pack(root / "late.zip", [("Skills.csv", "Name\nlate\n")])
    os.utime(root / "late.zip", (1_000_000, 1_000_000))  # arrives with an old date
    more = [r for r in run() if r not in first]
    assert {(r.export_id, r.cells) for r in more if r.table_key == "skills"} == {
        ("a", '{"Name":"written over"}'), ("late", '{"Name":"late"}'),
    }


def test_log_survives_a_restart(root, tmp_path):
    log = arrivals.Log(str(tmp_path / "log"))
    assert log.take_up(str(root)) == 1 and log.take_up(str(root)) == 1
    pack(root / "d.zip", [("Skills.csv", "Name\nD\n")])
    assert log.take_up(str(root)) == 2
    again = arrivals.Log(str(tmp_path / "log"))
    assert again.take_up(str(root)) == 2
    assert [os.path.basename(p) for p, _, _ in again.files(2)] == ["d.zip"]
    assert len(again.files(1)) == 6


def test_shares():
    files = [(str(i), n, 0) for i, n in enumerate([5, 5, 20, 0, 3, 9])]
    assert [[f[1] for f in s.files] for s in arrivals.shares(files, 10)] == [[5, 5], [20], [0, 3], [9]]
    assert arrivals.shares([]) == []


def test_streams_need_a_log(spark, root):
    arrivals.register(spark)
    with pytest.raises(Exception, match="log"):
        spark.readStream.format(arrivals.ROWS).load(str(root)).writeStream.format("noop").option(
            "checkpointLocation", str(root.parent / "s")
        ).start().awaitTermination(60)
    with pytest.raises(ValueError):
        stores.file_system("nosuch://x")
