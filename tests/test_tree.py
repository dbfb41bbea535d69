"""Documents as files: whole, in order, once, on any file system."""

import pytest
from pyarrow import fs as arrow_fs
from pyspark.sql import Row
from pyspark.sql import functions as F

from dossier.sinks import tree
from dossier.sinks.files import export_files

SCHEMA = (
    "export_id string, section string, lang string, file_name string, part_no long, whole boolean, "
    "content string"
)


def files(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


def parts(export, name, contents, step=7):
    return [(export, "s", "en", name, k * step, len(contents) == 1, c) for k, c in enumerate(contents)]


def test_a_document_of_parts_is_one_file(spark, tmp_path):
    long = [f"línea {k} 🚀\r\n" * (k % 5) for k in range(300)]
    rows = parts("e", "long.md", long) + parts("e", "short.md", ["x"]) + parts("team/f", "long.md", ["a", "b"])
    rows += [("e", "s", "es", "long.md", 0, True, "otra")]
    df = spark.createDataFrame(rows, SCHEMA).orderBy(F.rand(3)).repartition(5)
    for root in (str(tmp_path / "a"), (tmp_path / "b").as_uri()):
        for _ in range(2):
            export_files(df, root, "en")
    want = {"e/long.md": "".join(long).encode(), "e/short.md": b"x", "team/f/long.md": b"ab"}
    assert files(tmp_path / "a") == want and files(tmp_path / "b") == want
    assert not [p for p in tmp_path.rglob("_drafts*")]


def test_nothing_to_write(spark, tmp_path):
    export_files(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), "en")
    assert files(tmp_path) == {}


def test_unknown_schemes_are_refused(spark, tmp_path):
    df = spark.createDataFrame(parts("e", "s.md", ["x"]), SCHEMA)
    for root in ("nosuch://bucket/x", "relative/path"):
        with pytest.raises(Exception, match="no file system for|must be absolute"):
            export_files(df, root, "en")
    with pytest.raises(Exception, match="only added to"):
        spark.dataSource.register(tree.DocumentTree)
        df.write.format(tree.NAME).mode("overwrite").save(str(tmp_path))


def test_schemes():
    assert tree.file_system("/a/b")[1] == "/a/b"
    assert tree.file_system("file:/a/b")[1] == "/a/b"
    assert tree.file_system("file:///a/b c")[1] == "/a/b c"
    found, path = tree.file_system("s3a://bucket/a?region=eu-west-1")
    assert (found.type_name, path) == ("s3", "bucket/a")


def rows(name, contents):
    return [Row(export_id="e", file_name=name, part_no=k, content=c) for k, c in enumerate(contents)]


def test_repeated_and_failing_tasks(tmp_path):
    writer = tree.TreeWriter(str(tmp_path))

    def failing():
        yield from rows("a.md", ["1", "2"])
        yield from rows("b.md", ["3"])
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write(failing())
    whole = files(tmp_path)
    assert whole["e/a.md"] == b"12" and "e/b.md" not in whole  # b is still a draft
    done = writer.write(iter(rows("a.md", ["1", "2"]) + rows("b.md", ["3"])))
    assert (done.files, done.size) == (2, 3)
    writer.write(iter(rows("a.md", ["1", "2"])))  # a speculative twin
    writer.commit([done])
    assert files(tmp_path) == {"e/a.md": b"12", "e/b.md": b"3"}


def test_parts_out_of_order_are_refused(tmp_path):
    writer = tree.TreeWriter(str(tmp_path))
    with pytest.raises(ValueError, match="out of order"):
        writer.write(iter(reversed(rows("a.md", ["1", "2"]))))
    writer.abort([])
    assert files(tmp_path) == {}


def test_object_stores_get_whole_uploads(tmp_path, monkeypatch):
    """Without renames the file is written in place, and no draft is made."""
    monkeypatch.setattr(tree, "_WHOLE_UPLOADS", (arrow_fs.LocalFileSystem().type_name,))
    writer = tree.TreeWriter(str(tmp_path))
    writer.write(iter(rows("a.md", ["1", "2"])))
    assert files(tmp_path) == {"e/a.md": b"12"} and not list(tmp_path.glob("_drafts*"))
