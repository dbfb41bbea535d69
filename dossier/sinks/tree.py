"""Documents as files on any file system that Arrow reaches: a Spark data source that is written to.

Rows come ordered by (export, file, part); the parts of a document are streamed into one file, so a
document of any length needs the memory of one part. Where files are renamed (local disks, HDFS), a
file is written below ``_drafts-<run>`` and renamed when it is whole; object stores show a file only
when its upload ends. So a reader never sees half a document, and a repeated or speculative task
writes the same bytes over its own. The drafts of lost tasks go when the job ends.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from dossier.sources.stores import file_system

NAME = "document_tree"

#: Stores that have no rename.
_WHOLE_UPLOADS = ("s3", "gcs", "abfs")


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class _File:
    """One document on its way into a file."""

    def __init__(self, fs: arrow_fs.FileSystem, target: str, draft: str | None):
        self.fs, self.target, self.draft, self.size = fs, target, draft, 0
        fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
        if draft is not None:
            fs.create_dir(draft.rsplit("/", 1)[0], recursive=True)
        self.stream = fs.open_output_stream(draft or target)

    def add(self, content: str) -> None:
        data = content.encode()
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        if self.draft is not None:
            self.fs.move(self.draft, self.target)


class TreeWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.run = root.rstrip("/"), uuid.uuid4().hex
        file_system(self.root)  # refuses an unknown scheme before any task runs

    def _drafts(self, path: str) -> str:
        return f"{path.rstrip('/')}/_drafts-{self.run}"

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, base = file_system(self.root)
        renames = fs.type_name not in _WHOLE_UPLOADS
        files = size = 0
        name, document, seen = None, None, -1
        for row in iterator:
            if (row.export_id, row.file_name) != name:
                if document is not None:
                    document.close()
                    files, size = files + 1, size + document.size
                name, seen = (row.export_id, row.file_name), -1
                draft = f"{self._drafts(base)}/{uuid.uuid4().hex}" if renames else None
                document = _File(fs, f"{base.rstrip('/')}/{row.export_id}/{row.file_name}", draft)
            if row.part_no <= seen:
                raise ValueError(f"parts of {name} out of order or repeated")
            seen = row.part_no
            document.add(row.content)
        if document is not None:
            document.close()
            files, size = files + 1, size + document.size
        return Written(files, size)

    def _tidy(self) -> None:
        fs, base = file_system(self.root)
        drafts = self._drafts(base)
        if fs.get_file_info(drafts).type == arrow_fs.FileType.Directory:
            fs.delete_dir(drafts)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._tidy()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._tidy()


class DocumentTree(DataSource):
    """``<path>/<export_id>/<file_name>`` from rows (export_id, file_name, part_no, content), which
    must come with all parts of a file in one partition, in order."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        if overwrite:
            raise ValueError("a tree is only added to: files of the same name are replaced")
        return TreeWriter(self.options["path"])


cloudpickle.register_pickle_by_value(sys.modules[__name__])
