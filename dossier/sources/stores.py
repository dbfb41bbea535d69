"""File systems of paths and URIs, as tasks open them."""

from __future__ import annotations

import io

from pyarrow import fs as arrow_fs

#: Spark's names of schemes that Arrow knows by another.
_SAME_STORE = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "gcs": "gs"}

#: Bytes fetched at a time; a read that jumps elsewhere costs one fetch more.
FETCH = 1 << 18


def file_system(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a URI (or of an absolute local path) and the path in it.

    As in Spark, nothing in a local path is percent-encoded."""
    scheme, colon, rest = uri.partition(":")
    if colon and "/" not in scheme and len(scheme) > 1:
        if scheme == "file":
            return arrow_fs.LocalFileSystem(), "/" + rest.lstrip("/")
        uri = f"{_SAME_STORE.get(scheme, scheme)}:{rest}"
    elif not uri.startswith("/"):
        raise ValueError(f"a path must be absolute or a URI: {uri}")
    try:
        return arrow_fs.FileSystem.from_uri(uri)
    except Exception as error:
        raise ValueError(f"no file system for {uri}: {error}") from error


class Ranges(io.RawIOBase):
    """A file of any file system, of which only what is asked for is fetched."""

    def __init__(self, fs: arrow_fs.FileSystem, path: str):
        self._file = fs.open_input_file(path)
        self.fetched = 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        start = (0, self._file.tell(), self._file.size())[whence]
        if start + offset < 0:
            raise OSError("position before the start of the file")
        self._file.seek(start + offset)
        return start + offset

    def tell(self) -> int:
        return self._file.tell()

    def readinto(self, buffer) -> int:
        n = self._file.readinto(buffer)
        self.fetched += n
        return n

    def close(self) -> None:
        if not self.closed:
            self._file.close()
        super().close()


def opened(fs: arrow_fs.FileSystem, path: str) -> io.BufferedReader:
    return io.BufferedReader(Ranges(fs, path), FETCH)
