"""Binary files in a shared folder, written and read by executors through a file-system URI."""

from __future__ import annotations

import posixpath
import uuid


def open_uri(uri: str):
    """(file system, path) for file://, hdfs://, s3:// and the like."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class AtomicFile:
    """Written under a name of this attempt, moved to its final name on success: a retried
    or speculative task leaves one whole file."""

    def __init__(self, uri: str):
        self.fs, self.path = open_uri(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(posixpath.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.temp)
        self.at = 0

    def write(self, data: bytes) -> int:
        """Returns where the data begin."""
        begin = self.at
        self.out.write(data)
        self.at += len(data)
        return begin

    def __enter__(self) -> "AtomicFile":
        return self

    def __exit__(self, kind, *_) -> None:
        self.out.close()
        if kind is None:
            self.fs.move(self.temp, self.path)
        else:
            self.fs.delete_file(self.temp)
