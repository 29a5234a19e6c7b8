"""Byte ranges of files in the shared storage, read inside tasks."""

from __future__ import annotations


def located(uri: str):
    """(file system, path) of a URI or an absolute path."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def read_range(uri: str, offset: int, size: int) -> bytes:
    store, path = located(uri)
    with store.open_input_file(path) as f:
        return f.read_at(size, offset)
