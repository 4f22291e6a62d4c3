"""Files of a store as tasks read and list them: a place of their own, so that its functions can be shipped by value."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it; buckets (``s3``, ``s3a``) are read without credentials."""
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):/*(.*)$", uri, re.S)
    if not found or found[1] == "file":
        return fs.LocalFileSystem(), "/" + (found[2] if found else uri.lstrip("/"))
    if found[1] in ("s3", "s3a", "s3n"):
        return fs.S3FileSystem(anonymous=True), found[2]
    return fs.FileSystem.from_uri(uri)


def children(root: str):
    """A task's function: prefixes below ``root`` to what is directly under them, hidden and empty objects too."""
    store, base = store_of(root.rstrip("/"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for prefix in batch.column(0).to_pylist():
                found = store.get_file_info(fs.FileSelector(f"{base}/{prefix}".rstrip("/"), allow_not_found=True))
                for k in range(0, len(found), 4096):
                    part = found[k:k + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f.path[len(base) + 1:] for f in part], pa.string()),
                         pa.array([f.size if f.is_file else None for f in part], pa.int64()),
                         pa.array([not f.is_file for f in part])], ["key", "size", "folder"])

    return run


cloudpickle.register_pickle_by_value(sys.modules[__name__])
