"""Files that tasks write and read in a folder the whole cluster shares.

Spark has no writer for framed binary files, so tasks write them through
Arrow's file systems (local and mounted folders, HDFS, object stores).  A file's
name is new in each attempt and known to the rest of the job only through the
row its task returns; those rows, the manifest, are written as a table.  A lost
executor or a second attempt leaves files that no manifest names.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def partition() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def new_file(folder: str, suffix: str) -> str:
    """URI of a file that no other attempt has, below an existing or new folder."""
    system, path = locate(folder)
    system.create_dir(path, recursive=True)
    return f"{folder.rstrip('/')}/part-{partition():06d}-{uuid.uuid4().hex}{suffix}"


def create(uri: str):
    system, path = locate(uri)
    return system.open_output_stream(path, compression=None, buffer_size=1 << 20)


def open_file(uri: str):
    """Random access; ``size()``, ``seek()``, ``read()``."""
    system, path = locate(uri)
    return system.open_input_file(path)
