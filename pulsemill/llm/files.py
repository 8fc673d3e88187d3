"""Files that tasks write beside each other, and the table that says which of them count.

A task writes under a name of its own and returns a row about the file. These rows, saved by
Spark's committer, are the directory's contents: a file left by a lost or repeated attempt
is in no row and is never read.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from pulsemill.session import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder's address below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def opened(address: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address (a path or a URI) and the path in it."""
    return pafs.FileSystem.from_uri(address)


def write(folder: str, stem: str, suffix: str, content: bytes) -> str:
    """Write a new file; returns its name."""
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}{suffix}"
    with fs.open_output_stream(f"{path}/{name}") as out:
        out.write(content)
    return name
