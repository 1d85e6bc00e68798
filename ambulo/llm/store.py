"""Files in the shared folder, written and read by executors through pyarrow's file systems."""

from __future__ import annotations

from uuid import uuid4

from pyarrow import fs
from pyspark.sql import SparkSession

from .common import shared_dir


def new_folder(spark: SparkSession, kind: str) -> str:
    """URI of a new folder beside the checkpoints, which driver and executors share."""
    uri = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid4().hex}"
    return uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("file:///", "/", 1) if uri.startswith("file:///") else uri.removeprefix("file:"))


def write(folder: str, name: str, *parts: bytes) -> str:
    """The URI of a new file; an unfinished attempt leaves a file of another name, to which no row points."""
    system, path = _at(folder)
    system.create_dir(path, recursive=True)
    unique = f"{name}-{uuid4().hex}"
    with system.open_output_stream(f"{path}/{unique}") as out:
        for part in parts:
            out.write(part)
    return f"{folder}/{unique}"


def open_new(uri: str):
    """A stream into a new file."""
    system, path = _at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)


class Reader:
    """Range reads from one file at a time."""

    def __init__(self):
        self.uri, self.file = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            self.close()
            system, path = _at(uri)
            self.uri, self.file = uri, system.open_input_file(path)
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.uri, self.file = None, None


def read_all(uri: str) -> bytes:
    system, path = _at(uri)
    with system.open_input_file(path) as f:
        return f.read()
