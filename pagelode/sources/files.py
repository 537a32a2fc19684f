"""Small files on whatever file system a path names, through Spark's own Hadoop clients.

Paths are URIs or plain paths; plain paths follow the cluster's default file system. A
text is written beside its place and renamed, so readers see all of it or nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _at(spark, path)
    return bool(system.exists(at))


def is_folder(spark: SparkSession, path: str) -> bool:
    system, at = _at(spark, path)
    return bool(system.exists(at) and system.getFileStatus(at).isDirectory())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system."""
    system, at = _at(spark, path)
    return system.makeQualified(at).toString()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no folder."""
    system, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def make_folder(spark: SparkSession, path: str) -> None:
    system, at = _at(spark, path)
    system.mkdirs(at)


def delete(spark: SparkSession, path: str) -> None:
    system, at = _at(spark, path)
    system.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    return read_bytes(spark, path).decode()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in one step; what was there is replaced."""
    with text_writer(spark, path) as write:
        write(text)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    system, at = _at(spark, path)
    stream = system.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


@contextmanager
def text_writer(spark: SparkSession, path: str, most: int = 1 << 20) -> Iterator[Callable[[str], None]]:
    """A function that writes texts to a file, which appears under its name when all are written."""
    system, at = _at(spark, path)
    aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
    stream, held, size = system.create(aside, True), [], 0

    def write(text: str) -> None:
        nonlocal size
        held.append(text)
        size += len(text)
        if size >= most:
            stream.write(bytearray("".join(held).encode()))
            held.clear()
            size = 0

    try:
        yield write
        stream.write(bytearray("".join(held).encode()))
    except BaseException:
        stream.close()
        system.delete(aside, False)
        raise
    stream.close()
    _rename(system, aside, at)


def _rename(system, aside, at) -> None:
    if not system.rename(aside, at):  # some systems do not rename over a file
        system.delete(at, False)
        if not system.rename(aside, at):
            raise OSError(f"cannot write {at}")


class Place:
    """A path on any file system, used like one of :mod:`pathlib`."""

    def __init__(self, uri: str | Place, spark: SparkSession | None = None):
        self.uri = str(uri).rstrip("/") or "/"
        self.spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()

    def __truediv__(self, name: str) -> Place:
        return Place(f"{self.uri.rstrip('/')}/{name}", self.spark)

    def __str__(self) -> str:
        return self.uri

    def __repr__(self) -> str:
        return f"Place({self.uri!r})"

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Place) and self.qualified() == other.qualified()

    def __hash__(self) -> int:
        return hash(self.qualified())

    @property
    def name(self) -> str:
        return self.uri.rpartition("/")[2]

    @property
    def parent(self) -> Place:
        return Place(self.uri.rpartition("/")[0] or "/", self.spark)

    def qualified(self) -> str:
        return qualified(self.spark, self.uri)

    def resolve(self) -> Place:
        return Place(self.qualified(), self.spark)

    def exists(self) -> bool:
        return exists(self.spark, self.uri)

    def is_dir(self) -> bool:
        return is_folder(self.spark, self.uri)

    def names(self) -> list[str]:
        return [n for n in names(self.spark, self.uri) if not n.startswith(".")]

    def mkdir(self) -> None:
        make_folder(self.spark, self.uri)

    def delete(self) -> None:
        delete(self.spark, self.uri)

    def read_text(self) -> str:
        return read_text(self.spark, self.uri)

    def write_text(self, text: str) -> None:
        write_text(self.spark, self.uri, text)
