"""Small commit logs: numbered entries, each of which one writer alone creates.

An entry is a short text in a file named by its number. It is written under
another name and moved into place without overwriting, so it is there whole or
not at all, and of several writers of one number all but one are refused.
Works on any file system that Spark reaches.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, *parts: object):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(str(p).rstrip("/") for p in parts))


def _files(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the entries, ascending."""
    path = _path(spark, folder)
    files = _files(spark, path)
    if not files.exists(path):
        return []
    names = [status.getPath().getName() for status in files.listStatus(path)]
    return sorted(int(name) for name in names if name.isdigit())


def read_entry(spark: SparkSession, folder: str, number: int) -> str | None:
    path = _path(spark, folder, number)
    files = _files(spark, path)
    if not files.exists(path):
        return None
    stream = files.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_entry(spark: SparkSession, folder: str, number: int, text: str) -> bool:
    """Create an entry; False if there is one of that number already."""
    target, draft = _path(spark, folder, number), _path(spark, folder, f"_draft-{uuid.uuid4().hex}")
    files = _files(spark, target)
    out = files.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    moves = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    # No option given means: never overwrite.
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        moves.rename(draft, target, options)
    except Py4JJavaError as failed:
        files.delete(draft, False)
        if "FileAlreadyExists" not in failed.java_exception.getClass().getName():
            raise
        return False
    return True


def pinned_entry(spark: SparkSession, folder: str, number: int, text: str) -> str:
    """The entry of a number, created with ``text`` if there is none: the first caller decides."""
    if create_entry(spark, folder, number, text):
        return text
    return read_entry(spark, folder, number)
