"""Exclusive commits: paths that the first writer alone can create."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and the path as it knows it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def move_new(spark: SparkSession, source: str, target: str) -> bool:
    """Renames ``source`` to ``target`` unless that exists; whether this call did.

    Of several writers one wins, and a reader sees the whole target or none, as
    far as the file system's rename is atomic (that of an object store is not).
    """
    fs, to = file_system(spark, target)
    if to.getParent() is not None:
        fs.mkdirs(to.getParent())
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(to.toUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        context.rename(hadoop.Path(source), to, plain)
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Creates ``path`` with ``text`` unless it exists; whether this call created it.

    The marker is written aside and renamed, see :func:`move_new`.
    """
    aside = f"{path}.{uuid.uuid4().hex}"
    fs, hadoop = file_system(spark, aside)
    out = fs.create(hadoop, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        return move_new(spark, aside, path)
    finally:
        fs.delete(hadoop, False)


def read_claim(spark: SparkSession, path: str) -> str | None:
    """The text of a marker, or None where there is none."""
    fs, marker = file_system(spark, path)
    if not fs.exists(marker):
        return None
    stream = fs.open(marker)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def claims(spark: SparkSession, folder: str) -> list[str]:
    """Names of the markers in ``folder``, sorted."""
    fs, where = file_system(spark, folder)
    if not fs.exists(where):
        return []
    return sorted(n for n in (e.getPath().getName() for e in fs.listStatus(where)) if "." not in n)


def remove_path(spark: SparkSession, path: str) -> bool:
    """Deletes a file or folder; whether it was there."""
    fs, where = file_system(spark, path)
    return bool(fs.delete(where, True))
