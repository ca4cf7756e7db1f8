"""Folders of a shared file system: what stands in them, and files that are written once."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what stands in a folder, hidden ones left out; nothing where the folder does not exist."""
    files, place = _files(spark, path)
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place)]
    return sorted(n for n in names if not n.startswith((".", "_")))


def batches_in(spark: SparkSession, path: str) -> list[int]:
    """Ids of the folders `batch=<id>` whose writing was finished."""
    files, place = _files(spark, path)
    ids = [int(n.split("=")[1]) for n in names_in(spark, path) if n.startswith("batch=")]
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(b for b in ids if files.exists(done(f"{path}/batch={b}/_SUCCESS")))


def make(spark: SparkSession, path: str) -> None:
    files, place = _files(spark, path)
    files.mkdirs(place)


def remove(spark: SparkSession, path: str) -> None:
    files, place = _files(spark, path)
    files.delete(place, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or nothing where there is none."""
    files, place = _files(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file if none stands there; whether this call wrote it. Of several writers one wins, and readers
    see a whole file or none.

    The text is written aside and then gets its name in one step that fails where the name is taken: a hard link on a
    local disk, a rename that does not replace on others, as on HDFS.
    """
    files, place = _files(spark, path)
    jvm = spark.sparkContext._jvm
    files.mkdirs(place.getParent())
    aside = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}.{uuid.uuid4().hex}")
    stream = files.create(aside, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        if files.getUri().getScheme() == "file":
            local = lambda p: urlparse(p.toUri().toString()).path
            try:
                os.link(local(aside), local(place))
                return True
            except FileExistsError:
                return False
        return not files.exists(place) and bool(files.rename(aside, place))
    finally:
        files.delete(aside, False)
