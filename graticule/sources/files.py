"""Small files and folders through the session's own file system API, so that paths may be in any store."""

from __future__ import annotations

from pyspark.sql import SparkSession


def fs_of(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    fs, place = fs_of(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, place = fs_of(spark, path)
    stream = fs.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that isn't there yet, whole or not at all: under another name first, then moved. False if there is one."""
    fs, place = fs_of(spark, path)
    _, draft = fs_of(spark, f"{path}.{spark.sparkContext._jvm.java.util.UUID.randomUUID()}.draft")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    done = not fs.exists(place) and fs.rename(draft, place)
    if not done:
        fs.delete(draft, False)
    return bool(done)


def remove(spark: SparkSession, path: str) -> None:
    fs, place = fs_of(spark, path)
    fs.delete(place, True)
