"""Small files on the file system that a path names: listed, read and written from the driver.

They hold what a table is worth as a whole (which version is current, one record of a log), never
rows of a table.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of the Hadoop client that Spark reads with."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder, sorted; none if the folder isn't there."""
    system, place = _hadoop(spark, folder)
    if not system.exists(place):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(place) if status.isFile())


def stamp(spark: SparkSession, folder: str) -> tuple[tuple[str, int, int], ...]:
    """(name, length, time of change) of what lies in a folder: another stamp means other contents."""
    system, place = _hadoop(spark, folder)
    if not system.exists(place):
        return ()
    found = [(s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in system.listStatus(place)]
    return tuple(sorted(found))


def write_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file under its name once it is whole. False, and nothing changed, if the name is taken."""
    folder, _, name = path.rpartition("/")
    system, place = _hadoop(spark, path)
    if system.exists(place):
        return False
    unfinished = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_{name}-{uuid4().hex}")
    out = system.create(unfinished, True)
    out.write(bytearray(text.encode()))
    out.close()
    if system.rename(unfinished, place):
        return True
    system.delete(unfinished, False)
    return False


def read_text(spark: SparkSession, path: str) -> str:
    system, place = _hadoop(spark, path)
    source = system.open(place)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        system, place = _hadoop(spark, path)
        system.delete(place, False)
