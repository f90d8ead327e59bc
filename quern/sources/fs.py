"""Folders and small files on whatever file system a path names, through Hadoop's interface."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    own = jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def exists(spark: SparkSession, path: str) -> bool:
    system, own = _at(spark, path)
    return system.exists(own)


def listed(spark: SparkSession, path: str) -> list[tuple[str, bool, int]]:
    """(name, whether it is a folder, time of change) of what a folder holds, in natural order; nothing of a missing one."""
    system, own = _at(spark, path)
    if not system.exists(own):
        return []
    return sorted((x.getPath().getName(), x.isDirectory(), x.getModificationTime()) for x in system.listStatus(own))


def move(spark: SparkSession, path: str, to: str) -> None:
    """Renames; what stands at ``to`` is replaced."""
    system, own = _at(spark, path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
    system.delete(target, True)
    if not system.rename(own, target):
        raise OSError(f"{path} can't become {to}")


def remove(spark: SparkSession, path: str) -> None:
    system, own = _at(spark, path)
    system.delete(own, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    system, own = _at(spark, path)
    out = system.create(own, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, such as settings or a section of a report."""
    return spark.read.text(path, wholetext=True).first()[0]
