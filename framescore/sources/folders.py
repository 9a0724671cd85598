"""Small operations on folders of any store that Spark reads: marks that are made, renamed and listed."""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    store, target = _at(spark, path)
    return store.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    store, target = _at(spark, path)
    store.delete(target, True)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, which must not be there yet."""
    store, target = _at(spark, path)
    store.mkdirs(target.getParent())
    store.create(target, False).close()


def rename(spark: SparkSession, path: str, to: str) -> None:
    """One step for all readers; an error if there is nothing to rename, or something there already."""
    store, target = _at(spark, path)
    _, goal = _at(spark, to)
    store.mkdirs(goal.getParent())
    if not store.rename(target, goal):
        raise FileExistsError(f"cannot rename {path} to {to}")


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds; nothing if it is not there."""
    store, target = _at(spark, folder)
    if not store.exists(target):
        return []
    return sorted(str(f.getPath().getName()) for f in store.listStatus(target))
