"""Tables that an operator writes once, to cut lineage or to feed several readers.

They lie below ``spark.checkpoint.dir``, which all executors share, so a lost executor costs a re-read.
``release`` deletes the folders of finished work; a result that still reads them must be written first.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from framescore.session import new_shared_path, shuffle_tasks

# Shuffle files go with the query that wrote them, not whenever the driver collects its garbage: a large step has few queries, and each is large.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_OPEN: list[str] = []
# Names of bucketed tables, which lie in those folders too.
_TABLES: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def _cleaned(spark: SparkSession):
    """Queries within leave no shuffle files. For writes alone: no other query reads what a write has shuffled."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


class Scratch:
    """One operator run's folder of tables."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.base, self.paths = spark, new_shared_path(spark, tag), {}
        _OPEN.append(self.base)

    def write(self, df: DataFrame, name: str, narrow: bool = False, by: str | None = None) -> DataFrame:
        """Write ``df`` and return its table; an earlier table of that name stays for its readers.

        With ``by``, each value of that column has a folder of its own, so that a reader of one value reads no other.
        ``narrow`` rows (a few numbers and keys) go to an eighth of the shuffle's tasks, so that files are no smaller than those of texts.
        """
        if narrow:
            df = df.coalesce(max(1, shuffle_tasks(self.spark) // 8))
        n = len(self.paths)
        path = f"{self.base}/{name}-{n}"
        self.paths[n] = path
        with _cleaned(self.spark):
            (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """Write ``df`` in buckets by ``key``: a join on it with rows dealt to as many tasks does not move this table."""
        n = len(self.paths)
        path = f"{self.base}/{name}-{n}"
        self.paths[n] = path
        table = f"bucketed_{uuid.uuid4().hex}"
        with _cleaned(self.spark):
            df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(table)
        out = self.spark.table(table)
        out._scratch_path = path
        _TABLES.append(table)
        return out

    def drop(self, table: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        self.drop_path(table._scratch_path)

    def drop_path(self, path: str) -> None:
        _delete(self.spark, path)


def release(spark: SparkSession) -> None:
    """Delete all scratch folders of this session. Call it once the results made from them are written."""
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    while _OPEN:
        _delete(spark, _OPEN.pop())
