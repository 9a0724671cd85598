"""Tables dealt once by a key, so that later joins on it move only the other side.

A bucketed table costs one exchange when it is written; each bucket is then one sorted file. A join on the key with rows of any size sends those
rows to the buckets, and reads the table where it lies. The files tell a session all it needs: a folder holds the rows and their spec.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from framescore.sources.tables import codec

SPEC = "key string, buckets int, schema string"


def _name(path: str) -> str:
    return f"bucketed_{hashlib.md5(path.encode()).hexdigest()}"


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write ``df`` anew in ``buckets`` files by ``key``, each sorted by it.

    Choose ``buckets`` so that a bucket fits a task: pixels of a few hundred MB.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    dealt = df.repartition(buckets, key)
    writer = dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", f"{path}/rows").option("compression", codec(df))
    writer.saveAsTable(_name(path))
    spark.createDataFrame([(key, buckets, df.schema.json())], SPEC).coalesce(1).write.mode("overwrite").json(f"{path}/spec")


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The table, registered in this session's catalogue if it is not yet."""
    path = path.rstrip("/")
    if not spark.catalog.tableExists(_name(path)):
        spec = spark.read.schema(SPEC).json(f"{path}/spec").first()
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(spec["schema"])))
        spark.sql(
            f"CREATE TABLE {_name(path)} ({columns}) USING parquet CLUSTERED BY ({spec['key']}) SORTED BY ({spec['key']}) "
            f"INTO {spec['buckets']} BUCKETS LOCATION '{path}/rows'"
        )
    return spark.table(_name(path))


def drop_bucketed(spark: SparkSession, path: str) -> None:
    """Forget the table; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {_name(path.rstrip('/'))}")
