"""A stream that appends each key's row once, with keyed state in place of a look at the table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framescore.sources.ledger import KeyLedger, key_mark
from framescore.sources.selected import FILE, ROW, with_places
from framescore.streaming.score import FILES_PER_BATCH

# The class of Spark's state store that keeps state on disk.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB: memory does not grow with the number of keys."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def append_keyed_stream(
    spark: SparkSession, folder: str, store: KeyLedger, checkpoint: str, files_per_batch: int = FILES_PER_BATCH,
    time: str | None = None, within: str | None = None,
) -> StreamingQuery:
    """Append the rows of a folder's Parquet files, as they come, whose key ``store`` does not hold yet; all that is available now.

    Only the key, the file and the place of a row are dealt to the state; it holds each key once, so a key of an earlier
    micro-batch costs no look anywhere. With ``time`` and ``within``, a key is forgotten once the watermark has passed it by
    that long. What is new to the state is looked up in the ledger, which knows the keys of other appends; then the
    rows are copied from their files. Neither the stored rows nor, but for keys that may be known, the ledger is read.
    A replayed micro-batch has the name of the finished one and adds nothing. Of equal keys in one micro-batch any one is taken.
    """
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    mark = key_mark(F.col(store.key)).alias("mark")
    if time:
        seen = with_places(stream).select(mark, FILE, ROW, F.col(time).alias("_time")).withWatermark("_time", within or "0 seconds")
        fresh = seen.dropDuplicatesWithinWatermark(["mark"])
    else:
        fresh = with_places(stream).select(mark, FILE, ROW).dropDuplicates(["mark"])
    like = spark.createDataFrame([], schema)
    stream_name = hashlib.md5(checkpoint.encode()).hexdigest()

    def add(batch: DataFrame, number: int) -> None:
        store.append_places(like, batch.select("mark", FILE, ROW), f"{stream_name}-{number}")

    with state_on_disk(spark):
        return fresh.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
