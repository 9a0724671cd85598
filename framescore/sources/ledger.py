"""A table that takes each key once, whose re-runs read neither its rows nor move any pixels.

    rows/       the rows, a folder per append
    keys/       the ledger: one narrow row per key, bucketed and sorted by key
    bloom/      a Bloom filter of the keys, as rows: 64 bits for each of ``words`` words, pieces to be or-ed
    open/       a mark for each append that is under way or was broken off
    done/       a mark for each append that is finished

An append decides on narrow columns. Of equal keys in the incoming files the first in ``order`` is taken. A key whose bits are not all set in its
word of the filter is surely new: a join of the filter's words, which Spark broadcasts where it knows that they are few. Only the
others are looked up in the ledger: their few rows go to its buckets, the ledger itself is not shuffled. The rows chosen are then
copied from the incoming files as they are (``selected``).

An append is finished by one rename of its mark. What a broken one left is not seen: its rows and keys carry its name, which is still open. An
append of the same ``batch`` that is finished adds nothing, so a replayed micro-batch does no harm. One append at a time is assumed:
two at once could both take a key.

A null key is one key. The filter has about 16 bits a key for ``capacity`` keys (1 in 50 is then looked up in vain); above that it says
"maybe" more often, and results stay the same.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framescore.sources import folders
from framescore.sources.selected import BITS_LIMIT, FILE, ROW, take_rows, with_places
from framescore.sources.tables import codec, rows_per_file

BUCKETS, CAPACITY = 32, 1_000_000
PROBES = 4


def key_mark(key: Column) -> Column:
    """A key as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def bloom_word(mark: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(mark), F.lit(words))


def bloom_bits(mark: Column) -> Column:
    """The bits of a key in its word."""
    drawn = F.xxhash64(mark, F.lit(1))
    out = F.lit(0).cast("bigint")
    for i in range(PROBES):
        place = F.pmod(F.shiftright(drawn, 6 * i), F.lit(64)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    return out


class KeyLedger:
    """Rows of Parquet files with one row per value of ``key``, in a folder of its own."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS, capacity: int = CAPACITY):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        spec = f"{self.path}/spec"
        made = spark.createDataFrame([(key, buckets, max(1, capacity // 4))], "key string, buckets int, words int")
        made.coalesce(1).write.mode("ignore").json(spec)
        told = spark.read.schema("key string, buckets int, words int").json(spec).first()
        if told["key"] != key:
            raise ValueError(f"{path} is kept by {told['key']}, not by {key}")
        self.buckets, self.words = told["buckets"], told["words"]
        # The catalogue of a session may not know the ledger yet; its files do.
        self.table = f"ledger_{hashlib.md5(self.path.encode()).hexdigest()}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (mark STRING, batch STRING) USING parquet "
            f"CLUSTERED BY (mark) SORTED BY (mark) INTO {self.buckets} BUCKETS LOCATION '{self.path}/keys'"
        )
        spark.catalog.refreshTable(self.table)

    def _open(self) -> list[str]:
        return folders.names(self.spark, f"{self.path}/open")

    def _finished(self, rows: DataFrame) -> DataFrame:
        """Without what broken appends left."""
        broken = self._open()
        return rows.where(~F.col("batch").isin(broken)) if broken else rows

    def done(self, batch: str) -> bool:
        """Whether that append is finished."""
        return any(n.rpartition("~")[0] == batch for n in folders.names(self.spark, f"{self.path}/done"))

    def keys(self) -> DataFrame:
        """The ledger: (mark, batch) of all keys."""
        return self._finished(self.spark.table(self.table))

    def bloom(self) -> DataFrame | None:
        """(word, bits) of the filter, None before the first append."""
        if not folders.exists(self.spark, f"{self.path}/bloom"):
            return None
        pieces = self.spark.read.schema("word bigint, bits bigint").parquet(f"{self.path}/bloom")
        return pieces.groupBy("word").agg(F.bit_or("bits").alias("bits"))

    def read(self) -> DataFrame | None:
        """The rows, None if there are none yet."""
        if not folders.names(self.spark, f"{self.path}/rows"):
            return None
        rows = self.spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")
        return self._finished(rows.withColumn("batch", F.col("batch").cast("string"))).drop("batch")

    def new_keys(self, marks: DataFrame) -> DataFrame:
        """The rows of ``marks`` (mark and others, one per mark) whose key the ledger does not hold."""
        bloom = self.bloom()
        if bloom is None:
            return marks
        bits = bloom_bits(F.col("mark"))
        tested = marks.withColumn("_word", bloom_word(F.col("mark"), self.words)).join(bloom.toDF("_word", "_bits"), "_word", "left")
        maybe = F.coalesce(F.col("_bits").bitwiseAND(bits) == bits, F.lit(False))
        tested = tested.withColumn("_maybe", maybe)
        sure = tested.where(~F.col("_maybe")).select(*marks.columns)
        return sure.unionByName(self._unknown(tested.where("_maybe").select(*marks.columns)))

    def _unknown(self, marks: DataFrame) -> DataFrame:
        """Those of few marks that the ledger does not hold, bucket by bucket."""
        return marks.join(self.keys().select("mark").hint("merge"), "mark", "left_anti")

    def append(self, source: DataFrame, order: list[str], batch: str | None = None, limit: int = BITS_LIMIT) -> int:
        """Append the new keys' rows of ``source``, which reads Parquet files; the number of rows added."""
        marks = with_places(source).select(key_mark(F.col(self.key)).alias("mark"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], FILE, ROW)
        rest = [f"_o{i}" for i in range(len(order))]
        # A minimum, partial before the shuffle: one narrow row per key and task.
        first = marks.groupBy("mark").agg(F.min(F.struct(*rest, FILE, ROW)).alias("m")).select("mark", f"m.{FILE}", f"m.{ROW}")
        return self.append_places(source, first, batch, limit)

    def append_places(self, source: DataFrame, first: DataFrame, batch: str | None = None, limit: int = BITS_LIMIT) -> int:
        """The same for rows named by (mark, file, row), one per mark."""
        batch = batch or uuid.uuid4().hex
        if self.done(batch):
            return 0
        spark, name = self.spark, f"{batch}~{uuid.uuid4().hex}"
        folders.touch(spark, f"{self.path}/open/{name}")
        staged = f"{self.path}/staged/{name}"
        narrow = first.select("mark", FILE, ROW)
        # Written, as the two ways of looking a key up would work ``first`` out twice.
        narrow.write.parquet(f"{staged}/all")
        self.new_keys(spark.read.schema(narrow.schema).parquet(f"{staged}/all")).write.parquet(f"{staged}/new")
        chosen = spark.read.schema(narrow.schema).parquet(f"{staged}/new")
        n = chosen.count()
        if n:
            for rows in take_rows(source, chosen, limit):
                writer = rows.write.mode("append").option("maxRecordsPerFile", rows_per_file(rows)).option("compression", codec(rows))
                writer.parquet(f"{self.path}/rows/batch={name}")
            # One file a bucket and append.
            chosen.select("mark", F.lit(name).alias("batch")).repartition(self.buckets, "mark").write.insertInto(self.table)
            pieces = chosen.groupBy(bloom_word(F.col("mark"), self.words).alias("word")).agg(F.bit_or(bloom_bits(F.col("mark"))).alias("bits"))
            pieces.write.mode("append").parquet(f"{self.path}/bloom")
        folders.delete(spark, staged)
        folders.rename(spark, f"{self.path}/open/{name}", f"{self.path}/done/{name}")
        return n

    def clear_broken(self) -> None:
        """Delete the rows of appends that were broken off. Their keys stay unseen, so their marks stay."""
        for name in self._open():
            folders.delete(self.spark, f"{self.path}/rows/batch={name}")
            folders.delete(self.spark, f"{self.path}/staged/{name}")
