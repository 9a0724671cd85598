"""Operator 9: token counts kept as delta-maintained rollups.

The state is a folder with one sub-folder of totals per committed batch:

    deltas/batch=<id>/    source, lang, tokenizer, documents, tokens   (signed, additive)

A batch of signed events is summed by (source, lang, tokenizer version) and written under its id. A commit that is
repeated finds its batch complete and changes nothing; one that died half-way is written anew over what it left,
since only a folder with its success marker counts. Current totals are the sums over all complete batches, so they
never depend on the order of commits. One writer commits an id at a time: two that commit one id at once write one folder.

    folded/<n>/totals     the totals of many batches
    folded/<n>/ids        their ids

``compact`` folds all complete batches into one table of totals and keeps their ids, so a repeated commit of a folded batch still changes
nothing. It counts once its folder has its number, which is one rename; readers take the greatest number, and the folders of
batches that it holds. The folders of batches folded by the compaction before are deleted then, so a reader that began before keeps its files.

Events: ``insert`` adds a document and its tokens, ``delete`` takes both away, ``revise`` replaces a count (old_tokens) by
another (tokens), under the same or another tokenizer version: the document leaves the old key and enters the new one.

Sums are partial before the shuffle, so a source with a third of all rows sends one row per task.

Defined cases: null sources, languages and versions are keys of their own; a null or empty text has 0 tokens and counts as a
document; equal events of one batch all count; an empty batch commits no totals but is complete; columns of other names are
not read. Null counts are 0.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescore.llm.tokens import default_vocabulary, tokenizer
from framescore.llm.words import hash_words, slices

KEYS = ["source", "lang", "tokenizer"]
TOTALS = "source string, lang string, tokenizer string, documents bigint, tokens bigint"
EVENT = "doc_id bigint, source string, lang string, kind string, tokenizer string, tokens bigint, old_tokenizer string, old_tokens bigint"


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``docs`` without its text, plus bpe_tokens (ids of the vocabulary file) and words (white-space words)."""
    path = vocabulary or default_vocabulary()
    rest = [c for c in docs.columns if c not in ("text", "bpe_tokens", "words")]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema]
    schema = ", ".join([*fields, "bpe_tokens bigint", "words bigint"])

    def run(batches):
        for batch in batches:
            texts = batch.column(0).fill_null("")
            bpe, words = [], []
            for lo, hi in slices(texts):
                part = texts.slice(lo, hi - lo)
                bpe.append(np.diff(tokenizer(path).encode(part)[1]))
                words.append(np.diff(hash_words(part).first))
            count = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], count(bpe), count(words)], [*rest, "bpe_tokens", "words"])

    return docs.select(F.col("text").cast("string"), *rest).mapInArrow(run, schema)


def inserts(counts: DataFrame, tokenizer_name: str, tokens: str) -> DataFrame:
    return _event(counts, "insert", tokenizer_name, F.col(tokens), F.lit(None), F.lit(None))


def deletes(counts: DataFrame, tokenizer_name: str, tokens: str) -> DataFrame:
    return _event(counts, "delete", tokenizer_name, F.col(tokens), F.lit(None), F.lit(None))


def revisions(counts: DataFrame, old_name: str, old_tokens: str, new_name: str, new_tokens: str) -> DataFrame:
    return _event(counts, "revise", new_name, F.col(new_tokens), F.lit(old_name), F.col(old_tokens))


def _event(counts, kind, name, tokens, old_name, old_tokens) -> DataFrame:
    return counts.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(kind).alias("kind"),
        F.lit(name).alias("tokenizer"), tokens.cast("bigint").alias("tokens"),
        old_name.cast("string").alias("old_tokenizer"), old_tokens.cast("bigint").alias("old_tokens"),
    )


def deltas(events: DataFrame) -> DataFrame:
    """Signed totals of a batch of events; keys whose documents and tokens both cancel are left out."""
    plus = F.struct(F.col("tokenizer").alias("t"), F.lit(1).alias("sign"), F.coalesce("tokens", F.lit(0)).alias("n"))
    minus = F.struct(F.col("tokenizer").alias("t"), F.lit(-1).alias("sign"), F.coalesce("tokens", F.lit(0)).alias("n"))
    old = F.struct(F.col("old_tokenizer").alias("t"), F.lit(-1).alias("sign"), F.coalesce("old_tokens", F.lit(0)).alias("n"))
    entries = F.when(F.col("kind") == "insert", F.array(plus)).when(F.col("kind") == "delete", F.array(minus)).when(F.col("kind") == "revise", F.array(old, plus))
    return (
        events.select("source", "lang", F.inline(entries))
        .groupBy("source", "lang", F.col("t").alias("tokenizer"))
        .agg(F.sum("sign").cast("bigint").alias("documents"), F.sum(F.col("sign") * F.col("n")).cast("bigint").alias("tokens"))
        .where("documents <> 0 OR tokens <> 0")
    )


class Rollup:
    """Token totals below ``path``, a folder on a file system that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._hadoop = jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folder(self, batch: str) -> str:
        if not batch or not all(c.isalnum() or c in "-_." for c in batch):
            raise ValueError("a batch id is made of letters, digits, '-', '_' and '.'")
        return f"{self.path}/deltas/batch={batch}"

    def _complete(self, batch: str) -> bool:
        return self._fs.exists(self._hadoop(f"{self._folder(batch)}/_SUCCESS"))

    def _names(self, folder: str) -> list[str]:
        top = self._hadoop(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(top)) if self._fs.exists(top) else []

    def _folded(self) -> str | None:
        """The folder of the last compaction."""
        numbers = [int(n) for n in self._names("folded") if n.isdigit()]
        return f"{self.path}/folded/{max(numbers)}" if numbers else None

    def _folded_ids(self) -> DataFrame:
        folded = self._folded()
        return self.spark.read.schema("batch string").parquet(f"{folded}/ids") if folded else self.spark.createDataFrame([], "batch string")

    def committed(self, batch: str) -> bool:
        return self._complete(batch) or self._folded_ids().where(F.col("batch") == batch).limit(1).count() > 0

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Add a batch once. False if it was complete already; its events are then not read."""
        if self.committed(batch):
            return False
        deltas(events).write.mode("overwrite").parquet(self._folder(batch))
        return True

    def _unfolded(self) -> list[str]:
        """Ids of the complete batches that no compaction holds."""
        found = [n.removeprefix("batch=") for n in self._names("deltas")]
        folded = {r["batch"] for r in self._folded_ids().where(F.col("batch").isin(found)).collect()} if self._folded() else set()
        return [n for n in found if n not in folded and self._complete(n)]

    def batches(self) -> list[str]:
        """Ids of the complete batches, folded or not: one name per commit."""
        return sorted({*(r["batch"] for r in self._folded_ids().collect()), *self._unfolded()})

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens): keys that hold a document or tokens."""
        folded = self._folded()
        folders = [self._folder(b) for b in self._unfolded()] + ([f"{folded}/totals"] if folded else [])
        if not folders:
            return self.spark.createDataFrame([], TOTALS)
        return (
            self.spark.read.schema(TOTALS).parquet(*folders).groupBy(*KEYS)
            .agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 OR tokens <> 0")
        )

    def compact(self) -> int:
        """Fold all complete batches; how many were not folded before. One compaction at a time."""
        fresh, before = self._unfolded(), self._folded()
        if not fresh:
            return 0
        # Those of the compaction before, which readers no longer need.
        done = [n.removeprefix("batch=") for n in self._names("deltas") if n.removeprefix("batch=") not in fresh]
        staged = f"{self.path}/folded/staged-{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{staged}/totals")
        ids = self.spark.createDataFrame([(b,) for b in fresh], "batch string")
        self._folded_ids().unionByName(ids).write.parquet(f"{staged}/ids")
        number = int(before.rpartition("/")[2]) + 1 if before else 0
        goal = self._hadoop(f"{self.path}/folded/{number}")
        if self._fs.exists(goal) or not self._fs.rename(self._hadoop(staged), goal):
            raise FileExistsError(f"compaction {number} is there already")
        known = {r["batch"] for r in self._folded_ids().where(F.col("batch").isin(done)).collect()} if done else set()
        for batch in known:
            self._fs.delete(self._hadoop(self._folder(batch)), True)
        return len(fresh)
