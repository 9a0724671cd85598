"""Label joins, unions and deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescore.functions.names import stem


def label_keys(labels: DataFrame) -> DataFrame:
    """Labels as ``stem, label``: a label file names an image without its extension."""
    return labels.select(F.col("image_name").alias("stem"), "label")


def join_labels(images: DataFrame, labels: DataFrame, salt_by: Column | None = None, salts: int = 16) -> DataFrame:
    """Images with their label; unlabelled images stay, with a null label.

    The key is the name without its last extension, so ``a.jpg``, ``a.PNG`` and ``a`` take the label of ``a``.
    A stale ``label`` column is dropped first, and an image with several label rows
    comes out once per row. No side is hinted: Spark broadcasts the labels only when
    it knows their size, and otherwise splits a hot image name at run time. Where
    adaptive execution is off, ``salt_by`` (any column that varies inside a name)
    spreads each name over ``salts`` partitions and repeats the narrow label rows.
    Images that carry their ``stem`` are joined by it; written in buckets by stem (``sources.bucketed``), they stay
    where they are and the labels come to them.
    """
    kept = [c for c in images.columns if c != "label"]
    left, right = images.drop("label"), label_keys(labels)
    if "stem" not in left.columns:
        left = left.withColumn("stem", stem(F.col("name")))
    if salt_by is None:
        return left.join(right, "stem", "left").select(*kept, "label")
    left = left.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, ["stem", "_salt"], "left").select(*kept, "label")


def label_counts(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows per label of ``join_labels``, without building its rows.

    Both sides are counted per stem before the join, so a name that holds a third of
    all rows costs one row here.
    """
    left = images.groupBy(stem(F.col("name")).alias("stem")).agg(F.count(F.lit(1)).alias("_images"))
    right = label_keys(labels).groupBy("stem", "label").agg(F.count(F.lit(1)).alias("_labels"))
    rows = F.col("_images") * F.coalesce(F.col("_labels"), F.lit(1))
    return left.join(right, "stem", "left").groupBy("label").agg(F.sum(rows).alias("n"))


def union_all(frames: list[DataFrame], allow_missing: bool = False) -> DataFrame:
    """All rows of all frames, matched by column name; duplicates stay."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def dedup(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the least in ``order``, ties decided by the other columns.

    Written as a minimum, so each task keeps one row per key before anything is
    shuffled. Run it on listings, before pixels are attached.
    """
    rest = [c for c in df.columns if c not in (key, *order)]
    best = df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_best"))
    return best.select(key, "_best.*").select(*df.columns)


def only_new(incoming: DataFrame, existing: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The incoming rows an append may add: the first per key, none that is there already.

    ``key + order`` must identify an incoming row. The choice is made on those narrow
    columns alone and the full rows are only filtered by it, so pixels are neither
    sorted nor aggregated, and a key with very many rows is spread by its order.
    """
    marks = [key, *order]
    first = dedup(incoming.select(*marks), key, order)
    chosen = first.join(existing.select(key).distinct(), key, "left_anti")
    chosen = chosen.select(*[F.col(c).alias(f"_{c}") for c in marks])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in marks])
    return incoming.join(chosen, same, "left_semi")
