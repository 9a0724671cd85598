"""Splits, replication to class targets and stride sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescore.functions.names import frame_name, with_variant
from framescore.functions.seeds import draw
from framescore.operators.ranking import exact_rank
from framescore.schema import ABNORMAL, NORMAL

# Class targets, variants per image, the share held out for
# evaluation and the seconds between kept frames.
CLASS_TARGETS = {NORMAL: 800, ABNORMAL: 200}
FANOUT = 5
EVAL_ONE_IN = 5
SECONDS_BETWEEN_FRAMES = 2.0

# Copies of a row that one task makes in a run.
CHUNK = 256


def hash_split(df: DataFrame, key: str = "name", one_in: int = EVAL_ONE_IN) -> DataFrame:
    """Add ``split``: ``eval`` for about one key in ``one_in``, else ``train``."""
    held_out = F.pmod(draw(F.col(key)), F.lit(one_in)) == 0
    return df.withColumn("split", F.when(held_out, "eval").otherwise("train"))


def stratified_split(
    df: DataFrame, key: str = "name", label: str = "label", one_in: int = EVAL_ONE_IN,
) -> DataFrame:
    """``key, label, split`` with exactly ``ceil(n / one_in)`` eval rows in each class."""
    keyed = df.select(key, label).withColumn("_draw", F.md5(F.col(key)))
    ranked = exact_rank(keyed, [label], ["_draw", key])
    held_out = F.pmod(F.col("rank") - 1, F.lit(one_in)) == 0
    return ranked.select(key, label, F.when(held_out, "eval").otherwise("train").alias("split"))


def fan_out(df: DataFrame, copies: Column | int, first: int = 0) -> DataFrame:
    """``copies`` rows per row, numbered in ``variant``.

    Copies are made in chunks of at most ``CHUNK``. A fixed small number needs one chunk, one scan and no shuffle; where the
    number is a column, the chunks are dealt to all tasks first, so a row moves once per chunk and no task makes
    more than a few chunks of one row.
    """
    n = copies if isinstance(copies, Column) else F.lit(copies)
    if isinstance(copies, int) and copies <= CHUNK:
        return df.withColumn("variant", F.explode(F.sequence(F.lit(first), F.lit(copies - 1 + first))))
    chunks = F.ceil(n / F.lit(CHUNK)).cast("int")
    dealt = (
        df.withColumn("_n", n.cast("int")).where(F.col("_n") > 0)
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *_keys(df), "_chunk")
    )
    start = F.col("_chunk") * CHUNK
    inside = F.sequence(start, F.least(start + CHUNK, F.col("_n")) - 1)
    return dealt.withColumn("variant", F.explode(F.transform(inside, lambda i: i + first))).drop("_n", "_chunk")


def _keys(df: DataFrame) -> list[str]:
    """The narrow columns of a table: those that may decide where a row goes."""
    return [f.name for f in df.schema if f.dataType.simpleString() in ("string", "int", "bigint")]


def class_repetitions(df: DataFrame, targets: dict[int, int], label: str = "label") -> DataFrame:
    """``label, n_source, target, reps``, one row per target class.

    ``reps`` is ``floor(target / n_source)``, at least 1, since a class already at
    its target keeps its rows. A class without rows is an error that names it.
    """
    spark = df.sparkSession
    pairs = [
        F.struct(F.lit(c).alias(label), F.lit(n).cast("bigint").alias("target")) for c, n in targets.items()
    ]
    wanted = spark.range(0, 1, 1, 1).select(F.inline(F.array(*pairs)))
    counts = (
        df.where(F.col(label).isin(list(targets)))
        .groupBy(label).agg(F.count(F.lit(1)).alias("n_source"))
    )
    empty = F.raise_error(F.concat(F.lit("no rows of class "), F.col(label).cast("string")))
    n = F.when(F.col("n_source").isNull(), empty.cast("bigint")).otherwise(F.col("n_source"))
    reps = F.greatest(F.lit(1), F.floor(F.col("target") / F.col("n_source"))).cast("int")
    found = wanted.join(counts, label, "left").withColumn("n_source", n)
    return found.select(label, "n_source", "target", reps.alias("reps"))


def balance_classes(
    df: DataFrame,
    targets: dict[int, int] = CLASS_TARGETS,
    name: str = "name",
    label: str = "label",
    exact: bool = False,
    include_original: bool = False,
) -> DataFrame:
    """Replicate every class to about its target, one named variant per copy.

    ``exact`` adds the copies that the floor leaves missing, to the first rows in md5
    order of the name. ``include_original`` keeps each source row as variant -1. The
    tables joined in have one row per target class, so they are broadcast; the image
    rows move once per chunk of copies (``fan_out``). Rows of classes without a target, and of no class, stay
    once, as variant 0.
    """
    reps = class_repetitions(df, targets, label)
    copies, mark = F.col("reps"), F.struct(F.md5(F.col(name)), F.col(name))
    if exact:
        missing = F.greatest(F.lit(0), F.col("target") - F.col("reps") * F.col("n_source"))
        ranked = exact_rank(
            df.select(label, F.md5(F.col(name)).alias("_draw"), name), [label], ["_draw", name]
        )
        last = (
            ranked.join(F.broadcast(reps), label)
            .where(F.col("rank") == missing)
            .select(label, F.struct("_draw", name).alias("_last"))
        )
        reps = reps.join(last, label, "left")
        copies = copies + F.when(mark <= F.col("_last"), 1).otherwise(0)
    aimed = F.col("reps").isNotNull()
    joined = df.join(F.broadcast(reps), label, "left")
    copies = F.when(aimed, copies + 1 if include_original else copies).otherwise(1)
    varied = fan_out(joined, copies).withColumn("variant", F.col("variant") - F.when(aimed, int(include_original)).otherwise(0))
    as_is = (F.col("variant") < 0) | ~aimed
    renamed = F.when(as_is, F.col(name)).otherwise(with_variant(F.col(name), F.col("variant")))
    return varied.withColumns({"source_name": F.col(name), name: renamed}).select(
        *df.columns, "source_name", "variant"
    )


def frame_step(fps: Column, seconds: float = SECONDS_BETWEEN_FRAMES) -> Column:
    """Frames from one kept frame to the next, halves to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(fps * F.lit(seconds), 0).cast("int"))


def stride_sample(
    frames: DataFrame, source: str, order: list[str], step: Column | int
) -> DataFrame:
    """Keep every ``step``-th row of each source and number the kept rows from 1.

    For frames without an index of their own. Run it on narrow rows, before pixels are
    attached, since ranking moves them.
    """
    every = step if isinstance(step, Column) else F.lit(max(1, step))
    before = F.col("rank") - 1
    number = F.floor(before / every).cast("bigint") + 1
    return (
        exact_rank(frames, [source], order)
        .where(F.pmod(before, every) == 0)
        .withColumns({"frame_no": number, "frame_name": frame_name(number)})
        .drop("rank")
    )


def stride_by_index(frames: DataFrame, index: str, step: Column | int) -> DataFrame:
    """``stride_sample`` for frames that carry their position from 0: a filter, no shuffle."""
    every = step if isinstance(step, Column) else F.lit(max(1, step))
    number = F.floor(F.col(index) / every).cast("bigint") + 1
    kept = frames.where(F.pmod(F.col(index), every) == 0)
    return kept.withColumns({"frame_no": number, "frame_name": frame_name(number)})


def sample_class(df: DataFrame, value: int, n: int, order: str, label: str = "label") -> DataFrame:
    """The first ``n`` rows of one class in ``order``."""
    return df.where(F.col(label) == value).orderBy(order).limit(n)
