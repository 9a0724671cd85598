"""Operator 8: mixing sources to target weights by capped water-filling.

Every source gets budget in proportion to its weight, but no more than ``max_epochs`` times its size. The excess
of sources at their cap goes to the others by weight until none is above: with sources sorted by cap over weight, the
water level is where the sources before it are full, so two running sums over one row per source find it.

A source whose target is e times its size takes each document floor(e) times, and once more, in a seeded random
order, until the target is met; the document at the border gives a fraction of its words. The order is
md5(seed|doc_id): its first 12 bits deal a source's documents into 4,096 bins, whose sizes are summed before the
shuffle; only the documents of the one bin at the border are ordered and summed one by one.

Defined cases: a null text has size 0; a null source is a source, the last; a source of size 0 or of weight 0 takes
nothing; equal rows are taken alike and in order of their text; an empty table gives no rows; a null doc_id is ordered as an
empty string. Columns named like the added ones (size, source_size, target, taken) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framescore.llm.words import SPACES, WORD

WEIGHTS, SHARE, MAX_EPOCHS, SEED = (5, 2, 1), 1.5, 2, "mix-1"
BIN_DIGITS = 3


def word_count(text: Column) -> Column:
    """The number of words; one less than the cuts of the text between its first and last word."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.regexp_count(trimmed, F.lit(WORD))).cast("bigint")


def water_fill(sources: DataFrame, budget: Column, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Add target to (source, source_size, weight), one row per source: the capped shares of ``budget``."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf")))
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    filled = (
        sources.withColumn("cap", cap).withColumn("level", level)
        .withColumn("total", budget)
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(after))
        # The level if this source and all later ones were below their caps; the first that holds is the true one.
        .withColumn("water", F.when((F.col("rest") > 0) & (F.col("level") * F.col("rest") > F.col("left")), F.col("left") / F.col("rest")))
        .withColumn("water", F.min(F.struct(F.when(F.col("water").isNull(), 1).otherwise(0).alias("none"), "level", F.col("source").isNull().alias("last"), "source", "water")).over(Window.partitionBy(F.lit(1)))["water"])
    )
    target = F.when(F.col("weight") <= 0, 0.0).otherwise(F.least("cap", F.coalesce(F.greatest("water", F.lit(0.0)) * F.col("weight"), F.col("cap"))))
    return filled.withColumn("target", target).select(*sources.columns, "target")


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, order, text_hash): narrow rows, all that the mix decides on."""
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("order"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"))


def source_targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target): sources by code point, null last, weigh ``weights`` in turn.

    The windows over all sources hold one row per source.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(every) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    table = sizes.withColumn("weight", weight)
    budget = F.sum("source_size").over(Window.partitionBy(F.lit(1))) * F.lit(float(share))
    return water_fill(table, budget, max_epochs)


def take(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Add source_size, target, whole (repetitions), part (words of a further, partial one) and taken.

    ``rows`` is read twice: write it first where it is costly.
    """
    binned = rows.withColumn("bin", F.substring("order", 1, BIN_DIGITS))
    size = F.col("source_size")
    goal = F.round("target").cast("bigint")
    whole = F.when(size > 0, F.floor(goal / size)).otherwise(F.lit(0)).cast("bigint")
    plan = (
        targets.select(F.col("source").alias("s"), "source_size", "target", goal.alias("goal"), whole.alias("whole"))
        .withColumn("extra", F.col("goal") - F.col("whole") * size)
    )
    # Where each bin begins in its source's order: at most 16^3 rows a source.
    in_source = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        binned.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
        .withColumn("bin_start", F.coalesce(F.sum("bin_size").over(in_source), F.lit(0)))
        .join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .select(F.col("source").alias("s"), F.col("bin").alias("b"), "bin_size", "bin_start", "source_size", "target", "whole", "extra")
    )
    placed = binned.join(bins, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b"))).drop("s", "b")
    border = (F.col("bin_start") < F.col("extra")) & (F.col("bin_start") + F.col("bin_size") > F.col("extra"))
    in_bin = Window.partitionBy("source", "bin").orderBy("order", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    at_border = (
        placed.where(border)
        .withColumn("start", F.col("bin_start") + F.coalesce(F.sum("size").over(in_bin), F.lit(0)))
        .withColumn("part", F.least("size", F.greatest(F.lit(0), F.col("extra") - F.col("start"))))
        .drop("start")
    )
    clear = placed.where(~border).withColumn("part", F.when(F.col("bin_start") + F.col("bin_size") <= F.col("extra"), F.col("size")).otherwise(F.lit(0)))
    return (
        clear.unionByName(at_border)
        .withColumn("taken", (F.col("size") * F.col("whole") + F.col("part")).cast("bigint"))
        .drop("bin", "bin_size", "bin_start", "extra")
    )


def materialise(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """The mix itself: each document's row once per repetition, the partial one cut after its last taken word.

    Keeps the columns of ``docs``; n_chars, if there is one, counts the text that is taken. Documents of size 0 go.
    Rows are matched by doc_id and text; equal rows are all taken as often as the one that is taken most.
    """
    plan = taken.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.max("whole").alias("whole"), F.max("part").alias("part"), F.max("size").alias("_size")
    )
    keyed = docs.withColumn("_text_hash", F.md5(F.coalesce(F.col("text"), F.lit(""))))
    joined = keyed.join(plan, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")))
    copies = F.when(F.col("_size") == 0, F.lit(0)).otherwise(F.col("whole") + (F.col("part") > 0).cast("int"))
    rows = joined.where(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies.cast("bigint"))))
    partial = (F.col("_copy") > F.col("whole")) & (F.col("part") < F.col("_size"))
    head = F.regexp_extract("text", r"^[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", 0)
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0)
    cut = F.when(F.col("part") == 1, head).otherwise(F.array_join(F.slice(words, 1, F.col("part").cast("int")), ""))
    out = rows.withColumn("text", F.when(partial, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k, md5(coalesce(text, '')) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight,
         1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM s),
-- The water level fills all sources' capped shares to the total; shares grow with it piecewise linearly.
levels AS (
  SELECT a.source, 2.0::DOUBLE * a.source_size / a.weight AS level FROM w a),
fill AS (
  SELECT l.level, sum(least(2.0::DOUBLE * b.source_size, l.level * b.weight)) AS filled, any_value(b.total) AS total,
         sum(CASE WHEN 2.0::DOUBLE * b.source_size / b.weight < l.level THEN 0 ELSE b.weight END) AS open_weight,
         sum(CASE WHEN 2.0::DOUBLE * b.source_size / b.weight < l.level THEN 2.0::DOUBLE * b.source_size ELSE 0 END) AS full_size
  FROM (SELECT DISTINCT level FROM levels) l, w b GROUP BY l.level),
water AS (
  SELECT (total - full_size) / open_weight AS water FROM fill WHERE filled > total ORDER BY level LIMIT 1),
t AS (
  SELECT w.*, least(2.0::DOUBLE * source_size, coalesce((SELECT water FROM water) * weight, 2.0::DOUBLE * source_size)) AS target FROM w),
p AS (
  SELECT *, CAST(round(target) AS BIGINT) AS goal FROM t),
r AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.goal,
         CASE WHEN p.source_size > 0 THEN p.goal // p.source_size ELSE 0 END AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * whole + least(size, greatest(0, goal - whole * source_size - before)) AS BIGINT) AS taken
FROM r
""".replace("{seed}", SEED)
