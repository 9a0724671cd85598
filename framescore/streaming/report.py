"""Score statistics and confusion counts of a scored stream, by windows of event time.

Every micro-batch adds sums to the report: counts, sums, extremes and confusion counts per window and class, written once under
the batch's number. Sums are additive, so the report does not depend on the order in which rows arrive or on how they are cut into
micro-batches, and a replayed micro-batch replaces its own sums. No state is kept but the sums themselves.

The watermark is the greatest event time of the micro-batches before, less ``delay``. A row is late if its window ended at or before it. Spark's
own streaming aggregates drop late rows; here they are kept in a table of their own, so that nothing is lost unseen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framescore.schema import ABNORMAL, NORMAL
from framescore.sources import folders


def window_sums(rows: DataFrame, time: str, width: str, label: str = "label", score: str = "anomaly_score", predicted: str = "pred_class") -> DataFrame:
    """Additive sums per window and class, and the greatest event time in them; rows without a time are left out."""
    return rows.where(F.col(time).isNotNull()).groupBy(F.window(time, width).alias("w"), F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.count(score).alias("n_scores"), F.sum(score).alias("sum_score"), F.sum(F.col(score) * F.col(score)).alias("sum_square"),
        F.min(score).alias("min_score"), F.max(score).alias("max_score"), F.count_if(F.col(predicted) == ABNORMAL).alias("pred_abnormal"),
        F.count_if(F.col(predicted) == NORMAL).alias("pred_normal"), F.max(time).alias("last"),
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "label", "n", "n_scores", "sum_score", "sum_square", "min_score", "max_score",
             "pred_abnormal", "pred_normal", "last")


def _parts(spark: SparkSession, path: str) -> DataFrame | None:
    """The sums of all micro-batches."""
    if not any(n.startswith("batch=") for n in folders.names(spark, f"{path}/sums")):
        return None
    return spark.read.parquet(f"{path}/sums")


def report_stream(stream: DataFrame, time: str, width: str, delay: str, path: str, checkpoint: str, **columns: str) -> StreamingQuery:
    """Add a scored stream to the report at ``path``, all that is available now. ``columns`` name label, score and predicted."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _parts(spark, path)
        last = before.where(F.col("batch") < number).agg(F.max("last")).first()[0] if before is not None else None
        # One reading of the micro-batch for both tables.
        batch = batch.persist()
        if last is None:
            late = F.lit(False)
        else:
            watermark = F.lit(last).cast(batch.schema[time].dataType) - F.expr(f"INTERVAL {delay}")
            late = F.coalesce(F.window(time, width)["end"] <= watermark, F.lit(False))
        marked = batch.withColumn("_late", late)
        marked.where("_late").drop("_late").write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        window_sums(marked.where("NOT _late"), time, width, **columns).write.mode("overwrite").parquet(f"{path}/sums/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """``start, end, label, n, mean_score, std_score, min_score, max_score, pred_abnormal, pred_normal`` of all rows so far that were not late."""
    return summarise(_parts(spark, path))


def summarise(sums: DataFrame) -> DataFrame:
    """The report of any ``window_sums``, those of several micro-batches added up."""
    total = sums.groupBy("start", "end", "label").agg(
        *[F.sum(c).alias(c) for c in ("n", "n_scores", "sum_score", "sum_square", "pred_abnormal", "pred_normal")],
        F.min("min_score").alias("min_score"), F.max("max_score").alias("max_score"),
    )
    mean = F.when(F.col("n_scores") > 0, F.col("sum_score") / F.col("n_scores"))
    spread = F.sqrt(F.greatest(F.when(F.col("n_scores") > 0, F.col("sum_square") / F.col("n_scores")) - mean * mean, F.lit(0.0)))
    return total.select("start", "end", "label", "n", mean.alias("mean_score"), spread.alias("std_score"), "min_score", "max_score", "pred_abnormal", "pred_normal")


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that came after their window was closed."""
    return spark.read.parquet(f"{path}/late").drop("batch")
