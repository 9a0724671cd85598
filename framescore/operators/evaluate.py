"""Class counts, score statistics, F1, confusion matrix and threshold policies.

Every table here is one aggregation with a partial step in each task, over a
handful of groups; no row-level data is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescore.schema import ABNORMAL, NORMAL


def row_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """All rows, and the rows of each class, in one row."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(label) == NORMAL).alias("n_normal"),
        F.count_if(F.col(label) == ABNORMAL).alias("n_abnormal"),
    )


def distinct_labels(df: DataFrame, label: str = "label") -> DataFrame:
    return df.select(label).distinct()


def label_cardinality(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.count_distinct(label).alias("num_labels"))


def split_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per split and class."""
    return df.groupBy("split", label).agg(F.count(F.lit(1)).alias("n"))


def split_class_sums(df: DataFrame, label: str = "label") -> DataFrame:
    """One row per split with a column per class."""
    return df.groupBy("split").agg(
        F.count_if(F.col(label) == ABNORMAL).alias("n_abnormal"),
        F.count_if(F.col(label) == NORMAL).alias("n_normal"),
    )


def score_columns(score: str = "anomaly_score") -> list[Column]:
    """Count, mean, population deviation, least and greatest score, as aggregates."""
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("mean_score"),
        F.stddev_pop(score).alias("std_score"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
    ]


def score_stats(scores: DataFrame, label: str = "label", score: str = "anomaly_score") -> DataFrame:
    """The score columns of each class."""
    return scores.groupBy(label).agg(*score_columns(score))


def score_separation(scores: DataFrame, label: str = "label", score: str = "anomaly_score") -> DataFrame:
    """Whether every normal score lies below every abnormal score, and by how much."""
    normal = F.max(F.when(F.col(label) == NORMAL, F.col(score)))
    abnormal = F.min(F.when(F.col(label) == ABNORMAL, F.col(score)))
    return scores.agg(normal.alias("max_normal"), abnormal.alias("min_abnormal")).select(
        "max_normal", "min_abnormal",
        (F.col("min_abnormal") - F.col("max_normal")).alias("gap"),
        (F.col("max_normal") < F.col("min_abnormal")).alias("separated"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def threshold_sweep(scores: DataFrame, thresholds: list[float], label: str = "label", score: str = "anomaly_score") -> DataFrame:
    """Decisions at each threshold, flagging scores at or above it as abnormal.

    All thresholds are counted in one pass: four counters each, then unfolded.
    """
    abnormal, normal = F.col(label) == ABNORMAL, F.col(label) == NORMAL

    def counters(t: float) -> Column:
        flagged = F.col(score) >= t
        return F.struct(
            F.lit(float(t)).alias("threshold"),
            F.count_if(abnormal & flagged).alias("true_alarms"),
            F.count_if(normal & flagged).alias("false_alarms"),
            F.count_if(abnormal & ~flagged).alias("missed"),
            F.count_if(normal & ~flagged).alias("passed"),
        )

    unfolded = scores.agg(F.array(*[counters(t) for t in thresholds]).alias("_t")).select(F.inline("_t"))
    return unfolded.withColumns({
        "false_positive_rate": _ratio(F.col("false_alarms"), F.col("false_alarms") + F.col("passed")),
        "false_negative_rate": _ratio(F.col("missed"), F.col("missed") + F.col("true_alarms")),
    })


def f1_scores(predicted: DataFrame, label: str = "label", prediction: str = "pred_class") -> DataFrame:
    """Accuracy, F1 of each class as the positive class, and their mean."""
    y, p = F.col(label), F.col(prediction)

    def f1(cls: int) -> Column:
        hits = F.count_if((y == cls) & (p == cls))
        return _ratio(2.0 * hits, F.count_if(y == cls) + F.count_if(p == cls))

    return predicted.agg(
        F.count(F.lit(1)).alias("n"),
        _ratio(F.count_if(y == p).cast("double"), F.count(F.lit(1))).alias("accuracy"),
        f1(NORMAL).alias("f1_normal"),
        f1(ABNORMAL).alias("f1_abnormal"),
    ).withColumn("f1_macro", (F.col("f1_normal") + F.col("f1_abnormal")) / 2)


def confusion_matrix(predicted: DataFrame, label: str = "label", prediction: str = "pred_class") -> DataFrame:
    """A row per true class, a column per predicted class."""
    p = F.col(prediction)
    return predicted.groupBy(label).agg(
        F.count_if(p == ABNORMAL).alias("pred_abnormal"),
        F.count_if(p == NORMAL).alias("pred_normal"),
    )


def prior_baseline(split_rows: DataFrame, label: str = "label") -> DataFrame:
    """How the untrained predictor does: the larger train class for every eval row.

    The four class counts decide everything, so nothing is joined back to the rows.
    """
    train, held_out = F.col("split") == "train", F.col("split") == "eval"
    normal, abnormal = F.col(label) == NORMAL, F.col(label) == ABNORMAL
    counts = split_rows.agg(
        F.count_if(train & normal).alias("_train_normal"),
        F.count_if(train & abnormal).alias("_train_abnormal"),
        F.count_if(held_out & normal).alias("_normal"),
        F.count_if(held_out & abnormal).alias("_abnormal"),
    )
    n = F.col("_normal") + F.col("_abnormal")
    prior = F.when(F.col("_train_normal") > F.col("_train_abnormal"), NORMAL).otherwise(ABNORMAL)
    hits = F.when(prior == NORMAL, F.col("_normal")).otherwise(F.col("_abnormal"))

    def f1(cls: int) -> Column:
        return F.when(prior == cls, _ratio(2.0 * hits, n + hits)).otherwise(F.lit(0.0))

    return counts.select(
        n.alias("n"), prior.alias("prior_class"),
        _ratio(hits.cast("double"), n).alias("accuracy"),
        f1(NORMAL).alias("f1_normal"), f1(ABNORMAL).alias("f1_abnormal"),
    ).withColumn("f1_macro", (F.col("f1_normal") + F.col("f1_abnormal")) / 2)
