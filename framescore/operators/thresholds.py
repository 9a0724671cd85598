"""Thresholds for a wanted error rate: exact over the scores' order, or from sketches that are kept and merged.

A row is flagged as abnormal if its score is at or above the threshold. Ties share a side, so only scores themselves are thresholds, and
"none" is the threshold above all scores (infinity).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescore.operators.ranking import running_totals
from framescore.schema import ABNORMAL, NORMAL

# Scores kept per level of a sketch: the rank error is below ``RANK_ERROR`` with probability 0.99.
SKETCH_K, RANK_ERROR = 800, 0.005


def score_order(scores: DataFrame, label: str = "label", score: str = "anomaly_score") -> DataFrame:
    """One row per distinct score: how many normal and abnormal rows lie at or above it.

    Rows are counted by score before they are put in order, partial in each task.
    """
    known = scores.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    counts = known.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == NORMAL).alias("normal"), F.count_if(F.col(label) == ABNORMAL).alias("abnormal")
    )
    return running_totals(counts, ["threshold"], ["normal", "abnormal"], descending=True)


def threshold_at_rate(scores: DataFrame, rates: list[float], label: str = "label", score: str = "anomaly_score") -> DataFrame:
    """For each false-alarm rate, the lowest threshold that keeps to it, and what is missed there.

    ``rate, threshold, false_alarms, false_alarm_rate, missed, miss_rate``. A rate that no score keeps to has an infinite threshold.
    Without rows of a class its rate is 0.
    """
    order = score_order(scores, label, score)
    total = order.agg(*[F.coalesce(F.max(f"until_{c}"), F.lit(0)).alias(c) for c in ("normal", "abnormal")]).first()

    def lowest(rate: float) -> Column:
        allowed = F.when(F.col("until_normal") <= rate * total["normal"], F.col("threshold"))
        return F.struct(
            F.lit(float(rate)).alias("rate"), F.min(allowed).alias("threshold"),
            F.coalesce(F.min_by("until_normal", allowed), F.lit(0)).alias("false_alarms"), F.coalesce(F.min_by("until_abnormal", allowed), F.lit(0)).alias("_found"),
        )

    # All rates in one pass.
    found = order.agg(F.array(*[lowest(r) for r in rates]).alias("_r")).select(F.inline("_r"))
    share = lambda part, whole: part / whole if whole else F.lit(0.0)
    missed = total["abnormal"] - F.col("_found")
    return found.select(
        "rate", F.coalesce("threshold", F.lit(float("inf"))).alias("threshold"), "false_alarms",
        share(F.col("false_alarms"), total["normal"]).alias("false_alarm_rate"), missed.alias("missed"), share(missed, total["abnormal"]).alias("miss_rate"),
    )


def score_sketches(scores: DataFrame, run: str, label: str = "label", score: str = "anomaly_score") -> DataFrame:
    """``run, label, n, sketch``: a mergeable sketch of each class's scores, to be kept with the run."""
    known = scores.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    return known.groupBy(F.lit(run).alias("run"), F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(score).cast("double"), SKETCH_K).alias("sketch")
    )


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """``label, n, sketch`` over all runs."""
    return sketches.groupBy("label").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"))


def sketched_threshold(sketches: DataFrame, rate: float) -> DataFrame:
    """``label, n, threshold``: the score that about ``rate`` of each class lies above."""
    return merged_sketches(sketches).select("label", "n", F.kll_sketch_get_quantile_double("sketch", F.lit(1.0 - rate)).alias("threshold"))
