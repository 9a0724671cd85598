"""Logits to probabilities, classes and anomaly scores, all inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescore.functions.grid import let, number_array


def softmax(logits: Column) -> Column:
    """Stable softmax of an array: the largest logit is subtracted first."""
    def shares(exps: Column) -> Column:
        total = F.aggregate(exps, F.lit(0.0), lambda acc, e: acc + e)
        return let(total, lambda t: F.transform(exps, lambda e: e / t))

    exps = let(F.array_max(logits), lambda top: F.transform(logits, lambda z: F.exp(z - top)))
    return let(exps, shares)


def anomaly_score(probs: Column) -> Column:
    """The probability of class 0."""
    return F.element_at(probs, 1)


def argmax(values: Column) -> Column:
    """The position, from 0, of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def confidence(probs: Column) -> Column:
    return F.array_max(probs)


def _weighted_sum(features: Column, weights: list[float]) -> Column:
    products = F.zip_with(features, number_array(weights), lambda v, w: v.cast("double") * w)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def linear_logits(features: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """One logit per weight row, summed left to right in double."""
    return F.array(*[
        _weighted_sum(features, row) + F.lit(float(b)) for row, b in zip(weights, bias, strict=True)
    ])


def with_scores(df: DataFrame, logits: str = "logits") -> DataFrame:
    """Add ``probs, anomaly_score, pred_class, confidence`` to rows that have logits."""
    return df.withColumn("probs", softmax(F.col(logits))).withColumns({
        "anomaly_score": anomaly_score(F.col("probs")),
        "pred_class": argmax(F.col("probs")),
        "confidence": confidence(F.col("probs")),
    })
