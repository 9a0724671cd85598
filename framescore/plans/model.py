"""Train a head on a gold table, score tables with it, and judge the scores."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescore.functions.names import root
from framescore.functions.probability import linear_logits
from framescore.operators.evaluate import confusion_matrix, f1_scores, prior_baseline
from framescore.operators.head import GRID, MAX_ITERATIONS, Head, fit_best_head, predict
from framescore.operators.runlog import load_head, log_confusion, log_run, save_head
from framescore.operators.sampling import hash_split
from framescore.operators.scoring import score_table
from framescore.operators.tensors import pixel_features
from framescore.session import cut_lineage


def training_rows(gold: DataFrame, size: int = 8, by_source: bool = True) -> DataFrame:
    """``name, source_name, label, features, split`` of a gold table.

    All variants of one frame fall on one side of the split; ``by_source=False`` splits row by row.
    """
    source = F.col("source_name") if "source_name" in gold.columns else root(F.col("name"))
    rows = gold.select("name", source.alias("source_name"), "label", pixel_features(F.col("image"), size).alias("features"))
    return hash_split(rows, "source_name" if by_source else "name")


def train(
    spark: SparkSession, rows: DataFrame, run_dir: str, experiment: str, run_id: str,
    started: datetime, table: str, grid: tuple[float, ...] = GRID, iterations: int = MAX_ITERATIONS,
) -> tuple[Head, DataFrame]:
    """Fit the best head, store it, and log it next to the untrained baseline and the heads not chosen.

    The feature rows are written first and returned with the head: fitting reads them
    many times, and they must not be computed from the pixels each time.
    """
    rows = cut_lineage(rows, "features")
    baseline = prior_baseline(rows).first()
    head = fit_best_head(rows, grid=grid, iterations=iterations)
    on_train = f1_scores(predict(rows.where(F.col("split") == "train"), head.model)).first().asDict()
    metrics = {
        **head.metrics, "baseline_f1_normal": baseline["f1_normal"],
        **{f"train_{k}": v for k, v in on_train.items()},
        **{f"{k}@{reg}": v for reg, found in head.tried.items() for k, v in found.items()},
    }
    metrics = {k: v for k, v in metrics.items() if v is not None}
    save_head(spark, run_dir, run_id, head.weights, head.bias, head.reg)
    log_confusion(confusion_matrix(predict(rows.where(F.col("split") == "eval"), head.model)), run_dir, run_id)
    log_run(
        spark, run_dir, experiment, run_id, started,
        {"reg": str(head.reg), "iterations": str(iterations)}, metrics, {"Training-Input": table},
    )
    return head, rows


def score_stored(spark: SparkSession, rows: DataFrame, run_dir: str, run_id: str, keep: list[str], features: str = "features") -> DataFrame:
    """``score`` with a head that an earlier job has stored; ``rows`` may be a stream."""
    weights, bias = load_head(spark, run_dir, run_id)
    return score_table(rows, linear_logits(F.col(features), weights, bias), keep)


def score(rows: DataFrame, head: Head, keep: list[str], features: str = "features") -> DataFrame:
    """Scores of feature rows. A linear head is an expression, so no Python runs."""
    return score_table(rows, linear_logits(F.col(features), head.weights, head.bias), keep)
