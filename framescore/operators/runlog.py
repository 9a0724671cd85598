"""Runs, metrics and inputs as append-only tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framescore.schema import CONFUSION, HEADS, RUN_INPUTS, RUN_METRICS, RUNS, validate

RECENT = 5
SCHEMAS = {"runs": RUNS, "run_metrics": RUN_METRICS, "run_inputs": RUN_INPUTS}


def log_run(
    spark: SparkSession, folder: str, experiment: str, run_id: str, start_time: datetime,
    params: dict[str, str], metrics: dict[str, float], inputs: dict[str, str], status: str = "FINISHED",
) -> None:
    """Append one run below ``folder``; ``inputs`` maps a context to a table name.

    ``runs`` is written last: a run that can be seen has its metrics and inputs.
    """
    def rows(values: dict[str, str] | dict[str, float], value: str, key: str) -> Column:
        pairs = [F.struct(F.lit(k).alias(key), F.lit(v).alias(value)) for k, v in values.items()]
        return F.inline(F.array(*pairs))

    one = spark.range(0, 1, 1, 1).select(F.lit(run_id).alias("run_id"))
    settings = [F.lit(x) for pair in params.items() for x in pair]
    written: dict[str, DataFrame] = {
        "runs": one.select(
            F.lit(experiment).alias("experiment"), "run_id", F.lit(status).alias("status"),
            F.lit(start_time).alias("start_time"),
            F.create_map(*settings).cast("map<string,string>").alias("params"),
        ),
    }
    if metrics:
        floats = {k: float(v) for k, v in metrics.items()}
        written["run_metrics"] = one.select("run_id", rows(floats, "value", "metric"))
    if inputs:
        written["run_inputs"] = one.select("run_id", rows(inputs, "table_name", "context"))
    for name, df in reversed(written.items()):
        validate(df, SCHEMAS[name]).write.mode("append").parquet(f"{folder}/{name}")


def save_head(spark: SparkSession, folder: str, run_id: str, weights: list[list[float]], bias: list[float], reg: float) -> None:
    """Append a fitted head, one row per class, so that later jobs score with it."""
    rows = [(run_id, k, [float(x) for x in w], float(b), float(reg)) for k, (w, b) in enumerate(zip(weights, bias))]
    spark.createDataFrame(rows, HEADS).coalesce(1).write.mode("append").parquet(f"{folder}/heads")


def load_head(spark: SparkSession, folder: str, run_id: str) -> tuple[list[list[float]], list[float]]:
    """Weights and bias of a stored head: a row per class, so a bounded read."""
    found = spark.read.schema(HEADS).parquet(f"{folder}/heads").where(F.col("run_id") == run_id).orderBy("class").collect()
    if not found:
        raise KeyError(f"no head of run {run_id}")
    return [list(r["weights"]) for r in found], [r["bias"] for r in found]


def log_confusion(matrix: DataFrame, folder: str, run_id: str) -> None:
    """Append the confusion matrix of a run (label, pred_abnormal, pred_normal)."""
    rows = matrix.select(F.lit(run_id).alias("run_id"), F.col("label").cast("int").alias("label"), "pred_abnormal", "pred_normal")
    validate(rows, CONFUSION).write.mode("append").parquet(f"{folder}/run_confusion")


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    return validate(spark.read.schema(RUNS).parquet(f"{folder}/runs"), RUNS)


def read_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return validate(spark.read.schema(RUN_METRICS).parquet(f"{folder}/run_metrics"), RUN_METRICS)


def experiments(runs: DataFrame) -> DataFrame:
    """All experiments with their number of runs."""
    return runs.groupBy("experiment").agg(F.count(F.lit(1)).alias("n_runs"))


def experiment_runs(runs: DataFrame, experiment: str) -> DataFrame:
    return runs.where(F.col("experiment") == experiment)


def recent_runs(runs: DataFrame, k: int = RECENT) -> DataFrame:
    """The ``k`` latest runs, newest first."""
    return (
        runs.orderBy(F.col("start_time").desc(), "run_id").limit(k)
        .select("run_id", "status", "start_time")
    )
