"""A classifier head on frozen features, fitted with Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescore.functions.probability import with_scores
from framescore.operators.evaluate import f1_scores

# The weight decay.
WEIGHT_DECAY = 0.01

MAX_ITERATIONS = 100
GRID = (0.001, WEIGHT_DECAY, 0.1)


@dataclass(frozen=True)
class Head:
    """Weights and bias per class, and what fitting them measured."""

    weights: list[list[float]]
    bias: list[float]
    reg: float
    metrics: dict[str, float]
    model: LogisticRegressionModel
    # Evaluation of every value of the grid, the kept one among them.
    tried: dict[float, dict[str, float]]


def _vectors(df: DataFrame, features: str, label: str) -> DataFrame:
    return df.select(
        array_to_vector(F.col(features).cast("array<double>")).alias("features"),
        F.col(label).cast("double").alias("label"),
    )


def predict(df: DataFrame, model: LogisticRegressionModel, features: str = "features") -> DataFrame:
    """Add logits and everything derived from them to ``df``."""
    vectors = df.withColumn("_v", array_to_vector(F.col(features).cast("array<double>")))
    raw = model.copy().setFeaturesCol("_v").transform(vectors)
    logits = vector_to_array("rawPrediction")
    return with_scores(
        raw.withColumn("logits", logits).drop("_v", "rawPrediction", "probability", "prediction")
    )


def fit_head(
    df: DataFrame, features: str = "features", label: str = "label",
    reg: float = WEIGHT_DECAY, iterations: int = MAX_ITERATIONS, tol: float = 1e-6,
) -> LogisticRegressionModel:
    """Fit logits per class. Gradients are summed on executors; rows stay there.

    ``tol`` stops early, once an iteration improves the fit by no more than that.
    """
    return fit_vectors(_vectors(df, features, label), reg, iterations, tol)


def fit_vectors(vectors: DataFrame, reg: float, iterations: int, tol: float = 1e-6) -> LogisticRegressionModel:
    """``fit_head`` for ``features, label`` as Spark ML takes them; persist them when several heads are fitted."""
    estimator = LogisticRegression(
        family="multinomial", regParam=reg, maxIter=iterations, tol=tol, standardization=False,
        featuresCol="features", labelCol="label",
    )
    return estimator.fit(vectors)


def gradient(
    df: DataFrame, model: LogisticRegressionModel, reg: float, features: str = "features", label: str = "label"
) -> DataFrame:
    """``class, feature, slope``: the slope of the penalised mean loss at the fitted weights.

    With ``reg`` above 0 the best weights are unique, and there every slope is 0.
    """
    return slopes(predict(df, model, features), model.coefficientMatrix.toArray().tolist(), reg, features, label)


def slopes(rows: DataFrame, weights: list[list[float]], reg: float, features: str = "features", label: str = "label") -> DataFrame:
    """``gradient`` of any head with these weights, given its rows with their ``probs``."""
    table = [(k, j, float(w)) for k, row in enumerate(weights) for j, w in enumerate(row)]
    n = len(weights)
    error = [F.col("probs")[k] - (F.col(label) == k).cast("double") for k in range(n)]
    cells = rows.select(*[e.alias(f"e{k}") for k, e in enumerate(error)], F.posexplode(F.col(features).cast("array<double>")).alias("feature", "x"))
    sums = cells.groupBy("feature").agg(*[F.avg(F.col(f"e{k}") * F.col("x")).alias(f"g{k}") for k in range(n)])
    long = sums.select("feature", F.posexplode(F.array(*[F.col(f"g{k}") for k in range(n)])).alias("class", "mean"))
    known = rows.sparkSession.createDataFrame(table, "class int, feature int, weight double")
    return long.join(F.broadcast(known), ["class", "feature"]).select("class", "feature", (F.col("mean") + reg * F.col("weight")).alias("slope"))


def fit_best_head(
    rows: DataFrame, features: str = "features", label: str = "label",
    grid: tuple[float, ...] = GRID, iterations: int = MAX_ITERATIONS,
) -> Head:
    """Fit one head per regularisation on the train split, keep the best F1 on eval.

    ``rows`` has ``split`` (see ``hash_split``), so every head sees the same rows.
    """
    train, held_out = rows.where(F.col("split") == "train"), rows.where(F.col("split") == "eval")
    vectors = _vectors(train, features, label).persist()
    best: Head | None = None
    tried: dict[float, dict[str, float]] = {}
    for reg in grid:
        model = fit_vectors(vectors, reg, iterations)
        tried[reg] = found = f1_scores(predict(held_out, model, features), label).first().asDict()
        if best is None or found["f1_normal"] > best.metrics["f1_normal"]:
            best = Head(
                model.coefficientMatrix.toArray().tolist(), model.interceptVector.toArray().tolist(),
                reg, found, model, tried,
            )
    vectors.unpersist()
    return best
