"""Batch scoring with any model that maps an array of inputs to logits.

The contract is the same for all models: a scorer gives one ``array<double>`` of
logits per row, and probabilities, class and anomaly score are derived from it
inside Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescore.functions.indexmaps import MODEL_SIZE
from framescore.functions.probability import with_scores
from framescore.operators.tensors import stacks_of, tensor_stack
from framescore.schema import SCORES, validate

Predict = Callable[[np.ndarray], np.ndarray]
LOGITS = T.ArrayType(T.DoubleType())


def vector_logits(features: Column, make_predict: Callable[[], Predict], width: int, batch_size: int = 1024) -> Column:
    """Logits of feature vectors; ``make_predict`` loads the model once per worker."""
    return predict_batch_udf(
        make_predict, return_type=LOGITS, batch_size=batch_size, input_tensor_shapes=[[width]]
    )(features)


def image_logits(
    image: Column, make_predict: Callable[[], Predict], size: int = MODEL_SIZE, batch_size: int = 64
) -> Column:
    """Logits of images. Tensors are made next to the model, so only logits return to Spark."""

    @F.pandas_udf(LOGITS)
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        predict = make_predict()
        for images in batches:
            out = pd.Series([None] * len(images), dtype=object)
            for index, stack in stacks_of(images):
                for start in range(0, len(index), batch_size):
                    part = slice(start, start + batch_size)
                    logits = np.asarray(predict(tensor_stack(stack[part], size)), float)
                    out.loc[index[part]] = pd.Series(list(logits), index=index[part], dtype=object)
            yield out

    return score(image)


def score_table(df: DataFrame, logits: Column, keep: list[str]) -> DataFrame:
    """``keep`` plus the score columns, with the declared types checked."""
    scored = with_scores(df.select(*keep, logits.alias("logits")))
    validate(scored, SCORES)
    return scored


def linear_predict(weights: list[list[float]], bias: list[float]) -> Callable[[], Predict]:
    """A loader for a linear head, for use as ``make_predict``."""

    def load() -> Predict:
        w, b = np.asarray(weights, float), np.asarray(bias, float)
        return lambda x: x.reshape(len(x), -1).astype(float) @ w.T + b

    return load
