"""Heads fitted in epochs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from framescore.operators import epochs, head


def _rows(spark, path, n=240, noise=0.0, size=6, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x = [r.gauss(0, 1) for _ in range(size)]
        label = int(x[0] - 0.5 * x[1] > 0)
        if r.random() < noise:
            label = 1 - label
        rows.append((x, label, "eval" if i % 4 == 0 else "train"))
    spark.createDataFrame(rows, "features array<double>, label int, split string").repartition(3).write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_run_on_it_reaches_the_optimum(spark, tmp_path):
    rows = _rows(spark, tmp_path / "r", noise=0.2)
    fitted = epochs.fit_epochs(rows, reg=0.01, epochs=100, patience=None, tol=1e-6)
    assert fitted.stopped == "optimum" and fitted.epoch == len(fitted.history) < 60
    losses = [h["loss"] for h in fitted.history]
    assert all(b <= a + 1e-12 for a, b in zip(losses, losses[1:]))
    model = head.fit_head(rows.where("split = 'train'"), reg=0.01, iterations=500, tol=1e-12)
    assert np.allclose(fitted.weights, model.coefficientMatrix.toArray(), atol=2e-3)


def test_stops_when_the_metric_gets_no_better_and_keeps_the_best(spark, tmp_path):
    rows = _rows(spark, tmp_path / "r", n=160, noise=0.3, size=20)
    fitted = epochs.fit_epochs(rows, reg=1e-4, epochs=40, patience=3, tol=1e-9)
    assert fitted.stopped == "patience" and len(fitted.history) < 40 and len(fitted.history) == fitted.epoch + 3
    f1 = [h["f1_normal"] for h in fitted.history]
    assert fitted.metrics["f1_normal"] == max(f1) == f1[fitted.epoch - 1]
    best = epochs.fit_best(rows, grid=(1e-4, 0.1), epochs=8, patience=2)
    assert best.metrics["f1_normal"] >= max(f1[:3])


def test_measures_equal_those_of_scored_rows(spark, tmp_path):
    from framescore.functions.probability import linear_logits, with_scores
    from framescore.operators.evaluate import f1_scores
    from pyspark.sql import functions as F

    rows = _rows(spark, tmp_path / "r", noise=0.1)
    fitted = epochs.fit_epochs(rows, epochs=3, patience=None)
    logits = linear_logits(F.col("features"), fitted.weights, fitted.bias)
    want = f1_scores(with_scores(rows.where("split = 'eval'").withColumn("logits", logits))).first().asDict()
    for name in ("n", "accuracy", "f1_normal", "f1_abnormal", "f1_macro"):
        assert fitted.metrics[name] == pytest.approx(want[name])


def test_slopes_come_in_blocks(spark, tmp_path, monkeypatch):
    rows = _rows(spark, tmp_path / "r", n=60)
    whole = epochs.fit_epochs(rows, epochs=2, patience=None)
    monkeypatch.setattr(epochs, "BLOCK", 4)
    monkeypatch.setattr(epochs, "FAN", 1)
    assert np.allclose(epochs.fit_epochs(rows, epochs=2, patience=None).weights, whole.weights)


def test_nothing_to_fit_is_an_error(spark, tmp_path):
    rows = _rows(spark, tmp_path / "r", n=8)
    for part in (rows.where("false"), rows.where("split = 'eval'")):
        with pytest.raises(ValueError):
            epochs.fit_epochs(part)
