"""Thresholds for a rate, sketches of scores, and labelling that survives lost tasks."""

from __future__ import annotations

import os
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framescore.operators import thresholds
from framescore.operators.ranking import running_totals
from framescore.plans.labelling import label_stream, stream_contents, unanswered


def _scores(spark, n=3000, seed=3):
    r = random.Random(seed)
    rows = [(int(r.random() < 0.8), round(r.random(), 2) if r.random() < 0.5 else r.random()) for _ in range(n)]
    rows = [(y, s if y else min(1.0, s + 0.3)) for y, s in rows]
    return rows, spark.createDataFrame([*rows, (None, 0.5), (1, None), (0, float("nan"))], "label int, anomaly_score double").repartition(7)


def test_threshold_at_rate_equals_a_search(spark):
    rows, table = _scores(spark)
    rates = [0.0, 0.013, 0.2, 1.0]
    normal, abnormal = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    for got in thresholds.threshold_at_rate(table, rates).collect():
        allowed = [t for t in {s for _, s in rows} if sum(s >= t for s in normal) <= got.rate * len(normal)]
        t = min(allowed, default=float("inf"))
        assert got.threshold == t and got.false_alarms == sum(s >= t for s in normal) and got.missed == sum(s < t for s in abnormal)
        assert got.miss_rate == pytest.approx(got.missed / len(abnormal))


def test_rates_without_rows(spark):
    none = spark.createDataFrame([], "label int, anomaly_score double")
    (row,) = thresholds.threshold_at_rate(none, [0.1]).collect()
    assert row.threshold == float("inf") and row.false_alarms == 0 and row.miss_rate == 0.0
    ties = spark.createDataFrame([(1, 0.7)] * 10 + [(0, 0.7)] * 3, "label int, anomaly_score double")
    rows = {r.rate: r for r in thresholds.threshold_at_rate(ties, [0.5, 1.0]).collect()}
    assert rows[0.5].threshold == float("inf") and rows[0.5].missed == 3 and rows[1.0].threshold == 0.7


def test_running_totals(spark):
    rows = [(i, i % 7 - 3) for i in range(1000)]
    table = spark.createDataFrame(rows, "i int, v int").repartition(6)
    for down in (False, True):
        got = {r.i: r.until_v for r in running_totals(table, ["i"], ["v"], down).collect()}
        total, want = 0, {}
        for i, v in sorted(rows, reverse=down):
            total += v
            want[i] = total
        assert got == want


def test_sketches_of_runs_merge_within_their_error(spark):
    rows, table = _scores(spark, 20_000)
    known = table.withColumn("run", F.pmod(F.xxhash64("anomaly_score"), F.lit(4)))
    kept = [thresholds.score_sketches(known.where(F.col("run") == i), f"run-{i}") for i in range(4)]
    every = kept[0].unionByName(kept[1]).unionByName(kept[2]).unionByName(kept[3])
    assert every.select("run").distinct().count() == 4
    for rate in (0.01, 0.1, 0.5):
        for got in thresholds.sketched_threshold(every, rate).where("label IS NOT NULL").collect():
            own = [s for y, s in rows if y == got.label]
            above, at = sum(s > got.threshold for s in own), sum(s == got.threshold for s in own)
            # Ties share a rank, so the wanted rank lies within their span, but for the error.
            assert got.n == len(own)
            assert above - thresholds.RANK_ERROR * len(own) <= rate * len(own) <= above + at + thresholds.RANK_ERROR * len(own)


def _labeller(log, dies):
    def labeller(content: bytes) -> str:
        name = content.decode()
        with open(f"{log}/calls", "a") as calls:
            calls.write(name + "\n")
        if name == "image 17" and dies and not os.path.exists(f"{log}/died"):
            open(f"{log}/died", "w").close()
            os._exit(1)
        if name.endswith("3"):
            raise ValueError("busy")
        return '{"label": "x", "notes": ""}'

    return labeller


def test_a_lost_task_costs_the_calls_of_its_slice_only(spark, tmp_path):
    folder, log = tmp_path / "images", tmp_path / "log"
    folder.mkdir()
    log.mkdir()
    start = time.time() - 1000
    for i in range(30):
        path = folder / f"n{i:02}.jpg"
        path.write_bytes(f"image {i}".encode())
        os.utime(path, (start + i, start + i))
    out, progress = f"{tmp_path}/replies", f"{tmp_path}/progress"

    def run():
        label_stream(stream_contents(spark, str(folder), 10), _labeller(str(log), True), out, progress, in_flight=2).awaitTermination()

    with pytest.raises(Exception, match="STREAM_FAILED|exited|crash"):
        run()
    assert spark.read.parquet(out).count() == 10
    run()
    calls = Counter((log / "calls").read_text().split("\n")[:-1])
    assert set(calls) == {f"image {i}" for i in range(30)}
    # Only images of the slice that was lost are sent twice.
    assert {n for n, c in calls.items() if c > 1} <= {f"image {i}" for i in range(10, 20)} and max(calls.values()) == 2
    assert spark.read.parquet(out).count() == 30
    assert sorted(r.name for r in unanswered(spark, out).collect()) == ["n03.jpg", "n13.jpg", "n23.jpg"]
    (folder / "later.png").write_bytes(b"image 99")
    run()
    assert sum(Counter((log / "calls").read_text().split("\n")[:-1]).values()) == sum(calls.values()) + 1
