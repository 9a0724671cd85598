"""A report over a scored stream equals the batch's, whatever the order of arrival."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from framescore.streaming.report import late_rows, read_report, report_stream, summarise, window_sums
from framescore.streaming.score import stream_table

SCHEMA = "ts timestamp, label int, anomaly_score double, pred_class int"


def _rows(n=200, seed=1):
    r = random.Random(seed)
    start = datetime(2024, 5, 1)
    rows = [(start + timedelta(minutes=r.randrange(3000)), r.choice([0, 1, None]), r.random(), r.randrange(2)) for _ in range(n)]
    return [*rows, (None, 1, 0.5, 1), (start, 1, None, None)]


def _run(spark, path, pieces, delay):
    for piece in pieces:
        spark.createDataFrame(piece, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    report_stream(stream_table(spark, f"{path}/in", 1), "ts", "2 hours", delay, f"{path}/out", f"{path}/p").awaitTermination()


def _told(rows):
    return sorted(((r.start, str(r.label), r.n, r.pred_abnormal, r.pred_normal, r.min_score, r.max_score) for r in rows), key=str)


def test_report_equals_the_batch_in_any_order(spark, tmp_path):
    rows = _rows()
    want = summarise(window_sums(spark.createDataFrame(rows, SCHEMA), "ts", "2 hours")).collect()
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        _run(spark, f"{tmp_path}/{seed}", [rows[:50], rows[50:60], rows[60:]], "10 days")
        got = read_report(spark, f"{tmp_path}/{seed}/out").collect()
        assert _told(got) == _told(want) and late_rows(spark, f"{tmp_path}/{seed}/out").count() == 0
        means = {(r.start, r.label): (r.mean_score, r.std_score) for r in got}
        for r in want:
            assert means[r.start, r.label] == pytest.approx((r.mean_score, r.std_score), abs=1e-9)


def test_late_rows_are_kept_apart_and_a_restart_adds_nothing(spark, tmp_path):
    at = lambda hours: datetime(2024, 5, 1) + timedelta(hours=hours)
    first, second = [(at(10), 1, 0.5, 1)], [(at(1), 1, 0.1, 1), (at(8.5), 0, 0.9, 0), (at(11), 1, 0.2, 1)]
    _run(spark, str(tmp_path), [first, second], "2 hours")
    assert [(r.ts, r.anomaly_score) for r in late_rows(spark, f"{tmp_path}/out").collect()] == [(at(1), 0.1)]
    before = _told(read_report(spark, f"{tmp_path}/out").collect())
    assert sum(r[2] for r in before) == 3
    _run(spark, str(tmp_path), [], "2 hours")
    assert _told(read_report(spark, f"{tmp_path}/out").collect()) == before
