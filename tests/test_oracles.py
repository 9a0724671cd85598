"""Every query against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest
from compare import check, connect

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from framescore.operators.evaluate import f1_scores
from framescore.plans.oracles import ORACLES as PLAN_ORACLES
from framescore.plans.queries import QUERIES as PLANS

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMOKE_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, con, name):
    n, problems = check(spark, con, QUERIES[name], ORACLES[name], SMOKE_DIR)
    assert not problems
    assert n > 0


def test_all_queries_but_the_fits_have_an_oracle():
    assert set(PLANS) - set(PLAN_ORACLES) == {"head_fit_predict", "train_and_report"}


def test_trained_scores_tell_damaged_pictures(spark):
    stats = {r.label: r for r in QUERIES["train_and_report"](spark, SMOKE_DIR).collect()}
    assert stats[0].mean_score > 0.95 and stats[1].mean_score < 0.05


def test_entry(spark):
    assert {r.label for r in entry(spark).collect()} == {0, 1}


def test_fitted_head_beats_the_untrained_baseline(spark):
    fitted = QUERIES["head_fit_predict"](spark, SMOKE_DIR)
    baseline = QUERIES["baseline_f1"](spark, SMOKE_DIR).first()
    assert f1_scores(fitted).first().f1_macro > baseline.f1_macro
    assert all((r.anomaly_score > 0.5) == (r.pred_class == 0) for r in fitted.collect())
