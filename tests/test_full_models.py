"""The registered model queries run with the parameters of the operators."""

import math
from dataclasses import replace

from shiftcast.config import FORECAST
from shiftcast.operators import learned, seasonal
from shiftcast.plans import models
from shiftcast.plans.registry import all_queries

SF_DIR = "/root/testdata/sf0.001"


def test_boosted_queries_use_the_whole_configuration(spark, monkeypatch):
    seen = []
    real = learned._fit_one

    def few_rounds(rows, column, config):
        seen.append(config)
        return real(rows, column, replace(config, max_iter=2))

    monkeypatch.setattr(learned, "_fit_one", few_rounds)
    accuracy = all_queries()["boosted_accuracy"](spark, SF_DIR).collect()
    assert {(c.max_iter, c.patience, c.max_depth, c.step_size) for c in seen} == {(500, 50, 5, 0.05)}
    assert {r["n"] for r in accuracy} == {FORECAST.test_days * 24}


def test_boosting_goes_on_while_it_gains(spark, series):
    values = [10 + 5 * math.sin(i / 24 * 2 * math.pi) + (i % 168) / 20 for i in range(24 * 42)]
    df = series(values)
    config = replace(FORECAST, max_iter=45, patience=10)
    model = learned.fit_for_block(df, ["task"], 24, learned.holiday_span(df, 24), config, "task")
    assert model.models["calls"].getNumTrees > 40  # the first try has twenty rounds


def test_seasonal_queries_have_all_terms_and_years(spark, series):
    whole = seasonal.SeasonalSpec()
    for spec in (models.SPEC, models.ADDITIVE, models.DAILY):
        assert (spec.yearly, spec.monthly, spec.changepoints) == (whole.yearly, whole.monthly, whole.changepoints)
    spec = models._spec(series([1.0] * 48, start="2011-12-30 00:00:00"), models.SPEC, 48)
    years = {1970 + d / 365.2425 for d in spec.event_days}
    assert min(years) < 2012 <= max(years) < 2013


def test_orders_show_their_year(spark):
    rows = all_queries()["seasonal_components"](spark, SF_DIR).filter("task = 'orders'").collect()
    assert len(rows) > 6 * 365 and len({r["ts"] for r in rows}) == len(rows)
    assert {r["ts"][11:] for r in rows} == {"00:00:00.000000"} and max(r["h"] for r in rows) == 168
    assert max(abs(r["yearly"]) for r in rows) > 0
    judged = {r["task"]: r["n"] for r in all_queries()["seasonal_regression_accuracy"](spark, SF_DIR).collect()}
    assert judged["orders"] == 14 and judged["calls"] == 14 * 24
