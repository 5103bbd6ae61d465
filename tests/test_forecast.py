import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cashweave.operators import forecast as fc
from .conftest import rows

START = dt.date(2024, 1, 1)


def history(spark, *points, entity=None):
    """``(day number, value)`` pairs; the value is held as liquid money."""
    data = [(entity, START + dt.timedelta(days=d), float(v), None, 0.0) for d, v in points]
    return spark.createDataFrame(
        data, "who string, as_of_date date, liquid double, retirement double, investments double")


def expected(points, model, width=15, horizon=365, n=200):
    """The same model with numpy on one series."""
    x = np.array([p[0] for p in points], float)
    x, y = x - x.min(), np.array([p[1] for p in points], float)
    logs = model == "exponential" and bool((y > 0).all())
    v = np.log(y) if logs else y
    slope, base = np.polyfit(x, v, 1)
    floor = 0.05 if logs else y.mean() * 0.05
    sigma = max(np.std(v - (slope * x + base)), floor) * width / 15
    grid = np.linspace(0, x.max() + horizon, n)
    line = slope * grid + base
    if logs:
        p, f = np.exp(line), math.exp(sigma * 1.5)
        return grid, p, p / f, p * f
    grow = np.maximum(1, 1 + (grid - x.max()) / max(x.max(), 1) * 0.5) if model == "linear" else 1
    return grid, line, line - sigma * 2 * grow, line + sigma * 2 * grow


SERIES = {
    "line": [(0, 100), (10, 200), (20, 300), (30, 400)],
    "growth": [(0, 100), (30, 130), (60, 169), (95, 230), (120, 280), (150, 371)],
    "noise": [(3, 500), (9, 320), (20, 800), (44, 610), (51, 90), (70, 777)],
    "zero": [(0, 0), (10, 50), (30, 20)],
    "negative": [(0, -100), (10, -50), (30, -20)],
    "two": [(0, 10), (1, 20)],
    "flat": [(0, 70), (10, 70), (20, 70)],
}


@pytest.mark.parametrize("model", ["exponential", "linear"])
@pytest.mark.parametrize("name", SERIES)
def test_forecast_equals_numpy(spark, name, model):
    points = SERIES[name]
    got = fc.forecast(history(spark, *points), model=model, width=20).orderBy("point").collect()
    grid, p, low, high = expected(points, model, 20)
    assert len(got) == 200
    for col, want in (("x", grid), ("predicted", p), ("lower", low), ("upper", high)):
        np.testing.assert_allclose([r[col] for r in got], want, rtol=1e-8, atol=1e-8)
    first = min(d for d, _ in points)
    assert [r.as_of_date for r in got] == [START + dt.timedelta(days=first + int(g)) for g in grid]
    assert [r.is_future for r in got] == [bool(g > max(d for d, _ in points) - first) for g in grid]


@pytest.mark.parametrize("name, model, label", [
    ("growth", "exponential", "Exponential Fit"), ("zero", "exponential", "Linear Fit (exponential unavailable)"),
    ("negative", "exponential", "Linear Fit (exponential unavailable)"), ("growth", "linear", "Linear Fit")])
def test_labels(spark, name, model, label):
    assert {r.model for r in fc.forecast(history(spark, *SERIES[name]), model=model).collect()} == {label}


def test_exact_line_and_floor(spark):
    r = fc.fit(history(spark, *SERIES["line"]), model="linear").first()
    assert r.slope == pytest.approx(10) and r.sigma == pytest.approx(12.5)
    r = fc.fit(history(spark, *SERIES["flat"])).first()
    assert r.slope == pytest.approx(0) and r.sigma == 0.05


def test_entities_are_fitted_apart(spark):
    both = history(spark, *SERIES["line"], entity="a").union(history(spark, *SERIES["growth"], entity="b")) \
        .union(history(spark, (0, 1), entity="short"))
    got = {r.who: r for r in fc.forecast_summary(both, ["who"]).collect()}
    assert set(got) == {"a", "b"}
    for who, name in (("a", "line"), ("b", "growth")):
        _, p, low, high = expected(SERIES[name], "exponential")
        r, current = got[who], SERIES[name][-1][1]
        assert (r.current, r.projected, r.low, r.high) == pytest.approx((current, p[-1], low[-1], high[-1]))
        assert (r.growth, r.growth_pct) == pytest.approx((p[-1] - current, (p[-1] - current) / current * 100))


def test_growth_of_nothing_is_zero(spark):
    assert fc.forecast_summary(history(spark, (0, 5), (10, -5))).first().growth_pct == 0.0


def test_one_date_is_too_few(spark):
    assert fc.forecast(history(spark, (0, 1))).count() == 0
    assert fc.forecast(history(spark)).count() == 0


def test_value_column_and_arguments(spark):
    df = history(spark, *SERIES["line"]).withColumnRenamed("retirement", "r")
    assert fc.fit(df, value_col="liquid", model="linear").first().slope == pytest.approx(10)
    assert fc.forecast(df, value_col="liquid", points=5, horizon_days=10).count() == 5
    for bad in ({"model": "cubic"}, {"points": 1}):
        with pytest.raises(ValueError):
            fc.forecast(df, value_col="liquid", **bad)
    assert rows(fc.fit(df.where("false"), value_col="liquid")) == []


@pytest.mark.parametrize("model", ["exponential", "linear"])
def test_forecast_does_not_depend_on_the_partitioning(spark, model):
    """Equal bit for bit, however the rows are dealt and ordered: all moments are exact sums."""
    rng = np.random.default_rng(8)
    days = [(int(d), float(v)) for d, v in zip(rng.permutation(3000), np.round(rng.lognormal(11, 2, 3000), 2))]
    both = history(spark, *days, entity="a").union(history(spark, *days[:700], entity="b"))
    first = None
    for parts in (1, 7, 64):
        got = sorted(rows(fc.forecast(both.repartition(parts), ["who"], model=model)))
        first = first or got
        assert got == first


def test_moments_beyond_their_digits_are_refused(spark):
    big = history(spark, *[(d, 1e14 + d) for d in range(50)])
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        fc.fit(big, model="linear").collect()


def test_dates_without_a_value_take_no_part(spark):
    df = history(spark, *SERIES["growth"])
    more = df.union(history(spark, (500, 1)).withColumn("liquid", F.lit(None).cast("double")))
    assert rows(fc.fit(more, value_col="liquid")) == rows(fc.fit(df, value_col="liquid"))
