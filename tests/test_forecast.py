import datetime as dt

import numpy as np
import pytest

from railyard.operators import forecast as fc

MON = dt.date(2024, 1, 1)  # a Monday


def _weekly(spark, values, line="A", skip=()):
    rows = []
    for i, v in enumerate(values):
        if i in skip:
            continue
        rows.append((line, MON + dt.timedelta(days=7 * i), float(v)))
    return spark.createDataFrame(rows, "line string, week date, passengers double")


@pytest.mark.parametrize("n", [1, 5])
def test_short_series_repeats_last_value(spark, n):
    vals = list(range(10, 10 + n))
    out = sorted(fc.trend_forecast(_weekly(spark, vals)).collect(), key=lambda r: r.week)
    assert len(out) == 4
    last_week = MON + dt.timedelta(days=7 * (n - 1))
    assert [r.week for r in out] == [last_week + dt.timedelta(days=7 * k) for k in range(1, 5)]
    assert all(r.yhat == r.yhat_low == r.yhat_high == vals[-1] for r in out)


@pytest.mark.parametrize("n,skip", [(6, ()), (30, ()), (30, (3, 4, 17))])
def test_fit_matches_numpy(spark, n, skip):
    rng = np.random.default_rng(7)
    vals = list(1000 + 15 * np.arange(n) + rng.normal(0, 40, n))
    out = sorted(fc.trend_forecast(_weekly(spark, vals, skip=skip)).collect(), key=lambda r: r.week)
    y = np.array([v for i, v in enumerate(vals) if i not in skip])
    x = np.arange(len(y))
    slope, intercept = np.polyfit(x, y, 1)
    sigma = np.std(y - (intercept + slope * x))
    for k, r in enumerate(out, start=1):
        exp = intercept + slope * (len(y) - 1 + k)
        assert abs(r.yhat - exp) < 1e-6 * max(1, abs(exp))
        assert abs((r.yhat_high - r.yhat) - 1.64 * sigma) < 1e-6 * max(1, sigma)
        assert r.yhat_low <= r.yhat <= r.yhat_high


def test_constant_series_has_no_band(spark):
    out = fc.trend_forecast(_weekly(spark, [50] * 8)).collect()
    assert all(abs(r.yhat - 50) < 1e-9 and abs(r.yhat_high - r.yhat_low) < 1e-6 for r in out)


def test_no_data_no_rows(spark):
    empty = spark.createDataFrame([], "line string, week date, passengers double")
    assert fc.trend_forecast(empty).count() == 0


@pytest.mark.parametrize("ym,expected_first,n", [
    ("2024-01", dt.date(2024, 1, 1), 5),   # starts on a Monday
    ("2023-12", dt.date(2023, 11, 27), 5),  # December
    ("2024-02", dt.date(2024, 1, 29), 5),   # leap February
    ("2021-05", dt.date(2021, 4, 26), 6),   # touches six weeks
])
def test_month_weeks(spark, ym, expected_first, n):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(ym,)], "ym string")
    weeks = df.select(fc.month_weeks(F.col("ym"))).first()[0]
    assert weeks[0] == expected_first and len(weeks) == n
    assert all(w.weekday() == 0 for w in weeks)


def test_estimate_p_conserves_totals_and_uses_median(spark):
    pax = spark.createDataFrame(
        [("A", "2024-01", 1000.0), ("B", "2024-01", 1000.0), ("A", "2024-02", 3000.0)],
        "line string, ym string, passengers double")
    disp = spark.createDataFrame(
        [("2024-01", "A", 10), ("2024-01", "B", 10), ("2024-02", "A", 10),
         ("2024-01", "P", 4), ("2024-03", "P", 2), ("2024-03", "P", 0)],
        "ym string, line string, dispatched_trains long")
    out = fc.estimate_p(pax, disp).collect()
    total = sum(r.passengers for r in out)
    # January ratio 100, February 300, March has none: median 200
    assert abs(total - (4 * 100 + 2 * 200)) < 1e-9
    assert {r.line for r in out} == {"P"}


def test_estimate_p_without_ratio_is_empty(spark):
    pax = spark.createDataFrame([], "line string, ym string, passengers double")
    disp = spark.createDataFrame([("2024-01", "P", 4)], "ym string, line string, dispatched_trains long")
    assert fc.estimate_p(pax, disp).count() == 0


def test_estimate_p_without_p_rows_is_empty(spark):
    pax = spark.createDataFrame([("A", "2024-01", 1000.0)], "line string, ym string, passengers double")
    disp = spark.createDataFrame([("2024-01", "A", 10)], "ym string, line string, dispatched_trains long")
    assert fc.estimate_p(pax, disp).count() == 0
