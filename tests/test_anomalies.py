import datetime as dt

import pytest

from railyard.operators.anomalies import AnomalyConfig, detect_anomalies, prepare_daily_series

D0 = dt.date(2024, 1, 1)


def _series(spark, values, station="s1", gap_after=None):
    rows = []
    day = D0
    for i, v in enumerate(values):
        rows.append((day, station, float(v)))
        day += dt.timedelta(days=1 if gap_after is None or i != gap_after else 10)
    return spark.createDataFrame(rows, "date date, estacion string, pax_total double")


def test_first_six_rows_never_flagged(spark):
    s = _series(spark, [1, 100, 1, 100, 1, 1000])
    out = detect_anomalies(s).collect()
    assert all(r.rolling_mean is None and not r.is_anomaly and r.anomaly_type == "normal" for r in out)


def test_constant_series_has_no_deviation(spark):
    s = _series(spark, [5] * 20)
    out = detect_anomalies(s).collect()
    assert all(r.rolling_std is None and r.z_score is None and not r.is_anomaly for r in out)


def test_spike_and_drop(spark):
    base = [10, 11] * 10
    s = _series(spark, base + [200] + base + [-200])
    out = {r.date: r for r in detect_anomalies(s).collect()}
    ordered = [out[k] for k in sorted(out)]
    assert ordered[20].anomaly_type == "spike" and ordered[20].is_anomaly
    assert ordered[41].anomaly_type == "drop" and ordered[41].is_anomaly
    assert sum(r.is_anomaly for r in ordered) == 2


def test_window_counts_rows_not_days(spark):
    s = _series(spark, list(range(1, 9)), gap_after=3)
    out = sorted(detect_anomalies(s).collect(), key=lambda r: r.date)
    # the 7th row has a mean although a 10-day gap lies inside its window
    assert out[6].rolling_mean == sum(range(1, 8)) / 7


def test_mean_and_std_match_numpy(spark):
    import numpy as np
    vals = [3, 9, 4, 7, 12, 5, 8, 15, 2, 6, 11, 7, 9, 30, 4, 8]
    out = sorted(detect_anomalies(_series(spark, vals)).collect(), key=lambda r: r.date)
    for i, r in enumerate(out):
        win = np.array(vals[max(0, i - 13): i + 1], dtype=float)
        if len(win) < 7:
            assert r.rolling_mean is None
        else:
            assert abs(r.rolling_mean - win.mean()) < 1e-9
            assert abs(r.rolling_std - win.std(ddof=0)) < 1e-9


def test_prepare_drops_bad_dates_and_null_station(spark):
    raw = spark.createDataFrame(
        [("1/2/2024", "a", "5"), ("01/02/2024", "a", "x"), ("bad", "a", "7"), ("2/2/2024", None, "9"),
         ("2024-02-01", "a", "2")],
        "FECHA string, Estacion string, Pax_Total string")
    cfg = AnomalyConfig()
    got = {(r.date, r.estacion): r.pax_total for r in prepare_daily_series(raw, cfg).collect()}
    assert got == {(dt.date(2024, 2, 1), "a"): 7.0}


def test_global_series(spark):
    s = _series(spark, [1] * 10)
    cfg = AnomalyConfig(station_col=None)
    out = detect_anomalies(s.drop("estacion"), cfg).collect()
    assert len(out) == 10


def test_buckets_of_any_fixed_width(spark):
    times = ["2024-01-01 00:14:59", "2024-01-01 00:15:00", "2024-01-01 05:59:59.999999", "2024-01-01 06:00:00", "1969-12-31 23:50:00"]
    raw = spark.createDataFrame([(dt.datetime.fromisoformat(t), "s1", 1) for t in times], "fecha timestamp_ntz, estacion string, pax_total long")

    def starts(freq):
        return [str(r.date) for r in prepare_daily_series(raw, AnomalyConfig(freq=freq)).orderBy("date").collect()]

    assert starts("15min") == ["1969-12-31 23:45:00", "2024-01-01 00:00:00", "2024-01-01 00:15:00", "2024-01-01 05:45:00", "2024-01-01 06:00:00"]
    assert starts("6h") == ["1969-12-31 18:00:00", "2024-01-01 00:00:00", "2024-01-01 06:00:00"]
    assert starts("1.5h") == starts("90min") == starts("1h30min") == ["1969-12-31 22:30:00", "2024-01-01 00:00:00", "2024-01-01 04:30:00", "2024-01-01 06:00:00"]
    assert starts("h") == ["1969-12-31 23:00:00", "2024-01-01 00:00:00", "2024-01-01 05:00:00", "2024-01-01 06:00:00"]
    assert starts("D") == ["1969-12-31", "2024-01-01"]
    for bad in ("", "15", "MS", "W", "0h", "15min!", "0.5us"):
        with pytest.raises(ValueError):
            prepare_daily_series(raw, AnomalyConfig(freq=bad))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:  # the clock of the session counts, as it does for days
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        s = prepare_daily_series(raw, AnomalyConfig(freq="6h"))
        assert [r[0] for r in s.select(s.date.cast("string").alias("d")).orderBy("d").collect()] == ["1969-12-31 18:00:00", "2024-01-01 00:00:00", "2024-01-01 06:00:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
