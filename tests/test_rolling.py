"""Series cut into stretches and blocks against one window over the whole."""
import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from railyard.operators import rolling
from railyard.operators.anomalies import AnomalyConfig, detect_anomalies
from railyard.plans import QUERIES
from conftest import SF_SMOKE
from test_plans import _plan


@pytest.fixture()
def series(spark):
    rng = random.Random(4)
    rows = []
    for key, n in (("hot", 300), ("b", 40), ("c", 1), (None, 25)):
        places = sorted(rng.sample(range(-200, 2000), n))
        rows += [(key, p, rng.choice([None, rng.random() * 9, 1.0])) for p in places]
    rows.append(("b", None, 2.0))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, p long, v double").repartition(5)


@pytest.mark.parametrize("stretch,block,back", [(1, 1, 0), (7, 1, 3), (50, 10, 13), (100_000, 20, 13), (64, 100_000, 6)])
@pytest.mark.parametrize("keys", [["k"], []])
def test_any_cut_gives_the_frames_of_one_window(series, keys, stretch, block, back):
    order = ["p"] if keys else ["p", "k"]
    whole = Window.partitionBy(*keys).orderBy(*order)
    frame = whole.rowsBetween(-back, 0)
    stats = {"n": F.count("v"), "m": F.avg("v"), "s": F.stddev_pop("v"), "first": F.first("v")}
    want = series.select("*", (F.row_number().over(whole) - 1).alias(rolling.ROW), *[a.over(frame).alias(n) for n, a in stats.items()])
    rows = rolling.numbered(series, keys, F.col("p"), order, stretch)
    got = rolling.framed(rows, keys, back, stats, block)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_hot_station_of_fine_buckets(spark, monkeypatch):
    """The blocked path gives what the window over a station's days gives."""
    rng = random.Random(2)
    day = dt.date(2024, 1, 1)
    rows = [(day + dt.timedelta(days=i), s, rng.choice([10.0, 11.0, 10.5] * 7 + [90.0])) for s, n in (("a", 200), ("b", 30)) for i in range(n) if rng.random() < 0.8]
    frame = spark.createDataFrame(rows, "date date, estacion string, pax_total double")
    whole = sorted(map(tuple, detect_anomalies(frame).collect()))
    fine = frame.withColumn("date", F.col("date").cast("timestamp"))
    monkeypatch.setattr(rolling, "STRETCH", 16)
    monkeypatch.setattr(rolling, "BLOCK", 20)
    got = detect_anomalies(fine, AnomalyConfig(freq="1h")).withColumn("date", F.col("date").cast("date"))
    assert sorted(map(tuple, got.collect())) == whole
    assert any(r[6] for r in whole)


@pytest.mark.parametrize("name", ["anomaly_global", "anomaly_1s_global"])
def test_no_window_over_the_whole_series(spark, name):
    """The one window without a key runs over counts of stretches, not over rows."""
    plan = _plan(QUERIES[name](spark, SF_SMOKE))
    alone = [b for b in plan.split("\n\n") if "Window" in b.split("\n")[0] and "__stretch" not in b and "__block" not in b]
    assert len(alone) == 1 and "sum(__n" in alone[0]


def test_empty_series(spark):
    empty = spark.createDataFrame([], "date date, pax_total double")
    assert detect_anomalies(empty, AnomalyConfig(station_col=None)).collect() == []
