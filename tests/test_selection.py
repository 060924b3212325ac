"""Exact medians against statistics.median."""
import math
import random
import statistics

import pytest

from railyard.operators import selection
from railyard.plans import QUERIES
from conftest import SF_SMOKE
from test_plans import _plan


def cases():
    rng = random.Random(8)
    yield "uniform", [rng.random() for _ in range(3001)]
    yield "even", [rng.random() for _ in range(2000)]
    yield "one value", [3.5] * 500
    yield "few values", [rng.choice([1.0, 2.0]) for _ in range(1500)]
    yield "half and half", [1.0] * 400 + [7.0] * 400
    yield "wide", [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(2500)]
    yield "hot", [0.0] * 900 + [rng.random() - 0.4 for _ in range(1500)]
    yield "infinite", [math.inf] * 30 + [-math.inf] * 25 + [float(i) for i in range(300)]
    yield "large", [1.7e308] * 40
    yield "one", [2.0]
    yield "two", [2.0, 5.0]


@pytest.mark.parametrize("name,values", list(cases()), ids=lambda v: v if isinstance(v, str) else "")
@pytest.mark.parametrize("held,grid,accuracy", [(10, 20, 50), (100, 4, 1000)])
def test_medians_in_rounds(spark, monkeypatch, name, values, held, grid, accuracy):
    monkeypatch.setattr(selection, "SORTED", held)
    monkeypatch.setattr(selection, "GRID", grid)
    monkeypatch.setattr(selection, "ACCURACY", accuracy)
    rows = [(v,) for v in values] + [(None,), (math.nan,)] * 5
    random.Random(1).shuffle(rows)
    got = selection.exact_median(spark.createDataFrame(rows, "`a b` double").repartition(7), "a b")
    low, high = statistics.median_low(values), statistics.median_high(values)
    assert got == (low if low == high else low / 2 + high / 2)


def test_a_sketch_that_misses_only_costs_a_round(spark, monkeypatch):
    monkeypatch.setattr(selection, "SORTED", 10)
    values = selection._values(spark.createDataFrame([(float(i),) for i in range(1000)], "v double"), "v")
    for wrong in ([0.0] * 2001, [999.0] * 2001, [400.0] * 1000 + [450.0] * 1001):
        assert selection.select_rank(values, 500, 1000, wrong) == 500.0


def test_no_numbers(spark):
    empty = spark.createDataFrame([(None,), (math.nan,)], "v double")
    assert selection.exact_median(empty, "v") is None and selection.exact_median(empty.limit(0), "v") is None
    assert [tuple(r) for r in selection.medians(empty, ["v"]).collect()] == [("v", None)]


@pytest.mark.parametrize("name", ["headway_calibrated", "median_large"])
def test_no_percentile_buffer_in_the_plan(spark, name):
    assert "percentile" not in _plan(QUERIES[name](spark, SF_SMOKE)).lower() and "median(" not in _plan(QUERIES[name](spark, SF_SMOKE)).lower()
