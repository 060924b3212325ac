import datetime as dt

import pytest

from railyard.functions.coerce import (hour_of, light_names, parse_day_first, py_strip, snake_case_names,
                                       trim_strings)


def test_day_first_dates(spark):
    rows = [("13/2/2024",), ("03/02/2024",), ("2/13/2024",), ("2024-02-01",), ("xx",), (None,)]
    df = spark.createDataFrame(rows, "d string")
    got = [r[0] for r in df.select(parse_day_first(df, "d").cast("date")).collect()]
    assert got == [dt.date(2024, 2, 13), dt.date(2024, 2, 3), None, dt.date(2024, 2, 1), None, None]


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["  Pax Total ", "Estación-ID", "LINEA"])
    assert snake_case_names(df).columns == ["pax_total", "estación_id", "linea"]
    assert light_names(df).columns == ["pax total", "estación-id", "linea"]
    clash = spark.createDataFrame([(1, 2)], ["a b", "a_b"])
    with pytest.raises(ValueError):
        snake_case_names(clash)


def test_python_strip(spark):
    df = spark.createDataFrame([("\t x \n",), (" y　",), (" ",), (None,)], "s string")
    assert [r[0] for r in df.select(py_strip("s")).collect()] == ["x", "y", "", None]
    assert trim_strings(df).collect()[0][0] == "x"


def test_hour(spark):
    df = spark.createDataFrame([("07:15:00",), ("23:59",), ("x:1",), (None,)], "t string")
    assert [r[0] for r in df.select(hour_of(df.t)).collect()] == [7, 23, None, None]


def test_day_first_with_time(spark):
    rows = [("13/2/2024 07:05:09",), ("3/2/2024 7:05",), ("13/2/2024 25:00",)]
    df = spark.createDataFrame(rows, "d string")
    got = [r[0] for r in df.select(parse_day_first(df, "d")).collect()]
    assert got == [dt.datetime(2024, 2, 13, 7, 5, 9), dt.datetime(2024, 2, 3, 7, 5), None]


def test_py_round(spark):
    from pyspark.sql import functions as F
    from railyard.functions.coerce import py_round
    vals = [2.675, 1.005, 0.125, 0.375, 5.0585714, -2.675, 1234567.891, 0.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    assert [r[0] for r in df.select(py_round(F.col("v"), 2)).collect()] == [round(v, 2) for v in vals]


def test_hour_like_python_int(spark):
    from pyspark.sql import functions as F
    texts = ["07:15", "+7:15", "٧:15", "1_0:00", "1__0:00", "١٢:00", "１２:00", "7.5:00", "x:1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(hour_of(F.col("t"))).collect()]

    def py(t):
        try:
            return int(t.split(":")[0])
        except ValueError:
            return None

    assert got == [py(t) for t in texts]


def test_numbers_like_pandas(spark):
    import math

    import pandas as pd

    from railyard.functions.coerce import to_number
    texts = ["5", " 5 ", "1e3", "inf", "nan", "1,000", "5d", "5f", "1e400", "abc", "", "-2.5"]
    want = pd.to_numeric(pd.Series(texts, dtype=object), errors="coerce").tolist()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(to_number(df, "t")).collect()]
    for t, g, w in zip(texts, got, want):
        missing = g is None or (isinstance(g, float) and math.isnan(g))
        assert missing == math.isnan(w) and (missing or g == w), (t, g, w)


def test_day_first_separators(spark):
    rows = [("13-02-2024",), ("13.2.2024 07:05",), ("2024-02-13",), ("13-2-24",)]
    df = spark.createDataFrame(rows, "d string")
    got = [r[0] for r in df.select(parse_day_first(df, "d")).collect()]
    assert got == [dt.datetime(2024, 2, 13), dt.datetime(2024, 2, 13, 7, 5), dt.datetime(2024, 2, 13), dt.datetime(2024, 2, 13)]


def test_more_day_first_forms(spark):
    from railyard.functions.coerce import parse_day_first
    texts = {"5/1/24": "2024-01-05 00:00:00", "13/02/2024 07:00:00.000": "2024-02-13 07:00:00", "5/1/2024 7:00 PM": "2024-01-05 19:00:00",
             "5-1-2024 7:00:05 am": "2024-01-05 07:00:05", "5.1.24 17:30": "2024-01-05 17:30:00", "5/1/2024 7:00:00.25": "2024-01-05 07:00:00.25", "5/13/2024": None, "x": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.d for r in df.select("t", parse_day_first(df, "t").cast("string").alias("d")).collect()}
    assert got == texts


def test_nan_is_missing(spark):
    from railyard.functions.coerce import sum0, to_number
    df = spark.createDataFrame([(1.0, "2"), (float("nan"), "NaN"), (3.0, None)], "x double, t string")
    got = df.select(to_number(df, "x").alias("x"), to_number(df, "t").alias("t")).collect()
    assert [tuple(r) for r in got] == [(1.0, 2.0), (None, None), (3.0, None)]
    assert df.agg(sum0("x")).first()[0] == 4.0
