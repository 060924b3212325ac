"""Property tests: random labels (Spark rules against the full rule chains in
DuckDB SQL) and random series (rolling statistics against pandas rolling)."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from railyard.functions.lines import canonical_line_ah, canonical_line_az, normalize_line
from railyard.operators.anomalies import detect_anomalies
from railyard.plans import duck

PIECES = ["Linea", "Línea", "LÍNEA", "linea", "Lina", "premetro", "PREMETRO", " ", "\t", "a", "B", "c",
          "H", "x", "Z", "P", "p", "7", "í", "ñ", "-", "é"]
label = st.lists(st.sampled_from(PIECES), min_size=0, max_size=5).map("".join)


@settings(max_examples=25, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(label, st.none()), min_size=1, max_size=40))
def test_labels_match_rule_chains(spark, labels):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "i int, raw string")
    got = {r.i: (r.ah, r.az, r.nl) for r in df.select(
        "i", canonical_line_ah("raw").alias("ah"), canonical_line_az("raw").alias("az"),
        normalize_line("raw").alias("nl")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, raw VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(labels)))
    exp = {r[0]: tuple(r[1:]) for r in con.execute(
        f"SELECT i, {duck.canonical_ah('raw')}, {duck.canonical_az('raw')}, {duck.normalize('raw')} FROM t"
    ).fetchall()}
    assert got == exp


series = st.lists(st.integers(min_value=0, max_value=60), min_size=0, max_size=40)


@settings(max_examples=20, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(series, min_size=1, max_size=3))
def test_rolling_stats_match_pandas(spark, stations):
    rows = []
    for s_i, vals in enumerate(stations):
        for d_i, v in enumerate(vals):
            rows.append((dt.date(2024, 1, 1) + dt.timedelta(days=d_i), f"s{s_i}", float(v)))
    if not rows:
        return
    df = spark.createDataFrame(rows, "date date, estacion string, pax_total double")
    got = {(r.estacion, r.date): r for r in detect_anomalies(df).collect()}
    pdf = pd.DataFrame(rows, columns=["date", "estacion", "pax_total"]).sort_values(["estacion", "date"])
    g = pdf.groupby("estacion")["pax_total"]
    pdf["m"] = g.transform(lambda s: s.rolling(14, min_periods=7).mean())
    pdf["sd"] = g.transform(lambda s: s.rolling(14, min_periods=7).std(ddof=0)).replace(0, np.nan)
    for r in pdf.itertuples():
        x = got[(r.estacion, r.date)]
        if np.isnan(r.m):
            assert x.rolling_mean is None
            continue
        assert abs(x.rolling_mean - r.m) < 1e-9
        if x.rolling_std is None or np.isnan(r.sd):
            # exactly zero deviation here; pandas may leave rounding noise
            assert x.rolling_std is None and (np.isnan(r.sd) or r.sd < 1e-6)
            continue
        assert abs(x.rolling_std - r.sd) < 1e-6
        z = (r.pax_total - r.m) / r.sd
        if abs(abs(z) - 3.0) > 1e-6:
            assert x.is_anomaly == (abs(z) >= 3.0)


WS_CHARS = [" ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ",
            "​", " ", " ", " ", "　", "﻿", "a", "é", " b"]


@settings(max_examples=30, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(WS_CHARS), max_size=8).map("".join), min_size=1, max_size=50))
def test_strip_matches_python(spark, texts):
    from railyard.functions.coerce import py_strip
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", py_strip("t").alias("s")).collect()}
    assert got == {i: t.strip() for i, t in enumerate(texts)}
