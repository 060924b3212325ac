from pyspark.sql import functions as F

from railyard.operators import headway as h


def test_monthly_formula_and_drops(spark):
    df = spark.createDataFrame(
        [("2024-02", "LineaB", "29"), ("2024-01", "a", "0"), ("2024-13", "C", "10"), ("bad", "D", "5"),
         ("2023-02", "Línea E", "x"), ("2024-04", "h", "60")],
        "year_month string, line string, dispatched_trains string")
    got = {(r.year_month, r.line): r.avg_headway_min for r in h.headway_from_monthly(df).collect()}
    assert got == {("2024-02", "B"): 1080.0 * 29 / 29, ("2024-04", "H"): 1080.0 * 30 / 60}


def test_daily_aggregates_by_canonical_line(spark):
    df = spark.createDataFrame(
        [("2024-03-01", "B", 100), ("2024-03-02", "LineaB", 55), ("xx", "B", 7), ("2024-03-05", "C", 0)],
        "date string, line string, trains long")
    got = {(r.year_month, r.line): r.avg_headway_min for r in h.headway_from_daily(df).collect()}
    assert got == {("2024-03", "B"): 1080.0 * 31 / 155}


def test_dedup_prefers_first_source_name(spark):
    df = spark.createDataFrame(
        [("2024-01", "A", 4.0, h.SOURCE_MONTHLY), ("2024-01", "A", 5.0, h.SOURCE_DAILY),
         ("2024-01", "B", 3.0, h.SOURCE_MONTHLY), ("2024-01", "B", 2.0, h.SOURCE_MONTHLY)],
        "year_month string, line string, avg_headway_min double, source string")
    got = {(r.line, r.source, r.avg_headway_min) for r in h.dedup_by_key(df).collect()}
    assert got == {("A", h.SOURCE_DAILY, 5.0), ("B", h.SOURCE_MONTHLY, 2.0)}
    assert h.dedup_by_key(h.dedup_by_key(df)).count() == 2  # idempotent


def test_calibrated_median_is_target(spark):
    df = spark.createDataFrame([("m", str(i), float(v), "s") for i, v in enumerate([2.0, 8.0, 5.0, 11.0, 1.5])],
                               "year_month string, line string, avg_headway_min double, source string")
    med = h.calibrate(df).select(F.median("avg_headway_min")).first()[0]
    assert abs(med - 3.5) < 1e-12
    fixed = h.calibrate(df, auto=False, factor=2.0).agg(F.sum("avg_headway_min")).first()[0]
    assert abs(fixed - 2 * 27.5) < 1e-12


def test_out_of_range(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (20.0,), (20.5,)], "avg_headway_min double")
    assert sorted(r[0] for r in h.out_of_range(df).collect()) == [0.5, 20.5]


def test_daily_leaves_out_null_lines(spark):
    df = spark.createDataFrame([("2024-03-01", None, 100), ("2024-03-01", "B", 10)],
                               "date string, line string, trains long")
    assert [(r.line) for r in h.headway_from_daily(df).collect()] == ["B"]
