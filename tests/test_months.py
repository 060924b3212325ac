"""Ridership stored by month, and reading its last days."""
import datetime as dt
import os

import pytest

from railyard.operators import jobs
from railyard.operators.ridership import trailing_days
from railyard.plans import QUERIES
from railyard.sources import months
from conftest import SF_SMOKE


@pytest.fixture()
def table(spark, tmpdir_path):
    first = dt.date(2023, 12, 30)
    rows = [(first + dt.timedelta(days=i), line, i) for i in range(64) for line in "AB"] + [(None, "A", 999)]
    path = os.path.join(tmpdir_path, "r.parquet")
    months.write_by_month(spark.createDataFrame(rows, "date date, line string, passengers long"), path)
    return path


def test_months_are_folders(spark, table):
    assert months.months(spark, table) == ["2023-12", "2024-01", "2024-02", "2024-03"]
    assert months.last_day(spark, table) == dt.date(2024, 3, 2)
    assert spark.read.parquet(table).count() == 129
    assert months.read_months(spark, table, "2024-01", "2024-02").columns == ["date", "line", "passengers"]
    assert months.read_months(spark, table, "2024-01", "2024-02").count() == 2 * 60
    # a month written again replaces its rows and no others
    months.write_by_month(spark.createDataFrame([(dt.date(2024, 3, 9), "A", 5)], "date date, line string, passengers long"), table)
    assert spark.read.parquet(table).count() == 129 - 4 + 1 and months.last_day(spark, table) == dt.date(2024, 3, 9)


def test_the_last_week_opens_its_months_only(spark, table):
    rows, bounds = months.last_days(spark, table, 7)
    assert bounds == (dt.date(2024, 2, 25), dt.date(2024, 3, 2))
    assert {f.split("month=")[1][:7] for f in rows.inputFiles()} == {"2024-02", "2024-03"}
    got = sorted(map(tuple, trailing_days(rows, 7, bounds=bounds).collect()))
    assert got == sorted(map(tuple, trailing_days(spark.read.parquet(table), 7).collect()))


def test_a_newest_month_without_rows(spark, table):
    spark.createDataFrame([], "date date, line string, passengers long").write.parquet(f"{table}/month=2024-05")
    assert months.last_day(spark, table) == dt.date(2024, 3, 2)
    rows, bounds = months.last_days(spark, table, 3)
    assert {r.date for r in rows.collect()} >= {dt.date(2024, 3, 2), dt.date(2024, 2, 29)} and bounds[1] == dt.date(2024, 3, 2)


def test_tables_without_days(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "n.parquet")
    months.write_by_month(spark.createDataFrame([(None, "A", 1)], "date date, line string, passengers long"), path)
    rows, bounds = months.last_days(spark, path, 7)
    assert rows.collect() == [] and bounds is None and months.months(spark, os.path.join(tmpdir_path, "none")) == []
    empty = spark.createDataFrame([], "date date, line string, passengers long")
    assert trailing_days(empty).collect() == []


def test_weekly_summary_of_a_month_table(spark, table, tmpdir_path):
    flat = os.path.join(tmpdir_path, "flat.parquet")
    spark.read.parquet(table).drop("month").write.parquet(flat)
    texts = [spark.read.text(jobs.weekly_summary_from_files(spark, p, None, os.path.join(tmpdir_path, n))).collect() for p, n in ((table, "a.md"), (flat, "b.md"))]
    assert sorted(texts[0]) == sorted(texts[1]) and any("2024-02-25 to 2024-03-02" in r.value for r in texts[0])


@pytest.mark.parametrize("name", ["trailing_week", "trailing_week_by_month", "weekly_summary_text"])
def test_scans_of_ridership(spark, name):
    """One, besides the scan that finds the last day (of the newest month in a table by month)."""
    out = QUERIES[name](spark, SF_SMOKE)
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1
