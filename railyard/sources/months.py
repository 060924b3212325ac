"""Ridership stored by month, and its last days read from as few folders as they are in.

``month=yyyy-MM`` folders under the table's path are its partitions. Which
months there are is a listing; the last day is the maximum of the newest month
that holds one, so neither a scan of the table nor of its date column is needed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONTH = "month"


def write_by_month(df: DataFrame, path: str, date_col: str = "date") -> None:
    """Writes ``df`` with a folder per month of ``date_col``; rows without a date
    have a folder of their own. Whole months are replaced, others stay. Rows are
    rebalanced by month: few files a month, and a large one is split over tasks."""
    rows = df.withColumn(MONTH, F.date_format(F.col(date_col).cast("date"), "yyyy-MM"))
    (rows.hint("rebalance", F.col(MONTH)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path))


def months(spark: SparkSession, path: str) -> list[str]:
    """The months of a table, ascending; empty if it is not stored by month."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    found = sorted(n.removeprefix(f"{MONTH}=") for n in names if n.startswith(f"{MONTH}="))
    return [m for m in found if len(m) == 7 and m[4] == "-"]


def read_months(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """The rows of the months from ``first`` to ``last``, without the month column."""
    rows = spark.read.option("basePath", path).schema(_schema(spark, path)).parquet(*[f"{path}/{MONTH}={m}" for m in months(spark, path) if first <= m <= last])
    return rows.drop(MONTH)


def _schema(spark: SparkSession, path: str):
    """The table's columns, from one file of its newest month, and the month as text."""
    from pyspark.sql import types as T
    stored = spark.read.parquet(f"{path}/{MONTH}={months(spark, path)[-1]}").schema
    return T.StructType([f for f in stored.fields if f.name != MONTH] + [T.StructField(MONTH, T.StringType())])


def last_day(spark: SparkSession, path: str, date_col: str = "date") -> dt.date | None:
    """The last day of a table stored by month: newest month first."""
    for month in reversed(months(spark, path)):
        day = spark.read.parquet(f"{path}/{MONTH}={month}").agg(F.max(F.col(date_col)).cast("date")).first()[0]
        if day is not None:  # else a folder without rows
            return day
    return None


def last_days(spark: SparkSession, path: str, days: int, date_col: str = "date") -> tuple[DataFrame, tuple[dt.date, dt.date] | None]:
    """(rows of the months that the last ``days`` days are in, (first, last) of
    these days); without a day: an empty frame and None."""
    end = last_day(spark, path, date_col)
    if end is None:
        return spark.read.parquet(path).drop(MONTH).limit(0), None
    start = end - dt.timedelta(days=days - 1)
    return read_months(spark, path, start.strftime("%Y-%m"), end.strftime("%Y-%m")), (start, end)
