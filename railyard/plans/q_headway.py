"""Headway ETL queries."""

from __future__ import annotations

from ..operators import headway as h
from ..operators.selection import medians
from ..sources.testviews import view
from .common_sql import HEADWAY, HEADWAY_DAILY, HEADWAY_MONTHLY, dedup
from .registry import query, rounded, sql

_COLS = "year_month, line, round(avg_headway_min, 4) AS avg_headway_min, source"


@query("headway_monthly", sql(["dispatch_monthly"], HEADWAY_MONTHLY, f"SELECT {_COLS} FROM hm"))
def headway_monthly(spark, sf_dir):
    return rounded(h.headway_from_monthly(view(spark, sf_dir, "dispatch_monthly")))


@query("headway_daily", sql(["dispatch_daily"], HEADWAY_DAILY, f"SELECT {_COLS} FROM hd"))
def headway_daily(spark, sf_dir):
    return rounded(h.headway_from_daily(view(spark, sf_dir, "dispatch_daily")))


@query("headway_dedup", sql(["dispatch_monthly", "dispatch_daily"], HEADWAY_MONTHLY + HEADWAY_DAILY + [
    ("hm_hd", "SELECT * FROM hm UNION ALL SELECT * FROM hd"), dedup("hm_hd", "dd")],
    f"SELECT {_COLS} FROM dd"))
def headway_dedup(spark, sf_dir):
    both = h.headway_from_monthly(view(spark, sf_dir, "dispatch_monthly")).unionByName(
        h.headway_from_daily(view(spark, sf_dir, "dispatch_daily")))
    return rounded(h.dedup_by_key(both))


@query("headway_calibrated", sql(["dispatch_monthly"], HEADWAY, f"SELECT {_COLS} FROM headway"))
def headway_calibrated(spark, sf_dir):
    return rounded(h.headway_etl(view(spark, sf_dir, "dispatch_monthly"), None))


@query("headway_out_of_range", sql(["dispatch_monthly"], HEADWAY,
       f"SELECT {_COLS} FROM headway WHERE avg_headway_min < 1 OR avg_headway_min > 20"))
def headway_out_of_range(spark, sf_dir):
    return rounded(h.out_of_range(h.headway_etl(view(spark, sf_dir, "dispatch_monthly"), None)))


@query("median_large", """
    SELECT 'l_extendedprice' AS column_name, round(median(l_extendedprice), 4) AS median FROM lineitem
    UNION ALL SELECT 'l_quantity', round(CAST(median(l_quantity) AS DOUBLE), 4) FROM lineitem""")
def median_large(spark, sf_dir):
    """Exact medians of a fact table's columns, one of few and one of many values."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rounded(medians(lines, ["l_extendedprice", "l_quantity"]))
