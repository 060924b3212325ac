"""Headway estimates from dispatched trains, deduplication and calibration.

Inputs are monthly or daily dispatch counts; everything is a grouped
aggregate keyed by (month, line), so the output is bounded by months x lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import days_in_month, parse_iso_date, to_number
from ..functions.lines import canonical_line_ah
from ..session import cut_lineage
from .selection import exact_median

# Operating minutes per day (05:30-23:30), the median the
# calibration aims for, and the source tags.
OPERATING_MIN_PER_DAY = 1080
TARGET_MEDIAN_HEADWAY = 3.5
SOURCE_MONTHLY = "monthly_dispatched_trains"
SOURCE_DAILY = "daily_trains_aggregated"
HEADWAY_COLUMNS = ["year_month", "line", "avg_headway_min", "source"]


def _require(df: DataFrame, cols: set[str], what: str) -> None:
    if not cols.issubset(df.columns):
        raise ValueError(f"{what} must have columns: {', '.join(sorted(cols))}")


def _trains(df: DataFrame, c: str) -> F.Column:
    """Train counts as numbers; text that is not a number counts as 0."""
    return to_number(df, c, fill_zero=True).cast("double")


def _headway(trains: F.Column, year_month: F.Column) -> F.Column:
    return (F.lit(float(OPERATING_MIN_PER_DAY)) * days_in_month(year_month)) / trains


def headway_from_monthly(df: DataFrame) -> DataFrame:
    """avg_headway_min = 1080 x days in month / trains, per input row. Rows
    with no trains or a month text that does not parse are dropped."""
    _require(df, {"year_month", "line", "dispatched_trains"}, "monthly dispatch")
    ym = F.col("year_month").cast("string")
    trains = _trains(df, "dispatched_trains")
    return df.where((trains > 0) & days_in_month(ym).isNotNull()).select(
        ym.alias("year_month"),
        canonical_line_ah("line").alias("line"),
        _headway(trains, ym).alias("avg_headway_min"),
        F.lit(SOURCE_MONTHLY).alias("source"),
    )


def headway_from_daily(df: DataFrame) -> DataFrame:
    """Daily trains summed per month and canonical line, then the same formula."""
    _require(df, {"date", "line", "trains"}, "daily dispatch")
    day = parse_iso_date(F.col("date"))
    # summed by month and raw label first, labelled, then summed by canonical
    # line (additive); a grouped sum leaves out rows whose key is null
    raw = (
        df.where(day.isNotNull() & F.col("line").isNotNull())
        .groupBy(F.date_format(day, "yyyy-MM").alias("year_month"), F.col("line").alias("raw"))
        .agg(F.sum(_trains(df, "trains")).alias("trains"))
    )
    g = (
        raw.withColumn("line", canonical_line_ah("raw")).where(F.col("line").isNotNull())
        .groupBy("year_month", "line").agg(F.sum("trains").alias("dispatched_trains"))
    )
    ym = F.col("year_month")
    return g.where((F.col("dispatched_trains") > 0) & days_in_month(ym).isNotNull()).select(
        "year_month", "line",
        _headway(F.col("dispatched_trains"), ym).alias("avg_headway_min"),
        F.lit(SOURCE_DAILY).alias("source"),
    )


def dedup_by_key(df: DataFrame) -> DataFrame:
    """One row per (year_month, line): the first by source name, then by the
    smaller headway. A min over a struct is a partial aggregate, so a key with
    many copies is combined map-side instead of landing in one task."""
    best = F.min(F.struct("source", "avg_headway_min")).alias("best")
    return df.groupBy("year_month", "line").agg(best).select(
        "year_month", "line", "best.avg_headway_min", "best.source"
    )


def calibrate(df: DataFrame, auto: bool = True, factor: float = 1.0,
              target: float = TARGET_MEDIAN_HEADWAY) -> DataFrame:
    """Scale all headways so their exact median becomes ``target`` (when the
    median is positive), or by a fixed factor when ``auto`` is off.

    The headways (months x lines rows) are written once; their exact median is
    found in bounded memory (:mod:`.selection`)."""
    hw = F.col("avg_headway_min")
    if auto:
        df = cut_lineage(df)
        med = exact_median(df, "avg_headway_min")
        scaled = hw * F.lit(target / med if med is not None and med > 0 else 1.0)
    elif factor != 1.0:
        scaled = hw * F.lit(factor)
    else:
        return df
    return df.withColumn("avg_headway_min", scaled)


def headway_etl(monthly: DataFrame | None, daily: DataFrame | None) -> DataFrame:
    """The ETL: monthly source when given, else daily; dedup; calibrate.

    The deduplicated headways (months x lines rows) are checkpointed into the
    shared folder before calibration, so that the median and the scaling read
    them instead of the dispatch source."""
    if monthly is not None:
        out = headway_from_monthly(monthly)
    elif daily is not None:
        out = headway_from_daily(daily)
    else:
        raise ValueError("a monthly or a daily dispatch source is needed")
    return calibrate(dedup_by_key(out))


def out_of_range(df: DataFrame, low: float = 1.0, high: float = 20.0) -> DataFrame:
    """Headways outside [low, high] minutes."""
    hw = F.col("avg_headway_min")
    return df.where((hw < low) | (hw > high))
