"""Reusable oracle CTEs (DuckDB) mirroring the Spark building blocks."""

from __future__ import annotations

from . import duck

# Ridership on the insights page: any-letter labels, allowed lines only.
PAX = [
    ("pax", f"SELECT CAST(date AS DATE) AS date, {duck.canonical_az('line')} AS line, passengers "
            f"FROM ridership WHERE {duck.canonical_az('line')} IN {duck.ALL_LINES_SQL}"),
]

_HM = (
    "SELECT CAST(year_month AS VARCHAR) AS year_month, {line} AS line, "
    "CAST(1080 AS DOUBLE) * {dim} / coalesce(try_cast(CAST(dispatched_trains AS VARCHAR) AS DOUBLE), 0) "
    "AS avg_headway_min, 'monthly_dispatched_trains' AS source FROM dispatch_monthly "
    "WHERE coalesce(try_cast(CAST(dispatched_trains AS VARCHAR) AS DOUBLE), 0) > 0 AND {dim} IS NOT NULL"
).format(line=duck.canonical_ah("line"), dim=duck.days_in_month("CAST(year_month AS VARCHAR)"))

_HD_SUM = (
    "SELECT strftime(CAST(try_cast(CAST(date AS VARCHAR) AS TIMESTAMP) AS DATE), '%Y-%m') AS year_month, "
    "{line} AS line, sum(coalesce(try_cast(CAST(trains AS VARCHAR) AS DOUBLE), 0)) AS dispatched_trains "
    "FROM dispatch_daily WHERE try_cast(CAST(date AS VARCHAR) AS TIMESTAMP) IS NOT NULL "
    "AND {line} IS NOT NULL GROUP BY 1, 2"
).format(line=duck.canonical_ah("line"))

_HD = (
    "SELECT year_month, line, CAST(1080 AS DOUBLE) * {dim} / dispatched_trains AS avg_headway_min, "
    "'daily_trains_aggregated' AS source FROM hd_sum WHERE dispatched_trains > 0 AND {dim} IS NOT NULL"
).format(dim=duck.days_in_month("year_month"))

HEADWAY_MONTHLY = [("hm", _HM)]
HEADWAY_DAILY = [("hd_sum", _HD_SUM), ("hd", _HD)]


def dedup(src: str, name: str) -> tuple[str, str]:
    return (name, f"SELECT year_month, line, avg_headway_min, source FROM (SELECT *, row_number() OVER "
                  f"(PARTITION BY year_month, line ORDER BY source, avg_headway_min) AS rn FROM {src}) "
                  f"WHERE rn = 1")


def calibrate(src: str, name: str) -> tuple[str, str]:
    return (name, f"SELECT year_month, line, CASE WHEN med > 0 THEN avg_headway_min * (3.5 / med) "
                  f"ELSE avg_headway_min END AS avg_headway_min, source FROM {src}, "
                  f"(SELECT median(avg_headway_min) AS med FROM {src})")


# The headway ETL: monthly source, dedup, calibration.
HEADWAY = HEADWAY_MONTHLY + [dedup("hm", "hm_dedup"), calibrate("hm_dedup", "headway")]

# Headway as the insights page sees it: month-start date, any-letter labels.
HW_PAGE = HEADWAY + [
    ("hw", f"SELECT {duck.canonical_az('line')} AS line, avg_headway_min, "
           f"CAST(try_cast(concat(year_month, '-01') AS TIMESTAMP) AS DATE) AS date FROM headway "
           f"WHERE {duck.canonical_az('line')} IN {duck.ALL_LINES_SQL}"),
]

# The page's headway: also limited to the ridership date range (its default).
HW_PAGE_RANGED = HW_PAGE + [
    ("hw_r", "SELECT hw.* FROM hw, (SELECT min(date) AS lo, max(date) AS hi FROM pax) b "
             "WHERE hw.date >= b.lo AND hw.date <= b.hi"),
]
