"""Forecast and line-P estimate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lines import ALL_LINES, SUBTE_LINES, normalize_line
from ..operators.ridership import daily_by_line
from ..operators import forecast as fc
from ..sources.testviews import view
from . import duck
from .registry import query, rounded, sql

_NORM = duck.normalize("line")

# Forecast inputs (DuckDB): forecast labels, metro weekly/monthly sums, dispatch.
FC_BASE = [
    ("fp", f"SELECT CAST(date AS DATE) AS date, {_NORM} AS line, passengers FROM ridership "
           f"WHERE {_NORM} IN {duck.ALL_LINES_SQL}"),
    ("wk", f"SELECT line, {duck.week('date')} AS week, CAST(sum(passengers) AS DOUBLE) AS passengers "
           f"FROM fp WHERE line IN {duck.SUBTE_SQL} GROUP BY ALL"),
    ("pm", f"SELECT {duck.month('date')} AS ym, sum(passengers) AS pax FROM fp "
           f"WHERE line IN {duck.SUBTE_SQL} GROUP BY 1"),
    ("dm", f"SELECT CAST(year_month AS VARCHAR) AS ym, {_NORM} AS line, dispatched_trains "
           f"FROM dispatch_monthly WHERE {_NORM} IN {duck.ALL_LINES_SQL}"),
    ("tm", f"SELECT ym, sum(dispatched_trains) AS trains FROM dm WHERE line IN {duck.SUBTE_SQL} GROUP BY 1"),
    ("ratio", "SELECT pm.ym, CAST(pax AS DOUBLE) / CAST(trains AS DOUBLE) AS ratio "
              "FROM pm JOIN tm ON pm.ym = tm.ym WHERE trains <> 0"),
    ("fb", "SELECT median(ratio) AS m FROM ratio"),
    ("ep", "SELECT dm.ym, dm.dispatched_trains * coalesce(ratio.ratio, fb.m) AS est "
           "FROM dm LEFT JOIN ratio ON dm.ym = ratio.ym, fb WHERE dm.line = 'P'"),
    ("epw", "SELECT est, generate_series(CAST(date_trunc('week', f) AS TIMESTAMP), "
            "CAST(last_day(f) AS TIMESTAMP), INTERVAL 7 DAY) AS ws "
            "FROM (SELECT *, CAST(ym || '-01' AS DATE) AS f FROM ep) WHERE est IS NOT NULL"),
    ("wkp", "SELECT 'P' AS line, CAST(w AS DATE) AS week, sum(share) AS passengers FROM "
            "(SELECT unnest(ws) AS w, est / len(ws) AS share FROM epw) GROUP BY 1, 2"),
]


def _forecast_sql(src: str) -> list[tuple[str, str]]:
    return [
        ("xs", f"SELECT line, week, CAST(passengers AS DOUBLE) AS y, "
               f"CAST(row_number() OVER (PARTITION BY line ORDER BY week) - 1 AS DOUBLE) AS x FROM {src} "
               f"WHERE passengers IS NOT NULL"),
        ("fit", "SELECT line, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, "
                "regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, max(week) AS last_week, "
                "arg_max(y, week) AS last_y FROM xs GROUP BY line"),
        ("hz", "SELECT unnest(range(1, 5)) AS k"),
        ("fc", "SELECT line, CAST(last_week + INTERVAL (7 * k) DAY AS DATE) AS week, "
               "CASE WHEN n >= 6 THEN a + b * CAST(n - 1 + k AS DOUBLE) ELSE last_y END AS yhat, "
               "CASE WHEN n >= 6 THEN 1.64 * sqrt(greatest(syy - b * sxy, 0) / n) ELSE 0 END AS band "
               "FROM fit, hz"),
    ]


_FC_OUT = ("SELECT line, week, round(yhat, 4) AS yhat, round(yhat - band, 4) AS yhat_low, "
           "round(yhat + band, 4) AS yhat_high FROM fc")


def _metro(spark, sf_dir):
    """Metro-line ridership by day, forecast labels applied after the first sum."""
    return daily_by_line(view(spark, sf_dir, "ridership"), label=normalize_line, allowed=SUBTE_LINES)


@query("pax_per_train", sql(["ridership", "dispatch_monthly"], FC_BASE,
       "SELECT ym, round(ratio, 4) AS ratio FROM ratio"))
def pax_per_train(spark, sf_dir):
    metro = _metro(spark, sf_dir)
    disp = fc.dispatch_by_month(view(spark, sf_dir, "dispatch_monthly"))
    return rounded(fc.pax_per_train(fc.monthly_sum(metro), disp))


@query("month_weeks", sql(["dispatch_monthly"], [], """
    SELECT ym, CAST(w AS DATE) AS week, n_weeks FROM (
      SELECT ym, unnest(ws) AS w, len(ws) AS n_weeks FROM (
        SELECT ym, generate_series(CAST(date_trunc('week', f) AS TIMESTAMP), CAST(last_day(f) AS TIMESTAMP),
                                   INTERVAL 7 DAY) AS ws
        FROM (SELECT DISTINCT CAST(year_month AS VARCHAR) AS ym,
                     CAST(year_month || '-01' AS DATE) AS f FROM dispatch_monthly)))"""))
def month_weeks(spark, sf_dir):
    months = view(spark, sf_dir, "dispatch_monthly").select(F.col("year_month").alias("ym")).distinct()
    w = months.select("ym", fc.month_weeks(F.col("ym")).alias("ws"))
    return w.select("ym", F.explode("ws").alias("week"), F.size("ws").cast("long").alias("n_weeks"))


@query("estimate_p", sql(["ridership", "dispatch_monthly"], FC_BASE,
       "SELECT line, week, round(passengers, 4) AS passengers FROM wkp"))
def estimate_p(spark, sf_dir):
    metro = _metro(spark, sf_dir)
    disp = fc.dispatch_by_month(view(spark, sf_dir, "dispatch_monthly"))
    return rounded(fc.estimate_p(fc.monthly_sum(metro), disp))


_FIT = FC_BASE + [("wk_all", "SELECT line, week, passengers FROM wk UNION ALL "
                              "SELECT line, week, CAST(passengers AS DOUBLE) FROM wkp")]


@query("forecast_fit", sql(["ridership", "dispatch_monthly"], _FIT + _forecast_sql("wk_all"), _FC_OUT))
def forecast_fit(spark, sf_dir):
    return rounded(fc.forecast_all(view(spark, sf_dir, "ridership"), view(spark, sf_dir, "dispatch_monthly"), materialize=True))


_SHORT = [
    ("fp", f"SELECT CAST(date AS DATE) AS date, {_NORM} AS line, passengers FROM ridership_recent "
           f"WHERE {_NORM} IN {duck.ALL_LINES_SQL}"),
    ("wk", f"SELECT line, {duck.week('date')} AS week, CAST(sum(passengers) AS DOUBLE) AS passengers "
           "FROM fp GROUP BY ALL"),
]


@query("forecast_short", sql(["ridership_recent"], _SHORT + _forecast_sql("wk"), _FC_OUT))
def forecast_short(spark, sf_dir):
    weekly = fc.weekly_sum(daily_by_line(view(spark, sf_dir, "ridership_recent"), label=normalize_line))
    return rounded(fc.trend_forecast(weekly))


_PIVOT = ", ".join(f"round(max(CASE WHEN line = '{x}' THEN yhat END), 4) AS \"{x}\""
                   for x in ("A", "B", "C", "D", "E", "H", "P"))


@query("forecast_pivot", sql(["ridership", "dispatch_monthly"], _FIT + _forecast_sql("wk_all"),
       f"SELECT week, {_PIVOT} FROM fc GROUP BY week"))
def forecast_pivot(spark, sf_dir):
    f = fc.forecast_all(view(spark, sf_dir, "ridership"), view(spark, sf_dir, "dispatch_monthly"), materialize=True)
    return rounded(fc.pivot_weeks(f, ALL_LINES))


@query("page_forecast", sql(["ridership", "dispatch_monthly"], _FIT + _forecast_sql("wk_all"),
       "SELECT week, round(max(CASE WHEN line = 'A' THEN yhat END), 4) AS \"A\", round(max(CASE WHEN line = 'B' THEN yhat END), 4) AS \"B\" "
       "FROM fc WHERE line IN ('A', 'B') GROUP BY week"))
def page_forecast(spark, sf_dir):
    """The page's forecast table, weeks by selected lines."""
    from ..operators.jobs import insights_page
    pax, trains = view(spark, sf_dir, "ridership"), view(spark, sf_dir, "dispatch_monthly")
    page = insights_page(pax, None, lines=["A", "B"], forecast=fc.forecast_all(pax, trains, materialize=True))
    return rounded(page.forecast_pivot)
