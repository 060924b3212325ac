"""Ridership, KPI, change, station and summary queries (insights page)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.coerce import parse_day_first
from ..functions.lines import canonical_line_ah, canonical_line_az, normalize_line
from ..operators import headway as hw_ops
from ..operators import ridership as r
from ..session import shared_path
from ..sources.testviews import view
from . import duck
from .common_sql import HW_PAGE, HW_PAGE_RANGED, PAX
from .registry import query, rounded, sql


def _pax(spark, sf_dir):
    """Ridership by day and canonical line (labels after the first sum)."""
    return r.daily_by_line(view(spark, sf_dir, "ridership"))


def _headway(spark, sf_dir):
    return hw_ops.headway_etl(view(spark, sf_dir, "dispatch_monthly"), None)


def _hw_page(spark, sf_dir):
    return r.prepare_headway(_headway(spark, sf_dir))


def _page(spark, sf_dir):
    """The insights page over the test tables (one daily-by-line aggregate
    of ridership, written once, feeds every output)."""
    from ..operators.jobs import insights_page
    return insights_page(view(spark, sf_dir, "ridership"), _headway(spark, sf_dir))


def _dbl(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("double"))
    return df


@query("sum_by_line", sql(["ridership"], PAX,
       "SELECT line, CAST(sum(passengers) AS DOUBLE) AS passengers FROM pax GROUP BY line"))
def sum_by_line(spark, sf_dir):
    return r.sort_small(_dbl(r.sum_by_line(_pax(spark, sf_dir)), "passengers"), F.desc("passengers"), "line")


@query("mean_by_line", sql(["dispatch_monthly"], HW_PAGE,
       "SELECT line, round(avg(avg_headway_min), 4) AS avg_headway_min FROM hw GROUP BY line"))
def mean_by_line(spark, sf_dir):
    return r.sort_small(rounded(r.mean_by_line(_hw_page(spark, sf_dir))), "avg_headway_min", "line")


@query("kpis", sql(["ridership", "dispatch_monthly"], PAX + HW_PAGE_RANGED + [
    ("pbl", "SELECT line, sum(passengers) AS passengers FROM pax GROUP BY line"),
    ("hbl", "SELECT line, avg(avg_headway_min) AS m FROM hw_r GROUP BY line"),
], """SELECT coalesce(CAST(trunc(sum(passengers)) AS BIGINT), 0) AS total_passengers,
          coalesce((SELECT line FROM pbl ORDER BY passengers DESC, line LIMIT 1), '—') AS top_line,
          coalesce(CAST(trunc(max(passengers)) AS BIGINT), 0) AS top_passengers,
          round((SELECT avg(m) FROM hbl), 2) AS avg_headway_min
   FROM pbl"""))
def kpis(spark, sf_dir):
    return _page(spark, sf_dir).kpis


_KPI_RANGE = ("lines_f", "SELECT * FROM pax WHERE line IN ('A', 'B', 'D') AND date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")


@query("page_filtered", sql(["ridership", "dispatch_monthly"], PAX + HW_PAGE + [
    _KPI_RANGE,
    ("pbl", "SELECT line, sum(passengers) AS passengers FROM lines_f GROUP BY line"),
    ("hbl", "SELECT line, avg(avg_headway_min) AS m FROM hw WHERE line IN ('A', 'B', 'D') "
            "AND date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' GROUP BY line"),
], """SELECT coalesce(CAST(trunc(sum(passengers)) AS BIGINT), 0) AS total_passengers,
          coalesce((SELECT line FROM pbl ORDER BY passengers DESC, line LIMIT 1), '—') AS top_line,
          coalesce(CAST(trunc(max(passengers)) AS BIGINT), 0) AS top_passengers,
          round((SELECT avg(m) FROM hbl), 2) AS avg_headway_min
   FROM pbl"""))
def page_filtered(spark, sf_dir):
    """The page's KPIs for selected lines and explicit dates, Premetro off."""
    from ..operators.jobs import insights_page
    return insights_page(view(spark, sf_dir, "ridership"), _headway(spark, sf_dir), lines=["A", "B", "D"],
                         date_from="1996-01-01", date_to="1996-12-31", include_premetro=False).kpis


_WK = ("wk", f"SELECT line, {duck.week('date')} AS week, CAST(sum(passengers) AS DOUBLE) AS passengers "
             "FROM pax GROUP BY ALL")
_MO = ("mo", f"SELECT line, {duck.month('date')} AS month, CAST(sum(passengers) AS DOUBLE) AS passengers "
             "FROM pax GROUP BY ALL")


@query("weekly_sum", sql(["ridership"], PAX + [_WK], "SELECT line, week, passengers FROM wk"))
def weekly_sum(spark, sf_dir):
    return _dbl(r.weekly(_pax(spark, sf_dir)), "passengers")


@query("monthly_sum", sql(["ridership"], PAX + [_MO], "SELECT line, month, passengers FROM mo"))
def monthly_sum(spark, sf_dir):
    return _dbl(r.monthly(_pax(spark, sf_dir)), "passengers")


def _change_sql(src: str, period: str, out: str) -> tuple[str, str]:
    prev = f"lag(passengers) OVER (PARTITION BY line ORDER BY {period})"
    return (f"{src}_chg", f"SELECT line, {period}, passengers, {prev} AS passengers_prev, "
                          f"(passengers / nullif({prev}, 0) - 1) * 100 AS {out} FROM {src}")


@query("wow", sql(["ridership"], PAX + [_WK, _change_sql("wk", "week", "wow")],
       "SELECT line, week, passengers, passengers_prev, round(wow, 4) AS wow FROM wk_chg"))
def wow(spark, sf_dir):
    return rounded(r.with_change(_dbl(r.weekly(_pax(spark, sf_dir)), "passengers"), "week", "wow"))


@query("mom", sql(["ridership"], PAX + [_MO, _change_sql("mo", "month", "mom")],
       "SELECT line, month, passengers, passengers_prev, round(mom, 4) AS mom FROM mo_chg"))
def mom(spark, sf_dir):
    return rounded(r.with_change(_dbl(r.monthly(_pax(spark, sf_dir)), "passengers"), "month", "mom"))


@query("latest_mom", sql(["ridership"], PAX + [_MO, _change_sql("mo", "month", "mom")],
       "SELECT line, passengers, round(mom, 4) AS mom FROM mo_chg "
       "WHERE month = (SELECT max(month) FROM mo_chg)"))
def latest_mom(spark, sf_dir):
    m = r.with_change(_dbl(r.monthly(_pax(spark, sf_dir)), "passengers"), "month", "mom")
    return rounded(r.latest(m, "month", "mom"))


@query("latest_wow", sql(["ridership"], PAX + [_WK, _change_sql("wk", "week", "wow")],
       "SELECT line, passengers, round(wow, 4) AS wow FROM wk_chg "
       "WHERE week = (SELECT max(week) FROM wk_chg)"))
def latest_wow(spark, sf_dir):
    w = r.with_change(_dbl(r.weekly(_pax(spark, sf_dir)), "passengers"), "week", "wow")
    return rounded(r.latest(w, "week", "wow"))


@query("changes_written", sql(["ridership"], PAX + [_WK, _change_sql("wk", "week", "wow"), _MO, _change_sql("mo", "month", "mom")],
       "SELECT 'week_changes' AS table_name, line, round(passengers, 4) AS passengers, round(wow, 4) AS change FROM wk_chg WHERE week = (SELECT max(week) FROM wk_chg) "
       "UNION ALL SELECT 'month_changes', line, round(passengers, 4), round(mom, 4) FROM mo_chg WHERE month = (SELECT max(month) FROM mo_chg)"))
def changes_written(spark, sf_dir):
    """The page's two change tables written as CSV and read back by the library's reader."""
    from ..operators.jobs import insights_page, write_changes
    from ..sources.files import load_csv
    page = insights_page(view(spark, sf_dir, "ridership"), None)
    paths = write_changes(page, shared_path(spark, "exports", uuid.uuid4().hex))
    parts = [load_csv(spark, paths[name]).select(F.lit(name).alias("table_name"), "line", F.col("passengers").cast("double"), F.col(change).cast("double").alias("change"))
             for name, change in (("week_changes", "wow"), ("month_changes", "mom"))]
    return rounded(parts[0].unionByName(parts[1]))


_TRAILING = sql(["ridership"], [("b", "SELECT max(date) AS e FROM ridership")],
       """SELECT line, CAST(sum(passengers) AS DOUBLE) AS passengers,
                 CAST(e - INTERVAL 6 DAY AS DATE) AS period_start, e AS period_end
          FROM ridership, b WHERE date >= e - INTERVAL 6 DAY AND date <= e AND line IS NOT NULL
          GROUP BY line, e""")


@query("trailing_week", _TRAILING)
def trailing_week(spark, sf_dir):
    return _dbl(r.trailing_days(view(spark, sf_dir, "ridership"), 7), "passengers")


@query("trailing_week_by_month", _TRAILING)
def trailing_week_by_month(spark, sf_dir):
    """Ridership stored by month; the week is read from the newest months alone."""
    from ..sources.months import last_days, write_by_month
    path = shared_path(spark, "exports", uuid.uuid4().hex, "ridership.parquet")
    write_by_month(view(spark, sf_dir, "ridership"), path)
    rows, bounds = last_days(spark, path, 7)
    return _dbl(r.trailing_days(rows, 7, bounds=bounds), "passengers")


@query("system_summary", sql(["turnstiles"], [],
       """SELECT count(*) AS total_records, count(DISTINCT estacion) AS n_stations,
                 CAST(min(fecha) AS DATE) AS first_date, CAST(max(fecha) AS DATE) AS last_date
          FROM turnstiles"""))
def system_summary(spark, sf_dir):
    return r.system_summary(view(spark, sf_dir, "turnstiles"))


@query("global_totals", sql(["turnstiles"], [],
       """SELECT CAST(trunc(coalesce(sum(pax_pagos), 0)) AS BIGINT) AS total_entries,
                 CAST(NULL AS BIGINT) AS total_passes,
                 CAST(trunc(coalesce(sum(pax_total), 0)) AS BIGINT) AS total_traffic
          FROM turnstiles"""))
def global_totals(spark, sf_dir):
    return r.global_totals(view(spark, sf_dir, "turnstiles"))


@query("top_stations", sql(["turnstiles"], [
    ("g", "SELECT estacion AS station, coalesce(sum(CAST(pax_total AS DOUBLE)), 0) AS s, count(pax_total) AS nn, "
          "count(*) AS n FROM turnstiles WHERE estacion IS NOT NULL GROUP BY 1"),
    ("u", "SELECT coalesce(sum(nn) > 0 AND sum(s) > 0, false) AS use FROM g"),
], """SELECT station, CASE WHEN use THEN s ELSE CAST(n AS DOUBLE) END AS value,
             CASE WHEN use THEN 'passengers' ELSE 'count' END AS metric
      FROM g, u ORDER BY value DESC, station LIMIT 10"""))
def top_stations(spark, sf_dir):
    df = view(spark, sf_dir, "turnstiles")
    st = r.find_role_column(df.columns, "station")
    return r.top_stations(df, st, r.find_role_column(df.columns, "passengers"), k=10)


def _top_sql(section: str, expr: str, k: int) -> str:
    return (f"(SELECT '{section}' AS section, CAST(key AS VARCHAR) AS key, n, "
            f"row_number() OVER (ORDER BY n DESC, key) AS rank FROM "
            f"(SELECT {expr} AS key, count(*) AS n FROM turnstiles_timed WHERE {expr} IS NOT NULL "
            f"GROUP BY 1 ORDER BY n DESC, key LIMIT {k}))")


_HOUR_TEXT = "split_part(hora, ':', 1)"
_HOUR = f"try_cast({duck.strip(_HOUR_TEXT)} AS INTEGER)"


@query("dataset_summary", sql(["turnstiles_timed"], [],
       " UNION ALL ".join([_top_sql("top_stations", "estacion", 5), _top_sql("top_lines", "linea", 5),
                           _top_sql("hour_peaks", _HOUR, 10)])))
def dataset_summary(spark, sf_dir):
    return r.dataset_summary(view(spark, sf_dir, "turnstiles_timed"))


@query("hour_profile", sql(["turnstiles_timed"], [],
       f"SELECT {_HOUR} AS hour, count(*) AS n FROM turnstiles_timed WHERE {_HOUR} IS NOT NULL GROUP BY 1"))
def hour_profile(spark, sf_dir):
    return r.hour_profile(view(spark, sf_dir, "turnstiles_timed"), "hora")


@query("lines_union", sql(["ridership", "dispatch_monthly"], PAX + HW_PAGE_RANGED,
       "SELECT line FROM pax UNION SELECT line FROM hw_r"))
def lines_union(spark, sf_dir):
    return _page(spark, sf_dir).lines


@query("densified_monthly", sql(["ridership"], PAX + [
    ("mo", f"SELECT line, {duck.month('date')} AS month, sum(passengers) AS passengers FROM pax GROUP BY ALL"),
    ("rng", "SELECT min(CAST(month || '-01' AS DATE)) AS lo, max(CAST(month || '-01' AS DATE)) AS hi FROM mo"),
    ("cal", "SELECT l.line, strftime(CAST(t.m AS DATE), '%Y-%m') AS month FROM (SELECT DISTINCT line FROM mo) l, "
            "rng, unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS t(m)"),
], """SELECT cal.line, cal.month, CAST(coalesce(mo.passengers, 0) AS DOUBLE) AS passengers
      FROM cal LEFT JOIN mo ON cal.line = mo.line AND cal.month = mo.month"""))
def densified_monthly(spark, sf_dir):
    return _dbl(r.densify_monthly(r.monthly(_pax(spark, sf_dir))), "passengers")


@query("demo_join", sql(["ridership", "dispatch_monthly"], PAX + HW_PAGE,
       """SELECT p.line, p.passengers, round(h.avg_headway_min, 4) AS avg_headway_min
          FROM (SELECT line, CAST(sum(passengers) AS DOUBLE) AS passengers FROM pax GROUP BY line) p
          JOIN (SELECT line, avg(avg_headway_min) AS avg_headway_min FROM hw GROUP BY line) h
          ON p.line = h.line"""))
def demo_join(spark, sf_dir):
    p = _dbl(r.sum_by_line(_pax(spark, sf_dir)), "passengers")
    h = r.mean_by_line(_hw_page(spark, sf_dir))
    return rounded(p.join(h, "line"))


# --- labels and dates -------------------------------------------------------

_LABEL_SOURCES = [("ridership", "line"), ("turnstiles", "linea"), ("turnstiles_timed", "linea"),
                  ("turnstiles_raw", "LINEA"), ("dispatch_daily", "line")]


@query("line_labels", sql([v for v, _ in _LABEL_SOURCES], [
    ("raw", " UNION ALL ".join(f'SELECT "{c}" AS raw FROM "{v}"' for v, c in _LABEL_SOURCES)),
], f"""SELECT raw, {duck.canonical_ah('raw')} AS line_ah, {duck.canonical_az('raw')} AS line_az,
              {duck.normalize('raw')} AS line_norm, count(*) AS n FROM raw GROUP BY raw"""))
def line_labels(spark, sf_dir):
    parts = [view(spark, sf_dir, v).select(F.col(f"`{c}`").alias("raw")) for v, c in _LABEL_SOURCES]
    raw = parts[0]
    for p in parts[1:]:
        raw = raw.unionByName(p)
    g = raw.groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    return g.select("raw", canonical_line_ah("raw").alias("line_ah"), canonical_line_az("raw").alias("line_az"),
                    normalize_line("raw").alias("line_norm"), "n")


def _text_label(name, spark_fn, duck_fn):
    @query(name, sql([], [], f"SELECT conv_id, turn, {duck_fn('text')} AS line FROM conversations"))
    def q(spark, sf_dir):
        from ..sources.testviews import table
        return table(spark, sf_dir, "conversations").select("conv_id", "turn", spark_fn("text").alias("line"))
    return q


_text_label("canonical_line_ah", canonical_line_ah, duck.canonical_ah)
_text_label("canonical_line_az", canonical_line_az, duck.canonical_az)
_text_label("normalize_line", normalize_line, duck.normalize)


@query("coerce_dates", sql(["dated_text"], [],
       f"SELECT event_id, raw_date, CAST({duck.day_first('raw_date')} AS TIMESTAMP) AS parsed_at, "
       f"CAST({duck.day_first('raw_date')} AS DATE) AS parsed FROM dated_text"))
def coerce_dates(spark, sf_dir):
    df = view(spark, sf_dir, "dated_text")
    ts = parse_day_first(df, "raw_date")
    return df.select("event_id", "raw_date", ts.cast("timestamp_ntz").alias("parsed_at"),
                     ts.cast("date").alias("parsed"))


@query("turnstiles_to_ridership", sql(["turnstiles_timed"], [], f"""
    SELECT CAST(fecha AS DATE) AS date, {duck.normalize('linea')} AS line,
           CAST(sum(pax_total) AS DOUBLE) AS passengers
    FROM turnstiles_timed
    WHERE fecha IS NOT NULL AND {duck.normalize('linea')} IN {duck.ALL_LINES_SQL}
    GROUP BY 1, 2"""))
def turnstiles_to_ridership(spark, sf_dir):
    from ..operators.jobs import ridership_from_turnstiles
    out = ridership_from_turnstiles(view(spark, sf_dir, "turnstiles_timed"))
    return out.withColumn("passengers", F.col("passengers").cast("double"))


@query("top_stations_by_count", sql(["turnstiles_timed"], [],
       """SELECT estacion AS station, CAST(count(*) AS DOUBLE) AS value, 'count' AS metric
          FROM turnstiles_timed WHERE estacion IS NOT NULL GROUP BY estacion
          ORDER BY value DESC, station LIMIT 10"""))
def top_stations_by_count(spark, sf_dir):
    """Station ranking when no passenger column is usable: by row count."""
    df = view(spark, sf_dir, "turnstiles_timed").drop("pax_total")
    return r.top_stations(df, "estacion", r.find_role_column(df.columns, "passengers"), k=10)
