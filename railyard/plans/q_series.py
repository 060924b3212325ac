"""Daily series and rolling anomaly queries."""

from __future__ import annotations

from ..operators.anomalies import AnomalyConfig, detect_anomalies, prepare_daily_series
from ..sources.testviews import view
from .registry import query, rounded, with_views

_ANOMALY_SQL = """,
d AS (
  SELECT CAST(fecha AS DATE) AS date{station_sel}, SUM(pax_total) AS pax_total
  FROM {src} WHERE fecha IS NOT NULL{station_where}
  GROUP BY ALL),
s AS (
  SELECT date{station_sel}, CAST(pax_total AS DOUBLE) AS pax_total,
         count(pax_total) OVER w AS n,
         avg(CAST(pax_total AS DOUBLE)) OVER w AS m,
         stddev_pop(CAST(pax_total AS DOUBLE)) OVER w AS sd
  FROM d
  WINDOW w AS ({partition}ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
r AS (
  SELECT *, CASE WHEN n >= 7 THEN m END AS rolling_mean,
            CASE WHEN n >= 7 THEN nullif(sd, 0) END AS rolling_std
  FROM s),
z AS (SELECT *, (pax_total - rolling_mean) / rolling_std AS z_score FROM r)
SELECT date{station_sel}, pax_total, round(rolling_mean, 4) AS rolling_mean,
       round(rolling_std, 4) AS rolling_std, round(z_score, 4) AS z_score,
       coalesce(abs(z_score) >= 3.0, false) AS is_anomaly,
       CASE WHEN z_score >= 3.0 THEN 'spike' WHEN z_score <= -3.0 THEN 'drop'
            ELSE 'normal' END AS anomaly_type
FROM z
"""


def _anomaly_sql(src: str, station: bool) -> str:
    return with_views(
        [src],
        _ANOMALY_SQL.format(
            src=src,
            station_sel=", estacion" if station else "",
            station_where=" AND estacion IS NOT NULL" if station else "",
            partition="PARTITION BY estacion " if station else "",
        ),
    )


@query(
    "daily_series_station",
    with_views(
        ["turnstiles_timed"],
        """SELECT CAST(fecha AS DATE) AS date, estacion,
                  CAST(SUM(pax_total) AS DOUBLE) AS pax_total
           FROM turnstiles_timed WHERE fecha IS NOT NULL AND estacion IS NOT NULL
           GROUP BY ALL""",
    ),
)
def daily_series_station(spark, sf_dir):
    s = prepare_daily_series(view(spark, sf_dir, "turnstiles_timed"), AnomalyConfig())
    return s.withColumn("pax_total", s.pax_total.cast("double"))


@query(
    "series_15min_station",
    with_views(
        ["turnstiles_timed"],
        """SELECT make_timestamp(epoch_us(fecha) - epoch_us(fecha) % 900000000) AS date, estacion,
                  CAST(SUM(pax_total) AS DOUBLE) AS pax_total
           FROM turnstiles_timed WHERE fecha IS NOT NULL AND estacion IS NOT NULL
           GROUP BY ALL""",
    ),
)
def series_15min_station(spark, sf_dir):
    s = prepare_daily_series(view(spark, sf_dir, "turnstiles_timed"), AnomalyConfig(freq="15min"))
    s = s.withColumn("date", s.date.cast("timestamp_ntz"))
    return s.withColumn("pax_total", s.pax_total.cast("double"))


@query("anomaly_station", _anomaly_sql("turnstiles", station=True))
def anomaly_station(spark, sf_dir):
    cfg = AnomalyConfig()
    return rounded(detect_anomalies(prepare_daily_series(view(spark, sf_dir, "turnstiles"), cfg), cfg))


@query("anomaly_global", _anomaly_sql("turnstiles", station=False))
def anomaly_global(spark, sf_dir):
    cfg = AnomalyConfig(station_col=None)
    return rounded(detect_anomalies(prepare_daily_series(view(spark, sf_dir, "turnstiles"), cfg), cfg))


@query("anomaly_1s_global", with_views(["turnstiles_timed"], _ANOMALY_SQL.replace("CAST(fecha AS DATE)", "date_trunc('second', fecha)")
       .format(src="turnstiles_timed", station_sel="", station_where="", partition="")))
def anomaly_1s_global(spark, sf_dir):
    """One series of second buckets without stations: as long as its source's time, cut into blocks."""
    cfg = AnomalyConfig(station_col=None, freq="1s")
    out = detect_anomalies(prepare_daily_series(view(spark, sf_dir, "turnstiles_timed"), cfg), cfg)
    return rounded(out.withColumn("date", out.date.cast("timestamp_ntz")))


@query("anomaly_nan", with_views(["turnstiles_nan"], """,
t AS (SELECT fecha, linea AS estacion, CASE WHEN isnan(pax_total) THEN 0 ELSE pax_total END AS pax_total FROM turnstiles_nan)"""
       + _ANOMALY_SQL.replace(", pax_total, round", ", round(pax_total, 4) AS pax_total, round")
       .format(src="t", station_sel=", estacion", station_where=" AND estacion IS NOT NULL", partition="PARTITION BY estacion ")))
def anomaly_nan(spark, sf_dir):
    cfg = AnomalyConfig()
    rows = view(spark, sf_dir, "turnstiles_nan").withColumnRenamed("linea", "estacion")
    return rounded(detect_anomalies(prepare_daily_series(rows, cfg), cfg))
