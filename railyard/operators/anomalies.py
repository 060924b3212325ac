"""Daily series and rolling z-score anomaly flags.

Plan shape: scan -> partial sum by (day, station) -> shuffle on the same keys
-> final sum -> shuffle on station -> sort within partition -> window. The
window sees at most one row per station and day, whatever the raw volume, so a
station holding a third of all raw rows still gives a short per-day series.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import light_names, parse_day_first, to_number
from ..session import cut_lineage
from . import rolling

# Fixed widths in microseconds, by the names (and older names) of time units.
_UNITS = {"D": 86_400_000_000, "h": 3_600_000_000, "H": 3_600_000_000, "min": 60_000_000, "T": 60_000_000,
          "s": 1_000_000, "S": 1_000_000, "ms": 1_000, "L": 1_000, "us": 1, "U": 1}
_PART = re.compile(r"(\d+(?:\.\d+)?)?([A-Za-z]+)")


def bucket_width(freq: str) -> int:
    """Microseconds of a fixed width such as ``D``, ``6h``, ``15min``, ``1.5h`` or ``1h30min``."""
    text = freq.replace(" ", "")
    parts = list(_PART.finditer(text))
    if not parts or "".join(p[0] for p in parts) != text or any(p[2] not in _UNITS for p in parts):
        raise ValueError(f"unsupported freq {freq!r}; use a fixed width of the units {sorted(_UNITS)}")
    width = sum(Fraction(p[1] or 1) * _UNITS[p[2]] for p in parts)
    if width.denominator != 1 or width <= 0:
        raise ValueError(f"freq {freq!r} is not a positive number of microseconds")
    return int(width)


@dataclass(frozen=True)
class AnomalyConfig:
    date_col: str = "fecha"
    value_col: str = "pax_total"
    station_col: str | None = "estacion"
    freq: str = "D"
    window: int = 14
    z_threshold: float = 3.0
    min_periods: int = 7


def _has_station(df: DataFrame, cfg: AnomalyConfig) -> bool:
    return bool(cfg.station_col) and cfg.station_col in df.columns


def prepare_daily_series(df: DataFrame, cfg: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """Sum the value per time bucket (and station, when the column exists):
    a date per day, else the start of any fixed width as a timestamp.

    Rows whose date does not parse are dropped; a value that is not a number
    counts as 0; rows with a null station are left out, as a grouped sum over
    a null key would be.
    """
    dfx = light_names(df)
    if cfg.date_col not in dfx.columns or cfg.value_col not in dfx.columns:
        raise ValueError(f"Missing required columns: {cfg.date_col}, {cfg.value_col}")
    width = bucket_width(cfg.freq)
    ts = parse_day_first(dfx, cfg.date_col)
    if width == _UNITS["D"]:
        bucket = F.date_trunc("day", ts).cast("date").alias("date")
    else:  # clock time since 1970, floored to the width; dates and texts have no zone but the session's
        clock = F.unix_micros(F.from_utc_timestamp(ts, F.current_timezone()))
        bucket = F.to_utc_timestamp(F.timestamp_micros(clock - F.pmod(clock, F.lit(width))), F.current_timezone()).alias("date")
    keys = [bucket]
    cond = ts.isNotNull()
    if _has_station(dfx, cfg):
        keys.append(F.col(cfg.station_col))
        cond = cond & F.col(cfg.station_col).isNotNull()
    value = to_number(dfx, cfg.value_col, fill_zero=True)
    return dfx.where(cond).groupBy(*keys).agg(F.sum(value).alias(cfg.value_col))


def detect_anomalies(series: DataFrame, cfg: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """Rolling mean / population deviation over the last ``window`` rows,
    z-score, flag and direction label.

    Rolling frames count rows, not days. A station's days fit in a task (the
    calendar bounds them); a series without stations, or of finer buckets, is
    written once and cut into blocks that carry the rows a frame reaches back
    to (:mod:`.rolling`), so it spreads over tasks whatever its length. Both
    give the same frames, hence the same figures."""
    v = to_number(series, cfg.value_col).cast("double")
    keys = [cfg.station_col] if _has_station(series, cfg) else []
    columns = [*[F.col(c) for c in series.columns if c != cfg.value_col], v.alias(cfg.value_col)]
    value = F.col(cfg.value_col)
    aggs = {"_n": F.count(value), "_m": F.avg(value), "_s": F.stddev_pop(value)}
    rows = series.select(*columns)
    if keys and bucket_width(cfg.freq) >= _UNITS["D"]:
        # the three frame aggregates in one select: one Window operator, one pass
        w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-(cfg.window - 1), Window.currentRow)
        stats = rows.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
    else:
        rows = cut_lineage(rows)
        date = F.unix_date("date") if dict(rows.dtypes)["date"] == "date" else F.floor(F.unix_micros(F.col("date").cast("timestamp")) / bucket_width(cfg.freq))
        stats = rolling.framed(rolling.numbered(rows, keys, date, ["date"]), keys, cfg.window - 1, aggs)
    enough = F.col("_n") >= cfg.min_periods
    mean = F.when(enough, F.col("_m"))
    std = F.when(enough, F.nullif(F.col("_s"), F.lit(0.0)))
    z = (F.col(cfg.value_col) - mean) / std
    thr = cfg.z_threshold
    out = stats.select(
        *[F.col(c) for c in series.columns], mean.alias("rolling_mean"), std.alias("rolling_std"),
        z.alias("z_score"),
    )
    zc = F.col("z_score")
    return out.withColumn("is_anomaly", F.coalesce(F.abs(zc) >= thr, F.lit(False))).withColumn(
        "anomaly_type",
        F.when(zc >= thr, "spike").when(zc <= -thr, "drop").otherwise("normal"),
    )


def anomalies(df: DataFrame, cfg: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """Raw turnstile rows to flagged daily series (the notebook flow)."""
    return detect_anomalies(prepare_daily_series(df, cfg), cfg)
