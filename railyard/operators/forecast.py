"""Weekly ridership forecast: straight-line trend per line with an error band,
and the estimate of the line that has no turnstiles (P) from dispatched trains.

Plan shape: weekly and monthly sums are grouped aggregates (map-side combined);
the fit is one more grouped aggregate per line (``regr_*``), so no series is
ever collected into one task or the driver; the horizon is an ``explode``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import sum0, to_number
from ..functions.lines import ALL_LINES, SUBTE_LINES, in_lines, normalize_line
from ..session import cut_lineage
from .ridership import daily_by_line, week_start

# Horizon, minimum points for a fit, band width in deviations.
HORIZON = 4
MIN_POINTS = 6
BAND_Z = 1.64


def weekly_sum(df: DataFrame, value: str = "passengers") -> DataFrame:
    return df.groupBy("line", week_start(F.col("date")).alias("week")).agg(
        sum0(value).cast("double").alias(value)
    )


def monthly_sum(df: DataFrame, value: str = "passengers") -> DataFrame:
    return df.groupBy("line", F.date_format("date", "yyyy-MM").alias("ym")).agg(sum0(value).alias(value))


def dispatch_by_month(disp: DataFrame) -> DataFrame:
    """Monthly dispatch with forecast labels, known lines only."""
    return disp.select(
        F.col("year_month").cast("string").alias("ym"),
        normalize_line("line").alias("line"),
        to_number(disp, "dispatched_trains").alias("dispatched_trains"),
    ).where(in_lines("line", ALL_LINES))


def month_weeks(ym: F.Column) -> F.Column:
    """Mondays of the weeks that touch the month ``yyyy-MM`` (array of DATE)."""
    first = F.to_date(F.concat(ym, F.lit("-01")))
    return F.sequence(week_start(first), F.last_day(first), F.expr("INTERVAL 7 DAYS"))


def pax_per_train(pax_monthly: DataFrame, disp_monthly: DataFrame) -> DataFrame:
    """Passengers per dispatched train by month over the metro lines; months
    where either side is missing, or trains sum to 0, are left out."""
    pax = pax_monthly.where(in_lines("line", SUBTE_LINES)).groupBy("ym").agg(sum0("passengers").alias("pax"))
    tr = disp_monthly.where(in_lines("line", SUBTE_LINES)).groupBy("ym").agg(
        sum0("dispatched_trains").alias("trains")
    )
    ratio = F.try_divide(F.col("pax").cast("double"), F.col("trains").cast("double"))
    return pax.join(tr, "ym").select("ym", ratio.alias("ratio")).where(
        F.col("ratio").isNotNull() & ~F.isnan("ratio")
    )


def estimate_p(pax_monthly: DataFrame, disp_monthly: DataFrame, materialize: bool = False) -> DataFrame:
    """Weekly passengers of line P: its trains each month times that month's
    passengers-per-train (the median ratio when the month has none), shared
    equally over the weeks touching the month, then summed per week. With
    ``materialize`` the ratios (one row a month) are written once for the
    median and the lookup."""
    ratio = pax_per_train(pax_monthly, disp_monthly)
    if materialize:
        ratio = cut_lineage(ratio)
    fallback = ratio.select(F.median("ratio")).scalar()
    p = disp_monthly.where(F.col("line") == "P").join(ratio, "ym", "left")
    est = p.select(
        "ym", (F.col("dispatched_trains") * F.coalesce(F.col("ratio"), fallback)).alias("est")
    ).where(F.col("est").isNotNull())
    weeks = est.select("est", month_weeks(F.col("ym")).alias("weeks"))
    shares = weeks.select(
        F.explode("weeks").alias("week"), (F.col("est") / F.size("weeks")).alias("share")
    )
    return shares.groupBy(F.lit("P").alias("line"), "week").agg(F.sum("share").alias("passengers"))


def trend_forecast(weekly: DataFrame, horizon: int = HORIZON, min_points: int = MIN_POINTS,
                   z: float = BAND_Z, value: str = "passengers") -> DataFrame:
    """Per line: with fewer than ``min_points`` weeks the last value repeated,
    no band; otherwise the least-squares line over the present weeks (x is the
    row number among them, gaps skipped) extended ``horizon`` weeks, with a
    constant band of ``z`` population deviations of the residuals.

    The residual deviation comes from the same one-pass aggregate:
    SSR = Syy - slope * Sxy, sigma = sqrt(SSR / n)."""
    y = F.col(value).cast("double")
    s = weekly.where(y.isNotNull() & ~F.isnan(y))
    x = (F.row_number().over(Window.partitionBy("line").orderBy("week")) - 1).cast("double")
    pts = s.select("line", "week", y.alias("y"), x.alias("x"))
    fit = pts.groupBy("line").agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.regr_syy("y", "x").alias("syy"),
        F.regr_sxy("y", "x").alias("sxy"),
        F.max("week").alias("last_week"),
        F.max_by("y", "week").alias("last_y"),
    )
    k = F.col("k")
    line_fit = F.col("intercept") + F.col("slope") * (F.col("n") - 1 + k).cast("double")
    sigma = F.sqrt(F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)) / F.col("n"))
    fitted = F.col("n") >= min_points
    yhat = F.when(fitted, line_fit).otherwise(F.col("last_y"))
    band = F.when(fitted, F.lit(z) * sigma).otherwise(F.lit(0.0))
    return fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("k")).select(
        "line",
        F.date_add("last_week", k * 7).alias("week"),
        yhat.alias("yhat"),
        (yhat - band).alias("yhat_low"),
        (yhat + band).alias("yhat_high"),
    )


def forecast_all(ridership: DataFrame, dispatch: DataFrame | None, horizon: int = HORIZON,
                 materialize: bool = False) -> DataFrame:
    """End to end: metro lines from turnstiles, P estimated from dispatch (its
    own turnstile rows are left out), then the per-line forecast.

    With ``materialize`` the daily metro sums (one row per day and line) are
    checkpointed into the shared checkpoint folder, so the weekly branch, the
    monthly branch and the fallback-median subquery all read that small table
    instead of the fact table."""
    # one pass over the fact table: daily sums by line, forecast labels
    # applied after the first aggregation; weekly and monthly sums (additive)
    # both come from it, so the scan and its shuffle are shared
    metro = daily_by_line(ridership, label=normalize_line, allowed=SUBTE_LINES)
    if materialize:
        metro = cut_lineage(metro)
    weekly = weekly_sum(metro)
    if dispatch is not None:
        p = estimate_p(monthly_sum(metro), dispatch_by_month(dispatch), materialize)
        weekly = weekly.unionByName(p.select("line", "week", F.col("passengers").cast("double")))
    return trend_forecast(weekly, horizon=horizon)


def pivot_weeks(forecast: DataFrame, lines, value: str = "yhat") -> DataFrame:
    """Weeks x lines table of one forecast column for the selected lines (the
    caller's list, so the pivot needs no extra pass to find its columns)."""
    return forecast.groupBy("week").pivot("line", list(lines)).agg(F.max(value))
