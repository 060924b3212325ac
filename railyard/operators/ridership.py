"""Ridership aggregates: sums and means by line, KPIs, weekly and monthly
sums, period-over-period change, trailing window, station rankings and
dataset summaries.

Every aggregate is a ``groupBy`` with map-side partial aggregation, so a hot
line or station is combined inside each task before the shuffle. Global
statistics (latest period) are lazy scalar subqueries; the trailing window's
days are known when its plan is made.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import hour_of, month_start, nan_to_null, parse_day_first, py_round, sum0, to_number
from ..functions.lines import ALL_LINES, canonical_line_az, in_lines
from ..session import cut_lineage


def sort_small(df: DataFrame, *cols) -> DataFrame:
    """Order a result whose size is bounded by the line set (or a top-k):
    one partition sorted in place, without the sampling job and range
    shuffle of a global sort. Never use it on data that grows with input."""
    return df.coalesce(1).sortWithinPartitions(*cols)


def prepare_ridership(
    df: DataFrame,
    lines: tuple[str, ...] | list[str] | None = None,
    date_from=None,
    date_to=None,
    allowed=ALL_LINES,
    line_col: str = "line",
    date_col: str = "date",
) -> DataFrame:
    """Page filters: canonical labels, the allowed line set, the selected lines
    and an inclusive date range. Dates compare as DATE, so a last day that
    carries times stays whole."""
    out = df.withColumn(line_col, canonical_line_az(line_col)).where(in_lines(line_col, allowed))
    if lines is not None:
        out = out.where(in_lines(line_col, lines))
    day = F.col(date_col).cast("date")
    if date_from is not None:
        lo = date_from if isinstance(date_from, Column) else F.lit(date_from)
        out = out.where(day >= lo.cast("date"))
    if date_to is not None:
        hi = date_to if isinstance(date_to, Column) else F.lit(date_to)
        out = out.where(day <= hi.cast("date"))
    return out


def date_range(df: DataFrame, date_col: str = "date") -> tuple[Column, Column]:
    """First and last day of a frame as scalar subqueries (the page's default
    date range)."""
    d = F.col(date_col).cast("date")
    both = df.select(F.struct(F.min(d).alias("lo"), F.max(d).alias("hi"))).scalar()
    return both.getField("lo"), both.getField("hi")


def daily_by_line(df: DataFrame, label=canonical_line_az, allowed=ALL_LINES, lines=None, date_from=None,
                  date_to=None, value: str = "passengers", line_col: str = "line",
                  date_col: str = "date") -> DataFrame:
    """Sums by day and canonical line, labels applied after aggregation.

    The date range filters raw rows (and reaches the scan); rows are first
    summed by day and *raw* label (map-side combined), the label rules run on
    those few rows, then the sums are combined again by canonical line. Sums
    are additive, so the result equals labelling every row first, while the
    regular expressions run once per (day, raw label) instead of once per row.
    Rows with a null day are left out, as a grouped sum would."""
    day = F.col(date_col).cast("date")
    base = df.where(day.isNotNull())
    if date_from is not None:
        lo = date_from if isinstance(date_from, Column) else F.lit(date_from)
        base = base.where(day >= lo.cast("date"))
    if date_to is not None:
        hi = date_to if isinstance(date_to, Column) else F.lit(date_to)
        base = base.where(day <= hi.cast("date"))
    raw = base.groupBy(day.alias("date"), F.col(line_col).alias("raw")).agg(sum0(value).alias(value))
    keep = in_lines(F.col("line"), allowed)
    if lines is not None:
        keep = keep & in_lines(F.col("line"), lines)
    labelled = raw.withColumn("line", label(F.col("raw"))).where(keep)
    return labelled.groupBy("date", "line").agg(sum0(value).alias(value))


def prepare_headway(df: DataFrame, **filters) -> DataFrame:
    """Headway table for the page: a ``date`` at the month start, then the same
    filters as ridership."""
    if "year_month" in df.columns:
        df = df.withColumn("date", month_start(F.col("year_month")))
    else:
        df = df.withColumn("date", F.lit("2024-01-01").cast("date"))
    return prepare_ridership(df, **filters)


def sum_by_line(df: DataFrame, value: str = "passengers", line: str = "line") -> DataFrame:
    """Sum per line; rows with a null line are left out, as in a grouped sum."""
    return df.where(F.col(line).isNotNull()).groupBy(F.col(line).alias("line")).agg(sum0(value).alias(value))


def mean_by_line(df: DataFrame, value: str = "avg_headway_min", line: str = "line") -> DataFrame:
    """Mean per line; rows with a null line are left out."""
    return df.where(F.col(line).isNotNull()).groupBy(F.col(line).alias("line")).agg(F.avg(value).alias(value))


def kpis(pax_by_line: DataFrame, hw_by_line: DataFrame | None = None) -> DataFrame:
    """One-row KPI record: total (truncated to whole passengers), top line by
    passengers (ties to the first label) with its value, and the unweighted
    mean of line headways rounded to 2. Empty input gives 0, '—' and 0.

    The passenger and headway parts are one-row aggregates combined by a
    union and a global aggregate (each column is set by one part only)."""
    p = F.col("passengers").cast("double")
    null_l, null_s = F.lit(None).cast("long"), F.lit(None).cast("string")
    parts = pax_by_line.agg(
        F.sum("passengers").cast("long").alias("total"),
        F.min_by("line", F.struct((-p).alias("neg"), F.col("line"))).alias("top_line"),
        F.max("passengers").cast("long").alias("top"),
        F.lit(None).cast("double").alias("hw"),
    )
    if hw_by_line is not None:
        parts = parts.unionByName(hw_by_line.agg(
            null_l.alias("total"), null_s.alias("top_line"), null_l.alias("top"),
            F.avg(nan_to_null("avg_headway_min")).alias("hw")))
    return parts.agg(
        F.coalesce(F.max("total"), F.lit(0).cast("long")).alias("total_passengers"),
        F.coalesce(F.max("top_line"), F.lit("—")).alias("top_line"),
        F.coalesce(F.max("top"), F.lit(0).cast("long")).alias("top_passengers"),
        py_round(F.max("hw"), 2).alias("avg_headway_min"),
    )


def week_start(c) -> F.Column:
    """Monday of the week (weeks run Monday to Sunday)."""
    return F.date_trunc("week", c).cast("date")


def weekly(df: DataFrame, value: str = "passengers") -> DataFrame:
    return df.groupBy("line", week_start(F.col("date")).alias("week")).agg(sum0(value).alias(value))


def monthly(df: DataFrame, value: str = "passengers") -> DataFrame:
    return df.groupBy("line", F.date_format("date", "yyyy-MM").alias("month")).agg(sum0(value).alias(value))


def with_change(df: DataFrame, period: str, out: str, value: str = "passengers") -> DataFrame:
    """Percent change against the previous present period of the same line
    (a missing period makes the last one seen the previous). A previous value
    of 0 gives null, not infinity. Input is one row per line and period, so
    each window partition is a line's calendar, not its raw rows."""
    w = Window.partitionBy("line").orderBy(period)
    prev = F.lag(value, 1).over(w)
    v = F.col(value).cast("double")
    return df.withColumn(f"{value}_prev", prev.cast("double")).withColumn(
        out, (F.try_divide(v, F.col(f"{value}_prev")) - 1.0) * 100.0
    )


def latest(df: DataFrame, period: str, change: str, value: str = "passengers") -> DataFrame:
    """Rows of the latest period overall, largest change first (nulls last)."""
    last = df.select(F.max(period)).scalar()
    return sort_small(df.where(F.col(period) == last).select("line", value, change),
                      F.desc_nulls_last(change), "line")


def trailing_days(df: DataFrame, days: int = 7, value: str = "passengers", bounds: tuple | None = None) -> DataFrame:
    """Sum by line over the last ``days`` calendar days ending on the last date
    (``bounds``: the first and the last day, where they are known)."""
    start, end = trailing_bounds(df, days) if bounds is None else _days(bounds)
    return (
        in_days(df, start, end).where(F.col("line").isNotNull())
        .groupBy("line")
        .agg(sum0(value).alias(value))
        .withColumn("period_start", start)
        .withColumn("period_end", end)
    )


def trailing_bounds(df: DataFrame, days: int, date_col: str = "date") -> tuple[Column, Column]:
    """First and last day of the window as literals, from one scan of the date
    column: known days prune partitions and row groups when the plan is made.
    A table stored by month has them without that scan (:mod:`railyard.sources.months`)."""
    last = df.agg(F.max(F.col(date_col)).cast("date")).first()[0]
    return _days((last - dt.timedelta(days=days - 1), last) if last is not None else (None, None))


def _days(bounds: tuple) -> tuple[Column, Column]:
    return F.lit(bounds[0]).cast("date"), F.lit(bounds[1]).cast("date")


def in_days(df: DataFrame, start: Column, end: Column, date_col: str = "date") -> DataFrame:
    """Rows of an inclusive day range. The raw column is compared (a cast
    around it would keep the bounds from the scan and from partition pruning):
    a date with the days, a timestamp with their first and next midnight."""
    d = F.col(date_col)
    if df.schema[date_col].dataType.simpleString() == "date":
        return df.where((d >= start) & (d <= end))
    return df.where((d >= start) & (d < F.date_add(end, 1)))


def system_summary(df: DataFrame, station: str = "estacion", date_col: str = "fecha",
                   approx: bool = False) -> DataFrame:
    """Rows, distinct stations (exact, or HyperLogLog++ with ``approx``) and
    first / last day (dates parsed day-first, so text dates compare as dates)."""
    if station not in df.columns:
        n_st = F.lit(None).cast("long")
    elif approx:
        n_st = F.approx_count_distinct(station)
    else:
        n_st = F.count_distinct(station)
    day = parse_day_first(df, date_col)
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        n_st.alias("n_stations"),
        F.min(day).cast("date").alias("first_date"),
        F.max(day).cast("date").alias("last_date"),
    )


def global_totals(df: DataFrame, columns=("pax_pagos", "pax_pases_pagos", "pax_total"),
                  names=("total_entries", "total_passes", "total_traffic")) -> DataFrame:
    """Totals of the passenger columns truncated to whole numbers; an absent
    column gives null (shown as N/A)."""
    aggs = []
    for c, n in zip(columns, names):
        if c in df.columns:
            aggs.append(F.coalesce(F.sum(to_number(df, c)), F.lit(0)).cast("long").alias(n))
        else:
            aggs.append(F.lit(None).cast("long").alias(n))
    return df.agg(*aggs)


def top_stations(df: DataFrame, station: str, pax: str | None, k: int = 10) -> DataFrame:
    """Top-k stations by passengers, or by row count when the passenger column
    is absent, has no numeric value, or sums to zero or less.

    One grouped pass computes both measures; the choice is a scalar over the
    grouped result; the ranking is a TakeOrdered of k rows. Both name all
    measures, so that they share one shuffle and the table is scanned once."""
    base = df.where(F.col(station).isNotNull())
    if pax is not None and pax in df.columns:
        num = to_number(base, pax).cast("double")
        g = base.groupBy(F.col(station).alias("station")).agg(
            F.coalesce(F.sum(num), F.lit(0.0)).alias("s"), F.count(num).alias("nn"),
            F.count(F.lit(1)).alias("n"),
        )
        use = g.select((F.sum("nn") > 0) & (F.sum("s") > 0) & (F.sum("n") >= 0)).scalar() & (F.col("nn") >= 0)
    else:
        g = base.groupBy(F.col(station).alias("station")).agg(
            F.lit(None).cast("double").alias("s"), F.count(F.lit(1)).alias("n")
        )
        use = F.lit(False)
    use = F.coalesce(use, F.lit(False))
    out = g.select(
        "station",
        F.when(use, F.col("s")).otherwise(F.col("n").cast("double")).alias("value"),
        F.when(use, F.lit("passengers")).otherwise(F.lit("count")).alias("metric"),
    )
    return out.orderBy(F.desc("value"), F.asc("station")).limit(k)


def find_role_column(columns, role: str) -> str | None:
    """Column by role: exact names first, then substring match."""
    # The column names of each role.
    exact = {
        "station": ("estacion", "station", "station_name"),
        "passengers": ("pax_total", "total_pax", "passengers_total"),
    }
    words = {
        "station": ("estacion", "station"),
        "passengers": ("pax_total", "pax", "pasaj", "passenger"),
        "line": ("linea", "line"),
        "time": ("hora", "time"),
    }
    lower = {c.lower(): c for c in columns}
    for key in exact.get(role, ()):
        if key in lower:
            return lower[key]
    for c in columns:
        if any(wd in c.lower() for wd in words[role]):
            return c
    return None


def dataset_summary(df: DataFrame, n_top: int = 5, n_hours: int = 10) -> DataFrame:
    """Top stations, top lines and busiest hours by row count, in long form
    (section, key, n, rank). Columns are found by name (first name containing
    a station, line or time word). One scan: a row counts in each section, and
    counts are combined in the tasks; a section's first keys are picked in the
    tasks too. Ties go to the smaller key (by number where keys are numbers)."""
    def first_containing(*words: str) -> F.Column | None:
        name = next((c for c in df.columns if any(wd in c.lower() for wd in words)), None)
        return None if name is None else F.col(name)

    time = first_containing("hora", "time")
    sections = [("top_stations", first_containing("estacion", "station"), n_top), ("top_lines", first_containing("linea", "line"), n_top),
                ("hour_peaks", None if time is None else hour_of(time), n_hours)]
    sections = [s for s in sections if s[1] is not None]
    if not sections:
        raise ValueError("no station, line or time column found")
    numbers = [isinstance(f.dataType, T.NumericType) for f in df.select(*[c for _, c, _ in sections]).schema.fields]
    keys = F.array(*[F.struct(F.lit(name).alias("section"), c.cast("string").alias("key"),
                              (c.try_cast("decimal(38,10)") if number else F.lit(None).cast("decimal(38,10)")).alias("number"))
                     for (name, c, _), number in zip(sections, numbers)])
    counts = df.select(F.inline(keys)).where(F.col("key").isNotNull()).groupBy("section", "key", "number").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "number", "key")).cast("long")
    ranked = counts.withColumn("rank", rank).where(F.col("rank") <= max(k for *_, k in sections))
    kept = F.create_map(*[F.lit(x) for name, _, k in sections for x in (name, k)])[F.col("section")]
    return ranked.where(F.col("rank") <= kept).select("section", "key", "n", "rank")


def summary_maps(summary: DataFrame) -> DataFrame:
    """The long summary as one map per section (key -> n)."""
    return summary.groupBy("section").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "n")))).alias("counts")
    )


def hour_profile(df: DataFrame, time_col: str) -> DataFrame:
    """Row count per clock hour; text that is not ``HH:...`` is left out."""
    h = hour_of(F.col(time_col))
    return df.where(h.isNotNull()).groupBy(h.alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def lines_union(*frames: DataFrame, line: str = "line") -> DataFrame:
    """Sorted distinct lines present in any of the frames."""
    parts = [f.select(F.col(line).alias("line")) for f in frames]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return sort_small(out.where(F.col("line").isNotNull()).distinct(), "line")


def densify_monthly(monthly_df: DataFrame, value: str = "passengers") -> DataFrame:
    """Fill every month between the first and the last month of the data, for
    every line, with 0 where a line has no rows. The calendar is generated per
    line from the global range, so no pair of data rows is ever formed. The
    monthly sums (a row per month and line) are written once."""
    monthly_df = cut_lineage(monthly_df)
    bounds = monthly_df.select(F.to_date(F.concat("month", F.lit("-01"))).alias("m"))
    lo = bounds.select(F.min("m")).scalar()
    hi = bounds.select(F.max("m")).scalar()
    cal = (
        monthly_df.select("line").distinct()
        .select("line", F.explode(F.sequence(lo, hi, F.expr("INTERVAL 1 MONTH"))).alias("m"))
        .select("line", F.date_format("m", "yyyy-MM").alias("month"))
    )
    return cal.join(monthly_df, ["line", "month"], "left").select(
        "line", "month", F.coalesce(F.col(value), F.lit(0)).alias(value)
    )
