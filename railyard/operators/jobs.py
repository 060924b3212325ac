"""Composite jobs: the public entry points built from the operators.

Each job reads its inputs with Spark, keeps the work in one lazy plan per
output, and writes results through the sinks. Where one frame feeds several
actions it is written once (or checkpointed into the shared checkpoint
folder) and read back, so a lost executor never recomputes the whole input.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import light_names, month_start, parse_day_first, parse_iso_date, to_number
from ..functions.lines import ALL_LINES, SUBTE_LINES, normalize_line
from ..session import cut_lineage, shared_path
from ..sources import files, sinks
from ..sources import months as by_month
from . import forecast as fc
from . import headway as hw
from . import incidents as inc
from . import quality as q
from . import reports as rep
from . import ridership as r


def run_quality_pipeline(spark: SparkSession, raw_path: str, processed_dir: str,
                         cfg: q.DataQualityConfig) -> DataFrame:
    """Load CSV, clean, save (Parquet + CSV), check and summarise.

    The CSV is parsed once, into a Parquet copy of its texts; the counts that
    decide the columns' types are observed on the way. The clean rows are
    written once, and row, null and range counts and z-score bounds are observed
    there too. Only distinct counts (allowed sets, keys) read the saved table."""
    text = files.load_csv(spark, raw_path)
    names = text.columns
    text = text.toDF(*[f"c{i}" for i in range(len(names))])  # header names may be no names for Parquet
    copy = shared_path(spark, "raw", f"{cfg.name}_{uuid.uuid4().hex}")
    counts = q.observed_save(text, lambda df: df.write.parquet(copy), files.type_counts(text))
    # numbers become numeric columns, as a CSV reader with type inference gives
    raw = files.typed(spark.read.schema(text.schema).parquet(copy), counts).toDF(*names)
    clean = q.basic_cleaning(raw)
    out: dict[str, str] = {}
    measures = q.Measures(clean, cfg, cfg.numeric_columns)
    seen = q.observed_save(clean, lambda df: out.update(sinks.save_dataset(df, processed_dir, cfg.name)), measures.plain)
    return q.quality_result(counts["rows"], spark.read.parquet(out["parquet"]), cfg, observed=seen)


def ridership_from_turnstiles(df: DataFrame, date_col: str = "fecha", line_col: str = "linea",
                              value_col: str = "pax_total") -> DataFrame:
    """Turnstile rows to the (date, line, passengers) table: day-first dates,
    forecast label rules, numbers coerced (bad text counts 0), summed per day
    and line. Unparseable dates and unknown lines are left out."""
    dfx = light_names(df)
    day = parse_day_first(dfx, date_col).cast("date")
    value = to_number(dfx, value_col, fill_zero=True)
    rows = dfx.select(day.alias("date"), F.col(line_col).alias("line"), value.alias("passengers"))
    return r.daily_by_line(rows, label=normalize_line, allowed=ALL_LINES)


def headway_from_files(spark: SparkSession, monthly_path: str | None, daily_path: str | None,
                       out_path: str | None = None) -> DataFrame | None:
    """Headway ETL from files: the monthly CSV when it reads and has the
    columns, else the daily Parquet; dedup; calibrate; optionally written."""
    out = None
    if monthly_path:
        try:
            m = files.read_optional(spark, monthly_path, "csv")
            out = hw.headway_from_monthly(m) if m is not None else None
        except ValueError:
            out = None
    if out is None and daily_path:
        try:
            d = files.read_optional(spark, daily_path, "parquet")
            out = hw.headway_from_daily(d) if d is not None else None
        except ValueError:
            out = None
    if out is None:
        return None
    result = hw.calibrate(hw.dedup_by_key(out))
    if out_path:
        sinks.write_table(result, out_path, "csv")
    return result


def forecast_from_files(spark: SparkSession, ridership_path: str, dispatch_path: str | None,
                        out_path: str | None = None, horizon: int = fc.HORIZON) -> DataFrame:
    """Forecast end to end from the ridership Parquet and the optional monthly
    dispatch CSV."""
    pax = spark.read.parquet(ridership_path)
    disp = files.read_optional(spark, dispatch_path, "csv") if dispatch_path else None
    if disp is not None and not {"year_month", "line", "dispatched_trains"}.issubset(disp.columns):
        disp = None
    out = fc.forecast_all(pax, disp, horizon, materialize=True)
    if out_path:
        sinks.write_table(out, out_path, "csv")
    return out


@dataclass
class InsightsPage:
    pax_by_line: DataFrame
    hw_by_line: DataFrame | None
    kpis: DataFrame
    weekly: DataFrame
    monthly: DataFrame
    wow_latest: DataFrame
    mom_latest: DataFrame
    lines: DataFrame
    report: DataFrame
    payload: DataFrame
    forecast: DataFrame | None = None  # rows of the selected lines, by week and line
    forecast_pivot: DataFrame | None = None  # weeks x selected lines


def insights_page(ridership: DataFrame, headway: DataFrame | None, lines=None, date_from=None,
                  date_to=None, include_premetro: bool = True, generated_at: str = "",
                  materialize: bool = True, densify: bool = False,
                  forecast: DataFrame | None = None) -> InsightsPage:
    """Data of the insights page: filters, sums, KPIs, changes, report, payload
    and (with ``forecast``, the forecast table) the selected lines' forecast,
    as named DataFrames (nothing is collected)."""
    allowed = SUBTE_LINES + (("P",) if include_premetro else ())
    # one pass over the fact table: daily sums by line (additive, so week,
    # month and line totals all derive from it), labels applied after the
    # first aggregation; cut from the lineage once
    pax = r.daily_by_line(ridership, allowed=allowed, lines=lines, date_from=date_from, date_to=date_to)
    if materialize:
        pax = cut_lineage(pax)
    # the page's date range defaults to the ridership range and filters headway too
    lo, hi = r.date_range(pax)
    hwp = (r.prepare_headway(headway, lines=lines, date_from=date_from if date_from else lo,
                             date_to=date_to if date_to else hi, allowed=allowed)
           if headway is not None else None)
    pbl = r.sum_by_line(pax)
    hbl = r.mean_by_line(hwp) if hwp is not None else None
    k = r.kpis(pbl, hbl)
    weekly = r.with_change(r.weekly(pax), "week", "wow")
    monthly_sums = r.monthly(pax)
    if densify:  # every line x month of the range, 0 where a line has no rows
        monthly_sums = r.densify_monthly(monthly_sums)
    monthly = r.with_change(monthly_sums, "month", "mom")
    period = F.concat(F.lit(date_from).cast("string") if date_from else lo.cast("string"), F.lit(" to "),
                      F.lit(date_to).cast("string") if date_to else hi.cast("string"))
    line_df = r.lines_union(pax, hwp) if hwp is not None else r.lines_union(pax)
    shown = [x for x in allowed if lines is None or x in lines]
    fct = pivot = None
    if forecast is not None:
        fct = forecast.where(F.col("line").isin(shown)).orderBy("week", "line")
        pivot = fc.pivot_weeks(forecast.where(F.col("line").isin(shown)), shown)
    return InsightsPage(
        forecast=fct, forecast_pivot=pivot, pax_by_line=pbl, hw_by_line=hbl, kpis=k, weekly=weekly, monthly=monthly,
        wow_latest=r.latest(weekly, "week", "wow"), mom_latest=r.latest(monthly, "month", "mom"),
        lines=line_df, report=rep.insights_report(pbl, hbl, period),
        payload=rep.weekly_payload(k, line_df, period, generated_at),
    )


def write_changes(page: InsightsPage, out_dir: str) -> dict[str, str]:
    """The page's change tables as CSV: ``week_changes.csv`` and ``month_changes.csv``."""
    return {name: sinks.write_table(df, f"{out_dir}/{name}.csv", "csv")
            for name, df in (("week_changes", page.wow_latest), ("month_changes", page.mom_latest))}


def weekly_summary_from_files(spark: SparkSession, ridership_path: str, headway_path: str | None, out_path: str, days: int = 7) -> str:
    """The trailing-week summary as a job: ridership Parquet and headway CSV
    (optional; a ``date`` or ``year_month`` column) to a Markdown file. Of a
    table stored by month (:mod:`railyard.sources.months`) only the months of
    the window are opened."""
    headway = files.read_optional(spark, headway_path, "csv") if headway_path else None
    if headway is not None:
        day = parse_iso_date(F.col("date")) if "date" in headway.columns else month_start(F.col("year_month"))
        headway = headway.withColumns({"date": day, "avg_headway_min": to_number(headway, "avg_headway_min")})
    if by_month.months(spark, ridership_path):
        pax, bounds = by_month.last_days(spark, ridership_path, days)
    else:
        pax, bounds = spark.read.parquet(ridership_path), None
    return sinks.write_text(rep.weekly_summary(pax, headway, days, bounds=bounds), out_path)


def incident_pipeline(outputs: DataFrame, run_ts: str, raw_col: str = "raw_output") -> DataFrame:
    """Stored model outputs to routed tickets."""
    return inc.tickets(inc.classify(outputs, raw_col), run_ts)


def tickets_as_incidents(tickets: DataFrame) -> DataFrame:
    """Ticket rows in the incident log layout."""
    return tickets.select(
        F.col("ticket_id").alias("incident_id"), F.col("created_at").alias("reported_at"), "source",
        "description", "category", "severity", "line", "station", "target_team", "raw_llm_output",
    )


def load_passengers_summary(spark: SparkSession, path: str, demo: bool = False) -> tuple[DataFrame, str]:
    """Passengers by line from the ridership Parquet, else (only if the caller
    asks for them) the demo figures."""
    df = files.read_optional(spark, path, "parquet")
    if df is not None and {"line", "passengers"}.issubset(df.columns) and not df.isEmpty():
        return _tag(r.sum_by_line(df).orderBy("line"), "passengers", path), path
    if not demo:
        raise FileNotFoundError(f"no ridership table at {path}")
    return _tag(files.demo_frames(spark)[0], "passengers", "DEMO"), "DEMO"


def load_other_metric(spark: SparkSession, headway_path: str, monthly_path: str, daily_path: str,
                      demo: bool = False) -> tuple[DataFrame, str, str]:
    """Headway by line from the headway table, else mean dispatched trains by
    line from the monthly then the daily service table, else (with ``demo``)
    demo headways.
    Returns (frame, kind, source)."""
    found = files.first_available([
        ("headway", lambda: files.read_optional(spark, headway_path, "csv"), {"line", "avg_headway_min"}),
        ("monthly", lambda: files.read_optional(spark, monthly_path, "csv"), {"line", "dispatched_trains"}),
        ("daily", lambda: files.read_optional(spark, daily_path, "parquet"), {"line", "trains"}),
    ])
    if found is None and not demo:
        raise FileNotFoundError("no headway or service table found")
    if found is None:
        return _tag(files.demo_frames(spark)[1], "headway", "DEMO"), "headway", "DEMO"
    name, df = found
    if name == "headway":
        if "year_month" in df.columns:
            df = r.mean_by_line(df.withColumn("avg_headway_min", to_number(df, "avg_headway_min").cast("double")))
        out = df.select("line", "avg_headway_min").orderBy("line")
        return _tag(out, "headway", headway_path), "headway", headway_path
    col = "dispatched_trains" if name == "monthly" else "trains"
    src = monthly_path if name == "monthly" else daily_path
    level = F.avg(to_number(df, col).cast("double")).alias("service_level")
    out = df.groupBy("line").agg(level).orderBy("line")
    return _tag(out, "service", src), "service", src


def _tag(df: DataFrame, kind: str, source: str) -> DataFrame:
    """Constant columns naming the chosen source and its kind."""
    return df.withColumn("kind", F.lit(kind)).withColumn("source", F.lit(source))
