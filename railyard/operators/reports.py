"""Markdown reports and the weekly payload record.

Reports are one-row DataFrames. Their line lists come from per-line
aggregates (bounded by the line set), ordered inside an aggregate
(``array_sort`` of ``collect_list``), so no result passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import nan_to_null, sum0
from ..functions.lines import ALL_LINES, canonical_line_az, in_lines
from .ridership import in_days, trailing_bounds

# The summary texts used when no model summary is given.
DRAFT_SUMMARY = (
    "**Insights (draft)**\n"
    "- Passenger totals and headway appear stable across lines.\n"
    "- Watch potential demand spikes on Line D and service variability on Line E.\n"
    "- Consider correlating weather/events to refine headway estimates.\n\n"
    "**What to watch next week**: Headway stability vs. dispatched trains and peak-hour demand.\n\n"
    "🔎 KPI: Headway ~ stable; Line D remains the busiest."
)
PLAIN_SUMMARY = "- Stable week. Consider weather correlation.\n- Headway proxy consistent with dispatch volumes."

# The narrative prompt, with the dataset summary at the marker.
SUMMARY_MARKER = "{{DATA_SUMMARY}}"
INSIGHTS_PROMPT = (
    "You are an expert in urban mobility analytics. \n"
    "Generate a clear, concise narrative based on the following summary derived from Buenos Aires Subte "
    "turnstile data.\n"
    "\n"
    "The tone should be analytical, professional, and accessible to non-technical readers.\n"
    "\n"
    "Use ~4–6 short paragraphs. \n"
    "Highlight patterns, anomalies, peaks, and the general behavior of passengers.\n"
    "\n"
    "Dataset Summary:\n"
    "{{DATA_SUMMARY}}\n"
    "\n"
    "Write the insights below:\n"
)
SECTION_ORDER = ("top_stations", "top_lines", "hour_peaks")


def _ordered_lines(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """One row with the texts joined by newlines in ``key`` order (null when
    the frame is empty)."""
    items = F.array_sort(F.collect_list(F.struct(key.alias("k"), text.alias("t"))))
    return df.agg(F.array_join(F.transform(items, lambda s: s.getField("t")), "\n").alias("body"),
                  F.count(F.lit(1)).alias("n"))


def passenger_lines(pax_by_line: DataFrame) -> Column:
    """``- B: 47,777,794`` lines, largest first (ties by line)."""
    p = F.col("passengers")
    body = _ordered_lines(
        pax_by_line, F.struct(-p.cast("double"), F.col("line")),
        F.concat(F.lit("- "), F.col("line"), F.lit(": "), F.format_number(p.cast("long"), 0)),
    )
    return body.select(F.when(F.col("n") > 0, F.col("body"))).scalar()


def two_decimals(c: Column) -> Column:
    """Python's ``f"{x:.2f}"``: the binary value rounded half-even to two
    places. Java's ``%.2f`` rounds the shortest decimal text half-up instead
    (2.675 gives 2.68 there, 2.67 here); ``format_number`` rounds like
    Python, then its thousands separators are removed."""
    return F.regexp_replace(F.format_number(c, 2), ",", "")


def headway_lines(hw_by_line: DataFrame) -> Column:
    """``- A: 2.23 min`` lines, smallest headway first."""
    h = F.col("avg_headway_min")
    body = _ordered_lines(
        hw_by_line, F.struct(h, F.col("line")),
        F.concat(F.lit("- "), F.col("line"), F.lit(": "), two_decimals(h), F.lit(" min")),
    )
    return body.select(F.when(F.col("n") > 0, F.col("body"))).scalar()


def _sections(pax_body: Column, hw_body: Column, pax_title: str, hw_title: str) -> Column:
    pax_part = F.when(pax_body.isNotNull(), F.concat(F.lit(pax_title + "\n"), pax_body))
    hw_part = F.when(hw_body.isNotNull(), F.concat(F.lit("\n" + hw_title + "\n"), hw_body))
    return F.concat_ws("\n", pax_part, hw_part)


def insights_report(pax_by_line: DataFrame, hw_by_line: DataFrame | None, period: Column,
                    summary: str = DRAFT_SUMMARY) -> DataFrame:
    """The weekly insights report text: title, period, passengers by line,
    headway by line, then the summary."""
    spark = pax_by_line.sparkSession
    hw_body = headway_lines(hw_by_line) if hw_by_line is not None else F.lit(None).cast("string")
    # The section titles.
    md = _sections(passenger_lines(pax_by_line), hw_body,
                   "**Passengers (sum by line):**", "**Avg. Headway (min by line):**")
    text = F.concat(F.lit("# AI Weekly Insights\n\n_Period:_ "), period, F.lit("\n\n"), md,
                    F.lit("\n\n---\n\n"), F.lit(summary))
    return spark.range(1).select(period.alias("period"), text.alias("report"))


def weekly_summary(pax: DataFrame, headway: DataFrame | None, days: int = 7,
                   summary: str = PLAIN_SUMMARY, bounds: tuple | None = None) -> DataFrame:
    """Trailing-week summary: sums by line over the last ``days`` days to the
    last date, and mean headway by line for headway rows dated in the window.
    ``bounds``: the first and the last day, where they are known."""
    spark = pax.sparkSession
    start, end = trailing_bounds(pax, days) if bounds is None else (F.lit(b).cast("date") for b in bounds)
    window = in_days(pax, start, end).where(F.col("line").isNotNull())
    # known lines only, so that the text gathers a bounded number of labels;
    # the label rules run on sums per raw label
    raw = window.groupBy("line").agg(sum0("passengers").alias("passengers"))
    pax_by_line = (raw.withColumn("line", canonical_line_az("line")).where(in_lines("line", ALL_LINES))
                   .groupBy("line").agg(F.sum("passengers").alias("passengers")))
    hw_body = F.lit(None).cast("string")
    if headway is not None:
        hd = F.col("date").cast("date")
        rows = headway.where((hd >= start) & (hd <= end)).withColumn("line", canonical_line_az("line")).where(in_lines("line", ALL_LINES))
        hw_by_line = rows.groupBy("line").agg(F.avg(nan_to_null("avg_headway_min")).alias("avg_headway_min"))
        hw_body = headway_lines(hw_by_line)
    period = F.concat(start.cast("string"), F.lit(" to "), end.cast("string"))
    # The section titles.
    md = _sections(passenger_lines(pax_by_line), hw_body,
                   "**Passengers (sum, last 7 days):**", "**Avg. Headway (min, last 7 days):**")
    text = F.concat(F.lit("# Weekly Summary ("), period, F.lit(")\n\n"), md, F.lit("\n\n---\n\n"), F.lit(summary))
    return spark.range(1).select(period.alias("period"), text.alias("report"))


# Fixed value: the default path of the forecast preview.
def weekly_payload(kpis: DataFrame, lines: DataFrame, period: Column, generated_at: str,
                   report_file: str = "", summary_md: str = DRAFT_SUMMARY,
                   forecast_preview: str = "data/processed/passengers_forecast_weekly.csv") -> DataFrame:
    """One-row JSON payload: period, selected lines, KPIs and file references."""
    line_list = lines.agg(F.sort_array(F.collect_list("line")).alias("l")).select("l").scalar()
    k = kpis.select(
        F.struct(
            F.coalesce(F.col("total_passengers").cast("double"), F.lit(0.0)).alias("total_passengers"),
            F.col("top_line").cast("string").alias("top_line"),
            F.coalesce(F.col("avg_headway_min").cast("double"), F.lit(0.0)).alias("avg_headway_min"),
        ).alias("kpis")
    )
    return k.select(F.to_json(F.struct(
        period.alias("period"), line_list.alias("lines"), F.col("kpis"),
        F.lit(forecast_preview).alias("forecast_preview"), F.lit(report_file).alias("report_file"),
        F.lit(summary_md).alias("summary_md"), F.lit(generated_at).alias("generated_at"),
    )).alias("payload"))


def _json_string(c: Column) -> Column:
    """A JSON string literal of the text (quotes and escapes included): the
    one element of a JSON array, without its brackets."""
    j = F.to_json(F.array(c))
    return j.substr(F.lit(2), F.length(j) - F.lit(2))


def summary_json(summary: DataFrame) -> Column:
    """The long dataset summary (section, key, n, rank) as indented JSON with
    sections in their fixed order and entries by rank (a scalar subquery over
    at most a few dozen rows)."""
    entry = F.concat(F.lit("    "), _json_string(F.col("key")), F.lit(": "), F.col("n").cast("string"))
    per_section = summary.groupBy("section").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))),
                                 lambda s: s.getField("e")), ",\n").alias("body"))
    order = F.array_position(F.array(*[F.lit(x) for x in SECTION_ORDER]), F.col("section"))
    block = F.concat(F.lit("  "), _json_string(F.col("section")), F.lit(": {\n"), F.col("body"), F.lit("\n  }"))
    whole = per_section.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(order.alias("o"), block.alias("b")))), lambda s: s.getField("b")),
        ",\n").alias("j"), F.count(F.lit(1)).alias("k"))
    return whole.select(F.when(F.col("k") > 0, F.concat(F.lit("{\n"), F.col("j"), F.lit("\n}")))
                        .otherwise(F.lit("{}"))).scalar()


def insights_prompt(summary: DataFrame) -> DataFrame:
    """The narrative prompt with the dataset summary as indented JSON."""
    spark = summary.sparkSession
    return spark.range(1).select(
        F.replace(F.lit(INSIGHTS_PROMPT), F.lit(SUMMARY_MARKER), summary_json(summary)).alias("prompt"))
