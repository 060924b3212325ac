"""Source queries: CSV exports derived from the given tables, read back
through the folder / encoding-fallback readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_path
from ..sources.files import load_folder
from ..sources.testviews import view
from .common_sql import HEADWAY
from .q_forecast import _FC_OUT, _FIT, _forecast_sql
from .q_quality import _record, _result_sql
from .registry import query, rounded, sql

_RAW_COLS = [" Fecha", "Hora", "LINEA", "Estacion ", "Pax-Total"]


def _write_export(df, path: str, encoding: str) -> None:
    (df.write.mode("overwrite").option("header", "true").option("escape", '"').option("sep", ";").option("encoding", encoding)
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path))


@query("csv_folder_roundtrip", sql(["turnstiles_raw"], [],
       "SELECT " + ", ".join(f'"{c}"' for c in _RAW_COLS) + " FROM turnstiles_raw"))
def csv_folder_roundtrip(spark, sf_dir):
    """The raw export written as a folder of ';' CSV files -- morning rows in
    UTF-8, afternoon rows in Latin-1 with another column order -- then read
    back as one table by column name. Each call writes its own folder under
    the shared checkpoint location."""
    raw = view(spark, sf_dir, "turnstiles_raw")
    base = _run_dir(spark, "csv_exports")
    morning = F.col("Hora") < F.lit("12")
    _write_export(raw.where(morning), f"{base}/utf8", "UTF-8")
    _write_export(raw.where(~morning).select(*reversed([f"`{c}`" for c in _RAW_COLS])), f"{base}/latin1",
                  "ISO-8859-1")
    back = load_folder(spark, f"{base}/*/part-*.csv", sep=";")
    return back.select(*[F.col(f"`{c}`") for c in _RAW_COLS])


def _run_dir(spark, name: str) -> str:
    """A folder of its own for each run: a returned frame is lazy, and a
    second run must not overwrite the files it still reads."""
    return shared_path(spark, "exports", uuid.uuid4().hex, name)


def _export_csv(spark, sf_dir: str, name: str, sep: str = ",") -> str:
    path = _run_dir(spark, f"{name}.csv")
    (view(spark, sf_dir, name).write.mode("overwrite").option("header", "true").option("escape", '"').option("sep", sep).csv(path))
    return path


@query("csv_split_quotes", """
    SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text || chr(10) || '"' || role || '";' || chr(10) || chr(10) || turn AS body
    FROM conversations""")
def csv_split_quotes(spark, sf_dir):
    """Conversations exported as ';' CSV with line breaks, quotes and
    separators in the cells and in a header name, then read back: files whose
    records span lines, cut split by split."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    body = F.concat("text", F.lit('\n"'), "role", F.lit('";\n\n'), F.col("turn").cast("string"))
    path = _run_dir(spark, "conversations.csv")
    _write_export(talks.select("conv_id", "turn", F.col("role").alias("role\nof"), body.alias("body")), path, "UTF-8")
    back = load_folder(spark, path)
    return back.select("conv_id", "turn", F.col("`role\nof`").alias("role"), "body")


_HW_COLS = "year_month, line, round(avg_headway_min, 4) AS avg_headway_min, source"


@query("headway_from_csv", sql(["dispatch_monthly"], HEADWAY, f"SELECT {_HW_COLS} FROM headway"))
def headway_from_csv(spark, sf_dir):
    """Headway ETL from files: the monthly dispatch exported as CSV (text
    columns), the daily source as a fallback that is not needed."""
    from ..operators.jobs import headway_from_files
    monthly = _export_csv(spark, sf_dir, "dispatch_monthly")
    return rounded(headway_from_files(spark, monthly, _run_dir(spark, "missing.parquet")))


@query("forecast_from_files", sql(["ridership", "dispatch_monthly"],
                                  _FIT + _forecast_sql("wk_all"), _FC_OUT))
def forecast_from_files(spark, sf_dir):
    """Forecast end to end from a ridership Parquet export and a monthly
    dispatch CSV export."""
    from ..operators.jobs import forecast_from_files as run
    pax = _run_dir(spark, "ridership.parquet")
    view(spark, sf_dir, "ridership").write.mode("overwrite").parquet(pax)
    return rounded(run(spark, pax, _export_csv(spark, sf_dir, "dispatch_monthly")))


@query("dq_from_csv", _result_sql("turnstiles_raw", ["pax_total"], [
    "(SELECT CASE WHEN count(*) FILTER (WHERE CAST(pax_total AS DOUBLE) < 0) > 0 THEN 'Column ''pax_total'' has values below minimum 0' END FROM c)",
    "(SELECT CASE WHEN count(*) FILTER (WHERE CAST(pax_total AS DOUBLE) > 4) > 0 THEN 'Column ''pax_total'' has values above maximum 4' END FROM c)",
    "(SELECT CASE WHEN sum(k - 1) > 0 THEN printf('Composite key [''fecha'', ''hora'', ''linea'', ''estacion'', ''pax_total''] has %d duplicated rows', "
    "sum(k - 1)) END FROM (SELECT count(*) AS k FROM c GROUP BY fecha, hora, linea, estacion, pax_total))"]))
def dq_from_csv(spark, sf_dir):
    """The quality job on a ';'-free CSV export of the raw turnstile table:
    load with type inference, clean, save, check, summarise."""
    from ..operators.jobs import run_quality_pipeline
    from ..operators.quality import DataQualityConfig
    src = _run_dir(spark, "turnstiles_raw.csv")
    (view(spark, sf_dir, "turnstiles_raw").write.mode("overwrite").option("header", "true").option("escape", '"')
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(src))
    cfg = DataQualityConfig(
        name="turnstiles_raw", expected_columns=["fecha", "hora", "linea", "estacion", "pax_total"],
        non_null_columns=["fecha", "linea", "estacion"], numeric_columns=["pax_total"],
        allowed_values={"linea": ["Linea A", "LíneaB", "C", "D", "Premetro"]},
        value_ranges={"pax_total": (0, 4)}, unique_keys=[["fecha", "hora", "linea", "estacion", "pax_total"]],
        min_rows=1)
    return _record(run_quality_pipeline(spark, src, _run_dir(spark, "processed"), cfg))


_STREAM_DAY = "CAST(strptime(trim(\" Fecha\"), '%d/%m/%Y') AS DATE)"


@query("stream_daily_sums", sql(["turnstiles_raw"], [
    ("rows", f"SELECT {_STREAM_DAY} AS date, "
             "regexp_replace(\"LINEA\", '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g') AS linea, "
             "coalesce(try_cast(trim(\"Pax-Total\") AS DOUBLE), 0) AS pax_total FROM turnstiles_raw"),
], """SELECT date, linea, sum(pax_total) AS pax_total, count(*) AS rows FROM rows GROUP BY date, linea"""))
def stream_daily_sums(spark, sf_dir):
    """The raw export written as a folder of ';' CSV files and ingested by the
    streaming job (availableNow): daily sums by line, the days still open
    included. Each call runs in a fresh
    folder under the shared checkpoint location, so a rerun never re-reads
    files another run has seen."""
    from ..streaming.daily_stream import read_daily, start_daily_ingest
    run = shared_path(spark, "streams", f"daily_{uuid.uuid4().hex[:12]}")
    src = view(spark, sf_dir, "turnstiles_raw").select(
        F.col("` Fecha`").alias("fecha"), F.col("LINEA").alias("linea"),
        F.col("`Estacion `").alias("estacion"), F.col("`Pax-Total`").alias("pax_total"))
    (src.write.mode("overwrite").option("header", "true").option("escape", '"').option("sep", ";")
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(f"{run}/in"))
    q = start_daily_ingest(spark, f"{run}/in", f"{run}/out", checkpoint=f"{run}/checkpoint")
    q.awaitTermination()  # availableNow ends by itself when all files are read
    return read_daily(spark, f"{run}/out")


@query("first_available_metric", sql(["ridership", "dispatch_monthly", "dispatch_daily"], [], """
    SELECT 'monthly' AS branch, line, round(avg(CAST(dispatched_trains AS DOUBLE)), 4) AS value FROM dispatch_monthly GROUP BY line
    UNION ALL SELECT 'daily', line, round(avg(CAST(trains AS DOUBLE)), 4) FROM dispatch_daily GROUP BY line
    UNION ALL SELECT 'passengers', line, round(CAST(sum(passengers) AS DOUBLE), 4) FROM ridership GROUP BY line
    UNION ALL SELECT * FROM (VALUES ('demo', 'A', 3.5), ('demo', 'B', 4.0), ('demo', 'C', 4.2), ('demo', 'D', 3.8), ('demo', 'E', 5.0), ('demo', 'H', 4.6))"""))
def first_available_metric(spark, sf_dir):
    """Every branch of the source choice: the monthly table, the daily table, passengers, demo figures."""
    from ..operators.jobs import load_other_metric, load_passengers_summary
    none = _run_dir(spark, "missing")
    monthly = _export_csv(spark, sf_dir, "dispatch_monthly")
    daily, pax = _run_dir(spark, "daily.parquet"), _run_dir(spark, "ridership.parquet")
    view(spark, sf_dir, "dispatch_daily").write.parquet(daily)
    view(spark, sf_dir, "ridership").write.parquet(pax)
    parts = [
        load_other_metric(spark, none, monthly, daily)[0].select(F.lit("monthly").alias("branch"), "line", F.col("service_level").alias("value")),
        load_other_metric(spark, none, none, daily)[0].select(F.lit("daily"), "line", "service_level"),
        load_passengers_summary(spark, pax)[0].select(F.lit("passengers"), "line", F.col("passengers").cast("double")),
        load_other_metric(spark, none, none, none, demo=True)[0].select(F.lit("demo"), "line", "avg_headway_min"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return rounded(out)
