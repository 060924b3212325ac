"""Driver test tables seen as the engine's logical tables.

Each logical column is one SQL expression. Most expressions are valid in both
Spark SQL and DuckDB; where the dialects differ (date formatting) a pair is
given. The Spark side builds DataFrames from them; the oracle side builds CTEs
from the very same text, so both engines read identical inputs.

All views are projections or aggregates of the whole given tables: their work
grows with the tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Expr:
    spark: str
    duck: str | None = None

    def for_engine(self, engine: str) -> str:
        return self.spark if engine == "spark" or self.duck is None else self.duck


@dataclass(frozen=True)
class View:
    name: str
    source: str
    columns: dict[str, Expr]
    where: str | None = None
    group_by: tuple[str, ...] = field(default_factory=tuple)


def E(spark: str, duck: str | None = None) -> Expr:
    return Expr(spark, duck)


# Fixed test mappings (own design): raw line labels in several spellings, so
# the three label normalisers have real work to do.
LINE_FROM_FLAGS = E(
    "CASE concat(l_returnflag, l_linestatus) "
    "WHEN 'AF' THEN 'A' WHEN 'AO' THEN 'Linea B' WHEN 'NF' THEN 'LíneaC' "
    "WHEN 'NO' THEN 'LINEA D' WHEN 'RF' THEN ' e ' ELSE 'Premetro' END"
)
LINE_FROM_PRIORITY = E(
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'Linea A' WHEN '2-HIGH' THEN 'LíneaB' "
    "WHEN '3-MEDIUM' THEN 'C' WHEN '4-NOT SPECIFIED' THEN 'Linea H' ELSE 'Premetro' END"
)
LINE_FROM_EVENT = E(
    "CASE event_type WHEN 'click' THEN 'Linea A' WHEN 'view' THEN 'LíneaB' "
    "WHEN 'purchase' THEN 'C' WHEN 'signup' THEN 'linea d' ELSE 'Premetro' END"
)
YEAR_MONTH_ORDER = E("date_format(o_orderdate, 'yyyy-MM')", "strftime(o_orderdate, '%Y-%m')")

VIEWS: dict[str, View] = {}


def _register(v: View) -> View:
    VIEWS[v.name] = v
    return v


# Large turnstile table: one row per line item.
_register(View("turnstiles", "lineitem", {
    "fecha": E("l_shipdate"),
    "linea": LINE_FROM_FLAGS,
    "estacion": E("l_suppkey"),
    "pax_pagos": E("CAST(l_linenumber AS DOUBLE)"),
    "pax_total": E("l_quantity"),
}))

# Timed turnstile table: one row per event, with a clock-time column.
_register(View("turnstiles_timed", "events", {
    "fecha": E("ts"),
    "hora": E("date_format(ts, 'HH:mm:ss')", "strftime(ts, '%H:%M:%S')"),
    "linea": LINE_FROM_EVENT,
    "estacion": E("concat('Estacion ', CAST(user_id AS STRING))"),
    "pax_total": E("CAST(value AS DECIMAL(18,2))"),
}))

# Raw turnstile export: untidy headers, text values, padded labels, copies.
_register(View("turnstiles_raw", "events", {
    " Fecha": E("date_format(ts, 'd/M/yyyy')", "strftime(ts, '%-d/%-m/%Y')"),
    "Hora": E("date_format(ts, 'HH')", "strftime(ts, '%H')"),
    "LINEA": E(
        "CASE event_type WHEN 'click' THEN ' Linea A' WHEN 'view' THEN 'LíneaB ' "
        "WHEN 'purchase' THEN 'C' WHEN 'signup' THEN concat(chr(9), 'D') ELSE 'Premetro' END"
    ),
    "Estacion ": E(
        "CASE WHEN value >= 250 THEN concat('Estacion ', CAST(user_id AS STRING), ' ') "
        "ELSE concat('Estacion ', CAST(user_id AS STRING)) END"
    ),
    "Pax-Total": E("CAST(CAST(floor(value / 100) AS BIGINT) AS STRING)"),
}))

# Text dates in mixed formats, for the day-first parser.
_register(View("dated_text", "events", {
    "event_id": E("event_id"),
    "raw_date": E(
        "CASE event_type WHEN 'click' THEN date_format(ts, 'd/M/yyyy') "
        "WHEN 'view' THEN date_format(ts, 'dd/MM/yyyy') "
        "WHEN 'error' THEN CASE WHEN value < 50 THEN date_format(ts, 'd/M/yy') WHEN value < 100 THEN date_format(ts, 'd-M-yyyy h:mm a') "
        "WHEN value < 150 THEN concat(date_format(ts, 'd/M/yyyy HH:mm:ss'), '.250') ELSE date_format(ts, 'yyyy-MM-dd') END "
        "WHEN 'purchase' THEN date_format(ts, 'M/d/yyyy') "
        "WHEN 'signup' THEN CASE WHEN value < 200 THEN date_format(ts, 'd/M/yyyy H:mm:ss') ELSE 'xx' END "
        "ELSE 'xx' END",
        "CASE event_type WHEN 'click' THEN strftime(ts, '%-d/%-m/%Y') "
        "WHEN 'view' THEN strftime(ts, '%d/%m/%Y') "
        "WHEN 'error' THEN CASE WHEN value < 50 THEN strftime(ts, '%-d/%-m/%y') WHEN value < 100 THEN strftime(ts, '%-d-%-m-%Y %-I:%M %p') "
        "WHEN value < 150 THEN concat(strftime(ts, '%-d/%-m/%Y %H:%M:%S'), '.250') ELSE strftime(ts, '%Y-%m-%d') END "
        "WHEN 'purchase' THEN strftime(ts, '%-m/%-d/%Y') "
        "WHEN 'signup' THEN CASE WHEN value < 200 THEN strftime(ts, '%-d/%-m/%Y %-H:%M:%S') ELSE 'xx' END "
        "ELSE 'xx' END",
    ),
}))

# A double column with NaN in place of every tenth value or so.
_register(View("turnstiles_nan", "events", {
    "fecha": E("ts"),
    "linea": LINE_FROM_EVENT,
    "pax_total": E("CASE WHEN event_id % 10 = 3 THEN CAST('NaN' AS DOUBLE) ELSE CAST(value AS DOUBLE) END"),
}))

# Daily ridership by line.
_register(View("ridership", "orders", {
    "date": E("CAST(o_orderdate AS DATE)"),
    "line": LINE_FROM_PRIORITY,
    "passengers": E("CAST(o_totalprice AS DECIMAL(18,2))"),
}))

# A short (one-month) ridership series.
_register(View("ridership_recent", "events", {
    "date": E("CAST(ts AS DATE)"),
    "line": LINE_FROM_EVENT,
    "passengers": E("CAST(value AS DECIMAL(18,2))"),
}))

# Monthly dispatched trains by raw line label.
_register(View("dispatch_monthly", "orders", {
    "year_month": YEAR_MONTH_ORDER,
    "line": LINE_FROM_PRIORITY,
    "dispatched_trains": E("count(*)"),
}, group_by=("year_month", "line")))

# Daily dispatched trains by raw line label.
_register(View("dispatch_daily", "orders", {
    "date": E("CAST(o_orderdate AS DATE)"),
    "line": LINE_FROM_PRIORITY,
    "trains": E("count(*)"),
}, group_by=("date", "line")))

# Stored model outputs for incident texts: JSON with prose around it, explicit
# nulls, absent keys, two objects, single quotes and no JSON at all.
_SEVERITY = "CASE WHEN value < 20 THEN 'high' WHEN value < 100 THEN 'medium' ELSE 'low' END"
_CATEGORY = "CASE WHEN value < 50 THEN 'infrastructure' WHEN value < 150 THEN 'overcrowding' ELSE 'delay' END"
_register(View("model_outputs", "events", {
    "incident_id": E("concat('INC-', CAST(event_id AS STRING))"),
    "reported_at": E("ts"),
    "incident_text": E("concat('Event ', event_type, ' reported by user ', CAST(user_id AS STRING))"),
    "raw_output": E(
        "CASE event_type "
        "WHEN 'click' THEN concat('Here is the JSON: {\"category\": \"', " + _CATEGORY + ", "
        "'\", \"severity\": \"', " + _SEVERITY + ", '\", \"line\": \"B\", \"station\": \"Station ', "
        "CAST(user_id AS STRING), '\", \"target_team\": \"customer_support\", \"confidence\": 0.87}"
        " Hope this helps.') "
        "WHEN 'view' THEN concat('{\"category\": \"Mechanical\", \"severity\": \"', "
        "CASE WHEN value < 50 THEN 'HIGH' ELSE 'low' END, '\", \"line\": null, \"target_team\": \"\"}') "
        "WHEN 'error' THEN concat('Model failed; context was ', props) "
        "WHEN 'purchase' THEN '{\"category\": \"safety\", \"severity\": \"low\"}{\"category\": \"delay\"}' "
        "ELSE CASE WHEN value < 100 THEN '{''category'': ''ticketing'', ''severity'': ''low''}' "
        "ELSE '  no structured answer  ' END END"
    ),
}))

# Turns of conversations as incident descriptions.
_register(View("incident_texts", "conversations", {
    "conv_id": E("conv_id"),
    "turn": E("turn"),
    "description": E("text"),
}))

# One ingestion run per day of events: rows loaded that day and the time of
# the last row as the run time.
_register(View("ingestion_runs", "events", {
    "run_date": E("CAST(ts AS DATE)"),
    "run_id": E(
        "concat('run_', CAST(CAST(ts AS DATE) AS STRING), '_', "
        "date_format(max(ts), 'yyyyMMdd''T''HHmmss''Z'''))",
        "concat('run_', CAST(CAST(ts AS DATE) AS STRING), '_', strftime(max(ts), '%Y%m%dT%H%M%SZ'))",
    ),
    "source_file": E("'events.parquet'"),
    "rows_loaded": E("count(*)"),
    "created_at": E("max(ts)"),
    "model_tag": E("'phase3-week9'"),  # fixed value
}, group_by=("run_date",)))


_READERS: dict[tuple[int, str, str], DataFrame] = {}


def _app_id(spark: SparkSession) -> str:
    """The application id (a restarted session gets a new one)."""
    return spark.conf.get("spark.app.id", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver test table. The reader is kept per session, so the file
    listing and footers are read once, not once per query (the test tables
    are read-only)."""
    path = f"{sf_dir}/{name}.parquet"
    key = (id(spark), _app_id(spark), path)
    df = _READERS.get(key)
    if df is None:
        df = _READERS[key] = spark.read.parquet(path)
    return df


_BUILT: dict[tuple[int, str, str, str], DataFrame] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table from the driver test tables (built once per session:
    DataFrames are immutable plans, so reuse is safe)."""
    key = (id(spark), _app_id(spark), sf_dir, name)
    df = _BUILT.get(key)
    if df is None:
        df = _BUILT[key] = _build_view(spark, sf_dir, name)
    return df


def _build_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    v = VIEWS[name]
    df = table(spark, sf_dir, v.source)
    if v.where:
        df = df.where(F.expr(v.where))
    cols = [F.expr(e.for_engine("spark")).alias(n) for n, e in v.columns.items()]
    if not v.group_by:
        return df.select(*cols)
    keys = [F.expr(v.columns[k].for_engine("spark")).alias(k) for k in v.group_by]
    aggs = [c for n, c in zip(v.columns, cols) if n not in v.group_by]
    out = df.groupBy(*keys).agg(*aggs)
    return out.select(*[f"`{n}`" for n in v.columns])


def duck_cte(name: str) -> str:
    """The same logical table as a DuckDB CTE body."""
    v = VIEWS[name]
    cols = ", ".join(f'{e.for_engine("duck")} AS "{n}"' for n, e in v.columns.items())
    sql = f"SELECT {cols} FROM {v.source}"
    if v.where:
        sql += f" WHERE {v.where}"
    if v.group_by:
        sql += " GROUP BY " + ", ".join(f'"{k}"' for k in v.group_by)
    return f'"{name}" AS ({sql})'
