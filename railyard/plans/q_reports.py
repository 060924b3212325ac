"""Report, payload, ingestion-log and sampling queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import headway as hw_ops
from ..operators import ingest as ing
from ..operators import reports as rep
from ..operators import ridership as r
from ..session import shared_path
from ..sources.testviews import view
from . import duck
from .common_sql import HEADWAY, HW_PAGE_RANGED, PAX
from .q_incidents import _PARSE as INCIDENT_PARSE
from .registry import query, sql

GENERATED_AT = "2024-02-01T00:00:00+00:00"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _report_sql(title_head: str, title_tail: str, pax_title: str, hw_title: str, summary: str) -> str:
    nl = "chr(10)"
    return f"""SELECT period,
  {_lit(title_head)} || period || {_lit(title_tail)} ||
  concat_ws({nl},
    CASE WHEN pt.body IS NOT NULL THEN {_lit(pax_title)} || {nl} || pt.body END,
    CASE WHEN ht.body IS NOT NULL THEN {nl} || {_lit(hw_title)} || {nl} || ht.body END)
  || {nl} || {nl} || '---' || {nl} || {nl} || {_lit(summary)} AS report
FROM pt, ht, pr"""


_PT = ("pt", "SELECT string_agg('- ' || line || ': ' || format('{:,}', CAST(trunc(passengers) AS BIGINT)), "
             "chr(10) ORDER BY CAST(passengers AS DOUBLE) DESC, line) AS body FROM pbl")
_HT = ("ht", "SELECT string_agg('- ' || line || ': ' || printf('%.2f', h) || ' min', chr(10) ORDER BY h, line) "
             "AS body FROM hbl")


@query("report_text", sql(["ridership", "dispatch_monthly"], PAX + HW_PAGE_RANGED + [
    ("pbl", "SELECT line, sum(passengers) AS passengers FROM pax GROUP BY line"),
    ("hbl", "SELECT line, avg(avg_headway_min) AS h FROM hw_r GROUP BY line"),
    _PT, _HT,
    ("pr", "SELECT CAST(min(date) AS VARCHAR) || ' to ' || CAST(max(date) AS VARCHAR) AS period FROM pax"),
], _report_sql("# AI Weekly Insights\n\n_Period:_ ", "\n\n", "**Passengers (sum by line):**",
               "**Avg. Headway (min by line):**", rep.DRAFT_SUMMARY)))
def report_text(spark, sf_dir):
    from .q_ridership import _page
    return _page(spark, sf_dir).report


_WEEKLY_SQL = sql(["ridership", "dispatch_monthly"], HEADWAY + [
    ("b", "SELECT max(date) AS e FROM ridership"),
    ("pbl", f"SELECT {duck.canonical_az('line')} AS line, sum(passengers) AS passengers FROM ridership, b "
            f"WHERE date >= e - INTERVAL 6 DAY AND date <= e AND {duck.canonical_az('line')} IN {duck.ALL_LINES_SQL} GROUP BY 1"),
    ("hbl", "SELECT line, avg(avg_headway_min) AS h FROM headway, b "
            "WHERE CAST(year_month || '-01' AS DATE) >= e - INTERVAL 6 DAY "
            "AND CAST(year_month || '-01' AS DATE) <= e AND line IS NOT NULL GROUP BY line"),
    _PT, _HT,
    ("pr", "SELECT CAST(CAST(e - INTERVAL 6 DAY AS DATE) AS VARCHAR) || ' to ' || CAST(e AS VARCHAR) AS period "
           "FROM b"),
], _report_sql("# Weekly Summary (", ")\n\n", "**Passengers (sum, last 7 days):**",
               "**Avg. Headway (min, last 7 days):**", rep.PLAIN_SUMMARY))


@query("weekly_summary_text", _WEEKLY_SQL)
def weekly_summary_text(spark, sf_dir):
    from ..functions.coerce import month_start
    hw = hw_ops.headway_etl(view(spark, sf_dir, "dispatch_monthly"), None)
    hw = hw.withColumn("date", month_start(F.col("year_month")))
    return rep.weekly_summary(view(spark, sf_dir, "ridership"), hw)


@query("weekly_summary_job", f"SELECT report FROM ({_WEEKLY_SQL})")
def weekly_summary_job(spark, sf_dir):
    """The summary written from a ridership table stored by month and a headway CSV export, read back as text."""
    from ..operators.jobs import weekly_summary_from_files
    from ..sources.months import write_by_month
    from ..sources.sinks import write_table
    run = shared_path(spark, "exports", uuid.uuid4().hex)
    write_by_month(view(spark, sf_dir, "ridership"), f"{run}/ridership.parquet")
    write_table(hw_ops.headway_etl(view(spark, sf_dir, "dispatch_monthly"), None), f"{run}/headway.csv", "csv")
    out = weekly_summary_from_files(spark, f"{run}/ridership.parquet", f"{run}/headway.csv", f"{run}/summary.md")
    return spark.read.text(out, wholetext=True).where("value <> ''").select(F.regexp_replace("value", "\\n$", "").alias("report"))


@query("weekly_payload", sql(["ridership", "dispatch_monthly"], PAX + HW_PAGE_RANGED + [
    ("pbl", "SELECT line, sum(passengers) AS passengers FROM pax GROUP BY line"),
    ("hbl", "SELECT line, avg(avg_headway_min) AS m FROM hw_r GROUP BY line"),
    ("ls", "SELECT DISTINCT line FROM pax UNION SELECT DISTINCT line FROM hw_r WHERE line IS NOT NULL"),
], f"""SELECT (SELECT CAST(min(date) AS VARCHAR) || ' to ' || CAST(max(date) AS VARCHAR) FROM pax) AS period,
          (SELECT string_agg(line, ',' ORDER BY line) FROM ls) AS lines,
          CAST(coalesce(CAST(trunc(sum(passengers)) AS BIGINT), 0) AS DOUBLE) AS total_passengers,
          (SELECT line FROM pbl ORDER BY passengers DESC, line LIMIT 1) AS top_line,
          round((SELECT avg(m) FROM hbl), 2) AS avg_headway_min,
          {_lit(rep.DRAFT_SUMMARY)} AS summary_md, '{GENERATED_AT}' AS generated_at
   FROM pbl"""))
def weekly_payload(spark, sf_dir):
    """The payload's JSON text read back into columns."""
    from ..operators.jobs import insights_page
    page = insights_page(view(spark, sf_dir, "ridership"),
                         hw_ops.headway_etl(view(spark, sf_dir, "dispatch_monthly"), None),
                         generated_at=GENERATED_AT)
    schema = ("period string, lines array<string>, kpis struct<total_passengers:double,top_line:string,avg_headway_min:double>, "
              "summary_md string, generated_at string")
    return page.payload.select(F.from_json("payload", schema).alias("p")).select(
        "p.period", F.array_join("p.lines", ",").alias("lines"), "p.kpis.total_passengers", "p.kpis.top_line", "p.kpis.avg_headway_min",
        "p.summary_md", "p.generated_at")


@query("latest_runs", sql(["ingestion_runs"], [],
       "SELECT * FROM ingestion_runs ORDER BY created_at DESC, run_id DESC LIMIT 5"))
def latest_runs(spark, sf_dir):
    return ing.latest_runs(view(spark, sf_dir, "ingestion_runs"), 5)


@query("sample_n", sql(["dated_text"], [],
       "SELECT event_id, raw_date FROM dated_text ORDER BY md5(concat(event_id, ':42')), event_id LIMIT 5000"))
def sample_n(spark, sf_dir):
    return ing.sample_rows(view(spark, sf_dir, "dated_text"), 5000, "event_id", seed=42)


_LOG_TIME = "TIMESTAMP '2024-02-01 00:00:00'"


@query("ingest_daily", sql(["turnstiles_timed"], [], f"""SELECT 'run_2024-02-01_20240201T000000Z' AS run_id, DATE '2024-02-01' AS run_date,
    'events.parquet' AS source_file, count(*) AS rows_loaded, {_LOG_TIME} AS created_at, 'phase3-week9' AS model_tag FROM turnstiles_timed"""))
def ingest_daily(spark, sf_dir):
    """One daily batch, run twice (a retry), then the run log."""
    import datetime as dt
    log = shared_path(spark, "logs", uuid.uuid4().hex)
    for _ in range(2):
        ing.ingest_daily_batch(view(spark, sf_dir, "turnstiles_timed"), ing.PipelineConfig("2024-02-01"), log, "events.parquet", dt.datetime(2024, 2, 1))
    return ing.read_log(spark, log, "ingestion_runs")


_LOG_ROWS = ("SELECT CASE WHEN length(incident_text) % 5 = 0 THEN NULL ELSE incident_id END AS incident_id, "
             "{time} AS reported_at, incident_text AS description, '{name}' AS category FROM model_outputs")
_LOG_FIRST = _LOG_ROWS.format(time="CASE WHEN length(raw_output) % 7 = 0 THEN NULL ELSE reported_at END", name="first")
_LOG_SECOND = _LOG_ROWS.format(time="reported_at + INTERVAL 1 DAY", name="second") + " WHERE length(incident_text) % 2 = 0"


@query("log_roundtrip", sql(["model_outputs"], [
    ("every", f"SELECT *, 1 AS seq FROM ({_LOG_FIRST}) UNION ALL SELECT *, 2 FROM ({_LOG_SECOND})"),
    ("ranked", "SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY reported_at DESC NULLS LAST, seq DESC) AS r FROM every"),
], "SELECT incident_id, CAST(reported_at AS TIMESTAMP) AS reported_at, description, category FROM ranked WHERE r = 1 OR incident_id IS NULL"))
def log_roundtrip(spark, sf_dir):
    """Incidents appended, retried, appended again with later days; some have
    no time, some no id."""
    log = shared_path(spark, "logs", uuid.uuid4().hex)
    ing.init_log_tables(spark, log)
    view(spark, sf_dir, "model_outputs").createOrReplaceTempView("model_outputs")
    for rows, batch in ((_LOG_FIRST, "first"), (_LOG_FIRST, "first"), (_LOG_SECOND, "second"), (_LOG_SECOND, "second")):
        df = spark.sql(rows)
        df = df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).alias(f.name) for f in ing.INCIDENT_SCHEMA.fields])
        ing.append_log(df, log, "incidents", batch)
    return ing.read_log(spark, log, "incidents").select("incident_id", "reported_at", "description", "category")


@query("log_compacted", sql(["model_outputs"], [
    ("every", f"SELECT *, 1 AS seq FROM ({_LOG_FIRST}) UNION ALL SELECT *, 2 FROM ({_LOG_SECOND})"),
    ("ranked", "SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY reported_at DESC NULLS LAST, seq DESC) AS r FROM every"),
], "SELECT incident_id, CAST(reported_at AS TIMESTAMP) AS reported_at, description, category FROM ranked WHERE r = 1 OR incident_id IS NULL"))
def log_compacted(spark, sf_dir):
    """The two appends of log_roundtrip in nine parts each, compacted three
    folders at a time; one part is retried after it was compacted."""
    from ..sources.folders import Folders
    path = shared_path(spark, "logs", uuid.uuid4().hex, "incidents")
    schema = ing.stored_schema(ing.INCIDENT_SCHEMA)
    view(spark, sf_dir, "model_outputs").createOrReplaceTempView("model_outputs")
    for seq, rows in enumerate((_LOG_FIRST, _LOG_SECOND)):
        df = spark.sql(rows)
        df = df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).alias(f.name) for f in ing.INCIDENT_SCHEMA.fields])
        for part in (*range(9), 4):
            own = df.where(F.pmod(F.xxhash64("incident_id", "description"), F.lit(9)) == part)
            ing.write_batch(own, path, ing.INCIDENT_SCHEMA, f"append-{seq}-{part}")
            Folders(spark, path, schema).compact(3)
    return ing.newest(Folders(spark, path, schema).rows(), "incidents").select("incident_id", "reported_at", "description", "category")


def _prompt_sql() -> str:
    from .q_ridership import _HOUR, _top_sql
    summary = " UNION ALL ".join([_top_sql("top_stations", "estacion", 5), _top_sql("top_lines", "linea", 5),
                                  _top_sql("hour_peaks", _HOUR, 10)])
    tmpl = rep.INSIGHTS_PROMPT.replace("'", "''")
    return sql(["turnstiles_timed"], [
        ("s", summary),
        ("sec", "SELECT section, '  ' || to_json(section) || ': {' || chr(10) || "
                "string_agg('    ' || to_json(key) || ': ' || CAST(n AS VARCHAR), ',' || chr(10) ORDER BY rank) "
                "|| chr(10) || '  }' AS b, CASE section WHEN 'top_stations' THEN 1 WHEN 'top_lines' THEN 2 "
                "ELSE 3 END AS o FROM s GROUP BY section"),
        ("js", "SELECT coalesce('{' || chr(10) || string_agg(b, ',' || chr(10) ORDER BY o) || chr(10) || '}', "
               "'{}') AS j FROM sec"),
    ], f"SELECT replace('{tmpl}', '{rep.SUMMARY_MARKER}', j) AS prompt FROM js")


@query("insights_prompt", _prompt_sql())
def insights_prompt(spark, sf_dir):
    return rep.insights_prompt(r.dataset_summary(view(spark, sf_dir, "turnstiles_timed")))


@query("incident_log", sql(["model_outputs"], INCIDENT_PARSE,
       "SELECT category, severity, line, station, target_team, fallback_output, incident_text, "
       "TIMESTAMP '2024-02-01 00:00:00' AS timestamp FROM c"))
def incident_log(spark, sf_dir):
    from ..operators import incidents as inc
    return inc.incident_log(inc.classify(view(spark, sf_dir, "model_outputs")), "2024-02-01 00:00:00")


_PROFILE = [("fecha", "timestamp_ntz", None), ("linea", "string", "line"), ("estacion", "bigint", None), ("pax_pagos", "double", None), ("pax_total", "double", None)]


@query("dataset_profile", sql(["turnstiles"], [], " UNION ALL ".join(
    f"SELECT 'turnstiles' AS dataset, '{c}' AS column_name, '{t}' AS dtype, {'NULL' if r is None else _lit(r)} AS role, "
    "(SELECT count(*) FROM turnstiles) AS n_rows" for c, t, r in _PROFILE)))
def dataset_profile(spark, sf_dir):
    from ..sources.files import profile
    return profile(view(spark, sf_dir, "turnstiles"), "turnstiles")


@query("dataset_sample", sql(["turnstiles"], [("first", "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY "
       + ", ".join(f"{c} NULLS FIRST" for c, _, _ in _PROFILE) + ") AS row FROM turnstiles) WHERE row <= 5")], " UNION ALL ".join(
    f"SELECT 'turnstiles' AS dataset, row, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM first" for c, _, _ in _PROFILE)))
def dataset_sample(spark, sf_dir):
    from ..sources.files import first_rows
    return first_rows(view(spark, sf_dir, "turnstiles"), "turnstiles")
