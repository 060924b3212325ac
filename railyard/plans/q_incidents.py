"""Incident parsing, routing, ticket and count queries."""

from __future__ import annotations

from ..operators import incidents as inc
from ..sources.testviews import view
from . import duck
from .registry import query, sql

RUN_TS = "2024-02-01 00:00:00"

_B = "nullif(regexp_extract(raw_output, '(?s)(\\{.*\\})', 1), '')"
_PARSE = [
    ("b", f"SELECT *, {_B} AS b FROM model_outputs"),
    ("v", "SELECT *, coalesce(json_valid(b), false) AS ok FROM b"),
    ("c", """SELECT incident_id, reported_at, incident_text, raw_output, ok AS parsed_ok,
        CASE WHEN NOT ok THEN 'unknown' WHEN json_exists(b, '$.category') THEN json_extract_string(b, '$.category')
             ELSE 'unknown' END AS category,
        CASE WHEN NOT ok THEN 'unknown' WHEN json_exists(b, '$.severity') THEN json_extract_string(b, '$.severity')
             ELSE 'unknown' END AS severity,
        CASE WHEN ok THEN json_extract_string(b, '$.line') END AS line,
        CASE WHEN ok THEN json_extract_string(b, '$.station') END AS station,
        CASE WHEN NOT ok THEN 'manual_review' WHEN json_exists(b, '$.target_team')
             THEN json_extract_string(b, '$.target_team') ELSE 'manual_review' END AS target_team,
        CASE WHEN ok THEN try_cast(json_extract_string(b, '$.confidence') AS DOUBLE) END AS confidence,
        CASE WHEN NOT ok THEN """ + duck.strip("raw_output") + """ END AS fallback_output
      FROM v"""),
]
_ROUTE = [("r", """SELECT * REPLACE (CASE
        WHEN lower(coalesce(severity, '')) = 'high' THEN 'operations_control'
        WHEN lower(coalesce(category, '')) IN ('overcrowding', 'capacity') THEN 'operations_control'
        WHEN lower(coalesce(category, '')) IN ('infrastructure', 'mechanical') THEN 'infrastructure_maintenance'
        ELSE coalesce(nullif(target_team, ''), 'manual_review') END AS target_team) FROM c""")]


def _classified(spark, sf_dir):
    return inc.classify(view(spark, sf_dir, "model_outputs"))


@query("parse_incidents", sql(["model_outputs"], _PARSE, "SELECT * FROM c"))
def parse_incidents(spark, sf_dir):
    return _classified(spark, sf_dir)


@query("route_incidents", sql(["model_outputs"], _PARSE + _ROUTE,
       "SELECT incident_id, category, severity, target_team FROM r"))
def route_incidents(spark, sf_dir):
    return inc.route(_classified(spark, sf_dir)).select("incident_id", "category", "severity", "target_team")


@query("tickets", sql(["model_outputs"], _PARSE + _ROUTE, f"""
    SELECT 'TCK-' || strftime(TIMESTAMP '{RUN_TS}', '%Y%m%d%H%M%S') || '-' || incident_id AS ticket_id,
           TIMESTAMP '{RUN_TS}' AS created_at, 'llm_router' AS source, incident_text AS description,
           category, severity, line, station, target_team, confidence, raw_output AS raw_llm_output
    FROM r"""))
def tickets(spark, sf_dir):
    return inc.tickets(_classified(spark, sf_dir), RUN_TS)


@query("team_counts", sql(["model_outputs"], _PARSE + _ROUTE,
       "SELECT target_team, count(*) AS n FROM r GROUP BY target_team"))
def team_counts(spark, sf_dir):
    return inc.team_counts(inc.route(_classified(spark, sf_dir)))


_PROMPT_SQL = inc.INCIDENT_PROMPT.replace("'", "''")


@query("incident_prompts", sql(["incident_texts"], [],
       f"SELECT conv_id, turn, replace('{_PROMPT_SQL}', '{inc.INCIDENT_MARKER}', {duck.strip('description')}) "
       "AS prompt FROM incident_texts"))
def incident_prompts(spark, sf_dir):
    from pyspark.sql import functions as F
    df = view(spark, sf_dir, "incident_texts")
    return df.select("conv_id", "turn", inc.fill_template(F.col("description")).alias("prompt"))
