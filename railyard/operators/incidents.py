"""Incident text operators: prompt filling, JSON extraction from stored model
outputs, defaults for absent keys, rule-based routing, tickets, counts.

Model calls are not part of the engine: the outputs are a column of text, and
every step here is a column expression (no Python UDF).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import py_strip

# The classifier prompt (the text a model receives, with the
# incident placed at the marker), the fallback record values and the routing
# vocabulary.
INCIDENT_MARKER = "{{INCIDENT_TEXT}}"
INCIDENT_PROMPT = """You are an assistant for incident management in the Buenos Aires Subte system.

Your task is to read a single incident/ticket description and classify it into a structured JSON object.

Always return ONLY valid JSON. Do NOT include explanations, Markdown, or prose outside the JSON.

Use the following schema:

- category: one of
  - "delay"
  - "overcrowding"
  - "infrastructure"
  - "safety"
  - "ticketing"
  - "other"

- severity: one of
  - "low"
  - "medium"
  - "high"

- line: the Subte line mentioned, or null
  (e.g. "A", "B", "C", "D", "E", "H", "Premetro")

- station: the station name, or null if not clear

- target_team: one of
  - "operations_control"
  - "infrastructure_maintenance"
  - "security"
  - "customer_support"
  - "other"

Here is the incident text:

---
{{INCIDENT_TEXT}}
---

Now respond ONLY with a JSON object matching this pattern:

{
  "category": "...",
  "severity": "...",
  "line": "... or null",
  "station": "... or null",
  "target_team": "..."
}
"""
UNKNOWN = "unknown"
MANUAL_REVIEW = "manual_review"
HIGH_SEVERITY = "high"
INFRA_CATEGORIES = ("infrastructure", "mechanical")
CROWD_CATEGORIES = ("overcrowding", "capacity")
INFRA_TEAM = "infrastructure_maintenance"
OPS_TEAM = "operations_control"

# Strict JSON, as Python's json.loads reads it.
_JSON_OPTIONS = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false",
                 "allowNumericLeadingZeros": "false", "allowUnquotedControlChars": "false",
                 "mode": "PERMISSIVE"}


def fill_template(text: Column, template: str = INCIDENT_PROMPT, marker: str = INCIDENT_MARKER) -> Column:
    """The template with every marker replaced by the stripped text."""
    return F.replace(F.lit(template), F.lit(marker), py_strip(text))


def extract_braced(raw: Column) -> Column:
    """Text from the first ``{`` to the last ``}``; null when there is none or
    the last ``}`` comes first. Index arithmetic (``instr`` on the text and on
    its reverse), linear in the text length."""
    start = F.instr(raw, "{")
    last = F.length(raw) - F.instr(F.reverse(raw), "}") + 1
    ok = (start > 0) & (F.instr(raw, "}") > 0) & (last > start)
    return F.when(ok, raw.substr(start, last - start + 1))


def parse_object(raw: Column) -> Column:
    """The braced part as ``map<string,string>`` when it is exactly one strict
    JSON object, else null. Wrapping in ``[...]`` makes trailing content (a
    second object) a parse error instead of being ignored."""
    braced = extract_braced(raw)
    arr = F.from_json(F.concat(F.lit("["), braced, F.lit("]")), "array<map<string,string>>", _JSON_OPTIONS)
    return F.when(F.size(arr) == 1, F.element_at(arr, 1))


def _last_value(m: Column, unique: Column, key: str) -> Column:
    """Value of the last ``key`` entry: a parsed object keeps repeated keys in
    order, and the last one wins, as in Python's JSON reader. Objects without
    repeated keys (``unique``) take the plain lookup; only the rare others
    scan their entries."""
    hits = F.filter(F.map_entries(m), lambda e: e.getField("key") == key)
    return F.when(unique, m.getItem(key)).otherwise(F.try_element_at(hits, F.lit(-1)).getField("value"))


def _key_or(m: Column, unique: Column, key: str, default: str | None) -> Column:
    """Value of ``key``; ``default`` only when the key is absent (an explicit
    JSON null stays null), or when nothing parsed."""
    d = F.lit(default).cast("string")
    return F.when(m.isNull(), d).when(F.map_contains_key(m, key), _last_value(m, unique, key)).otherwise(d)


def classify(df: DataFrame, raw_col: str = "raw_output") -> DataFrame:
    """Parsed classification fields next to the input columns.

    Unparseable output gives the fallback record (unknown / unknown / null /
    null / manual_review) and keeps the stripped text in ``fallback_output``.
    """
    m = parse_object(F.col(raw_col))
    keys = F.map_keys(F.col("_m"))
    parsed = df.withColumn("_m", m).withColumn("_u", F.size(keys) == F.size(F.array_distinct(keys)))
    mm, u = F.col("_m"), F.col("_u")
    return parsed.select(
        *[F.col(f"`{c}`") for c in df.columns],
        mm.isNotNull().alias("parsed_ok"),
        _key_or(mm, u, "category", UNKNOWN).alias("category"),
        _key_or(mm, u, "severity", UNKNOWN).alias("severity"),
        _key_or(mm, u, "line", None).alias("line"),
        _key_or(mm, u, "station", None).alias("station"),
        _key_or(mm, u, "target_team", MANUAL_REVIEW).alias("target_team"),
        _last_value(mm, u, "confidence").try_cast("double").alias("confidence"),
        F.when(mm.isNull(), py_strip(F.col(raw_col))).alias("fallback_output"),
    )


def routed_team(category: Column, severity: Column, team: Column) -> Column:
    """Routing rules, strongest first: high severity -> operations control;
    crowding categories -> operations control; infrastructure categories ->
    maintenance; else the given team, or manual review when empty."""
    cat = F.lower(F.coalesce(category, F.lit("")))
    sev = F.lower(F.coalesce(severity, F.lit("")))
    given = F.coalesce(F.nullif(team, F.lit("")), F.lit(MANUAL_REVIEW))
    return (
        F.when(sev == HIGH_SEVERITY, F.lit(OPS_TEAM))
        .when(cat.isin(*CROWD_CATEGORIES), F.lit(OPS_TEAM))
        .when(cat.isin(*INFRA_CATEGORIES), F.lit(INFRA_TEAM))
        .otherwise(given)
    )


def route(df: DataFrame) -> DataFrame:
    return df.withColumn("target_team", routed_team(F.col("category"), F.col("severity"), F.col("target_team")))


def _run_time(run_ts: str | None) -> Column:
    """The run time: the given one (reruns repeat), else the current UTC time."""
    if run_ts is None:
        return F.current_timestamp().cast("timestamp_ntz")
    return F.lit(run_ts).cast("timestamp_ntz")


def tickets(classified: DataFrame, run_ts: str | None = None, description_col: str = "incident_text",
            key_col: str = "incident_id", raw_col: str = "raw_output", source: str = "llm_router") -> DataFrame:
    """Ticket records. The id is the run time plus the row key, so ids stay
    unique within a batch; pass ``run_ts`` to make reruns repeat."""
    ts = _run_time(run_ts)
    r = route(classified)
    return r.select(
        F.concat(F.lit("TCK-"), F.date_format(ts, "yyyyMMddHHmmss"), F.lit("-"), F.col(key_col)).alias("ticket_id"),
        ts.alias("created_at"),
        F.lit(source).alias("source"),
        F.col(description_col).alias("description"),
        "category", "severity", "line", "station", "target_team", "confidence",
        F.col(raw_col).alias("raw_llm_output"),
    )


def team_counts(df: DataFrame) -> DataFrame:
    """Rows per team, largest first (models may write any team, so the result
    is sorted as a distributed table)."""
    g = df.groupBy("target_team").agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("n"), "target_team")


def incident_log(classified: DataFrame, run_ts: str | None = None, text_col: str = "incident_text") -> DataFrame:
    """Classification log rows: result fields, the incident text, the time."""
    return classified.select(
        "category", "severity", "line", "station", "target_team", "fallback_output",
        F.col(text_col).alias("incident_text"), _run_time(run_ts).alias("timestamp"),
    )
