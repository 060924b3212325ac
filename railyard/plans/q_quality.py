"""Data-quality queries (cleaning, checks, anomalies, result record)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as q
from ..sources.testviews import view
from . import duck
from .registry import query, rounded, sql

# Rules for the large turnstile table (own fixture rules).
TURNSTILE_RULES = q.DataQualityConfig(
    name="turnstiles",
    expected_columns=["fecha", "linea", "estacion", "pax_total", "pax_franq"],
    non_null_columns=["fecha", "linea", "estacion", "pax_franq"],
    numeric_columns=["pax_total", "pax_pagos"],
    allowed_values={"linea": ["A", "B", "C", "D", "E", "H"], "sentido": ["N", "S"]},
    value_ranges={"pax_total": (1, 49), "pax_pagos": (2, None), "pax_franq": (0, 1)},
    unique_keys=[["estacion", "fecha"], ["linea", "estacion", "fecha"], ["sentido"]],
    min_rows=1000,
)

_SCAN_SQL = " UNION ALL ".join([
    "SELECT 'rows' AS \"check\", CAST(NULL AS VARCHAR) AS column_name, count(*) AS n FROM turnstiles",
    "SELECT 'nulls', 'fecha', count(*) FILTER (WHERE fecha IS NULL) FROM turnstiles",
    "SELECT 'nulls', 'linea', count(*) FILTER (WHERE linea IS NULL) FROM turnstiles",
    "SELECT 'nulls', 'estacion', count(*) FILTER (WHERE estacion IS NULL) FROM turnstiles",
    "SELECT 'missing', 'pax_franq', CAST(NULL AS BIGINT)",
    "SELECT 'below_min', 'pax_total', count(*) FILTER (WHERE pax_total < 1) FROM turnstiles",
    "SELECT 'above_max', 'pax_total', count(*) FILTER (WHERE pax_total > 49) FROM turnstiles",
    "SELECT 'below_min', 'pax_pagos', count(*) FILTER (WHERE pax_pagos < 2) FROM turnstiles",
])


@query("dq_nulls_ranges", sql(["turnstiles"], [], _SCAN_SQL))
def dq_nulls_ranges(spark, sf_dir):
    return q.scan_counts(view(spark, sf_dir, "turnstiles"), TURNSTILE_RULES)


@query("dq_allowed", sql(["turnstiles"], [],
       "SELECT DISTINCT 'linea' AS column_name, linea AS bad_value FROM turnstiles "
       "WHERE NOT coalesce(linea IN ('A','B','C','D','E','H'), false)"))
def dq_allowed(spark, sf_dir):
    return q.allowed_violations(view(spark, sf_dir, "turnstiles"), TURNSTILE_RULES)


def _dup_sql(cols: list[str]) -> str:
    keys = ", ".join(cols)
    return (f"SELECT '{','.join(cols)}' AS key_columns, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicated "
            f"FROM (SELECT count(*) AS n FROM turnstiles GROUP BY {keys})")


@query("dq_duplicate_keys", sql(["turnstiles"], [], " UNION ALL ".join(
    [_dup_sql(["estacion", "fecha"]), _dup_sql(["linea", "estacion", "fecha"])])))
def dq_duplicate_keys(spark, sf_dir):
    return q.duplicate_keys(view(spark, sf_dir, "turnstiles"), TURNSTILE_RULES)


@query("dq_zscore", sql(["turnstiles_timed"], [
    ("st", "SELECT avg(CAST(pax_total AS DOUBLE)) AS m, stddev_samp(CAST(pax_total AS DOUBLE)) AS s "
           "FROM turnstiles_timed"),
], """SELECT 'pax_total' AS column_name, round((CAST(pax_total AS DOUBLE) - m) / s, 4) AS z_score,
             fecha, hora, linea, estacion, CAST(pax_total AS DOUBLE) AS pax_total
      FROM turnstiles_timed, st
      WHERE s IS NOT NULL AND s <> 0 AND abs((CAST(pax_total AS DOUBLE) - m) / s) >= 4"""))
def dq_zscore(spark, sf_dir):
    out = q.numeric_anomalies(view(spark, sf_dir, "turnstiles_timed"), ["pax_total"], 4.0)
    return rounded(out.withColumn("pax_total", F.col("pax_total").cast("double")))


_RAW_COLS = {"fecha": '" Fecha"', "hora": '"Hora"', "linea": '"LINEA"', "estacion": '"Estacion "',
             "pax_total": '"Pax-Total"'}


@query("dedup_trim", sql(["turnstiles_raw"], [], "SELECT " + ", ".join(
    f"{duck.strip(src)} AS {dst}" for dst, src in _RAW_COLS.items()) + " FROM (SELECT DISTINCT * FROM turnstiles_raw)"))
def dedup_trim(spark, sf_dir):
    return q.basic_cleaning(view(spark, sf_dir, "turnstiles_raw"), by_digest=True)


_ISSUES_SQL = """
SELECT 0 AS seq, 'Missing columns: [''pax_franq'']' AS issue
UNION ALL SELECT 1, 'Unexpected columns: [''pax_pagos'']'
UNION ALL SELECT 103, 'Non-null column ''pax_franq'' is missing from dataframe'
UNION ALL SELECT 100 + i, printf('Column ''%s'' has %d null values', c, n) FROM (
  SELECT 0 AS i, 'fecha' AS c, count(*) FILTER (WHERE fecha IS NULL) AS n FROM turnstiles
  UNION ALL SELECT 1, 'linea', count(*) FILTER (WHERE linea IS NULL) FROM turnstiles
  UNION ALL SELECT 2, 'estacion', count(*) FILTER (WHERE estacion IS NULL) FROM turnstiles) WHERE n > 0
UNION ALL SELECT 200, printf('Dataset has %d rows, less than required minimum 1000', n)
  FROM (SELECT count(*) AS n FROM turnstiles) WHERE n < 1000
UNION ALL SELECT 300, printf('Column ''linea'' contains %d values outside allowed set', count(*))
  FROM (SELECT DISTINCT linea FROM turnstiles WHERE NOT coalesce(linea IN ('A','B','C','D','E','H'), false))
  HAVING count(*) > 0
UNION ALL SELECT 400, 'Column ''pax_total'' has values below minimum 1' FROM turnstiles
  HAVING count(*) FILTER (WHERE pax_total < 1) > 0
UNION ALL SELECT 401, 'Column ''pax_total'' has values above maximum 49' FROM turnstiles
  HAVING count(*) FILTER (WHERE pax_total > 49) > 0
UNION ALL SELECT 402, 'Column ''pax_pagos'' has values below minimum 2' FROM turnstiles
  HAVING count(*) FILTER (WHERE pax_pagos < 2) > 0
UNION ALL SELECT 500 + i, printf('Composite key %s has %d duplicated rows', k, d) FROM (
  SELECT 0 AS i, '[''estacion'', ''fecha'']' AS k, sum(n - 1) AS d
    FROM (SELECT count(*) AS n FROM turnstiles GROUP BY estacion, fecha)
  UNION ALL SELECT 1, '[''linea'', ''estacion'', ''fecha'']', sum(n - 1)
    FROM (SELECT count(*) AS n FROM turnstiles GROUP BY linea, estacion, fecha)) WHERE d > 0
"""


@query("dq_issues", sql(["turnstiles"], [], _ISSUES_SQL))
def dq_issues(spark, sf_dir):
    return q.issues(view(spark, sf_dir, "turnstiles"), TURNSTILE_RULES)


_CLEAN = "SELECT " + ", ".join(f"{duck.strip(src)} AS {dst}" for dst, src in _RAW_COLS.items()) + " FROM (SELECT DISTINCT * FROM turnstiles_raw)"


def _result_sql(name: str, numeric: list[str], issues: list[str]) -> str:
    """The result record; ``issues`` are SQL texts (null: no issue) in order."""
    st = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_samp(CAST({c} AS DOUBLE)) AS s_{c}" for c in numeric)
    hit = ", ".join(f"CASE WHEN count(*) FILTER (WHERE s_{c} > 0 AND abs((CAST({c} AS DOUBLE) - m_{c}) / s_{c}) >= 4) > 0 "
                    f"THEN '\"{c}\"' END" for c in sorted(numeric))
    found = ", ".join(f"'\"' || {i} || '\"'" for i in issues)
    return sql(["turnstiles_raw"], [
        ("c", _CLEAN), ("n", "SELECT count(*) AS n FROM c"), ("st", f"SELECT {st} FROM c"),
        ("an", f"SELECT '[' || concat_ws(',', {hit}) || ']' AS a FROM c, st"),
        ("iss", f"SELECT '[' || concat_ws(',', {found}) || ']' AS i FROM n"),
    ], f"""SELECT '{name}' AS dataset_name, (SELECT count(*) FROM turnstiles_raw) AS n_rows_before, n.n AS n_rows_after,
           5 AS n_columns, i AS issues, a AS anomaly_columns, i = '[]' AS is_acceptable FROM n, an, iss""")


def _record(result):
    """The two arrays as JSON texts, which both engines can compare."""
    return result.withColumns({"issues": F.to_json("issues"), "anomaly_columns": F.to_json("anomaly_columns")})


@query("dq_result", _result_sql("turnstiles_raw", ["hora", "pax_total"], [
    "CASE WHEN n < 1000 THEN printf('Dataset has %d rows, less than required minimum 1000', n) END"]))
def dq_result(spark, sf_dir):
    from ..sources.files import counted_types
    raw, n = counted_types(view(spark, sf_dir, "turnstiles_raw"))
    clean = q.basic_cleaning(raw)
    return _record(q.quality_result(n, clean, q.guess_rules(clean, "turnstiles_raw")))


@query("dq_many_values", sql(["turnstiles"], [], """
    SELECT 300 AS seq, printf('Column ''estacion'' contains %d values outside allowed set', count(DISTINCT estacion)) AS issue
    FROM turnstiles WHERE estacion NOT IN (1, 2) HAVING count(*) > 0"""))
def dq_many_values(spark, sf_dir):
    """An allowed set that many values are outside of: the text has their exact number."""
    cfg = q.DataQualityConfig(name="t", expected_columns=["fecha", "linea", "estacion", "pax_pagos", "pax_total"], allowed_values={"estacion": [1, 2]})
    return q.issues(view(spark, sf_dir, "turnstiles"), cfg)


@query("dq_nan", sql(["turnstiles_nan"], [], " UNION ALL ".join([
    "SELECT 'rows' AS \"check\", CAST(NULL AS VARCHAR) AS column_name, count(*) AS n FROM turnstiles_nan",
    "SELECT 'nulls', 'pax_total', count(*) FILTER (WHERE isnan(pax_total)) FROM turnstiles_nan",
    "SELECT 'below_min', 'pax_total', count(*) FILTER (WHERE pax_total < 10) FROM turnstiles_nan",
    "SELECT 'above_max', 'pax_total', count(*) FILTER (WHERE pax_total > 100 AND NOT isnan(pax_total)) FROM turnstiles_nan"])))
def dq_nan(spark, sf_dir):
    cfg = q.DataQualityConfig(name="t", expected_columns=[], non_null_columns=["pax_total"], value_ranges={"pax_total": (10, 100)})
    return q.scan_counts(view(spark, sf_dir, "turnstiles_nan"), cfg)


@query("sum_nan", sql(["turnstiles_nan"], [], "SELECT linea AS line, round(sum(CASE WHEN isnan(pax_total) THEN 0 ELSE pax_total END), 4) AS passengers "
                                              "FROM turnstiles_nan GROUP BY linea"))
def sum_nan(spark, sf_dir):
    from ..operators import ridership as r
    rows = view(spark, sf_dir, "turnstiles_nan").withColumnsRenamed({"linea": "line", "pax_total": "passengers"})
    return rounded(r.sum_by_line(rows))
