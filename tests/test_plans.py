"""Plan guards for every registered query: no cartesian or nested-loop joins,
no Python evaluation, and column pruning at the Parquet scans."""

import re

import pyarrow.parquet as pq
import pytest

from railyard.plans import QUERIES
from conftest import SF_SMOKE

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def _plan(df) -> str:
    jvm = df.sparkSession._jvm
    return jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(
        df._jdf.queryExecution(), "formatted")


def _table_widths():
    out = {}
    for t in ("lineitem", "orders", "events", "conversations"):
        out[t] = len(pq.read_schema(f"{SF_SMOKE}/{t}.parquet").names)
    return out


WIDTHS = _table_widths()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_shape(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMOKE))
    for bad in FORBIDDEN:
        assert bad not in plan, (name, bad)
    for block in plan.split("\n\n"):
        if "Scan parquet" not in block:
            continue
        loc = re.search(r"Location: .*?/(\w+)\.parquet\]", block)
        schema = re.search(r"ReadSchema: struct<(.*)>", block)
        if not loc or not schema:
            continue
        n_cols = len([c for c in schema.group(1).split(",") if c])
        if loc.group(1) in ("lineitem", "orders"):
            assert n_cols < WIDTHS[loc.group(1)], (name, loc.group(1), schema.group(1))


STOPS = ("HashAggregate", "ObjectHashAggregate", "SortAggregate", "TakeOrderedAndProject")


def _tree(plan: str):
    """Parse the tree part of a formatted plan into (name, children) nodes."""
    lines = plan.split("== Physical Plan ==")[1].strip("\n").split("\n\n")[0].split("\n")
    nodes, stack = [], []
    for line in lines:
        m = re.search(r"[A-Za-z]", line)
        if not m:
            continue
        depth = m.start()
        name = line[m.start():].split(" (")[0].strip()
        node = (name, [])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        if stack:
            stack[-1][1][1].append(node)
        nodes.append(node)
        stack.append((depth, node))
    return nodes


# what these store and shuffle again is aggregated: one row per bucket of a series
STORED_SERIES = {"anomaly_global", "anomaly_1s_global"}


def _reaches_scan_unaggregated(node, stored=False) -> bool:
    name, children = node
    if name.startswith("Scan"):
        return not (stored and name.startswith("Scan ExistingRDD"))
    if any(name.startswith(s) for s in STOPS) or name.startswith("BroadcastExchange"):
        return False
    return any(_reaches_scan_unaggregated(c, stored) for c in children)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_raw_row_shuffle(spark, name):
    """Every shuffle carries (partial) aggregates: no Exchange reaches a scan
    without an aggregate in between."""
    plan = _plan(QUERIES[name](spark, SF_SMOKE))
    for node in _tree(plan):
        if node[0] == "Exchange":
            assert not any(_reaches_scan_unaggregated(c, name in STORED_SERIES) for c in node[1]), (name, plan.split("\n\n")[0])


@pytest.mark.parametrize("name", ["kpis", "report_text", "weekly_payload", "lines_union", "page_filtered", "forecast_fit", "forecast_pivot"])
def test_ridership_is_scanned_once(spark, name):
    """The daily sums are written once; what is returned reads them, not the fact table."""
    plan = _plan(QUERIES[name](spark, SF_SMOKE))
    assert sum("o_totalprice" in block for block in plan.split("\n\n") if "Scan parquet" in block) <= 1, name


def test_trailing_window_is_pruned(spark, tmp_path):
    """The bounds of the window reach the scan of a DATE column, down to its row groups."""
    import datetime as dt

    from pyspark.sql import functions as F

    from railyard.operators.ridership import trailing_days
    first = dt.date(2024, 1, 1)
    rows = [(first + dt.timedelta(days=i), line, i) for i in range(120) for line in "AB"]
    df = spark.createDataFrame(rows, "date date, line string, passengers long")
    path = str(tmp_path / "r.parquet")
    df.withColumn("month", F.date_trunc("month", "date").cast("date")).write.partitionBy("month").parquet(path)
    out = trailing_days(spark.read.parquet(path), 7)
    got = {r.line: (r.passengers, r.period_start, r.period_end) for r in out.collect()}
    last = first + dt.timedelta(days=119)
    assert got == {x: (sum(range(113, 120)), last - dt.timedelta(days=6), last) for x in "AB"}
    text = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    scan = next(line for line in text.split("\n") if "FileScan parquet" in line and "passengers" in line)
    first_day, last_day = last - dt.timedelta(days=6), last
    formatted = _plan(out)
    assert f"GreaterThanOrEqual(date,{first_day})" in formatted and f"LessThanOrEqual(date,{last_day})" in formatted, scan


def test_top_stations_scan_once(spark):
    """The choice of the measure reads the shuffle of the sums, not the table."""
    out = QUERIES["top_stations"](spark, SF_SMOKE)
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final
