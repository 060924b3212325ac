import datetime as dt

import pytest
from pyspark.sql import functions as F

from railyard.operators import ingest as ing


def test_sample_exact_and_repeatable(spark):
    df = spark.range(0, 20000).selectExpr("id", "id % 7 AS g")
    a = ing.sample_rows(df, 1234, "id")
    b = ing.sample_rows(df.repartition(13), 1234, "id")
    ra, rb = sorted(r.id for r in a.collect()), sorted(r.id for r in b.collect())
    assert len(ra) == 1234 and ra == rb
    assert ing.sample_rows(df, 50000, "id").count() == 20000


def test_sample_draws_copies_independently(spark):
    df = spark.range(0, 10000).selectExpr("id", "id % 100 AS value")
    got = ing.sample_rows(df, 50, "id").collect()
    assert len(got) == 50 and len({r.value for r in got}) > 25


def test_sample_needs_a_key(spark):
    with pytest.raises(ValueError):
        ing.sample_rows(spark.range(10), 3, "none")
    with pytest.raises(ValueError):
        ing.ingest_daily_batch(spark.range(10), ing.PipelineConfig("2025-11-22", limit_rows=3), "/nowhere", "s", dt.datetime(2025, 11, 22))


def test_large_batch_is_logged_whole(spark, tmpdir_path):
    rec = ing.ingest_daily_batch(spark.range(250_000), ing.PipelineConfig("2025-11-22"), tmpdir_path, "s", dt.datetime(2025, 11, 22)).first()
    assert rec.rows_loaded == 250_000


def test_ingest_log_is_idempotent(spark, tmpdir_path):
    src = spark.range(0, 500).selectExpr("id AS ID", "id * 2 AS Value ")
    cfg = ing.PipelineConfig(run_date="2025-11-22", limit_rows=100, key="id")
    ts = dt.datetime(2025, 11, 22, 6, 0, 0)
    rec = ing.ingest_daily_batch(src, cfg, tmpdir_path, "src.csv", ts).first()
    assert rec.rows_loaded == 100 and rec.run_id == "run_2025-11-22_20251122T060000Z"
    ing.ingest_daily_batch(src, cfg, tmpdir_path, "src.csv", ts)  # retried run
    runs = ing.read_log(spark, tmpdir_path, "ingestion_runs")
    assert runs.count() == 1
    ing.ingest_daily_batch(src, cfg, tmpdir_path, "src.csv", ts + dt.timedelta(hours=1))
    assert ing.read_log(spark, tmpdir_path, "ingestion_runs").count() == 2
    assert ing.latest_runs(ing.read_log(spark, tmpdir_path, "ingestion_runs"), 1).first().created_at == \
        ts + dt.timedelta(hours=1)


def test_incident_log_append(spark, tmpdir_path):
    ing.init_log_tables(spark, tmpdir_path)
    assert ing.read_log(spark, tmpdir_path, "incidents").count() == 0
    rows = spark.createDataFrame(
        [("INC-1", dt.datetime(2025, 1, 1), "demo", "d", "infrastructure", "medium", "B", "S", "t", None)],
        ing.INCIDENT_SCHEMA)
    ing.append_log(rows, tmpdir_path, "incidents", "b1")
    ing.append_log(rows, tmpdir_path, "incidents", "b1")
    assert ing.read_log(spark, tmpdir_path, "incidents").count() == 1


def test_example_incidents_append_and_count(spark, tmpdir_path):
    from railyard.operators.incidents import team_counts
    rows = ing.example_incidents(spark, "2025-11-22", dt.datetime(2025, 11, 22, 8, 0))
    ing.append_log(rows, tmpdir_path, "incidents", "b1")
    ing.append_log(rows, tmpdir_path, "incidents", "b1")  # retried
    log = ing.read_log(spark, tmpdir_path, "incidents")
    assert log.count() == 2
    assert [(r.target_team, r.n) for r in team_counts(log).collect()] == [
        ("infrastructure_maintenance", 1), ("operations_control", 1)]


def test_incident_log_keeps_earlier_rows_of_the_day(spark, tmpdir_path):
    t = dt.datetime(2025, 11, 22, 8, 0)
    first = ing.example_incidents(spark, "2025-11-22", t)
    ing.append_log(first, tmpdir_path, "incidents", "b1")
    later = spark.createDataFrame(
        [("INC-2025-11-22-0003", t + dt.timedelta(hours=2), "example", "d", "safety", "high", "C", "S",
          "operations_control", None),
         ("INC-2025-11-22-0001", t, "example", "updated", "infrastructure", "medium", "B", "S",
          "infrastructure_maintenance", None)],
        ing.INCIDENT_SCHEMA)
    ing.append_log(later, tmpdir_path, "incidents", "b2")
    ing.append_log(later, tmpdir_path, "incidents", "b2")  # retried
    log = {r.incident_id: r for r in ing.read_log(spark, tmpdir_path, "incidents").collect()}
    assert sorted(log) == ["INC-2025-11-22-0001", "INC-2025-11-22-0002", "INC-2025-11-22-0003"]
    assert log["INC-2025-11-22-0001"].description == "updated"


def test_incident_log_loses_nothing(spark, tmpdir_path):
    def rows(*r):
        return spark.createDataFrame([(i, t, "s", d, None, None, None, None, None, None) for i, t, d in r], ing.INCIDENT_SCHEMA)

    day = dt.datetime(2025, 1, 1)
    ing.append_log(rows(("a", None, "no time"), (None, day, "no id"), (None, day, "no id too"), ("m", day, "first day")), tmpdir_path, "incidents", "one")
    ing.append_log(rows(("b", None, "no time either"), ("m", day + dt.timedelta(days=1), "moved")), tmpdir_path, "incidents", "two")
    got = sorted(r.description for r in ing.read_log(spark, tmpdir_path, "incidents").collect())
    assert got == ["moved", "no id", "no id too", "no time", "no time either"]


def test_sampling_and_summary_scan_their_input_once_more(spark):
    """The plans of what is returned: one scan each (sampling has counted its buckets in another)."""
    from railyard.plans import QUERIES
    for name in ("sample_n", "dataset_summary"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1, name


def test_newest_rows_of_large_logs_in_tasks_of_bounded_size(spark, tmpdir_path, monkeypatch):
    """However few files and whichever keys the rows have: many small tasks, the same rows."""
    monkeypatch.setattr(ing, "TASK_BYTES", 40_000, raising=False)
    monkeypatch.setattr(ing, "KEY_GROUPS", 64, raising=False)
    day = dt.datetime(2025, 1, 1)
    key = F.when(F.col("id") % 3 == 0, "INC-hot").when(F.col("id") % 100 == 1, None).otherwise(F.concat(F.lit("INC-"), (F.col("id") % 1500).cast("string")))
    time = F.when(F.col("id") % 7 > 0, F.lit(day) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") * 37 % 2000).cast("decimal(18,6)")))
    rows = spark.range(4000).select(*[{"incident_id": key, "reported_at": time.cast("timestamp_ntz"), "description": F.col("id").cast("string")}.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name)
                                      for f in ing.INCIDENT_SCHEMA.fields])
    for name in ("a", "b"):
        ing.write_batch(rows.coalesce(1), f"{tmpdir_path}/incidents", ing.INCIDENT_SCHEMA, name, day)
    got = ing.read_log(spark, tmpdir_path, "incidents")
    made = [len(p) for p in got.where("incident_id IS NOT NULL").rdd.glom().collect()]
    assert len(made) > 20 and max(made) < 300
    best, without = {}, []
    for r in rows.collect():
        if r.incident_id is None:
            without += [r.description] * 2
        elif r.incident_id not in best or (r.reported_at or dt.datetime.min) > best[r.incident_id][0]:
            best[r.incident_id] = (r.reported_at or dt.datetime.min, {r.description})
        elif (r.reported_at or dt.datetime.min) == best[r.incident_id][0]:
            best[r.incident_id][1].add(r.description)
    have = [(r.incident_id, r.reported_at, r.description) for r in got.collect()]
    assert sorted(d for i, _, d in have if i is None) == sorted(without)
    keyed = {i: (t or dt.datetime.min, d) for i, t, d in have if i is not None}
    assert len([1 for i, _, _ in have if i is not None]) == len(keyed) and keyed.keys() == best.keys()
    assert all(keyed[i][0] == t and keyed[i][1] in d for i, (t, d) in best.items())
