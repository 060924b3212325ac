import json
import os

from pyspark.sql import functions as F

from railyard.operators import jobs, quality as q, reports as rep, ridership as r
from railyard.sources.testviews import view

SF = "/root/testdata/sf0.001"


def test_prompt_json_matches_python(spark):
    summary = r.dataset_summary(view(spark, SF, "turnstiles_timed"))
    rows = sorted(summary.collect(), key=lambda x: (rep.SECTION_ORDER.index(x.section), x.rank))
    d = {}
    for x in rows:
        d.setdefault(x.section, {})[x.key] = x.n
    expected = rep.INSIGHTS_PROMPT.replace(rep.SUMMARY_MARKER, json.dumps(d, indent=2, ensure_ascii=False))
    assert rep.insights_prompt(summary).first().prompt == expected


def test_quality_pipeline(spark, tmpdir_path):
    raw = os.path.join(tmpdir_path, "raw.csv")
    with open(raw, "w", encoding="latin-1") as f:
        f.write("Fecha,Linea,Estacion ,Pax-Total\n1/2/2024,A,Peña,5\n1/2/2024,A,Peña,5\n2/2/2024, B ,X,7\n")
    cfg = q.DataQualityConfig(name="turnstile_export", expected_columns=["fecha", "linea", "estacion", "pax_total"],
                              non_null_columns=["fecha"], allowed_values={"linea": ["A", "B"]})
    res = jobs.run_quality_pipeline(spark, raw, os.path.join(tmpdir_path, "out"), cfg).first()
    assert (res.n_rows_before, res.n_rows_after, res.n_columns) == (3, 2, 4)
    assert res.issues == [] and res.is_acceptable
    saved = spark.read.parquet(os.path.join(tmpdir_path, "out", "turnstile_export_clean.parquet"))
    assert sorted(x.estacion for x in saved.collect()) == ["Peña", "X"]


def test_turnstiles_bridge(spark):
    df = spark.createDataFrame(
        [("13/2/2024", "Linea A", "3"), ("13/2/2024", "a", "2"), ("bad", "A", "1"), ("14/2/2024", "Bus", "x"),
         ("14/2/2024", "Premetro", "x")],
        "fecha string, linea string, pax_total string")
    got = {(x.date.isoformat(), x.line): x.passengers for x in jobs.ridership_from_turnstiles(df).collect()}
    assert got == {("2024-02-13", "A"): 5.0, ("2024-02-14", "B"): 0.0, ("2024-02-14", "P"): 0.0}


def test_headway_source_fallback(spark, tmpdir_path):
    daily = os.path.join(tmpdir_path, "daily.parquet")
    spark.createDataFrame([("2024-03-01", "B", 100)], "date string, line string, trains long").write.parquet(daily)
    bad_monthly = os.path.join(tmpdir_path, "monthly.csv")
    with open(bad_monthly, "w") as f:
        f.write("ym,line,n\n2024-03,B,3\n")
    out = jobs.headway_from_files(spark, bad_monthly, daily).collect()
    assert [(x.line, x.source) for x in out] == [("B", "daily_trains_aggregated")]
    assert jobs.headway_from_files(spark, None, os.path.join(tmpdir_path, "none.parquet")) is None


def test_insights_page_and_metric_fallback(spark, tmpdir_path):
    pax = view(spark, SF, "ridership")
    page = jobs.insights_page(pax, None, lines=["A", "B"], date_from="1996-01-01", date_to="1996-12-31")
    assert {x.line for x in page.pax_by_line.collect()} <= {"A", "B"}
    assert page.report.first().report.startswith("# AI Weekly Insights\n\n_Period:_ 1996-01-01 to 1996-12-31")
    assert json.loads(page.payload.first().payload)["lines"] == ["A", "B"]
    df, kind, src = jobs.load_other_metric(spark, *(os.path.join(tmpdir_path, n) for n in ("h.csv", "m.csv", "d.p")), demo=True)
    assert (kind, src, df.count()) == ("headway", "DEMO", 6)
    m = os.path.join(tmpdir_path, "m.csv")
    with open(m, "w") as f:
        f.write("year_month,line,dispatched_trains\n2024-01,A,10\n2024-02,A,20\n")
    df, kind, src = jobs.load_other_metric(spark, os.path.join(tmpdir_path, "h.csv"), m, "x")
    assert kind == "service" and df.first().service_level == 15.0


def test_incident_pipeline(spark):
    out = view(spark, SF, "model_outputs")
    t = jobs.tickets_as_incidents(jobs.incident_pipeline(out, "2024-01-01 00:00:00"))
    assert t.count() == out.count() and "incident_id" in t.columns
    assert t.where(F.col("target_team").isNull()).count() == 0


def test_checkpoint_dir_rules(spark):
    from railyard.session import ensure_checkpoint_dir, shared_path
    d = ensure_checkpoint_dir(spark)
    assert d and shared_path(spark, "x").startswith(d.rstrip("/"))
    page = jobs.insights_page(view(spark, SF, "ridership"), None)  # checkpoints its daily table
    assert page.pax_by_line.count() > 0


def test_summary_approx_densify_and_now(spark):
    t = view(spark, SF, "turnstiles")
    exact, approx = r.system_summary(t).first(), r.system_summary(t, approx=True).first()
    assert abs(approx.n_stations - exact.n_stations) <= max(2, exact.n_stations // 20)
    page = jobs.insights_page(view(spark, SF, "ridership"), None, densify=True, materialize=False)
    months = page.monthly.groupBy("line").count().collect()
    assert len({c["count"] for c in months}) == 1  # every line has every month
    from railyard.operators import incidents as inc
    tk = inc.tickets(inc.classify(view(spark, SF, "model_outputs"))).first()
    assert tk.created_at is not None and tk.ticket_id.startswith("TCK-")
