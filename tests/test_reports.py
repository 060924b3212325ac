"""Golden report: the saved report's printed figures fed back through the
KPI and report operators must give the saved text exactly."""

from pyspark.sql import functions as F

from railyard.operators import reports as rep
from railyard.operators import ridership as r

# Figures and text of the saved report.
PAX = [("B", 47777794.0), ("A", 38227676.0), ("D", 32785347.0), ("C", 30567864.0), ("H", 21216633.0),
       ("E", 18438564.0)]
HW = [("A", 2.23), ("B", 2.88), ("H", 3.55), ("C", 3.67), ("E", 4.15), ("D", 5.07), ("P", 13.86)]

GOLDEN = """# AI Weekly Insights

_Period:_ 2024-01-01 to 2024-12-31

**Passengers (sum by line):**
- B: 47,777,794
- A: 38,227,676
- D: 32,785,347
- C: 30,567,864
- H: 21,216,633
- E: 18,438,564

**Avg. Headway (min by line):**
- A: 2.23 min
- B: 2.88 min
- H: 3.55 min
- C: 3.67 min
- E: 4.15 min
- D: 5.07 min
- P: 13.86 min

---

""" + rep.DRAFT_SUMMARY


def test_golden_report(spark):
    pax = spark.createDataFrame(PAX, "line string, passengers double")
    hw = spark.createDataFrame(HW, "line string, avg_headway_min double")
    out = rep.insights_report(pax, hw, F.lit("2024-01-01 to 2024-12-31")).first()
    assert out.report == GOLDEN


def test_golden_kpis(spark):
    pax = spark.createDataFrame(PAX, "line string, passengers double")
    hw = spark.createDataFrame(HW, "line string, avg_headway_min double")
    k = r.kpis(pax, hw).first()
    assert (k.total_passengers, k.top_line, k.top_passengers, k.avg_headway_min) == (
        189013878, "B", 47777794, 5.06)


def test_empty_kpis(spark):
    pax = spark.createDataFrame([], "line string, passengers double")
    k = r.kpis(pax, None).first()
    assert (k.total_passengers, k.top_line, k.top_passengers, k.avg_headway_min) == (0, "—", 0, None)


def test_payload_is_json(spark):
    import json
    pax = spark.createDataFrame(PAX, "line string, passengers double")
    hw = spark.createDataFrame(HW, "line string, avg_headway_min double")
    k = r.kpis(pax, hw)
    p = json.loads(rep.weekly_payload(k, pax.select("line"), F.lit("p"), "t").first().payload)
    assert p["kpis"] == {"total_passengers": 189013878.0, "top_line": "B", "avg_headway_min": 5.06}
    assert p["lines"] == ["A", "B", "C", "D", "E", "H"] and p["period"] == "p"


def test_change_with_gap_and_zero(spark):
    import datetime as dt
    rows = [("A", dt.date(2024, 1, 1), 0.0), ("A", dt.date(2024, 1, 8), 10.0), ("A", dt.date(2024, 1, 22), 15.0),
            ("B", dt.date(2024, 1, 1), 4.0)]
    df = spark.createDataFrame(rows, "line string, week date, passengers double")
    got = {(x.line, x.week): x.wow for x in r.with_change(df, "week", "wow").collect()}
    assert got[("A", dt.date(2024, 1, 8))] is None          # previous value 0
    assert got[("A", dt.date(2024, 1, 22))] == 50.0          # missing week: last seen is previous
    latest = r.latest(r.with_change(df, "week", "wow"), "week", "wow").collect()
    assert [x.line for x in latest] == ["A"]                 # line B absent in the latest week


def test_trailing_week_leaves_out_null_lines(spark):
    import datetime as dt
    rows = [(dt.date(2024, 1, 10), "A", 5.0), (dt.date(2024, 1, 10), None, 7.0), (dt.date(2024, 1, 1), "A", 9.0)]
    df = spark.createDataFrame(rows, "date date, line string, passengers double")
    got = [(x.line, x.passengers) for x in r.trailing_days(df, 7).collect()]
    assert got == [("A", 5.0)]
    text = rep.weekly_summary(df, None).first().report
    assert text.startswith("# Weekly Summary (2024-01-04 to 2024-01-10)\n\n**Passengers (sum, last 7 days):**\n- A: 5")


def test_saved_change_table_golden(spark, tmpdir_path):
    """Rows of the saved month-over-month table, written through the result
    sink, give the saved file: order (change descending) and number text."""
    import glob
    from railyard.sources import sinks
    rows = [("B", 3767936.0, -0.5920519251778944), ("E", 1334195.0, -11.58685686188493),
            ("A", 3045587.0, 0.9160884576896899), ("H", 1544000.0, -5.603623255745704),
            ("C", 2260538.0, -4.59868394398153), ("D", 2849870.0, -10.83459187443937)]
    df = spark.createDataFrame([(x[0], "2024-12", x[1], x[2]) for x in rows],
                               "line string, month string, passengers double, mom double")
    out = sinks.write_table(r.latest(df, "month", "mom"), f"{tmpdir_path}/changes", "csv")
    text = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{out}/part-*.csv")))
    assert text == (
        "line,passengers,mom\n"
        "A,3045587.0,0.9160884576896899\n"
        "B,3767936.0,-0.5920519251778944\n"
        "C,2260538.0,-4.59868394398153\n"
        "H,1544000.0,-5.603623255745704\n"
        "D,2849870.0,-10.83459187443937\n"
        "E,1334195.0,-11.58685686188493\n"
    )


def test_station_and_summary_rules(spark):
    df = spark.createDataFrame(
        [("S1", "13/2/2024", "5"), ("S1", "2/1/2024", "x"), ("S2", "9/3/2024", "y"), (None, "1/1/2020", "9")],
        "estacion string, fecha string, pax_total string")
    top = {x.station: (x.value, x.metric) for x in r.top_stations(df, "estacion", "pax_total").collect()}
    assert top == {"S1": (5.0, "passengers"), "S2": (0.0, "passengers")}
    by_count = {x.station: x.value for x in r.top_stations(df, "estacion", None).collect()}
    assert by_count == {"S1": 2.0, "S2": 1.0}
    summ = r.system_summary(df).first()
    assert (summ.total_records, summ.n_stations, str(summ.first_date), str(summ.last_date)) == (
        4, 2, "2020-01-01", "2024-03-09")
    tot = r.global_totals(df).first()
    assert (tot.total_entries, tot.total_passes, tot.total_traffic) == (None, None, 14)


def test_summary_maps(spark):
    from railyard.sources.testviews import view
    summary = r.dataset_summary(view(spark, "/root/testdata/sf0.001", "turnstiles_timed"))
    maps = {x.section: x.counts for x in r.summary_maps(summary).collect()}
    assert set(maps) == {"top_stations", "top_lines", "hour_peaks"}
    assert len(maps["top_stations"]) == 5 and len(maps["hour_peaks"]) == 10
    assert all(isinstance(v, int) for v in maps["top_lines"].values())


def test_two_decimals_like_python(spark):
    vals = [2.675, 1.005, 0.125, 36.995, 1234.565, 13.86, 5.0585714, -2.675]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [x[0] for x in df.select(rep.two_decimals(F.col("v"))).collect()]
    assert got == [f"{v:.2f}" for v in vals]


def test_all_missing_group_sums_to_zero(spark):
    import datetime as dt
    rows = [(dt.date(2024, 1, 1), "A", None), (dt.date(2024, 1, 1), "B", 5.0)]
    df = spark.createDataFrame(rows, "date date, line string, passengers double")
    assert {x.line: x.passengers for x in r.sum_by_line(df).collect()} == {"A": 0.0, "B": 5.0}
    assert {x.line: x.passengers for x in r.daily_by_line(df).collect()} == {"A": 0.0, "B": 5.0}
