import pytest

from railyard.operators import quality as q


def _df(spark):
    rows = [("A", " x", 1.0, None), ("B", "x", 5.0, 1), ("Z", "y", None, 1), (None, "y", 9.0, 1),
            ("A", " x", 1.0, None)]
    return spark.createDataFrame(rows, "linea string, estacion string, pax double, k long")


CFG = q.DataQualityConfig(
    name="t", expected_columns=["linea", "estacion", "pax", "other"],
    non_null_columns=["linea", "pax", "absent"],
    allowed_values={"linea": ["A", "B"], "absent": ["x"]},
    value_ranges={"pax": (2, None), "k": (None, 0)},
    unique_keys=[["linea", "k"], ["absent"]],
    min_rows=10,
)


def test_cleaning_drops_copies_before_trimming(spark):
    clean = q.basic_cleaning(_df(spark))
    # the two identical rows collapse; ' x' and 'x' rows stay apart, then both read 'x'
    assert clean.count() == 4
    assert clean.where("estacion = 'x'").count() == 2


def test_issue_texts(spark):
    got = [r.issue for r in q.issues(_df(spark), CFG).orderBy("seq").collect()]
    assert got == [
        "Missing columns: ['other']",
        "Unexpected columns: ['k']",
        "Column 'linea' has 1 null values",
        "Column 'pax' has 1 null values",
        "Non-null column 'absent' is missing from dataframe",
        "Dataset has 5 rows, less than required minimum 10",
        "Column 'linea' contains 2 values outside allowed set",
        "Column 'pax' has values below minimum 2",
        "Column 'k' has values above maximum 0",
        "Composite key ['linea', 'k'] has 1 duplicated rows",
    ]


def test_counts(spark):
    rows = {(r.check, r.column_name): r.n for r in q.scan_counts(_df(spark), CFG).collect()}
    assert rows[("rows", None)] == 5
    assert rows[("nulls", "pax")] == 1
    assert rows[("missing", "absent")] is None
    assert rows[("below_min", "pax")] == 2
    assert rows[("above_max", "k")] == 3


def test_zscore_skips_constant_and_finds_outlier(spark):
    rows = [(float(v), 3.0) for v in [10] * 30 + [1000]]
    df = spark.createDataFrame(rows, "v double, c double")
    out = q.numeric_anomalies(df, ["v", "c", "missing"], 4.0).collect()
    assert [(r.column_name, r.v) for r in out] == [("v", 1000.0)]


def test_result_record(spark):
    raw = _df(spark)
    res = q.quality_result(raw, q.basic_cleaning(raw), CFG).first()
    assert res.n_rows_before == 5 and res.n_rows_after == 4 and res.n_columns == 4
    assert res.is_acceptable is False and len(res.issues) > 0


def test_guess_rules(spark):
    df = spark.createDataFrame([("d", "l", 1.0)], "fecha string, linea string, pax_total double")
    cfg = q.guess_rules(df, "x")
    assert cfg.date_columns == ["fecha"] and cfg.numeric_columns == ["pax_total"]
    assert cfg.non_null_columns == ["fecha", "linea"]


def test_allowed_issue_counts_every_value(spark):
    df = spark.range(0, 500).selectExpr("CAST(id AS STRING) AS code")
    cfg = q.DataQualityConfig(name="t", expected_columns=["code"], allowed_values={"code": ["1"]})
    got = [r.issue for r in q.issues(df, cfg).collect()]
    assert got == ["Column 'code' contains 499 values outside allowed set"]
    assert q.allowed_violations(df, cfg).count() == 499


def test_text_columns_in_numeric_rules(spark):
    df = spark.createDataFrame([("5",), ("x",), ("-1",), (None,)] + [("1",)] * 30 + [("900",)], "v string")
    cfg = q.DataQualityConfig(name="t", expected_columns=["v"], value_ranges={"v": (0, 100)})
    rows = {(r.check, r.column_name): r.n for r in q.scan_counts(df, cfg).collect()}
    assert rows[("below_min", "v")] == 1 and rows[("above_max", "v")] == 1
    out = q.numeric_anomalies(df, ["v"], 4.0).collect()
    assert [r.v for r in out] == ["900"]


def test_allowed_values_of_another_kind(spark):
    df = spark.createDataFrame([("A", 1), ("x", 2), (None, 3)], "t string, n long")
    cfg = q.DataQualityConfig(name="t", expected_columns=["t", "n"],
                              allowed_values={"t": ["A", 1], "n": [1, "2"]})
    bad = {(r.column_name, r.bad_value) for r in q.allowed_violations(df, cfg).collect()}
    assert bad == {("t", "x"), ("t", None), ("n", "2"), ("n", "3")}


def _scans(df, kind):
    return df._jdf.queryExecution().executedPlan().toString().count(f"FileScan {kind}") if kind else 0


def test_quality_job_parses_the_csv_once(spark, tmpdir_path, monkeypatch):
    """The CSV plan runs in the first save only; the result reads the saved rows once, for its distinct counts."""
    import os

    from railyard.operators import jobs
    path = os.path.join(tmpdir_path, "r.csv")
    with open(path, "w") as f:
        f.write("Line,Pax,odd (name)\nA,1,x\nA,1,x\nB,2.5,\n C,900,z\nB,,y\n")
    saves, plain = [], q.observed_save

    def noted(df, save, aggs):
        saves.append((_scans(df, "csv"), _scans(df, "parquet")))
        return plain(df, save, aggs)

    monkeypatch.setattr(q, "observed_save", noted)
    cfg = q.DataQualityConfig(name="r", expected_columns=["line", "pax", "odd_(name)"], non_null_columns=["pax", "gone"], numeric_columns=["pax"],
                              allowed_values={"line": ["A", "B"]}, value_ranges={"pax": (2, 800)}, unique_keys=[["line"], ["line", "pax"]], min_rows=9)
    out = jobs.run_quality_pipeline(spark, path, os.path.join(tmpdir_path, "out"), cfg)
    assert saves == [(1, 0), (0, 1)]
    assert _scans(out, "csv") == 0 and _scans(out, "parquet") == 1
    r = out.first()
    assert (r.n_rows_before, r.n_rows_after, r.n_columns, r.is_acceptable) == (5, 4, 3, False)
    assert r.issues == ["Column 'pax' has 1 null values", "Non-null column 'gone' is missing from dataframe", "Dataset has 4 rows, less than required minimum 9",
                        "Column 'line' contains 1 values outside allowed set", "Column 'pax' has values below minimum 2", "Column 'pax' has values above maximum 800",
                        "Composite key ['line'] has 1 duplicated rows"]


def test_one_scan_for_all_checks(spark):
    from railyard.plans import QUERIES
    for name in ("dq_issues", "dq_duplicate_keys", "dq_result"):
        assert _scans(QUERIES[name](spark, "/root/testdata/sf0.001"), "parquet") == 1, name


def test_bounds_tell_which_columns_have_far_values(spark):
    """As the rows of numeric_anomalies, without reading them."""
    rows = [(float(i % 3), 5.0, None, 1.0 if i else 900.0, "x") for i in range(60)] + [(-500.0, 5.0, None, float("nan"), "y")]
    df = spark.createDataFrame(rows, "low double, same double, none double, high double, text string")
    cfg = q.DataQualityConfig(name="z", expected_columns=df.columns, numeric_columns=["low", "same", "none", "high", "absent"])
    far = {r.column_name for r in q.numeric_anomalies(df, cfg.numeric_columns).collect()}
    res = q.quality_result(df, df, cfg).first()
    assert set(res.anomaly_columns) == far == {"low", "high"} and res.is_acceptable
    seen = q.observed_save(df, lambda d: d.write.format("noop").mode("overwrite").save(), q.Measures(df, cfg, cfg.numeric_columns).plain)
    assert q.quality_result(61, df, cfg, observed=seen).first() == res


@pytest.mark.parametrize("most", [0, 1000])
def test_distinct_rows_by_digest(spark, monkeypatch, most):
    monkeypatch.setattr(q, "BROADCAST_DIGESTS", most)
    rows = [("a", None, 1.0), (None, "a", 1.0), ("a", None, 1.0), ("b", "b", float("nan")), ("b", "b", float("nan")), ("c", "c", 0.0), ("c", "c", -0.0), (None, None, None), (None, None, None), ("d", "d", 2.0)]
    df = spark.createDataFrame(rows, "x string, `y z` string, v double").repartition(4)
    assert sorted(map(repr, q.distinct_rows(df).collect())) == sorted(map(repr, df.dropDuplicates().collect()))
    assert q.distinct_rows(df).count() == 6 and q.distinct_rows(df.limit(0)).count() == 0


def test_equal_digests_of_different_rows_are_compared(spark, monkeypatch):
    monkeypatch.setattr(q.F, "xxhash64", lambda *c: q.F.lit(7).cast("long"))
    df = spark.createDataFrame([(i % 3, "x") for i in range(9)], "a long, b string")
    assert sorted(map(tuple, q.distinct_rows(df).collect())) == [(0, "x"), (1, "x"), (2, "x")]


def test_rows_with_digests_of_their_own_are_not_shuffled(spark):
    from railyard.plans import QUERIES
    out = QUERIES["dedup_trim"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    single, more = plan.split("\n   +- ", 1)  # the two sides of the union
    assert "LeftAnti" in single and "Exchange hashpartitioning" not in single and "LeftSemi" in more
