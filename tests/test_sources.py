import os

from railyard.sources import files, sinks


def _write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding) as f:
        f.write(text)


def test_csv_latin1_fallback(spark, tmpdir_path):
    _write(os.path.join(tmpdir_path, "a.csv"), "estacion,pax\nPeña,1\nNA,2\n", "latin-1")
    _write(os.path.join(tmpdir_path, "b.csv"), "estacion,pax\nCongreso,3\n", "utf-8")
    df = files.load_csv(spark, os.path.join(tmpdir_path, "*.csv"))
    got = sorted((r.estacion or "", r.pax) for r in df.collect())
    assert got == [("", "2"), ("Congreso", "3"), ("Peña", "1")]


def test_folder_union_by_name(spark, tmpdir_path):
    _write(os.path.join(tmpdir_path, "m1.csv"), "fecha;linea;pax_total\n1/1/2024;A;5\n")
    _write(os.path.join(tmpdir_path, "m2.csv"), "fecha;linea;pax_total\n2/1/2024;B;6\n")
    _write(os.path.join(tmpdir_path, "m3.csv"), "linea;fecha;pax_total;extra\nC;3/1/2024;7;x\n")
    df = files.load_folder(spark, os.path.join(tmpdir_path, "m*.csv"))
    got = sorted((r.fecha, r.linea, r.pax_total, r.extra) for r in df.collect())
    assert got == [("1/1/2024", "A", "5", None), ("2/1/2024", "B", "6", None), ("3/1/2024", "C", "7", "x")]
    typed = files.infer_types(df)
    assert dict(typed.dtypes)["pax_total"] == "bigint"


def test_optional_and_first_available(spark, tmpdir_path):
    assert files.read_optional(spark, os.path.join(tmpdir_path, "none.parquet")) is None
    empty = os.path.join(tmpdir_path, "empty.parquet")
    spark.createDataFrame([], "line string, trains long").write.parquet(empty)
    full = os.path.join(tmpdir_path, "full.parquet")
    spark.createDataFrame([("A", 3)], "line string, trains long").write.parquet(full)
    pick = files.first_available([
        ("missing", lambda: files.read_optional(spark, os.path.join(tmpdir_path, "x.csv")), {"line"}),
        ("empty", lambda: files.read_optional(spark, empty), {"line", "trains"}),
        ("wrong", lambda: files.read_optional(spark, full), {"line", "dispatched_trains"}),
        ("full", lambda: files.read_optional(spark, full), {"line", "trains"}),
    ])
    assert pick[0] == "full"
    pax, hw = files.demo_frames(spark)
    assert pax.join(hw, "line").count() == 6


def test_profile_and_save(spark, tmpdir_path):
    df = spark.createDataFrame([("A", 3.5, 1)], "linea string, avg_headway_min double, trains long")
    prof = {r.column_name: r for r in files.profile(df, "x").collect()}
    assert prof["linea"].role == "line" and prof["avg_headway_min"].role == "headway"
    assert prof["trains"].n_rows == 1
    out = sinks.save_dataset(df, tmpdir_path, "demo")
    assert spark.read.parquet(out["parquet"]).count() == 1
    assert spark.read.option("header", "true").csv(out["csv"]).columns == ["linea", "avg_headway_min", "trains"]


def test_first_rows_of_a_profile(spark):
    df = spark.createDataFrame([(i % 4, f"x{i}", None if i % 3 else float(i)) for i in range(9, -1, -1)], "`a.b` long, c string, `d``e` double")
    got = files.first_rows(df, "x").orderBy("row").collect()
    assert len(got) == 15 and {r.dataset for r in got} == {"x"}
    cells = {(r.row, r.column_name): r.value for r in got}
    assert [cells[i, "c"] for i in range(1, 6)] == ["x0", "x4", "x8", "x1", "x5"]
    assert [cells[i, "d`e"] for i in range(1, 6)] == ["0.0", None, None, None, None] and cells[4, "a.b"] == "1"
    assert [r.value for r in files.first_rows(df, "x", order=["c"], n=2).orderBy("row").collect() if r.column_name == "c"] == ["x0", "x1"]
    assert files.first_rows(df.limit(0)).count() == 0


def test_odd_file_names(spark, tmpdir_path):
    _write(os.path.join(tmpdir_path, "a b+c.csv"), "x;y\n1;2\n")
    _write(os.path.join(tmpdir_path, "d%e.csv"), "y;x\n3;4\n")
    with open(os.path.join(tmpdir_path, "f g.csv"), "w", encoding="latin-1") as f:
        f.write("x;y\nPeña;5\n")
    facts = files.file_facts(spark, os.path.join(tmpdir_path, "*.csv")).collect()
    assert sorted((f.head, f.is_utf8) for f in facts) == [("x;y", False), ("x;y", True), ("y;x", True)]
    df = files.load_folder(spark, os.path.join(tmpdir_path, "*.csv"))
    assert sorted((r.x, r.y) for r in df.collect()) == [("1", "2"), ("4", "3"), ("Peña", "5")]


def test_latin1_header_and_standard_quoting(spark, tmpdir_path):
    body = 'Línea;Estación;n\n"a ""q"" b";"x;y";1\n"two\nlines";"back\\";2\nPlain;é;3\n'
    _write(os.path.join(tmpdir_path, "u.csv"), body)
    _write(os.path.join(tmpdir_path, "l.csv"), body, "latin-1")
    _write(os.path.join(tmpdir_path, "h.csv"), "Línea;n\nonly header is accented;4\n", "latin-1")
    _write(os.path.join(tmpdir_path, "b.csv"), "\ufeffLínea;n\nbom;5\n")
    df = files.load_folder(spark, os.path.join(tmpdir_path, "*.csv"))
    assert sorted(df.columns) == ["Estación", "Línea", "n"]
    got = sorted(((r["Línea"], r["Estación"], r["n"]) for r in df.collect()), key=repr)
    two = [('a "q" b', "x;y", "1"), ("two\nlines", "back\\", "2"), ("Plain", "é", "3")]
    assert got == sorted([*two, *two, ("only header is accented", None, "4"), ("bom", None, "5")], key=repr)


def test_saved_csv_is_read_by_other_readers(spark, tmpdir_path):
    import csv
    import glob
    rows = [('say "hi"', "a,b", " padded "), ("back\\", "line\nbreak", "x")]
    out = sinks.save_dataset(spark.createDataFrame(rows, "a string, b string, c string"), tmpdir_path, "t")
    got = []
    for f in glob.glob(out["csv"] + "/part-*.csv"):
        with open(f, newline="") as handle:
            got += list(csv.reader(handle))[1:]
    assert sorted(map(tuple, got)) == sorted(rows)
    assert sorted(map(tuple, files.load_csv(spark, out["csv"]).collect())) == sorted(rows)
