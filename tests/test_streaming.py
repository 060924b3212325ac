import os

from railyard.operators.ingest import read_log
from railyard.streaming.daily_stream import read_daily, start_daily_ingest


def _write(path, rows):
    with open(path, "w") as f:
        f.write("fecha;linea;estacion;pax_total\n")
        for r in rows:
            f.write(";".join(r) + "\n")


def test_daily_stream_sums_and_is_restartable(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    out = os.path.join(tmpdir_path, "out")
    ckpt = os.path.join(tmpdir_path, "ckpt")
    logs = os.path.join(tmpdir_path, "logs")
    _write(os.path.join(src, "d1.csv"), [("1/1/2024", "A", "S1", "5"), ("1/1/2024", "A", "S2", "7"),
                                         ("1/1/2024", "B", "S1", "x"), ("bad", "A", "S1", "9")])
    q = start_daily_ingest(spark, src, out, logs, checkpoint=ckpt)
    q.awaitTermination(120)
    _write(os.path.join(src, "d2.csv"), [("2/1/2024", "A", "S1", "1"), ("5/1/2024", "A", "S1", "2")])
    q = start_daily_ingest(spark, src, out, logs, checkpoint=ckpt)  # resumes from the checkpoint
    q.awaitTermination(120)
    got = {(r.date.isoformat(), r.linea): (r.pax_total, r.rows) for r in read_daily(spark, out).collect()}
    assert got == {("2024-01-01", "A"): (12.0, 2), ("2024-01-01", "B"): (0.0, 1), ("2024-01-02", "A"): (1.0, 1),
                   ("2024-01-05", "A"): (2.0, 1)}  # open days included
    other = start_daily_ingest(spark, src, os.path.join(tmpdir_path, "out2"), logs, checkpoint=ckpt + "2")
    other.awaitTermination(120)
    runs = read_log(spark, logs, "ingestion_runs").collect()
    assert sorted(r.rows_loaded for r in runs if r.rows_loaded) == [2, 3, 5]  # one stream's runs never overwrite another's


def test_a_batch_reads_only_its_days(spark, tmpdir_path, monkeypatch):
    """The count of new rows opens the folders of the days that the batch changed."""
    from railyard.streaming import daily_stream
    src, out, logs, ckpt = (os.path.join(tmpdir_path, n) for n in ("in", "out", "logs", "ckpt"))
    os.makedirs(src)
    opened, plain = [], daily_stream._new_rows

    def noted(s, out_dir, batch_id, days):
        opened.append([d.isoformat() for d in days])
        return plain(s, out_dir, batch_id, days)

    monkeypatch.setattr(daily_stream, "_new_rows", noted)
    files = [[("1/1/2024", "A", "S", "1"), ("1/1/2024", "B", "S", "1"), ("2/1/2024", "A", "S", "1")], [("2/1/2024", "A", "S", "5"), ("3/1/2024", "A", "S", "2")],
             [("bad", "A", "S", "1")], [("3/1/2024", "A", "S", "1"), ("3/1/2024", "B", "S", "1")]]
    for i, rows in enumerate(files):
        _write(os.path.join(src, f"f{i}.csv"), rows)
        start_daily_ingest(spark, src, out, logs, checkpoint=ckpt).awaitTermination(120)
    assert [d for d in opened if d] == [["2024-01-01", "2024-01-02"], ["2024-01-02", "2024-01-03"], ["2024-01-03"]]
    assert sorted(r.rows_loaded for r in read_log(spark, logs, "ingestion_runs").collect() if r.rows_loaded) == [2, 2, 3]
    got = {(r.date.isoformat(), r.linea): (r.pax_total, r.rows) for r in read_daily(spark, out).collect()}
    assert got == {("2024-01-01", "A"): (1.0, 1), ("2024-01-01", "B"): (1.0, 1), ("2024-01-02", "A"): (6.0, 2), ("2024-01-03", "A"): (3.0, 2), ("2024-01-03", "B"): (1.0, 1)}
