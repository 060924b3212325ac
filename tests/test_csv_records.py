"""CSV files cut into records split by split, against the csv module on the whole file."""
import csv
import io
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from railyard.sources import files
from railyard.sources.csv_records import Quotes, split_maps, split_states
from railyard.sources.files import NA_VALUES


@pytest.fixture()
def tiny_splits(spark):
    """Files are read in splits of some 40 bytes."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "40")
    yield
    spark.conf.set(name, before)


def write(folder, name, text, encoding="utf-8"):
    path = os.path.join(folder, name)
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return path


def whole(text, sep):
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if any(c.strip() for c in r) or len(r) > 1]
    head = rows[0]
    return head, sorted((tuple(None if i >= len(r) or r[i] in NA_VALUES else r[i] for i in range(len(head))) for r in rows[1:]), key=repr)


def messy(rng, rows, sep, feed):
    def cell():
        kind = rng.randrange(8)
        body = "".join(rng.choice(["a", "é", "ß", " ", "x1"]) for _ in range(rng.randrange(6)))
        if kind == 0:
            return '"' + body + rng.choice(["\n", "\r\n", '""', sep, '""\n""', "\n\n"]) + body + '"'
        if kind == 1:
            return body + rng.choice(['5" pipe', 'a"b"c'])
        if kind == 2:
            return '"' + body + '"'
        return body

    lines = [sep.join(f"h{i}" for i in range(4))]
    for _ in range(rows):
        lines.append(sep.join([rng.choice("klm"), *(cell() for _ in range(rng.choice([3, 3, 3, 2])))]))
        if rng.randrange(9) == 0:
            lines.append(rng.choice(["", "  "]))
    return feed.join(lines) + rng.choice(["", feed])


@pytest.mark.parametrize("seed,sep,feed,encoding", [(1, ",", "\n", "utf-8"), (2, ";", "\r\n", "utf-8"), (3, ";", "\n", "latin-1"), (4, "|", "\n", "utf-8"), (5, "\t", "\r\n", "latin-1")])
def test_messy_files_in_tiny_splits(spark, tmpdir_path, tiny_splits, seed, sep, feed, encoding):
    text = messy(random.Random(seed), 60, sep, feed)
    path = write(tmpdir_path, "m.csv", text, encoding)
    head, rows = whole(text, sep)
    got = files.load_csv(spark, path, sep)
    assert got.columns == head
    assert sorted(map(tuple, got.collect()), key=repr) == rows


def test_one_large_file_gives_many_tasks(spark, tmpdir_path, tiny_splits):
    text = "a;b\n" + "".join(f'{i};"x\ny{i}"\n' for i in range(200))
    path = write(tmpdir_path, "one.csv", text)
    got = files.load_csv(spark, path, ";")
    assert got.rdd.getNumPartitions() > 20
    assert got.where("b = concat('x\n', 'y', a)").count() == 200
    # a cell longer than many splits
    path = write(tmpdir_path, "long.csv", "a;b\n1;\"" + "line\n" * 500 + "\"\n2;z\n")
    assert sorted(map(tuple, files.load_csv(spark, path, ";").collect())) == [("1", "line\n" * 500), ("2", "z")]


def test_states_of_splits_follow_the_text(spark, tmpdir_path, tiny_splits):
    text = messy(random.Random(9), 80, ",", "\n")
    path = write(tmpdir_path, "s.csv", text)
    raw, quotes = text.encode(), Quotes(",")
    states = split_states(split_maps(spark, [path], ",")).collect()
    assert len(states) > 10
    for r in states:
        start = raw.find(b"\n", r.block - 1) + 1 if r.block else 0  # a split starts with its first whole line
        assert r.inside == quotes.spans(raw[:start], False)[1], r


def test_headers_with_line_breaks_and_differing_files(spark, tmpdir_path):
    write(tmpdir_path, "a.csv", '"a\nx";b\n1;2\n')
    write(tmpdir_path, "b.csv", '﻿"b";"a\nx";c;c\n3;"4\n5";6;7\n')
    write(tmpdir_path, "c.csv", 'b;"a\nx"\né;8\n', "latin-1")
    write(tmpdir_path, "d.csv", "b\n9\n")
    write(tmpdir_path, "e.csv", "")
    got = files.load_folder(spark, os.path.join(tmpdir_path, "*.csv"))
    assert set(got.columns) == {"a\nx", "b", "c", "c.1"}
    rows = sorted(map(tuple, got.select("`a\nx`", "b", "c", "`c.1`").collect()), key=repr)
    assert rows == sorted([("1", "2", None, None), ("4\n5", "3", "6", "7"), ("8", "é", None, None), (None, "9", None, None)], key=repr)


def test_a_header_longer_than_its_split(spark, tmpdir_path, tiny_splits):
    name = "n" + "\n" * 3 + "m" * 100 + "\nz"
    path = write(tmpdir_path, "h.csv", f'﻿"{name}",b\n1,"x\n2"\n')
    got = files.load_csv(spark, path)
    assert got.columns == [name, "b"] and [tuple(r) for r in got.collect()] == [("1", "x\n2")]


@pytest.mark.parametrize("more", ["", '7;"l\nm"\n'])
def test_rows_wider_than_their_header(spark, tmpdir_path, more):
    """By line and by record: an error whatever is selected, or the column _extra."""
    write(tmpdir_path, "w.csv", 'a;b\n1;2;3\n4;5;\n6\n7;8;"x;""y""";;9\n' + more)
    write(tmpdir_path, "v.csv", "a;b;c\n1;2;3\n1;2;3;4\n")
    path = os.path.join(tmpdir_path, "*.csv")
    for choose in (lambda d: d, lambda d: d.select("b"), lambda d: d.agg(F.count("*"))):
        with pytest.raises(PySparkException, match="beyond its header"):
            choose(files.load_folder(spark, path)).collect()
    got = sorted(((r.a, r.b, r.c, r._extra) for r in files.load_csv(spark, path, ";", wide="extra").collect()), key=repr)
    want = [("1", "2", None, ["3"]), ("4", "5", None, None), ("6", None, None, None), ("7", "8", None, ['x;"y"', "", "9"]), ("1", "2", "3", None), ("1", "2", "3", ["4"])]
    assert got == sorted(want + ([("7", "l\nm", None, None)] if more else []), key=repr)
    write(tmpdir_path, "x.csv", "_extra;b\n1;2\n")
    with pytest.raises(ValueError, match="_extra"):
        files.load_csv(spark, path, ";", wide="extra")


def test_a_cell_that_never_ends(spark, tmpdir_path):
    path = write(tmpdir_path, "n.csv", 'a,b\n1,"2\n3,4\n')
    with pytest.raises(ValueError, match="never ends"):
        files.load_csv(spark, path)
    with pytest.raises(ValueError, match="separator"):
        files.load_csv(spark, path, "::")


def test_files_by_line_need_no_python(spark, tmpdir_path):
    path = write(tmpdir_path, "p.csv", 'a,b\n"1","x ""q"", y"\n2,\n')
    got = files.load_csv(spark, path)
    assert "MapInArrow" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == [("1", 'x "q", y'), ("2", None)]
