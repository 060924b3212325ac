"""CSV records of files whose quoted cells hold line breaks, read in splits.

Where a split of such a file starts, nothing in it says whether that place is
inside a quoted cell. So each split is first read as a map: where a reader ends
that enters it outside a cell, and where one that enters it inside. Maps are
composed over a file's splits (a window over one small row each), which gives
the state each split starts in; then every split cuts its own lines into
records. A record that crosses a border leaves a piece in each split, and only
these pieces are shuffled and joined.

Rows of a split have an order that only the task reading it knows, and a state
runs along it: this is the one place of the library with Python in the tasks
(Arrow batches, scanned by compiled patterns and the ``csv`` module).

A quote opens a cell only as its first character; inside, two quotes are one.
A line feed, with or without a carriage return, or a lone carriage return ends
a record outside of quoted cells. Lines of white space only are no records.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Splits that start inside a cell are broadcast up to so many (a file name and a place each), else joined by a shuffle.
BROADCAST_SPLITS = 100_000
#: Longest cell that is read.
CELL_BYTES = (1 << 31) - 1

PIECES = "file string, block bigint, start bigint, first boolean, cells array<string>, raw binary"
MAPS = "file string, block bigint, from_outside boolean, from_inside boolean, ends_inside boolean, head binary"


def file_path_col() -> F.Column:
    """The row's source file as a plain path. ``_metadata.file_path`` is a URI
    (a space reads ``%20``); decoding it gives the path the readers and the
    file listing use. ``+`` is protected first, as form decoding would turn it
    into a space."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def as_paths(names: list[str]) -> list[str]:
    """File names as paths to read: pattern characters stand for themselves."""
    return [re.sub(r"([\[\]{}*?,\\])", r"\\\1", n) for n in names]


def split_lines(spark: SparkSession, names: list[str]) -> DataFrame:
    """file, block (start of the split), raw (the line's bytes), in the splits' order."""
    rows = spark.read.option("lineSep", "\n").text(as_paths(names))
    return rows.select(file_path_col().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("raw"))


class Quotes:
    """Finds the quoted cells of text that starts at a record or inside a cell."""

    def __init__(self, sep: str):
        if len(sep) != 1 or not sep.isascii() or sep in '"\r\n':
            raise ValueError(f"the separator must be one ASCII character, not {sep!r}")
        self.opens = re.compile(b"[" + re.escape(sep.encode()) + b'\r\n]"')
        self.closes = re.compile(rb'[^"]*+(?:""[^"]*+)*+"')

    def spans(self, text: bytes, inside: bool) -> tuple[list[tuple[int, int]], bool]:
        """(start, end) of what is inside quoted cells, and whether the end is."""
        found, at = [], 0
        if not inside and text[:1] == b'"':
            inside, at = True, 1
        while True:
            if inside:
                close = self.closes.match(text, at)
                if close is None:
                    found.append((at, len(text)))
                    return found, True
                found.append((at, close.end()))
                at = close.end()
            opened = self.opens.search(text, at)
            if opened is None:
                return found, False
            inside, at = True, opened.end()

    def record_ends(self, text: bytes, inside: bool) -> tuple[np.ndarray, bool]:
        """Places right after each record's end, and whether the text ends inside a cell."""
        spans, after = self.spans(text, inside)
        data = np.frombuffer(text, np.uint8)
        feed = data == 10
        alone = data == 13
        alone[:-1] &= ~feed[1:]
        ends = np.flatnonzero(feed | alone)
        if spans:
            starts, stops = np.array(spans).T
            k = np.searchsorted(starts, ends, "right") - 1
            ends = ends[(k < 0) | (ends >= stops[np.maximum(k, 0)])]
        return ends + 1, after


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes | None]]:
    """(first row's columns but raw, text) for each run of lines of one split in a
    batch; a text of None follows the last run of a split."""
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        block, name = batch.column("block").to_numpy(), batch.column("file")
        new = np.flatnonzero(block[1:] != block[:-1]) + 1 if n > 1 else []
        names = name.to_pylist()
        cut = sorted({0, n, *new, *(i for i in range(1, n) if names[i] != names[i - 1])})
        raw = batch.column("raw").to_pylist()
        for lo, hi in zip(cut, cut[1:]):
            own = {c: batch.column(c)[lo].as_py() for c in batch.schema.names if c != "raw"}
            if last is None or (last["file"], last["block"]) != (own["file"], own["block"]):
                if last is not None:
                    yield last, None
                if own["block"] == 0:
                    raw[lo] = raw[lo].removeprefix(b"\xef\xbb\xbf")
            last = own
            yield own, b"\n".join(raw[lo:hi]) + b"\n"
    if last is not None:
        yield last, None


def split_maps(spark: SparkSession, names: list[str], sep: str) -> DataFrame:
    """file, block, from_outside and from_inside (whether a reader that enters
    there ends inside a cell), ends_inside (whether the one that enters inside
    meets a record's end), head (bytes of the file's first record, in its
    first split if that record ends there)."""

    def run(batches):
        quotes = Quotes(sep)
        out, state, ended, head, start = [], [False, True], False, None, b""
        for split, text in _runs(batches):
            if text is None:
                out.append((split["file"], split["block"], *state, ended, head))
                state, ended, head, start = [False, True], False, None, b""
                continue
            if split["block"] == 0 and head is None:
                start += text
                ends, _ = quotes.record_ends(start, False)
                lo = 0
                for hi in ends.tolist():
                    if start[lo:hi].strip():
                        head = start[lo:hi]
                        break
                    lo = hi
            ends, inside = quotes.record_ends(text, state[1])
            ended = ended or len(ends) > 0
            state = [inside if state[0] == state[1] else quotes.spans(text, state[0])[1], inside]
        if out:
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                             names=["file", "block", "from_outside", "from_inside", "ends_inside", "head"])

    return split_lines(spark, names).mapInArrow(run, MAPS)


def split_states(maps: DataFrame) -> DataFrame:
    """``maps`` with ``inside`` (the state a split starts in), ``after`` (the one
    it ends in) and ``opened`` (if it starts inside: the split in which that record began).

    A map that ends alike from both states sets the state; of the others, those that
    swap the states since then count."""
    order = Window.partitionBy("file").orderBy("block")
    sets = F.col("from_outside") == F.col("from_inside")
    swaps = F.sum((F.col("from_outside") & ~F.col("from_inside")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = maps.withColumn("swaps", swaps)
    known = F.last(F.when(sets, F.struct(F.col("from_outside").cast("int").alias("is"), "swaps")), ignorenulls=True)
    state = (F.coalesce(known.over(order)["is"], F.lit(0)) + F.col("swaps") - F.coalesce(known.over(order)["swaps"], F.lit(0))) % 2 == 1
    rows = rows.withColumn("after", state)
    rows = rows.withColumn("inside", F.coalesce(F.lag("after").over(order), F.lit(False)))
    begins = F.col("after") & (~F.col("inside") | F.col("ends_inside"))  # a record that goes on in the next split
    opened = F.last(F.when(begins, F.col("block")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("opened", F.when(F.col("inside"), opened)).drop("swaps")


def _cells(records: list[bytes], sep: str, encoding: str) -> list[list[str]]:
    csv.field_size_limit(CELL_BYTES)
    texts = (r.decode(encoding) for r in records)
    return list(csv.reader((t[:-2] if t.endswith("\r\n") else t[:-1] if t[-1:] in "\r\n" else t for t in texts), delimiter=sep))


def head_cells(raw: bytes, sep: str, encoding: str) -> list[str]:
    return _cells([raw], sep, encoding)[0]


def _pieces(spark: SparkSession, names: list[str], sep: str, encoding: str, states: DataFrame) -> DataFrame:
    lines = split_lines(spark, names)
    inside = states.where("inside").select("file", "block", "opened")
    if inside.count() <= BROADCAST_SPLITS:
        lines = lines.join(F.broadcast(inside), ["file", "block"], "left")
    else:  # lines meet their split again, in their order
        lines = lines.withColumn("i", F.monotonically_increasing_id()).join(inside, ["file", "block"], "left")
        lines = lines.repartition("file", "block").sortWithinPartitions("file", "block", "i").drop("i")

    def run(batches):
        quotes = Quotes(sep)
        kept, inside, entered, first = [], None, False, False  # the unfinished record; the state; whether that record began in an earlier split
        for split, text in _runs(batches):
            if text is None:
                if kept:
                    yield _rows([split], [split["opened"] if entered else split["block"]], [first and not entered], [None], [b"".join(kept)])
                kept, inside = [], None
                continue
            if inside is None:
                inside = entered = split["opened"] is not None
                first = split["block"] == 0
            ends, inside = quotes.record_ends(text, inside)
            ends = ends.tolist()
            if not ends:
                kept.append(text)
                continue
            parts = [b"".join([*kept, text[:ends[0]]]), *(text[a:b] for a, b in zip(ends, ends[1:]))]
            kept = [text[ends[-1]:]] if ends[-1] < len(text) else []
            if entered:
                yield _rows([split], [split["opened"]], [False], [None], [parts.pop(0)])
                entered = False
            parts = [p for p in parts if p.strip()]
            if parts:
                n = len(parts)
                yield _rows([split] * n, [None] * n, [first] + [False] * (n - 1), _cells(parts, sep, encoding), [None] * n)
                first = False

    def _rows(splits, starts, firsts, cells, raws):
        return pa.RecordBatch.from_arrays(
            [pa.array([s["file"] for s in splits]), pa.array([s["block"] for s in splits], pa.int64()), pa.array(starts, pa.int64()),
             pa.array(firsts, pa.bool_()), pa.array(cells, pa.list_(pa.string())), pa.array(raws, pa.binary())],
            names=["file", "block", "start", "first", "cells", "raw"])

    return lines.mapInArrow(run, PIECES)


def records(spark: SparkSession, names: list[str], sep: str, encoding: str, states: DataFrame) -> DataFrame:
    """file, first (whether it is the file's first record), cells (array of texts) of every record."""
    pieces = _pieces(spark, names, sep, encoding, states)
    whole = pieces.where("cells is not null").select("file", "first", "cells")
    parts = pieces.where("raw is not null")
    joined = parts.groupBy("file", "start").agg(F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", "raw"))).alias("parts"))
    joined = joined.select("file", "first", F.expr("aggregate(parts.raw, cast('' as binary), (a, r) -> concat(a, r))").alias("raw"))

    def run(batches):
        for batch in batches:
            cells = _cells(batch.column("raw").to_pylist(), sep, encoding)
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("first"), pa.array(cells, pa.list_(pa.string()))], names=["file", "first", "cells"])

    return whole.unionByName(joined.mapInArrow(run, "file string, first boolean, cells array<string>"))
