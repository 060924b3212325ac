"""Quality classifier: kernel ridge on document statistics by random Fourier
features, with isotonic calibration.

Every document gets a dozen statistics of its whole text (numpy over the byte
blocks). Labelled rows are joined first, so fitting reads features of a
bounded sample only (``FIT_ROWS``, a hash of the id decides; the one place
where a sample is used). Standardised statistics pass a random Fourier map
that approximates a Gaussian kernel; each task sums its normal equations, the
sums (features squared) are solved on the driver. A quarter of the sample is
kept from the fit and calibrates the scores: counts per score bin, pooled to
an increasing curve. Scoring is one pass over all documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .textblocks import NOT_SPACE, blocks, word_hashes, word_spans

#: Labelled rows used for fitting and calibration at most (expected number).
FIT_ROWS = 40_000
FEATURES, RIDGE, BINS = 256, 1e-3, 1000
GOOD = 0.7

# Byte classes: lower, upper, digit, space, line break, sentence punctuation, other ASCII symbol, non-ASCII.
CLASSES = 8
_CLASS = np.full(256, 6, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[0x20, 0x09]], _CLASS[[0x0A, 0x0D]], _CLASS[128:] = 0, 1, 2, 3, 4, 7
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[i for i in range(33, 127) if _CLASS[i] in (5, 6)]] = True
STATISTICS = CLASSES + 6


def statistics(data: np.ndarray, border: np.ndarray) -> np.ndarray:
    """One row of statistics per text; an empty text has zeros (but for counts, which are logarithms of 1)."""
    n = len(border) - 1
    size = np.diff(border)
    row = np.repeat(np.arange(n), size)
    share = np.bincount(row * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES) / np.maximum(size, 1)[:, None]
    starts, ends, at = word_spans(data, border, NOT_SPACE)
    words = np.diff(at)
    some = np.maximum(words, 1)
    of = np.repeat(np.arange(n), words)
    length = ends - starts
    mean = np.bincount(of, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(of, length.astype(float) ** 2, n) / some - mean ** 2, 0))
    odd_end = np.bincount(of, _SYMBOL[data[ends - 1]] if len(ends) else None, n) / some if len(ends) else np.zeros(n)
    lines = np.bincount(row, data == 0x0A, n) + 1
    hashes = word_hashes(data, starts, ends)
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(at[:-1], at[1:])]) / some
    return np.column_stack([share, np.log1p(words), mean, spread, odd_end, np.log(some / lines), distinct])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    edges: np.ndarray  # raw scores, rising
    curve: np.ndarray  # probability at each edge, rising

    def mapped(self, x: np.ndarray) -> np.ndarray:
        return fourier(np.clip((x - self.mean) / self.scale, -6, 6))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.mapped(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.edges, self.curve), 0.0, 1.0)


def fourier(z: np.ndarray) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel of width sqrt(2 * dimensions), and a constant."""
    rng = np.random.RandomState(7)
    turn = rng.normal(size=(z.shape[1], FEATURES)) / np.sqrt(2 * z.shape[1])
    shift = rng.uniform(0, 2 * np.pi, FEATURES)
    return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ turn + shift), np.ones(len(z))])


def increasing(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The increasing sequence nearest to ``value`` (weighted least squares), by pooling."""
    pools: list[list[float]] = []  # mean, weight, members
    for v, w in zip(value, weight):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sums(table: DataFrame, dim: int, of) -> np.ndarray:
    """Sum over tasks of the matrix (dim columns) that ``of`` makes of a task's rows."""

    def run(batches):
        total = None
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, -1)
            if len(x):
                part = of(x, batch.column("y").to_numpy().astype(float))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total))], names=["i", "row"])

    rows = table.select("x", "y").mapInArrow(run, "i int, row array<double>").toPandas()
    if not len(rows):
        return np.zeros((0, dim))
    out = np.zeros((rows["i"].max() + 1, dim))
    for i, r in zip(rows["i"], rows["row"]):
        out[i] += r
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> Model | None:
    """The model, or None where no row may be learned from. Several labels of
    an id count as their majority (ties: 1); null labels and ids don't count."""
    known = labels.select(labels[id_col].alias("id"), labels[label_col].alias("y")).where("id is not null and y is not null").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    n = known.count()
    draw = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000))
    known = known.where(draw < min(1.0, rows / max(n, 1)) * 1_000_000)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, border in blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(list(statistics(data, border))), part.column("y"), part.column("own")], names=["x", "y", "own"])

    own = F.pmod(F.xxhash64(F.lit("calibrate"), "id"), F.lit(4)) == 0
    # the sample's ids and labels are at most some FIT_ROWS rows
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(known), "id").select("text", "y", own.alias("own"))
    # the scan keeps its own tasks; the few small rows go to 16, as each task's sums come to the driver
    table = stored(picked.mapInArrow(measure, "x array<double>, y double, own boolean").repartition(16), "statistics")
    first = _sums(table, STATISTICS, lambda x, y: np.vstack([np.full(x.shape[1], len(x)), x.sum(0), (x * x).sum(0), np.full(x.shape[1], y.sum())]))
    if not len(first):
        return None
    mean = first[1] / first[0]
    scale = np.sqrt(np.maximum(first[2] / first[0] - mean ** 2, 1e-12))
    model = Model(mean, scale, np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))
    fitted = table.where("not own")
    fitted = fitted if fitted.limit(1).count() else table

    def normal(x, y):
        m = model.mapped(x)
        return np.column_stack([m.T @ m, m.T @ y])

    sums = _sums(fitted, FEATURES + 2, normal)
    gram, right = sums[:, :-1], sums[:, -1]
    weight = np.linalg.solve(gram + RIDGE * max(gram[-1, -1], 1) * np.eye(len(gram)) / FEATURES, right)
    model = Model(mean, scale, weight, np.zeros(1), np.zeros(1))

    def counts(x, y):
        b = np.clip(((model.raw(x) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.vstack([np.bincount(b, minlength=BINS), np.bincount(b, y, BINS)])

    calibration = table.where("own")
    total, good = _sums(calibration if calibration.limit(1).count() else table, BINS, counts)
    used = np.flatnonzero(total)
    curve = increasing(good[used] / total[used], total[used])
    return Model(mean, scale, weight, (used + 0.5) / BINS * 2 - 0.5, curve)


def _scores(model: Model | None, data: np.ndarray, border: np.ndarray) -> np.ndarray:
    return np.ones(len(border) - 1) if model is None else model.score(statistics(data, border))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: id, held_out, score (0 to 1) and predicted (1 if
    score >= 0.7). Null and empty texts are scored like any other (as texts
    without characters). Without any label to learn from every score is 1.
    Equal rows and null ids (never held out) keep a row each; other columns
    are not read; an empty table gives an empty result."""
    model = fit(docs, labels, id_col, text_col, label_col)

    def run(batches):
        for batch in batches:
            for part, data, border in blocks(batch, "text"):
                score = _scores(model, data, border)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(score), pa.array((score >= GOOD).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).select("id", held_out(F.col("id")).alias("held_out"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` that are predicted good, all columns as they are."""
    model = fit(docs, labels, id_col, text_col, label_col)
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    name = f"c{docs.columns.index(text_col)}"

    def run(batches):
        for batch in batches:
            for part, data, border in blocks(batch, name):
                yield part.filter(pa.array(_scores(model, data, border) >= GOOD))

    return inner.mapInArrow(run, inner.schema).toDF(*docs.columns)
