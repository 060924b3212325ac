"""Streams of sorted rows cut into runs of whole groups, for tasks that look at the groups of a key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_groups(batches: Iterator[pa.RecordBatch], by: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, borders of the groups) for rows sorted by ``by`` (not null): a
    group that goes on in the next batch waits for its end."""
    kept: pa.Table | None = None

    def borders(have: pa.Table) -> np.ndarray:
        new = np.zeros(have.num_rows - 1, bool)
        for c in by:
            v = have.column(c).to_numpy()
            new |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(new) + 1, [have.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        have = table if kept is None else pa.concat_tables([kept, table]).combine_chunks()
        cut = borders(have)
        kept = have.slice(cut[-2])  # the last group may go on
        if len(cut) > 2:
            yield have.slice(0, cut[-2]), cut[:-1]
    if kept is not None:
        yield kept, borders(kept)


def dealt_pairs(rows: DataFrame, key: str, salt: str, chunk: int) -> DataFrame:
    """``rows`` with a column ``cell``: a group of up to ``chunk`` rows is one
    cell; a larger one is dealt by the hash of ``salt`` into k chunks, and its
    rows go to the cells of every pair of chunks, so that each two rows meet in
    one cell (two of one chunk in k) and no cell holds much more than 2 * chunk.
    ``cell`` is the pair as x * 2**32 + y with x <= y; two rows of one chunk
    are to be looked at in the cell x = y only (``own``: the row's chunk)."""
    big = rows.groupBy(key).agg(F.count("*").alias("c")).where(F.col("c") > chunk).select(key, F.ceil(F.col("c") / chunk).cast("long").alias("k"))
    rows = rows.join(big, key, "left").withColumn("own", F.when(F.col("k").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(salt), F.col("k"))).cast("long"))
    other = F.explode(F.when(F.col("k").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    rows = rows.withColumn("other", other)
    return rows.withColumn("cell", F.least("own", "other") * F.lit(1 << 32) + F.greatest("own", "other")).drop("k", "other")


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a, b) as fewer ones that connect the same: each node that is
    not the smallest of its component, and that smallest."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(names))
    while True:
        least = np.minimum(label[x], label[y])
        now = label.copy()
        np.minimum.at(now, x, least)
        np.minimum.at(now, y, least)
        np.minimum.at(now, label[x], least)
        np.minimum.at(now, label[y], least)
        now = now[now]
        if (now == label).all():
            break
        label = now
    more = np.flatnonzero(label != np.arange(len(names)))
    return names[more], names[label[more]]
