"""Row numbers and trailing row frames over series of any length.

A window needs all rows of its partition in one task. Here a series is cut
twice instead: first into stretches of its time axis, whose row counts (one
small row each) are summed up to give every row its number in the series, then
into blocks of equally many rows. Each block also gets the last rows of the
one before it, as many as a frame reaches back, so its own rows see whole
frames. Both cuts are shuffles on (key, stretch) and (key, block): a series
without a key, or one key with a third of all rows, spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of the time axis in a stretch, and rows in a block.
STRETCH = 65_536
BLOCK = 65_536

ROW = "__row"


def numbered(series: DataFrame, keys: Sequence[str], place: Column, order: Sequence[str], stretch: int | None = None) -> DataFrame:
    """``series`` with ``__row``: 0, 1, ... in each key's order. ``place`` is a
    whole number that never falls along that order (a bucket of the time axis;
    null comes first): rows of ``stretch`` (``STRETCH``) consecutive places are
    numbered in one task. ``series`` is read twice and should be stored or cheap."""
    at = F.coalesce(F.floor(place / (stretch or STRETCH)).cast("long"), F.lit(-(1 << 62)))
    rows = series.withColumn("__stretch", at)
    counts = rows.groupBy(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], F.col("__stretch").alias("__s")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*[f"__{i}" for i in range(len(keys))]).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    same = F.col("__stretch") == F.col("__s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__{i}"))
    own = F.row_number().over(Window.partitionBy(*keys, "__stretch").orderBy(*order)) - 1
    out = rows.withColumn("__own", own).join(counts, same)
    return out.select(*series.columns, (F.col("__before") + F.col("__own")).alias(ROW))


def framed(rows: DataFrame, keys: Sequence[str], back: int, stats: dict[str, Column], block: int | None = None) -> DataFrame:
    """``rows`` of :func:`numbered` with each of ``stats`` (an aggregate) over the
    frame of the row and the ``back`` rows before it in its key's order."""
    size = max(block or BLOCK, back, 1)
    own = F.expr(f"{ROW} div {size}")
    both = F.when(F.expr(f"{ROW} % {size}") >= size - back, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = rows.withColumn("__block", F.explode(both))
    frame = Window.partitionBy(*keys, "__block").orderBy(ROW).rowsBetween(-back, Window.currentRow)
    out = dealt.select("*", *[agg.over(frame).alias(name) for name, agg in stats.items()])
    return out.where(F.col("__block") == own).drop("__block")
