"""Exact order statistics in bounded memory.

``median`` and ``percentile`` keep every value of a group in one buffer. Here
each round reads the values once: a quantile sketch of bounded size brackets
the wanted rank between two values, and counts below, at and between them say
exactly where the rank lies. The next round looks at the open interval that
holds it, a few ten-thousandths of the last one's values (repeated values
settle at once, as a bracket's end), until ``SORTED`` values or fewer are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: So many values left are sorted.
SORTED = 10_000
#: The sketch's ranks are off by at most a 1 / ACCURACY of the values; GRID of its quantiles are kept.
ACCURACY, GRID = 10_000, 2_000


def _values(df: DataFrame, value: str) -> DataFrame:
    v = F.col("`" + value.replace("`", "``") + "`").cast("double")
    return df.select(v.alias("v")).where(v.isNotNull() & ~F.isnan(v))


def _between(lo: float | None, hi: float | None) -> Column:
    inside = F.lit(True)
    if lo is not None:
        inside = inside & (F.col("v") > lo)
    if hi is not None:
        inside = inside & (F.col("v") < hi)
    return inside


def _sketch(inside: Column) -> Column:
    return F.percentile_approx(F.when(inside, F.col("v")), [i / GRID for i in range(GRID + 1)], ACCURACY).alias("grid")


def select_rank(values: DataFrame, rank: int, n: int, grid: list[float]) -> float:
    """The value of ``rank`` (from 0) of the ``n`` values in column ``v``;
    ``grid``: their approximate quantiles at 0, 1 / GRID, ... 1."""
    lo = hi = None  # the open interval that holds the rank
    before = 0  # values that are not above lo
    while n > SORTED:
        x = rank - before
        low, high = int((x / n - 2 / ACCURACY) * GRID), int(((x + 1) / n + 2 / ACCURACY) * GRID) + 1
        a = grid[low] if low > 0 else None
        b = grid[high] if high < GRID else None
        if a is None and b is None:
            a = grid[GRID // 2]
        inside = _between(lo, hi)
        edge = [F.count_if(inside & F.coalesce(F.col("v") < a, F.lit(False))) if a is not None else F.lit(0),
                F.count_if(inside & (F.col("v") == a)) if a is not None else F.lit(0),
                F.count_if(inside & _between(a, b)),
                F.count_if(inside & (F.col("v") == b)) if b is not None and b != a else F.lit(0)]
        found = values.agg(*[e.alias(f"n{i}") for i, e in enumerate(edge)], _sketch(inside & _between(a, b))).first()
        parts = [(lo, a), a, (a, b), b, (b, hi)]
        for part, k in zip(parts, [*found[:4], None]):
            if k is None or x < k:
                break
            x -= k
        if not isinstance(part, tuple):
            return part
        before, held = rank - x, n - sum(found[:4]) if k is None else k
        if part == (a, b):
            lo, hi, n, grid = (lo if a is None else a), (hi if b is None else b), held, found["grid"]
        else:  # the sketch's bound did not hold: the rest of the interval, sketched anew
            lo, hi, n = *part, held
            grid = values.agg(_sketch(_between(lo, hi))).first()["grid"]
    left = values.where(_between(lo, hi)).agg(F.sort_array(F.collect_list("v")).alias("v"))
    return left.select(F.get("v", F.lit(rank - before))).first()[0]


def exact_median(df: DataFrame, value: str) -> float | None:
    """The median of the column's numbers; null and NaN are missing values,
    and without any number there is none. ``df`` is read some three to five
    times: store what is costly to make."""
    values = _values(df, value)
    n, grid = values.agg(F.count("*"), _sketch(F.lit(True))).first()
    if not n:
        return None
    lower = select_rank(values, (n - 1) // 2, n, grid)
    if n % 2:
        return lower
    upto, above = values.agg(F.count_if(F.col("v") <= lower), F.min(F.when(F.col("v") > lower, F.col("v")))).first()
    return lower if upto > n // 2 else lower / 2 + above / 2


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, median: the exact median of each column."""
    schema = T.StructType([T.StructField("column_name", T.StringType()), T.StructField("median", T.DoubleType())])
    return df.sparkSession.createDataFrame([(c, exact_median(df, c)) for c in columns], schema)
