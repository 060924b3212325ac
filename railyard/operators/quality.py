"""Data-quality rules: cleaning, schema / null / range / allowed-set /
composite-key checks, global z-score anomalies and the result record.

All checks of a configuration are one aggregate, hence one scan
(:class:`Measures`): row, null and range counts and the bounds of z-scores as
plain aggregates, values outside allowed sets and composite keys as distinct
counts, which Spark expands and combines before it shuffles. The plain part
can also be observed while a table is written and then costs no scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import snake_case_names, to_number, trim_strings
from ..session import cut_lineage


@dataclass(frozen=True)
class DataQualityConfig:
    name: str
    expected_columns: list[str]
    non_null_columns: list[str] = field(default_factory=list)
    date_columns: list[str] = field(default_factory=list)
    numeric_columns: list[str] = field(default_factory=list)
    allowed_values: dict[str, list[Any]] = field(default_factory=dict)
    value_ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    unique_keys: list[list[str]] = field(default_factory=list)
    min_rows: int = 1


#: Digests of repeated rows (16 bytes each) are broadcast up to so many.
BROADCAST_DIGESTS = 1_000_000


def distinct_rows(df: DataFrame) -> DataFrame:
    """``df`` without full duplicates (nulls equal each other), for stored tables
    of wide rows: 128-bit digests are shuffled, and rows only if their digest
    occurs more than once; these are compared in full, so no row goes by a
    digest alone. With more repeated digests than can be broadcast, all rows
    are shuffled. ``df`` is read three times."""
    cols = [_col(c) for c in df.columns]
    one = F.xxhash64(*cols)
    two = F.xxhash64(F.lit(1), *cols, *[c.isNull() for c in cols])  # nulls do not count in a hash by themselves
    rows = df.select(one.alias("__one"), two.alias("__two"), "*")
    repeated = cut_lineage(rows.groupBy("__one", "__two").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))
    if repeated.count() > BROADCAST_DIGESTS:
        return df.dropDuplicates()
    single, more = (rows.join(F.broadcast(repeated), ["__one", "__two"], kind).select(*cols) for kind in ("left_anti", "left_semi"))
    return single.unionByName(more.dropDuplicates())


def basic_cleaning(df: DataFrame, by_digest: bool = False) -> DataFrame:
    """Snake-case names, drop full duplicate rows (:func:`distinct_rows` with
    ``by_digest``), then strip text columns.

    The order matters: rows that differ only by surrounding spaces are still
    distinct when duplicates are dropped, as in the rule this follows."""
    named = snake_case_names(df)
    return trim_strings(distinct_rows(named) if by_digest else named.dropDuplicates())


def _col(name: str) -> F.Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _is_missing(df: DataFrame, name: str) -> F.Column:
    c = _col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def column_issues(df: DataFrame, cfg: DataQualityConfig) -> list[str]:
    """Missing / unexpected columns (schema only, no data read)."""
    missing = set(cfg.expected_columns) - set(df.columns)
    extra = set(df.columns) - set(cfg.expected_columns)
    out = []
    if missing:
        out.append(f"Missing columns: {sorted(missing)}")
    if extra:
        out.append(f"Unexpected columns: {sorted(extra)}")
    return out


class Measures:
    """The aggregates that the checks of ``cfg`` need over ``df``, by name."""

    def __init__(self, df: DataFrame, cfg: DataQualityConfig, numeric: list[str] | None = None):
        self.plain: dict[str, F.Column] = {"rows": F.count(F.lit(1))}
        self.distinct: dict[str, F.Column] = {}
        #: (check, column, name of the measure; None for an absent column)
        self.counts: list[tuple[str, str | None, str | None]] = [("rows", None, "rows")]
        for i, col in enumerate(cfg.non_null_columns):
            if col in df.columns:
                self.plain[f"null{i}"] = F.count_if(_is_missing(df, col))
            self.counts.append(("nulls", col, f"null{i}") if col in df.columns else ("missing", col, None))
        for i, (col, bounds) in enumerate(cfg.value_ranges.items()):
            if col not in df.columns:
                continue
            num = to_number(df, col)  # NaN and text that is not a number compares as null, never out of range
            for check, bound, beyond in zip(("below_min", "above_max"), bounds, (num.__lt__, num.__gt__)):
                if bound is not None:
                    self.plain[f"{check}{i}"] = F.count_if(F.coalesce(beyond(F.lit(bound)), F.lit(False)))
                    self.counts.append((check, col, f"{check}{i}"))
        #: (column, name); the number of distinct values outside its allowed set
        self.allowed = []
        for i, (col, bad) in enumerate(_outside(df, cfg)):
            self.distinct[f"allowed{i}"] = F.count_distinct(F.when(bad, F.struct(_col(col).cast("string"))))
            self.allowed.append((col, f"allowed{i}"))
        #: (key columns, name); the number of distinct keys (nulls equal each other)
        self.keys = []
        for i, key in enumerate(k for k in cfg.unique_keys if all(c in df.columns for c in k)):
            self.distinct[f"key{i}"] = F.count_distinct(F.struct(*[_col(c) for c in key]))
            self.keys.append((key, f"key{i}"))
        #: (column, name) of the numeric columns' mean, deviation, least and largest value
        self.spread = []
        for i, col in enumerate(c for c in (numeric or []) if c in df.columns):
            num = to_number(df, col).cast("double")
            for stat, agg in (("mean", F.avg), ("dev", F.stddev_samp), ("min", F.min), ("max", F.max)):
                self.plain[f"{stat}{i}"] = agg(num)
            self.spread.append((col, str(i)))

    def row(self, df: DataFrame) -> DataFrame:
        """All measures as one row of one scan."""
        return df.agg(*[agg.alias(name) for name, agg in {**self.plain, **self.distinct}.items()])

    def observed(self, df: DataFrame, plain: dict[str, Any]) -> DataFrame:
        """The row, with the plain measures as they were observed; ``df`` is read only for distinct counts."""
        known = [F.lit(v).cast("double" if isinstance(v, float) else "long" if isinstance(v, int) else "double").alias(k) for k, v in plain.items()]
        if self.distinct:
            return df.agg(*[agg.alias(name) for name, agg in self.distinct.items()]).select("*", *known)
        return df.sparkSession.range(1).select(*known)

    def anomalous(self, z_threshold: float) -> F.Column:
        """The numeric columns with a value ``z_threshold`` sample deviations from
        the mean: the least or the largest value is one, if any is."""
        hits = []
        for col, i in self.spread:
            mean, dev = F.col(f"mean{i}"), F.col(f"dev{i}")
            far = F.greatest((F.col(f"max{i}") - mean) / dev, (mean - F.col(f"min{i}")) / dev)
            hits.append(F.when(dev.isNotNull() & (dev != 0) & ~F.isnan(dev) & F.coalesce(far >= z_threshold, F.lit(False)), F.lit(col)))
        return F.array_sort(F.filter(F.array(*hits), lambda c: c.isNotNull())) if hits else F.array().cast("array<string>")


def scan_counts(df: DataFrame, cfg: DataQualityConfig) -> DataFrame:
    """Row count, null counts of the non-null columns and out-of-range counts,
    all from one aggregate; returned long as (check, column_name, n). An
    absent non-null column gives a ``missing`` row with null n."""
    m = Measures(df, cfg)
    one = df.agg(*[agg.alias(name) for name, agg in m.plain.items()])
    return one.select(F.inline(_counts(m)))


def _counts(m: Measures) -> F.Column:
    return F.array(*[F.struct(F.lit(check).alias("check"), F.lit(col).cast("string").alias("column_name"),
                              (F.col(name) if name else F.lit(None)).cast("long").alias("n")) for check, col, name in m.counts])


def _outside(df: DataFrame, cfg: DataQualityConfig) -> list[tuple[str, F.Column]]:
    """(column, whether its value is outside the allowed set) of the present columns; null is outside."""
    out = []
    for col, allowed in cfg.allowed_values.items():
        if col not in df.columns:
            continue
        # only values of the column's kind can be equal to one of its values
        # (text is never equal to a number); comparing across kinds would make
        # Spark cast the column, which fails on the first text that is not one
        dtype = df.schema[col].dataType
        if isinstance(dtype, T.StringType):
            vals = [v for v in allowed if isinstance(v, str)]
        elif isinstance(dtype, T.NumericType):
            vals = [v for v in allowed if isinstance(v, (int, float)) and not isinstance(v, bool)]
        else:
            vals = list(allowed)
        out.append((col, ~(F.coalesce(_col(col).isin(vals), F.lit(False)) if vals else F.lit(False))))
    return out


def allowed_violations(df: DataFrame, cfg: DataQualityConfig) -> DataFrame:
    """Distinct values outside each allowed set; null counts as outside.
    Absent columns are skipped. Long form (column_name, bad_value)."""
    found = [F.when(bad, F.struct(F.lit(col).alias("column_name"), _col(col).cast("string").alias("bad_value"))) for col, bad in _outside(df, cfg)]
    if not found:
        return df.sparkSession.createDataFrame([], "column_name string, bad_value string")
    # one scan for all columns: each row's bad values become rows, then distinct ones
    hits = df.select(F.explode(F.array(*found)).alias("e")).where(F.col("e").isNotNull())
    return hits.select("e.column_name", "e.bad_value").distinct()


def duplicate_keys(df: DataFrame, cfg: DataQualityConfig) -> DataFrame:
    """Rows beyond the first for each composite key (nulls equal each other).
    Keys with an absent column are skipped. (key_columns, n_duplicated).
    One scan for all keys: each row is expanded to its keys and these are
    combined in the tasks before they are shuffled."""
    m = Measures(df, cfg)
    if not m.keys:
        return df.sparkSession.createDataFrame([], "key_columns string, n_duplicated long")
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[m.distinct[name].alias(name) for _, name in m.keys])
    return one.select(F.inline(F.array(*[F.struct(F.lit(",".join(key)).alias("key_columns"), (F.col("rows") - F.col(name)).alias("n_duplicated")) for key, name in m.keys])))


def numeric_anomalies(df: DataFrame, numeric_columns: list[str] | None = None,
                      z_threshold: float = 4.0) -> DataFrame:
    """Rows whose value is at least ``z_threshold`` sample deviations from the
    column mean, per numeric column, long form: (column_name, z_score, row...).

    Mean and deviation of all columns come from one aggregate used as a
    scalar subquery (one row by construction); columns with zero or undefined
    deviation are skipped."""
    if numeric_columns is None:
        numeric_columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    cols = [c for c in numeric_columns if c in df.columns]
    schema = "column_name string, z_score double, " + ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields
    )
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    def num(c: str) -> F.Column:
        return to_number(df, c).cast("double")

    stats = df.agg(*[
        F.struct(F.avg(num(c)).alias("m"), F.stddev_samp(num(c)).alias("s")).alias(f"s{i}")
        for i, c in enumerate(cols)
    ])
    # one scalar subquery for all columns, one scan of the rows: each row
    # carries the list of its flagged columns, exploded into output rows
    all_stats = stats.select(F.struct(*[f"s{i}" for i in range(len(cols))])).scalar()
    flagged = []
    for i, c in enumerate(cols):
        st = all_stats.getField(f"s{i}")
        sd = st.getField("s")
        z = (num(c) - st.getField("m")) / sd
        valid = sd.isNotNull() & (sd != 0) & ~F.isnan(sd)
        flagged.append(F.when(valid & F.coalesce(F.abs(z) >= z_threshold, F.lit(False)),
                              F.struct(F.lit(c).alias("column_name"), z.alias("z_score"))))
    exploded = df.select(F.explode(F.array(*flagged)).alias("_hit"), *[_col(x) for x in df.columns])
    return exploded.where(F.col("_hit").isNotNull()).select(
        "_hit.column_name", "_hit.z_score", *[_col(x) for x in df.columns]
    )


def _py_list(values: list[str]) -> str:
    return "[" + ", ".join(repr(v) for v in values) + "]"


def _issue_list(df: DataFrame, cfg: DataQualityConfig, m: Measures) -> F.Column:
    """array<struct<seq, issue>> in check order, null entries where a check found nothing."""
    def issue(seq: int, found: F.Column | bool, text: F.Column | str) -> F.Column:
        entry = F.struct(F.lit(seq).cast("int").alias("seq"), (F.lit(text) if isinstance(text, str) else text).alias("issue"))
        return F.when(F.lit(found) if isinstance(found, bool) else found, entry)

    # The issue texts, here and below (the allowed-set text has a count instead of a list).
    out = [issue(i, True, text) for i, text in enumerate(column_issues(df, cfg))]
    nulls = {c: i for i, c in enumerate(cfg.non_null_columns)}
    ranges = {c: i for i, c in enumerate(cfg.value_ranges)}
    for check, col, name in m.counts:
        n = F.col(name) if name else None
        if check == "missing":
            out.append(issue(100 + nulls[col], True, f"Non-null column '{col}' is missing from dataframe"))
        elif check == "nulls":
            out.append(issue(100 + nulls[col], n > 0, F.format_string("Column '%s' has %d null values", F.lit(col), n)))
        elif check == "rows":
            out.append(issue(200, n < cfg.min_rows, F.format_string("Dataset has %d rows, less than required minimum %d", n, F.lit(cfg.min_rows))))
        else:
            low = check == "below_min"
            text = f"Column '{col}' has values {'below minimum' if low else 'above maximum'} {cfg.value_ranges[col][0 if low else 1]}"
            out.append(issue((400 if low else 401) + 2 * ranges[col], n > 0, text))
    # allowed sets: the text has the number of distinct bad values, the values
    # themselves are rows of ``allowed_violations`` (there may be any number)
    for col, name in m.allowed:
        out.append(issue(300 + list(cfg.allowed_values).index(col), F.col(name) > 0, F.format_string("Column '%s' contains %d values outside allowed set", F.lit(col), F.col(name))))
    for key, name in m.keys:
        n = F.col("rows") - F.col(name)
        out.append(issue(500 + cfg.unique_keys.index(key), n > 0, F.format_string("Composite key %s has %d duplicated rows", F.lit(_py_list(key)), n)))
    return F.array_sort(F.filter(F.array(*out), lambda e: e.isNotNull()))


def issues(df: DataFrame, cfg: DataQualityConfig) -> DataFrame:
    """Human-readable issues in check order, one row each: (seq, issue). One scan."""
    m = Measures(df, cfg)
    return m.row(df).select(F.inline(_issue_list(df, cfg, m)))


def quality_result(raw: DataFrame | int, clean: DataFrame, cfg: DataQualityConfig,
                   z_threshold: float = 4.0, observed: dict[str, Any] | None = None) -> DataFrame:
    """One-row result: name, rows before / after, columns, issues (ordered),
    columns with z-score anomalies, and acceptable = no issues.

    ``raw`` may be its row count, where that is known. ``observed``: the plain
    measures of ``clean``, where its writing has observed them (see
    :func:`observed_save`). What is left is one scan of ``clean`` at most."""
    m = Measures(clean, cfg, cfg.numeric_columns)
    row = m.row(clean) if observed is None else m.observed(clean, observed)
    before = F.lit(raw).cast("long") if isinstance(raw, int) else raw.select(F.count(F.lit(1))).scalar()
    return row.select(
        F.lit(cfg.name).alias("dataset_name"),
        before.alias("n_rows_before"),
        F.col("rows").alias("n_rows_after"),
        F.lit(len(clean.columns)).alias("n_columns"),
        F.transform(_issue_list(clean, cfg, m), lambda e: e.getField("issue")).alias("issues"),
        m.anomalous(z_threshold).alias("anomaly_columns"),
    ).withColumn("is_acceptable", F.size("issues") == 0)


def observed_save(df: DataFrame, save, aggs: dict[str, F.Column]) -> dict[str, Any]:
    """Runs ``save(frame)``, which writes the frame, and returns the aggregates
    over the rows written. They are taken in the writing tasks, the last ones of
    the job, whose results Spark counts once however often a task is tried."""
    seen = Observation()
    save(df.observe(seen, *[agg.alias(name) for name, agg in aggs.items()]))
    return seen.get


def guess_rules(df: DataFrame, name: str, min_rows: int = 1000) -> DataQualityConfig:
    """Rules guessed from names and types: date-like names, numeric columns,
    and non-null for line / station / date-like names (schema only)."""
    cols = list(df.columns)
    dates = [c for c in cols if "fecha" in c.lower() or "date" in c.lower()]
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    # The name hints.
    words = ["linea", "line", "station", "estacion", "fecha", "date"]
    non_null = [c for c in cols if any(w in c.lower() for w in words)]
    return DataQualityConfig(name=name, expected_columns=cols, non_null_columns=non_null,
                             date_columns=dates, numeric_columns=numeric, min_rows=min_rows)
