"""File sources: CSV with encoding fallback, folders of CSV with differing
headers, optional reads, first-available source selection, demo frames and
dataset profiles.

Only the distinct header lines pass through the driver; files are listed and
read by Spark.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import py_number, py_strip
from ..functions.lines import SUBTE_LINES
from ..session import cut_lineage
from .csv_records import Quotes, as_paths, file_path_col, head_cells, records, split_maps, split_states

# Texts pandas reads as missing by default.
NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


#: File names and header lines (some hundred bytes each) are broadcast up to so many files, else joined by a shuffle.
BROADCAST_FILES = 100_000


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file, folder or glob resolves (a listing, no data read)."""
    try:
        spark.read.format("binaryFile").load(path)
        return True
    except AnalysisException:
        return False


def null_na_texts(df: DataFrame) -> DataFrame:
    """Text cells that read as missing by default become null."""
    return df.select(*[
        F.when(_named(f.name).isin(list(NA_VALUES)), F.lit(None)).otherwise(_named(f.name))
        .alias(f.name) if isinstance(f.dataType, T.StringType) else _named(f.name)
        for f in df.schema.fields
    ])


def type_counts(df: DataFrame) -> dict[str, F.Column]:
    """The aggregates that :func:`typed` decides by: of every text column its
    non-null values, and those that are whole numbers and numbers."""
    out = {"rows": F.count(F.lit(1))}
    for i, f in enumerate(df.schema.fields):
        if isinstance(f.dataType, T.StringType):
            v = _named(f.name)
            out[f"n{i}"], out[f"l{i}"], out[f"d{i}"] = F.count(v), F.count(py_strip(v).try_cast("long")), F.count(py_number(v))
    return out


def typed(df: DataFrame, counts: dict) -> DataFrame:
    """Text columns whose every non-null value is a whole number become BIGINT,
    else a number DOUBLE; others stay text."""
    cols = []
    for i, f in enumerate(df.schema.fields):
        c, n = _named(f.name), counts.get(f"n{i}")
        if n and counts[f"l{i}"] == n:
            c = py_strip(c).try_cast("long")
        elif n and counts[f"d{i}"] == n:
            c = py_number(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def infer_types(df: DataFrame) -> DataFrame:
    """:func:`typed` by one aggregate pass."""
    return counted_types(df)[0]


def counted_types(df: DataFrame) -> tuple[DataFrame, int]:
    """(:func:`typed` rows, their number) by one aggregate pass."""
    counts = df.agg(*[agg.alias(name) for name, agg in type_counts(df).items()]).first().asDict()
    return typed(df, counts), counts["rows"]


def file_facts(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """One row per file: its name, whether all of its bytes are UTF-8, its
    first line that is not blank, and ``by_line``: whether each line is a record
    of its own (no quoted cell goes on in the next line, every quote opens,
    closes or is doubled in a quoted cell). One scan of the lines in tasks; a
    per-file aggregate."""
    lines = spark.read.text(path).select(
        file_path_col().alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("i"), F.col("value").cast("binary").alias("raw"))
    text = F.col("raw").cast("string")
    s = _in_class(sep)
    cell = f'(?:"[^"]*+(?:""[^"]*+)*+"|[^"{s}]*+)'
    alone = ~F.contains(text, F.lit('"')) | F.decode("raw", "ISO-8859-1").rlike(f"^(?:\u00ef\u00bb\u00bf)?{cell}(?:[{s}]{cell})*+\r?$")
    begins = (F.col("block") == 0) & (F.trim(F.translate(text, "\r\t", "  ")) != "")
    head = F.min_by(F.when(begins, F.col("raw")), F.when(begins, F.col("i")))
    facts = lines.groupBy("file").agg(F.every(F.is_valid_utf8(text)).alias("is_utf8"), head.alias("head"), F.every(alone).alias("by_line"))
    first = F.when(F.col("is_utf8"), F.decode("head", "UTF-8")).otherwise(F.decode("head", "ISO-8859-1"))
    return facts.select("file", "is_utf8", F.regexp_replace(first, "^\ufeff|\r$", "").alias("head"), "by_line")


def _in_class(sep: str) -> str:
    """The separator as it stands inside a pattern's brackets."""
    return "\\" + sep if sep in "\\]^-[&" else sep


def load_csv(spark: SparkSession, path: str | list[str], sep: str = ",", multi_line: bool = True, wide: str = "error") -> DataFrame:
    """CSV files with a header as one table of text columns, by column name.

    Every file is UTF-8 or, if any of its bytes (header included) are not,
    Latin-1. Files may differ in their headers: columns are matched by decoded
    name, absent ones are null; a name that a header repeats gets .1, .2 and so
    on. Quotes in quoted cells are doubled; cells and header names may hold
    line breaks. The missing-value texts become null; rows with fewer cells
    than their header end in nulls. Blank lines are no rows. A quoted cell that
    never ends raises ValueError.

    ``wide``: a row with non-empty cells beyond its header raises an error when
    it is read (``error``), or has them as an array in the column ``_extra``,
    null in other rows (``extra``).

    Files whose lines are records go to Spark's reader, parsed as Latin-1
    (which keeps every byte) with the cells of UTF-8 files decoded; the others
    are cut into records split by split (:mod:`.csv_records`), so a file of any
    size is read by many tasks either way. ``multi_line=False`` takes every
    line for a record unseen. The names of the files that are not by line (as
    Spark's own listing has them) and the distinct headers come to the driver."""
    if wide not in ("error", "extra"):
        raise ValueError(f"wide must be 'error' or 'extra', not {wide!r}")
    Quotes(sep)  # refuses separators of other than one ASCII character
    if isinstance(path, str) and not path_exists(spark, path):
        raise FileNotFoundError(f"File does not exist: {path}")
    facts = cut_lineage(file_facts(spark, path, sep))
    if not multi_line:
        facts = facts.withColumn("by_line", F.lit(True))
    broken = {utf8: sorted(r[0] for r in facts.where(~F.col("by_line") & (F.col("is_utf8") == utf8)).select("file").collect()) for utf8 in (True, False)}
    parts = []
    lined = facts.where("by_line and head is not null")
    if not lined.isEmpty():
        paths = as_paths([r[0] for r in lined.select("file").collect()]) if any(broken.values()) else path
        parts.append(_by_line(spark, paths, lined, sep))
    for utf8, encoding in ((True, "utf-8"), (False, "latin-1")):
        if broken[utf8]:
            parts.append(_by_record(spark, broken[utf8], sep, encoding))
    if not parts:
        raise FileNotFoundError(f"no files with a header line in {path}")
    names = list(dict.fromkeys(n for _, columns in sorted(parts, key=lambda p: p[1]) for n in columns))
    if wide == "extra" and "_extra" in names:
        raise ValueError("a header has the name _extra")
    rows, _ = parts[0]
    for more, _ in parts[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    extra = F.col("__extra")
    if wide == "extra":
        return null_na_texts(rows.select(*[_named(n) for n in names], extra.alias("_extra")))
    # in a filter, so that no choice of columns lets such a row through
    message = F.format_string("a row has %d cells beyond its header, the first is: %s", F.size(extra), extra[0])
    rows = rows.where(F.when(extra.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(True))
    return null_na_texts(rows.select(*[_named(n) for n in names]))


def _named(name: str) -> F.Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _filled(cells: F.Column) -> F.Column:
    """The cells if any is not empty, else null."""
    return F.when(F.exists(cells, lambda c: F.coalesce(c != "", F.lit(False))), cells)


def _by_line(spark: SparkSession, paths: str | list[str], facts: DataFrame, sep: str) -> tuple[DataFrame, list[str]]:
    """(rows with a column per name and __extra, names) of files whose lines are records."""
    heads = sorted(r[0] for r in facts.select("head").distinct().collect())
    headers = {h: _unique(next(csv.reader([h], delimiter=sep), [])) for h in heads}
    width = max(1, max(len(names) for names in headers.values()))
    cells = [f"_c{i}" for i in range(width)]
    # all cells are parsed (no column pruning): only so does the reader notice a row of another width
    rows = (spark.read.options(header="true", sep=sep, encoding="ISO-8859-1", escape='"', mode="PERMISSIVE", multiLine="false",
                               enforceSchema="true", columnPruning="false", columnNameOfCorruptRecord="__line")
            .schema(", ".join(f"{c} string" for c in [*cells, "__line"])).csv(paths))
    facts = facts.select(F.col("file").alias("__file"), "is_utf8", "head")
    if facts.count() <= BROADCAST_FILES:
        facts = F.broadcast(facts)
    rows = rows.select(*cells, "__line", file_path_col().alias("__file")).join(facts, "__file")
    decoded = lambda c: F.when(F.col("is_utf8"), F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")).otherwise(c)
    rows = rows.select("head", *[decoded(F.col(c)).alias(c) for c in cells], decoded(F.col("__line")).alias("__line"))
    # each named column is the cell at its place in the row's own header
    names = list(dict.fromkeys(n for h in heads for n in headers[h]))
    out = []
    for name in names:
        places: dict[int, list[str]] = {}
        for h in heads:
            if name in headers[h]:
                places.setdefault(headers[h].index(name), []).append(h)
        if len(heads) == 1:
            value = F.col(cells[headers[heads[0]].index(name)])
        else:
            value = F.coalesce(*[F.when(F.col("head").isin(hs), F.col(cells[i])) for i, hs in places.items()])
        out.append(value.alias(name))
    by_width: dict[int, list[str]] = {}
    for h in heads:
        by_width.setdefault(len(headers[h]), []).append(h)
    n = F.lit(width)
    for k, hs in by_width.items():
        n = F.when(F.col("head").isin(hs), F.lit(k)).otherwise(n) if len(by_width) > 1 else F.lit(k)
    s = _in_class(sep)
    line = F.col("__line")
    cut = F.transform(F.split(line, f'[{s}](?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda c: F.when(
        c.startswith('"'), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    seps = F.length(line) - F.length(F.replace(line, F.lit(sep), F.lit("")))
    # a row as wide as the widest header may stand under a shorter one (the reader refuses a query of __line alone, so one cell is always named)
    least = max(1, min(by_width))
    own = F.slice(F.array(*cells[least - 1:]), n - least + 2, width)
    extra = F.when(line.isNull(), _filled(own)).when(seps >= n, _filled(F.slice(cut, n + 1, F.size(cut))))
    return rows.select(*out, extra.alias("__extra")), names


def _by_record(spark: SparkSession, files: list[str], sep: str, encoding: str) -> tuple[DataFrame, list[str]]:
    """As :func:`_by_line`, of files whose records may span lines."""
    states = cut_lineage(split_states(split_maps(spark, files, sep)))
    last = states.groupBy("file").agg(F.max_by("after", "block").alias("after")).where("after").first()
    if last is not None:
        raise ValueError(f"a quoted cell of {last[0]} never ends")
    rows = records(spark, files, sep, encoding, states)
    found = {r[0]: head_cells(bytes(r[1]), sep, encoding) for r in states.where("head is not null").select("file", "head").collect()}
    if len(found) < len(files):  # a header longer than its split
        found = {r[0]: r[1] for r in rows.where("first").select("file", "cells").collect()}
    headers = {f: _unique(c) for f, c in found.items()}
    distinct = sorted(set(map(tuple, headers.values())))
    places = spark.createDataFrame([(f, distinct.index(tuple(h)), len(h)) for f, h in headers.items()], "file string, header int, n int")
    rows = rows.where(~F.col("first")).join(F.broadcast(places), "file")
    names = list(dict.fromkeys(n for h in distinct for n in h))
    value = lambda n: F.coalesce(*[F.when(F.col("header") == i, F.get("cells", F.lit(h.index(n)))) for i, h in enumerate(distinct) if n in h])
    extra = F.when(F.size("cells") > F.col("n"), _filled(F.slice("cells", F.col("n") + 1, F.size("cells"))))
    return rows.select(*[value(n).alias(n) for n in names], extra.alias("__extra")), names


def _unique(names: list[str]) -> list[str]:
    """Header names; a repeated one gets .1, .2 and so on, as pandas names it."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(f"{n}.{k}" if k else n)
    return out


def load_folder(spark: SparkSession, pattern: str, sep: str = ";", multi_line: bool = True) -> DataFrame:
    """All CSV files of a folder or glob, concatenated by column name."""
    return load_csv(spark, pattern, sep, multi_line)


def read_optional(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame | None:
    """The table at ``path``, or None when it is missing or cannot be read."""
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    if fmt == "csv":
        options = {"header": "true", "escape": '"', "multiLine": "true", **options}
    try:
        if not path_exists(spark, path):
            return None
        df = spark.read.format(fmt).options(**options).load(path)
        df.schema  # noqa: B018 - forces the read of metadata
        return df
    except AnalysisException:  # missing, or not such a file
        return None
    except PySparkException as exc:  # a file of another format; anything else is an error of the caller's
        if "FOOTER" in str(exc.getCondition()) or "FAILED_READ_FILE" in str(exc.getCondition()):
            return None
        raise


def first_available(candidates: Sequence[tuple[str, Callable[[], DataFrame | None], set[str]]]
                    ) -> tuple[str, DataFrame] | None:
    """The first candidate whose frame exists, has the required columns and
    holds at least one row (``isEmpty`` reads one row, not the table)."""
    for name, load, required in candidates:
        df = load()
        if df is None or not required.issubset(df.columns):
            continue
        if not df.isEmpty():
            return name, df
    return None


def demo_frames(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Demo passengers and headway by line (used only when no data exists)."""
    # The demo figures.
    passengers = [120000, 95000, 87000, 110000, 76000, 64000]
    headway = [3.5, 4.0, 4.2, 3.8, 5.0, 4.6]
    pax = spark.createDataFrame(list(zip(SUBTE_LINES, passengers)), "line string, passengers long")
    hw = spark.createDataFrame(list(zip(SUBTE_LINES, headway)), "line string, avg_headway_min double")
    return pax, hw


# Name hints for dataset profiling.
LINE_NAMES = {"line", "línea", "linea", "line_name", "linea_nombre", "linea_id", "line_id"}
HEADWAY_NAMES = {"avg_headway_min", "headway_min", "avg_headway"}
HEADWAY_WORDS = ["headway", "frecuencia", "intervalo", "tiempo", "min"]


def profile(df: DataFrame, name: str = "") -> DataFrame:
    """Columns with their type and detected role (line, headway by name or by
    numeric keyword), plus the row count. Roles come from the schema only."""
    lowers = {c.lower(): c for c in df.columns}
    line_col = next((lowers[c] for c in sorted(LINE_NAMES) if c in lowers), None)
    hw_exact = next((lowers[c] for c in sorted(HEADWAY_NAMES) if c in lowers), None)
    hw_kw = next((f.name for f in df.schema.fields
                  if any(k in f.name.lower() for k in HEADWAY_WORDS) and isinstance(f.dataType, T.NumericType)),
                 None)
    roles = {}
    for col, role in ((hw_kw, "headway_keyword"), (hw_exact, "headway"), (line_col, "line")):
        if col is not None:
            roles[col] = role
    rows = [(name, f.name, f.dataType.simpleString(), roles.get(f.name)) for f in df.schema.fields]
    spark = df.sparkSession
    cols = spark.createDataFrame(rows, "dataset string, column_name string, dtype string, role string")
    n = df.select(F.count(F.lit(1))).scalar()
    return cols.withColumn("n_rows", n)


def first_rows(df: DataFrame, name: str = "", order: Sequence[str] | None = None, n: int = 5) -> DataFrame:
    """The first ``n`` rows as one row per row number and column (dataset, row,
    column_name, value as text). A table has no order of its own: ``order``
    names the columns to order by (ascending, nulls first), all in turn by default."""
    cols = {c: F.col("`" + c.replace("`", "``") + "`") for c in df.columns}
    by = [cols[c].asc_nulls_first() for c in (order or df.columns)]
    top = df.orderBy(*by).limit(n).withColumn("__row", F.row_number().over(Window.orderBy(*by)).cast("long"))
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), v.cast("string").alias("value")) for c, v in cols.items()])
    return top.select(F.lit(name).alias("dataset"), F.col("__row").alias("row"), F.inline(cells))
