"""Column-name and value coercions (names, trimming, dates, numbers, hours).

All value coercions are plain Spark column expressions, so they stay inside
whole-stage codegen and never fail a job on bad text (ANSI ``try_*`` forms).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's ``str.strip()`` removes (``str.isspace``).
# Spark's ``trim`` removes spaces only.
PY_WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def py_strip(c: Column | str) -> Column:
    """Python ``str.strip()`` as a column expression: ``btrim`` with the
    whitespace set, linear in the text length whatever its content."""
    col = F.col(c) if isinstance(c, str) else c
    return F.btrim(col, F.lit(PY_WHITESPACE_CHARS))


def snake_case_names(df: DataFrame) -> DataFrame:
    """Strip, lower-case, and turn spaces and dashes into underscores.

    Two source columns that end up with one name are an error: Spark would
    otherwise keep both and make every later reference ambiguous.
    """
    names = [c.strip().lower().replace(" ", "_").replace("-", "_") for c in df.columns]
    return _rename_all(df, names)


def light_names(df: DataFrame) -> DataFrame:
    """Strip and lower-case column names only."""
    return _rename_all(df, [c.strip().lower() for c in df.columns])


def _rename_all(df: DataFrame, names: list[str]) -> DataFrame:
    seen: dict[str, str] = {}
    for old, new in zip(df.columns, names):
        if new in seen:
            raise ValueError(f"columns {seen[new]!r} and {old!r} both map to {new!r}")
        seen[new] = old
    return df.toDF(*names)


def trim_strings(df: DataFrame) -> DataFrame:
    """Strip every string column the Python way; other columns untouched."""
    cols = [
        py_strip(F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, T.StringType)
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    return df.select(*cols)


# Day-first text with a two- or four-digit year and an optional clock time
# (24 hours, with a fraction, or AM / PM); slash, dash or dot separated.
DAY_FIRST_PATTERNS = tuple(f"d/M/{y}{clock}" for y in ("yyyy", "yy") for clock in ("[ H:mm[:ss[.SSSSSS]]]", " h:mm[:ss] a"))


def day_first_text(text: Column) -> Column:
    """Timestamp from stripped text: ISO first, then day-first; bad text gives
    null. Batch and stream read dates with this one parser."""
    slashed = F.regexp_replace(F.upper(text), r"^(\d{1,2})([-.])(\d{1,2})\2(\d{2,4})", "$1/$3/$4")
    return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(slashed, F.lit(p)) for p in DAY_FIRST_PATTERNS])


def parse_day_first(df: DataFrame, name: str) -> Column:
    """Timestamp from a column that may be text in ISO or day-first form.

    Date and timestamp columns are cast directly; text is tried as ISO first,
    then day-first, per row. Unparseable text gives null.
    """
    dtype = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    return day_first_text(py_strip(c.cast("string")))


def parse_iso_date(c: Column) -> Column:
    """ISO text (or date/timestamp) to DATE; bad text gives null."""
    return F.try_to_timestamp(c.cast("string")).cast("date")


def month_start(year_month: Column) -> Column:
    """``yyyy-MM`` text to the first day of that month; bad text gives null."""
    return F.try_to_timestamp(F.concat(year_month.cast("string"), F.lit("-01"))).cast("date")


def days_in_month(year_month: Column) -> Column:
    return F.dayofmonth(F.last_day(month_start(year_month)))


def to_number(df: DataFrame, name: str, fill_zero: bool = False) -> Column:
    """Numeric value of a column; text that is not a number gives null (or 0).

    Numeric columns keep their type, so exact decimals stay exact."""
    dtype = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if not isinstance(dtype, T.NumericType):
        c = py_number(c)
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        c = nan_to_null(c)
    return F.coalesce(c, F.lit(0)) if fill_zero else c


def py_number(c: Column) -> Column:
    """A number from text the way pandas reads it (``to_numeric``): surrounding
    whitespace allowed; Java's parser would also take type suffixes (5d, 5f)
    and turn overflow (1e400) into infinity, both are missing here."""
    text = py_strip(c.cast("string"))
    num = text.try_cast("double")
    suffix = text.rlike(r"[0-9.][dDfF]$")
    overflow = (F.abs(num) == F.lit(float("inf"))) & ~text.rlike(r"(?i)inf")
    return F.when(suffix | overflow | F.isnan(num), F.lit(None).cast("double")).otherwise(num)


def nan_to_null(c: Column | str) -> Column:
    """NaN is a missing value (Spark would order it above every number); the
    type of the column stays."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(col), col)


def _decimal_digits() -> tuple[str, str]:
    """Every decimal digit of the Basic Multilingual Plane outside ASCII, and
    its ASCII digit (built from the Unicode database, as Python's ``int``
    reads them)."""
    import unicodedata

    src = [chr(cp) for cp in range(0x80, 0x10000) if unicodedata.category(chr(cp)) == "Nd"]
    return "".join(src), "".join(str(unicodedata.decimal(ch)) for ch in src)


_DIGITS_FROM, _DIGITS_TO = _decimal_digits()


def py_int(c: Column) -> Column:
    """Python's ``int(text)``: surrounding whitespace, a sign, any decimal
    digits (not only ASCII) and single underscores between digits; anything
    else gives null."""
    text = F.translate(py_strip(c.cast("string")), _DIGITS_FROM, _DIGITS_TO)
    return F.regexp_replace(text, r"(?<=[0-9])_(?=[0-9])", "").try_cast("int")


def hour_of(c: Column) -> Column:
    """Hour number from ``HH:MM[:SS]`` text: the part before the first colon."""
    return py_int(F.split_part(c.cast("string"), F.lit(":"), F.lit(1)))


def py_round(c: Column, digits: int) -> Column:
    """Python's ``round(x, digits)`` for doubles: the exact binary value
    rounded half-even. Spark's ``round`` rounds the shortest decimal text
    half-up (2.675 -> 2.68; Python gives 2.67). ``format_number`` rounds like
    Python; its text (separators removed) is read back as a double."""
    return F.regexp_replace(F.format_number(c, digits), ",", "").try_cast("double")


def sum0(c: Column | str) -> Column:
    """A grouped sum that is 0, not null, when every value is missing (as a
    grouped sum in pandas is)."""
    return F.coalesce(F.sum(nan_to_null(c)), F.lit(0))
