"""Line-label normalisers.

Three rule sets exist because three parts of the workload disagree on the same
label (for example ``Premetro``): the headway ETL keeps letters A-H, the
insights page any letter, and the forecast knows the Premetro line. Each is one
``when`` chain of regular expressions, evaluated JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import py_strip

# Metro lines and the light-rail line.
SUBTE_LINES = ("A", "B", "C", "D", "E", "H")
PREMETRO_LINES = ("P",)
ALL_LINES = SUBTE_LINES + PREMETRO_LINES


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def canonical_line_ah(c: Column | str) -> Column:
    """Letter A-H: a single letter, ``Linea X`` / ``LíneaX``, else the last
    A-H letter anywhere (case-insensitive), upper-cased; else the stripped
    text. Null stays null.

    The first two rules always end in the last A-H letter of the text (no
    other character folds into a-h), so one greedy extraction covers all
    three (the oracle keeps the rules apart and so checks this)."""
    text = py_strip(_col(c).cast("string"))
    last = F.regexp_extract(text, r"(?ius)^.*([a-h])", 1)
    return F.when(last != "", F.upper(last)).otherwise(text)


def canonical_line_az(c: Column | str) -> Column:
    """As :func:`canonical_line_ah` with any letter. The ``Linea X`` rule is
    kept apart here: matched without regard to case it also takes letters
    that fold into a-z (the long s becomes ``S``), which the last-ASCII-letter
    rule would skip."""
    text = py_strip(_col(c).cast("string"))
    named = F.regexp_extract(text, r"(?iuU)^l[ií]nea\s*([a-z])$", 1)
    last = F.regexp_extract(text, r"(?s)^.*([A-Za-z])", 1)
    return F.when(named != "", F.upper(named)).when(last != "", F.upper(last)).otherwise(text)


def normalize_line(c: Column | str) -> Column:
    """Forecast rule set: anything mentioning Premetro is P; ``Linea X`` or
    ``Lína X`` anywhere gives X; a single known letter; else the first letter
    if it is a known line; else the stripped text. Null stays null (it never
    passes the known-line filter that follows)."""
    text = py_strip(_col(c).cast("string"))
    known = F.array(*[F.lit(x) for x in ALL_LINES])
    named = _empty_to_null(F.regexp_extract(text, r"(?U)[Ll][ií]ne?a\s*([A-Za-z])", 1))
    first = F.upper(F.regexp_extract(text, r"([A-Za-z])", 1))
    return (
        F.when(text.rlike(r"(?iu)premetro"), F.lit("P"))
        .when(named.isNotNull(), F.upper(named))
        .when((F.length(text) == 1) & F.array_contains(known, F.upper(text)), F.upper(text))
        .when(F.array_contains(known, first), first)
        .otherwise(text)
    )


def in_lines(c: Column | str, lines=ALL_LINES) -> Column:
    """Membership that is false (not null) for a null label."""
    return F.coalesce(_col(c).isin(list(lines)), F.lit(False))
