"""DuckDB SQL fragments for the oracle side (same semantics as the Spark
column functions in :mod:`railyard.functions`)."""

from __future__ import annotations

# The characters Python's ``str.strip()`` removes, as an RE2 class.
PY_WS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
ALL_LINES_SQL = "('A','B','C','D','E','H','P')"
SUBTE_SQL = "('A','B','C','D','E','H')"


def strip(e: str) -> str:
    return f"regexp_replace(CAST({e} AS VARCHAR), '^{PY_WS}+|{PY_WS}+$', '', 'g')"


def canonical_ah(e: str) -> str:
    t = strip(e)
    return (
        f"(CASE WHEN {t} IS NULL THEN NULL "
        f"WHEN regexp_matches({t}, '(?i)^[a-h]$') THEN upper({t}) "
        f"WHEN regexp_matches({t}, '(?i)^l[ií]nea\\s*[a-h]$') "
        f"THEN upper(regexp_extract({t}, '(?i)^l[ií]nea\\s*([a-h])$', 1)) "
        f"WHEN regexp_matches({t}, '(?i)[a-h]') THEN upper(regexp_extract({t}, '(?is)^.*([a-h])', 1)) "
        f"ELSE {t} END)"
    )


def canonical_az(e: str) -> str:
    t = strip(e)
    return (
        f"(CASE WHEN {t} IS NULL THEN NULL "
        f"WHEN regexp_matches({t}, '^[A-Za-z]$') THEN upper({t}) "
        f"WHEN regexp_matches({t}, '(?i)^l[ií]nea\\s*[a-z]$') "
        f"THEN upper(regexp_extract({t}, '(?i)^l[ií]nea\\s*([a-z])$', 1)) "
        f"WHEN regexp_matches({t}, '[A-Za-z]') THEN upper(regexp_extract({t}, '(?s)^.*([A-Za-z])', 1)) "
        f"ELSE {t} END)"
    )


def normalize(e: str) -> str:
    t = strip(e)
    first = f"upper(regexp_extract({t}, '([A-Za-z])', 1))"
    return (
        f"(CASE WHEN {t} IS NULL THEN NULL "
        f"WHEN regexp_matches({t}, '(?i)premetro') THEN 'P' "
        f"WHEN regexp_matches({t}, '[Ll][ií]ne?a\\s*[A-Za-z]') "
        f"THEN upper(regexp_extract({t}, '[Ll][ií]ne?a\\s*([A-Za-z])', 1)) "
        f"WHEN length({t}) = 1 AND upper({t}) IN {ALL_LINES_SQL} THEN upper({t}) "
        f"WHEN {first} IN {ALL_LINES_SQL} THEN {first} "
        f"ELSE {t} END)"
    )


def day_first(e: str) -> str:
    t = strip(e)
    clocks = ("", " %H:%M:%S.%f", " %H:%M:%S", " %H:%M", " %I:%M:%S %p", " %I:%M %p")
    fmts = ", ".join(f"'%d{sep}%m{sep}{y}{tail}'" for y in ("%y", "%Y") for sep in "/-." for tail in clocks)
    return f"coalesce(CASE WHEN regexp_matches({t}, '^\\d{{4}}-') THEN try_cast({t} AS TIMESTAMP) END, try_strptime({t}, [{fmts}]))"


def week(e: str) -> str:
    return f"CAST(date_trunc('week', {e}) AS DATE)"


def month(e: str) -> str:
    return f"strftime({e}, '%Y-%m')"


def days_in_month(ym: str) -> str:
    return f"dayofmonth(last_day(CAST(try_cast(concat({ym}, '-01') AS TIMESTAMP) AS DATE)))"
