"""Secret scans over whole texts, driven by a trigram inverted index.

Every rule is a regular expression. From its parse tree a Boolean query over
trigrams is derived: concatenation gives AND, alternation gives OR, and parts
without a literal of three characters give nothing. Each block of texts gets
an inverted index (trigram -> rows) over the trigrams that any rule asks for;
a rule's query is answered by intersecting and uniting postings, and only the
rows that remain are read by the regular expression. A rule whose query is
empty (no mandatory trigram) reads every row. Texts are indexed with A-Z
lower-cased, so one index serves both kinds of case.

The index lives in the task that read the block: no shuffle, memory bounded by
the block, and a lost executor only repeats its own splits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textblocks import LOWER, blocks

try:
    from re import _constants as C, _parser as parser
except ImportError:  # older Python
    import sre_constants as C
    import sre_parse as parser


@dataclass(frozen=True)
class Rule:
    """``group``/``least``: the part of a match that must have so many characters."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    fold: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.fold else 0))


# The base rules of the contract.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
# Well-known public token formats; their spans come on top of the base ones.
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

# A query is True (no condition), a trigram, or ("and" | "or", frozenset of queries).
Query = bool | bytes | tuple


def _both(a: Query, b: Query) -> Query:
    parts = {p for q in (a, b) if q is not True for p in (q[1] if isinstance(q, tuple) and q[0] == "and" else (q,))}
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def _either(queries: Iterable[Query]) -> Query:
    queries = list(queries)
    if not queries or any(q is True for q in queries):
        return True
    parts = {p for q in queries for p in (q[1] if isinstance(q, tuple) and q[0] == "or" else (q,))}
    return next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def _of_text(text: str) -> Query:
    raw = bytes(LOWER[np.frombuffer(text.encode(), np.uint8)])
    out: Query = True
    for i in range(len(raw) - 2):
        out = _both(out, raw[i:i + 3])
    return out


#: Literal texts that a part of a pattern can take are followed up to so many.
MOST_TEXTS = 64


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every match of ``pattern`` satisfies."""

    def walk(nodes) -> tuple[Query, set[str] | None]:
        """(condition, all texts the part can be or None if not a short list)."""
        cond: Query = True
        texts: set[str] | None = None  # texts of the literal run that is open
        whole: set[str] | None = {""}

        def close() -> None:
            nonlocal cond, texts
            if texts:
                cond = _both(cond, _either(_of_text(t) for t in texts))
            texts = None

        for op, arg in nodes:
            own_cond: Query = True
            own: set[str] | None = None
            if op is C.LITERAL:
                own = {chr(arg)}
            elif op is C.SUBPATTERN:
                own_cond, own = walk(arg[3])
            elif op is C.BRANCH:
                branches = [walk(b) for b in arg[1]]
                if all(t is not None for _, t in branches):
                    own = set().union(*(t for _, t in branches))
                own_cond = _either(c for c, _ in branches)
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) or op is getattr(C, "POSSESSIVE_REPEAT", None):
                least, most, inner = arg
                inner_cond, inner_texts = walk(inner)
                if inner_texts is not None and most == 1:
                    own = inner_texts | ({""} if least == 0 else set())
                elif inner_texts is not None and least == most and most <= 4:
                    own = {""}
                    for _ in range(most):
                        own = {a + b for a in own for b in inner_texts}
                elif least:
                    own_cond = inner_cond
            elif op is C.IN and all(k is C.LITERAL for k, _ in arg):
                own = {chr(v) for _, v in arg}
            elif op is C.AT:
                own = {""}
            if own is not None and len(own) <= MOST_TEXTS:
                joined = {a + b for a in (texts or {""}) for b in own}
                if len(joined) > MOST_TEXTS:
                    close()
                    joined = own
                texts = joined
            else:
                close()
                own = None
            if own is None:
                cond = _both(cond, own_cond)
                whole = None
            elif whole is not None:
                whole = {a + b for a in whole for b in own}
                whole = whole if len(whole) <= MOST_TEXTS else None
        close()
        return cond, whole

    return walk(parser.parse(pattern, re.ASCII))[0]


def _trigrams(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1]))


class Index:
    """Postings of one block for the trigrams that ``queries`` ask for."""

    def __init__(self, data: np.ndarray, border: np.ndarray, trigrams: list[bytes], table: np.ndarray):
        self.rows = len(border) - 1
        self.postings: dict[bytes, np.ndarray] = {t: np.zeros(0, np.int64) for t in trigrams}
        if len(data) >= 3 and trigrams:
            low = LOWER[data].astype(np.uint32)
            code = table[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
            at = np.flatnonzero(code)
            row = np.searchsorted(border, at, "right") - 1
            keep = at + 3 <= border[row + 1]
            key = np.unique(code[at[keep]].astype(np.int64) * self.rows + row[keep])
            which, row = key // self.rows, key % self.rows
            cut = np.searchsorted(which, np.arange(1, len(trigrams) + 2))
            for i, t in enumerate(trigrams):
                self.postings[t] = row[cut[i]:cut[i + 1]]

    def answer(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.rows)
        if isinstance(query, bytes):
            return self.postings[query]
        parts = sorted((self.answer(q) for q in query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


def _spans(rule: Rule, regex: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in regex.finditer(text) if len(m.group(rule.group)) >= rule.least]


def faster(rule: Rule) -> Rule:
    """A rule that is one character class repeated has maximal runs as its
    matches, so the least length can go into the pattern."""
    parsed = list(parser.parse(rule.pattern, re.ASCII))
    if rule.group == 0 and rule.least > 1 and len(parsed) == 1 and parsed[0][0] is C.MAX_REPEAT \
            and parsed[0][1][:2] == (1, C.MAXREPEAT) and parsed[0][1][2][0][0] is C.IN and rule.pattern.endswith("]+"):
        return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least},}}", 0, rule.least, rule.fold)
    return rule


def spans_by_row(batches: Iterator[pa.RecordBatch], column: str, rules: tuple[Rule, ...]
                 ) -> Iterator[tuple[pa.RecordBatch, pa.Array, list[list[tuple[int, int, int]]]]]:
    """For each block: its rows, its texts, and per row the (start, rule, end) spans in code points, sorted."""
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted(set().union(*map(_trigrams, queries)))
    table = np.zeros(1 << 24, np.uint16)
    for i, t in enumerate(trigrams):
        table[(t[0] << 16) | (t[1] << 8) | t[2]] = i + 1
    rules = [faster(r) for r in rules]
    regexes = [r.compiled() for r in rules]
    for batch in batches:
        for part, data, border in blocks(batch, column):
            index = Index(data, border, trigrams, table)
            texts = [None] * part.num_rows
            found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            raw = data.tobytes()
            for k, (rule, regex, query) in enumerate(zip(rules, regexes, queries)):
                for i in index.answer(query):
                    if texts[i] is None:
                        texts[i] = raw[border[i]:border[i + 1]].decode("utf-8", "replace")
                    found[i] += [(a, k, b) for a, b in _spans(rule, regex, texts[i])]
            for f in found:
                f.sort()
            yield part, texts, found


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES,
                 base: int = len(BASE_RULES)) -> DataFrame:
    """One row per document: id, a count for each of the first ``base`` rules,
    the SHA-256 of their spans and all spans as text.

    Spans are ``kind:start:end`` (code points, end exclusive), comma-joined by
    start and then in the order of the rules; per rule they are the leftmost
    non-overlapping matches, without those whose measured part is too short.
    A null or empty text has no spans; repeated rows and null ids give a row
    each; other columns are not read.
    """
    names = [r.kind for r in rules]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, found in spans_by_row(batches, "text", rules):
            text = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
            counts = np.zeros((base, part.num_rows), np.int64)
            for i, spans in enumerate(found):
                for _, k, _ in spans:
                    if k < base:
                        counts[k, i] += 1
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), *(pa.array(c) for c in counts),
                 pa.array([hashlib.sha256(text([s for s in f if s[1] < base]).encode()).hexdigest() for f in found]),
                 pa.array([text(f) for f in found], pa.string())],
                names=["id", *(f"n_{n}" for n in names[:base]), "base_sha256", "spans"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"n_{n} bigint" for n in names[:base]) + ", base_sha256 string, spans string"
    return rows.mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping and touching
    spans once); rows, columns and other values stay. A null text stays null."""
    where = docs.columns.index(text_col)
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    name = f"c{where}"

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, found in spans_by_row(batches, name, rules):
            if any(found):
                out = part.column(name).to_pylist()
                for i, spans in enumerate(found):
                    if spans:
                        pieces, last = [], 0
                        for a, _, b in spans:
                            if a > last or not pieces:
                                pieces += [texts[i][last:a], mark]
                            last = max(last, b)
                        out[i] = "".join([*pieces, texts[i][last:]])
                part = part.set_column(where, part.schema.field(where), pa.array(out, part.schema.field(where).type))
            yield part

    return inner.mapInArrow(clean, inner.schema).toDF(*docs.columns)
