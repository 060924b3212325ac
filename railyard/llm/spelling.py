"""Spelling variants: words one edit apart, by a variable-length gram index.

1. Words are counted in the tasks that read the texts; words, not occurrences,
   are shuffled.
2. Gram dictionary: a gram of a padded word that is in many words is too
   frequent to stand alone and is extended by a letter, from ``SHORTEST`` to
   ``LONGEST`` letters. The dictionary is the set of these frequent prefixes;
   its limit follows from the number of grams, so that each length has at most
   ``PREFIXES`` of them, whatever the vocabulary. It steers the lists' lengths,
   not the results: any dictionary gives the same near words.
3. A word is decomposed into the grams that start at each letter (as long as
   the dictionary says), without those that end no later than an earlier one.
   Such a gram depends on a window of ``LONGEST`` letters only, so one edit
   affects at most those whose window holds it: the largest number of them
   over all edits is the word's bound. A near word has all but so many of the
   word's grams, moved by one place at most.
4. Hence two near words share a gram among the bound + 1 grams of either that
   come first in any common order (rarest first): only these short lists are
   read, each keyed by gram, place and length. In a list's task, two words are
   merged on the rest of their grams as bitmaps: more grams that the other
   lacks than the bound rule them out; what is left is verified letter by
   letter, and only near words leave the task. Lists longer than ``CHUNK`` are
   dealt into pairs of chunks; none is capped.

With ``LONGEST - 1`` pad letters on each side every word of three letters or
more has a gram that no edit affects, so no pair is beyond the index.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .groups import dealt_pairs, whole_groups
from .textblocks import LOWER, blocks, mask_spans, mix, word_hashes

SHORTEST, LONGEST = 2, 4
PREFIXES = 4096
#: A gram in fewer words than this is never extended.
FREQUENT = 32
CHUNK = 2048
#: Counters that order the grams; a gram's is picked by its hash.
COUNTERS = 1 << 16
#: Distinct words that a task counts before it gives them out.
COUNTED = 200_000
#: Words of more letters are verified one by one.
WIDTH = 64
PAD, END = b"\x01" * (LONGEST - 1), b"\x02" * (LONGEST - 1)

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _crc_table() -> np.ndarray:
    """Of the reflected polynomial 0xEDB88320."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def _crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each span, carried on from ``before``; all spans a byte at a time."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, state = starts[order], before[order] ^ np.uint32(0xFFFFFFFF)
    reach = -size[order]
    for k in range(min(int(size.max(initial=0)), WIDTH)):
        n = int(np.searchsorted(reach, -k, "left"))  # spans longer than k
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + k]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(reach, -WIDTH, "left"))):
        state[i] = zlib.crc32(data[at[i] + WIDTH:at[i] - reach[i]].tobytes(), int(state[i]))
    out = np.empty(len(state), np.uint32)
    out[order] = state
    return out


def _count(data: np.ndarray, border: np.ndarray, ids: list, least: int, every: int) -> Counter:
    """Words of a block, with the letter taken from every ``every``-th."""
    lead = data == 0xC3  # of U+00C0 to U+00FF, and of no other letter
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    starts, ends, at = mask_spans(inside, border)
    leads = np.concatenate([[0], np.cumsum(lead)])
    letters = (ends - starts) - (leads[ends] - leads[starts])
    row = np.repeat(np.arange(len(border) - 1), np.diff(at))
    keep = letters >= least
    starts, ends, letters, row = starts[keep], ends[keep], letters[keep], row[keep]
    low = LOWER[data]
    named = np.array([i is not None for i in ids], bool)
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    crc = _crc32(low, starts, ends, before[row])
    cut = (crc % every == 0) & named[row]
    text, out = low.tobytes(), Counter()
    for i in np.flatnonzero(cut).tolist():
        word = text[starts[i]:ends[i]].decode()
        drop = int(crc[i]) % len(word)
        if len(word) > least:
            out[word[:drop] + word[drop + 1:]] += 1
    starts, ends = starts[~cut], ends[~cut]
    _, first, n = np.unique(word_hashes(data, starts, ends), return_index=True, return_counts=True)
    for a, b, k in zip(starts[first].tolist(), ends[first].tolist(), n.tolist()):
        out[text[a:b].decode()] += k
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5, times: int = 3, every: int = 97) -> DataFrame:
    """word, n: the words of at least ``least`` letters that occur at least
    ``times`` times. Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF,
    A-Z lower-cased. Of a run whose CRC-32 of ``<id>:<run>`` is divisible by
    ``every``, the letter at CRC-32 modulo length is deleted (a null id deletes none)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: Counter = Counter()
        for batch in batches:
            for part, data, border in blocks(batch, "text"):
                have.update(_count(data, border, part.column("id").to_pylist(), least, every))
                if len(have) > COUNTED:
                    yield _given(have)
                    have = Counter()
        yield _given(have)

    def _given(have: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(have.keys(), pa.string()), pa.array(have.values(), pa.int64())], names=["word", "n"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where("text is not null").mapInArrow(count, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _padded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The padded words as bytes (all letters are below U+0100) and their borders."""
    raw = [PAD + w.encode("latin-1") + END for w in words]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def _codes(text: np.ndarray, size: int) -> np.ndarray:
    """Each ``size`` letters as a number (its length in the top byte), row borders not heeded."""
    n = max(0, len(text) - size + 1)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out << np.uint64(8)) | text[k:k + n]
    return out


class Grams:
    """The grams of a batch of words: per gram its row, place, code and length; per row the bound."""

    def __init__(self, words: list[str], frequent: np.ndarray):
        text, border = _padded(words)
        n = len(text)
        row = np.repeat(np.arange(len(words)), np.diff(border))
        left = border[1:][row] - np.arange(n)  # letters up to the end of the row
        size = np.minimum(SHORTEST, left)
        for q in range(SHORTEST, LONGEST):
            code = _codes(text, q)
            at = np.minimum(np.searchsorted(frequent, code), len(frequent) - 1) if len(frequent) else None
            more = np.zeros(n, bool)
            if at is not None:
                more[:len(code)] = frequent[at] == code
            size = np.where((size == q) & more & (left > q), q + 1, size)
        end = np.arange(n) + size
        longest = np.maximum.accumulate(end)
        own = np.ones(n, bool)
        own[1:] = end[1:] > longest[:-1]
        own &= left >= SHORTEST
        at = np.flatnonzero(own)
        self.row, self.size = row[at], size[at]
        self.place = at - border[:-1][self.row]
        self.code = np.zeros(len(at), np.uint64)
        for q in range(SHORTEST, LONGEST + 1):
            mine = self.size == q
            self.code[mine] = _codes(text, q)[at[mine]]
        # an edit of letter i affects the grams that end in i + 1 .. i + LONGEST
        ends = np.zeros(n + LONGEST + 1, np.int64)
        ends[end[at]] = 1
        total = np.concatenate([[0], np.cumsum(ends)])
        inner = (np.arange(n) - border[:-1][row] >= len(PAD)) & (left > len(END))
        letter = np.flatnonzero(inner)
        self.bound = np.maximum.reduceat(total[letter + LONGEST + 1] - total[letter + 1], np.searchsorted(letter, border[:-1])) if len(words) else np.zeros(0, np.int64)
        self.letters = np.diff(border) - len(PAD) - len(END)


def _counter(code: np.ndarray) -> np.ndarray:
    return (mix(code) % np.uint64(COUNTERS)).astype(np.int64)


def _tally(words: DataFrame, make, schema: str) -> DataFrame:
    """Partial counts of the numbers that ``make`` gives for a list of words."""

    def run(batches):
        for batch in batches:
            values, n = np.unique(make(batch.column("word").to_pylist()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(n)], names=["code", "n"])

    return words.select("word").mapInArrow(run, schema).groupBy("code").agg(F.sum("n").alias("n"))


def gram_dictionary(words: DataFrame, prefixes: int = PREFIXES, least: int = FREQUENT) -> np.ndarray:
    """The grams too frequent to stand alone, as sorted codes: at most ``prefixes`` of each length."""

    def every(texts: list[str]) -> np.ndarray:
        text, border = _padded(texts)
        left = np.repeat(border[1:], np.diff(border)) - np.arange(len(text))
        return np.concatenate([_codes(text, q)[left[:len(text) - q + 1] >= q] for q in range(SHORTEST, LONGEST)])

    total = words.agg(F.sum(F.length("word") + len(PAD) + len(END))).first()[0] or 0
    limit = max(least, total // prefixes)
    found = _tally(words, every, "code bigint, n bigint").where(F.col("n") > limit).select("code").collect()
    return np.sort(np.array([r[0] for r in found], np.uint64))


def _order(words: DataFrame, frequent: np.ndarray) -> np.ndarray:
    """How many words have a gram of each counter."""
    out = np.zeros(COUNTERS, np.int64)
    for r in _tally(words, lambda texts: _counter(Grams(texts, frequent).code), "code bigint, n bigint").collect():
        out[r[0]] = r[1]
    return out


def _lists(words: DataFrame, frequent: np.ndarray, order: np.ndarray) -> DataFrame:
    """word, n -> its rows in the lists of its bound + 1 first grams: one as a
    word of its length (base), two as a word one letter shorter than the list's."""

    def index(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 5000):
                part = batch.slice(lo, 5000)
                g = Grams(part.column("word").to_pylist(), frequent)
                bits = (mix(g.code ^ np.uint64(0x5BD1E995)) % np.uint64(128)).astype(np.int64)
                marks = np.zeros((part.num_rows, 128), bool)
                marks[g.row, bits] = True
                marks = np.packbits(marks, axis=1, bitorder="little").view(np.int64)
                by = np.lexsort([g.place, g.code, order[_counter(g.code)], g.row])
                rank = np.arange(len(by)) - np.searchsorted(g.row[by], g.row[by])
                by = by[rank <= g.bound[g.row[by]]]
                row, place, code, size = g.row[by], g.place[by], g.code[by], g.letters[g.row[by]]
                name = lambda p, s: mix(mix(code + np.uint64(0x9E37)) ^ (p.astype(np.uint64) << np.uint64(32)) ^ s.astype(np.uint64))
                key = np.concatenate([name(place, size), name(place, size + 1), name(place + 1, size + 1)]).view(np.int64)
                row, base = np.tile(row, 3), np.arange(3 * len(by)) < len(by)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(base), part.column("word").take(pa.array(row)), part.column("n").take(pa.array(row)),
                     pa.array(g.bound[row].astype(np.int32)), pa.array(marks[row, 0]), pa.array(marks[row, 1])],
                    names=["key", "base", "word", "n", "bound", "bits0", "bits1"])

    return words.select("word", "n").mapInArrow(index, "key bigint, base boolean, word string, n bigint, bound int, bits0 bigint, bits1 bigint")


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i + 1:]


def _verified(words: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of places are one edit apart."""
    size = np.array([len(w) for w in words])
    out = np.zeros(len(i), bool)
    swap = size[i] > size[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    short = size[j] <= WIDTH
    for p in np.flatnonzero(~short).tolist():
        out[p] = one_edit(words[i[p]], words[j[p]])
    used = np.unique(np.concatenate([i[short], j[short]]))
    place = np.zeros(len(words), np.int64)
    place[used] = np.arange(len(used))
    letters = np.zeros((len(used), WIDTH + 1), np.uint8)
    for k, u in enumerate(used.tolist()):
        w = words[u].encode("latin-1")
        letters[k, :len(w)] = np.frombuffer(w, np.uint8)
    column = np.arange(WIDTH)
    for lo in range(0, len(i), 1 << 15):
        p = np.arange(lo, min(len(i), lo + (1 << 15)))
        p = p[short[p]]
        a, b, n = letters[place[i[p]]], letters[place[j[p]]], size[i[p]][:, None]
        differ = (a[:, :-1] != b[:, :-1]) & (column < n)
        same_size = size[i[p]] == size[j[p]]
        shifted = (a[:, :-1] != b[:, 1:]) & (column < n)
        first = np.where(differ.any(1), differ.argmax(1), n[:, 0])
        last = np.where(shifted.any(1), WIDTH - 1 - shifted[:, ::-1].argmax(1), -1)
        out[p] = np.where(same_size, differ.sum(1) == 1, (size[j[p]] - size[i[p]] == 1) & (last < first))
    return out


def near_words(words: DataFrame, prefixes: int = PREFIXES, chunk: int = CHUNK) -> DataFrame:
    """word, n -> (a, n_a, b, n_b): every pair of near words once (a < b)."""
    frequent = gram_dictionary(words, prefixes)
    order = _order(words, frequent)
    rows = stored(_lists(words, frequent, order), "gram_lists")
    shared = rows.groupBy("key").agg(F.count("*").alias("c"), F.max("base").alias("b")).where("c > 1 and b").select("key")
    rows = dealt_pairs(rows.join(shared, "key", "left_semi"), "key", "word", chunk)

    def merge(batches):
        for table, _ in whole_groups(batches, ["key", "cell"]):
            key, cell, own, bound = (table.column(c).to_numpy() for c in ("key", "cell", "own", "bound"))
            base = table.column("base").to_numpy()
            outer = (cell >> 32) != (cell & 0xFFFFFFFF)
            b0, b1 = (table.column(c).to_numpy().view(np.uint64) for c in ("bits0", "bits1"))
            lo, hi = [], []
            i, step = np.arange(len(key) - 1), 0
            while len(i):  # rows `step` apart in one cell
                step += 1
                i = i[i + step < len(key)]
                i = i[(key[i] == key[i + step]) & (cell[i] == cell[i + step])]
                j = i + step
                ok = (base[i] | base[j]) & (~outer[i] | (own[i] != own[j]))
                ok &= np.bitwise_count(b0[i] & ~b0[j]) + np.bitwise_count(b1[i] & ~b1[j]) <= bound[i]
                ok &= np.bitwise_count(b0[j] & ~b0[i]) + np.bitwise_count(b1[j] & ~b1[i]) <= bound[j]
                lo.append(i[ok])
                hi.append(j[ok])
            if not lo:
                continue
            lo, hi = np.concatenate(lo), np.concatenate(hi)
            words = table.column("word").to_pylist()
            ok = _verified(words, lo, hi)
            lo, hi = lo[ok].tolist(), hi[ok].tolist()
            n = table.column("n").to_pylist()
            pairs = {(words[x], n[x], words[y], n[y]) if words[x] < words[y] else (words[y], n[y], words[x], n[x]) for x, y in zip(lo, hi)}
            if pairs:
                a, na, b, nb = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(na, pa.int64()), pa.array(b), pa.array(nb, pa.int64())], names=["a", "n_a", "b", "n_b"])

    parts = max(1, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = rows.repartition(parts, "key", "cell").sortWithinPartitions("key", "cell")
    return stored(cells.mapInArrow(merge, "a string, n_a bigint, b string, n_b bigint").distinct(), "near_words")


def roots(forms: DataFrame) -> DataFrame:
    """word, form (not null) -> word, root: forms followed to the last, in doubled steps."""
    steps = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if steps.join(on, "root", "left_semi").isEmpty():
            return steps
        steps = stored(steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5, times: int = 3, every: int = 97) -> DataFrame:
    """One row per word of :func:`vocabulary`: word, n, form (its near word of
    largest n, the first in code-point order of several, if that n is at least
    twice the word's; else null), form_n, root (forms followed to the last; the
    word itself if it has none) and n_near (number of near words).

    Null and empty texts hold no words; texts and words are taken whole, of any
    length. Repeated rows count again. Other columns are not read; an empty
    table gives none."""
    words = stored(vocabulary(docs, id_col, text_col, least, times, every), "words")
    near = near_words(words)
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = both.groupBy(F.col("a").alias("word"), F.col("n_a").alias("n")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))).alias("best"))
    enough = -F.col("best.less") >= 2 * F.col("n")
    best = stored(best.select("word", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    last = roots(best.where("form is not null"))
    out = words.join(best, "word", "left").join(last, "word", "left")
    return out.select("word", "n", "form", F.coalesce("root", "word").alias("root"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
