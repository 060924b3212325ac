"""Repeated passages removed exactly, by two-stage suffix sorting.

A byte goes if it lies in a ``length``-byte string that also starts in a
document with a smaller id. The suffix array of the whole corpus would not fit
a task, so strings that can be equal are brought together first:

1. Equal texts form a class; all but its smallest id are wholly repeated (if
   long enough), and only one text per class goes on.
2. Every window of ``length`` bytes has an anchor: the 24-byte gram in it with
   the smallest hash (the last of equal ones). Equal windows have equal
   anchors. Tasks send their distinct anchor hashes, packed per bucket and
   chunk of rows; buckets answer which of them occur in another document.
3. A chunk takes its texts and these answers and cuts out the segments: the
   windows of one repeated anchor together with their bytes. Segments that are
   equal within a chunk are settled there, and only the smallest id's goes on.
   Anchors that very many chunks share are split: each of their windows
   travels alone, to the bucket of its own hash, so that no bucket gets all
   the surroundings of a common line.
4. A bucket sorts the suffixes of its segments in two stages: only suffixes
   smaller than their successors are sorted directly (to the depth that
   matters), the others are induced by scanning the buckets of first bytes in
   order. Neighbours with a common prefix of ``length`` bytes or more are the
   same window; those whose id is not the smallest of their run are removed.
5. The removed stretches are united per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_ids, stored
from .textblocks import BYTE_VALUE, blocks, mix, powers

LENGTH, GRAM = 50, 24
#: Rows of a chunk at most (a power of two), and buckets of a partition (numbered by a byte).
CHUNK_BITS, BUCKETS_PER_PARTITION = 8, 256
#: Buckets are sorted together up to so many bytes of segments; sorting takes about 100 times as much memory.
SORT_BYTES = 1 << 19
#: Bytes of a chunk of texts that are all as long as the longest.
CHUNK_BYTES = 64 << 20
#: An anchor in more chunks than this is split into single windows.
SHARED_BY = 2_000
#: Row ids are broadcast up to so many (8 bytes each), else joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Window starts hashed at a time; below 2**20 for the position bits.
PIECE = 1 << 19


def anchors(data: np.ndarray, border: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first window, last window) of each anchor, in order; windows are byte starts whose ``length`` bytes lie in one row."""
    gram = min(GRAM, length)
    width = length - gram + 1
    keys, first, last = [], [], []
    n = len(data)
    for lo in range(0, max(0, n - length + 1), PIECE):
        hi = min(n, lo + PIECE + length - 1)
        part = data[lo:hi]
        p = powers(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[part] * p[:len(part)], out=total[1:])
        grams = mix((total[gram:] - total[:-gram]) * powers(len(part), inverse=True)[:len(part) - gram + 1])
        position = np.arange(len(grams), dtype=np.uint64)
        low = (grams & ~np.uint64(0xFFFFF)) | (np.uint64(0xFFFFF) - position)
        span = 1
        while span * 2 <= width:  # minimum over `width` grams by doubling
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
        anchor = (np.uint64(0xFFFFF) - (low & np.uint64(0xFFFFF))).astype(np.int64)
        start = np.arange(lo, lo + len(anchor))
        row = np.searchsorted(border, start, "right") - 1
        ok = start + length <= border[row + 1]
        start, row, anchor = start[ok], row[ok], anchor[ok]
        if not len(start):
            continue
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        keys.append(grams[anchor[at]])
        first.append(start[at])
        last.append(start[np.append(at[1:], len(start)) - 1])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(first), np.concatenate(last)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _short(key: np.ndarray) -> np.ndarray:
    """40 bits of a key; with its bucket enough to tell anchors apart (a chance match only costs a comparison)."""
    return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)


def _packed(short: np.ndarray) -> bytes:
    return (short & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (short >> np.uint64(32)).astype(np.uint8).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    n = len(raw) // 5
    return np.frombuffer(raw, "<u4", n).astype(np.uint64) | (np.frombuffer(raw, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32))


def _send(batches: Iterator[pa.RecordBatch], buckets: int, length: int) -> Iterator[pa.RecordBatch]:
    """bucket, chunk, once, more: packed anchors that one document of a chunk holds, and that several do."""
    for batch in batches:
        chunk = batch.column("chunk").to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(chunk[1:] != chunk[:-1]) + 1, [len(chunk)]])
        for lo, hi in zip(cut[:-1], cut[1:]):
            keys, rows = [], []
            at = 0
            for part, data, border in blocks(batch.slice(lo, hi - lo), "text"):
                key, first, _ = anchors(data, border, length)
                keys.append(key)
                rows.append(at + np.searchsorted(border, first, "right") - 1)
                at += part.num_rows
            key, row = np.concatenate(keys), np.concatenate(rows)
            if not len(key):
                continue
            order = np.lexsort((row, key))
            key, row = key[order], row[order]
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            stop = np.append(start[1:], len(key)) - 1
            several = row[start] != row[stop]
            key = key[start]
            place = _bucket(key, buckets)
            order = np.argsort(place, kind="stable")
            key, several, place = key[order], several[order], place[order]
            edge = np.searchsorted(place, np.arange(buckets + 1))
            out = [(b, _packed(_short(key[x:y][~several[x:y]])), _packed(_short(key[x:y][several[x:y]]))) for b, (x, y) in enumerate(zip(edge[:-1], edge[1:])) if y > x]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int32()), pa.array(np.full(len(out), chunk[lo])), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())],
                names=["bucket", "chunk", "once", "more"])


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The rows of each value of a sorted column."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        value = batch.column(column).to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(value[1:] != value[:-1]) + 1, [len(value)]])
        for lo, hi in zip(cut[:-1], cut[1:]):
            if kept and kept[-1].column(column)[0].as_py() != value[lo]:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(lo, hi - lo))
    if kept:
        yield pa.Table.from_batches(kept)


def _answer(batches: Iterator[pa.RecordBatch], shared_by: int) -> Iterator[pa.RecordBatch]:
    """chunk, bucket, repeated, shared: its anchors that another document holds, and those that very many chunks hold."""
    for table in _groups(batches, "bucket"):
        bucket, chunks = table.column("bucket")[0].as_py(), table.column("chunk").to_numpy()
        once, more = ([_unpacked(x) for x in table.column(c).to_pylist()] for c in ("once", "more"))
        both = [np.concatenate(x) for x in zip(once, more)]
        every = np.concatenate(both)
        of = np.repeat(np.arange(len(both)), [len(x) for x in both])
        weight = np.concatenate([np.concatenate([np.zeros(len(a), bool), np.ones(len(b), bool)]) for a, b in zip(once, more)])
        order = np.argsort(every, kind="stable")
        every, of, weight = every[order], of[order], weight[order]
        start = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        count = np.diff(np.append(start, len(every)))
        repeated = np.repeat((count > 1) | np.logical_or.reduceat(weight, start), count)
        shared = np.repeat(count > shared_by, count)
        order = np.argsort(of[repeated], kind="stable")
        key, own, hot = every[repeated][order], of[repeated][order], shared[repeated][order]
        edge = np.searchsorted(own, np.arange(len(both) + 1))
        out = [(int(chunks[i]), _packed(key[x:y][~hot[x:y]]), _packed(key[x:y][hot[x:y]])) for i, (x, y) in enumerate(zip(edge[:-1], edge[1:])) if y > x]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out]), pa.array(np.full(len(out), bucket, np.int32)), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())],
                                             names=["chunk", "bucket", "repeated", "shared"])


# kind 0: segments for a partition, packed (subs uint8: bucket within it, ids int64, rows of the chunk uint16, starts uint32, sizes - length uint16);
# kind 1: stretches settled within a chunk (rows, starts, stops - starts uint32; ids and bytes empty)
CUT = "bucket int, kind int, chunk bigint, subs binary, ids binary, rows binary, starts binary, sizes binary, bytes binary"
_NAMES = [f.split()[0] for f in CUT.split(", ")]
_KINDS = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each size, behind each other."""
    shift = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    return shift + np.arange(int(size.sum()))


def _segments(part, data, border, known, buckets, length, chunk_bits):
    """(hash, bucket, id, row of the chunk, start in its text, start in the block, size) of the segments of known anchors."""
    n = len(data)
    p = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * p[:n], out=total[1:])
    inverse = powers(n + 1, inverse=True)
    key, first, last = anchors(data, border, length)
    home = _bucket(key, buckets)
    name = (_short(key) << np.uint64(20)) | home.astype(np.uint64)
    ids, rows = part.column("id").to_numpy(), part.column("uid").to_numpy() & ((1 << chunk_bits) - 1)
    for which, have in known.items():
        if not len(have) or not len(name):
            continue
        hit = have[np.minimum(np.searchsorted(have, name), len(have) - 1)] == name
        a, z, bucket = first[hit], last[hit] + length, _bucket(key[hit], buckets * BUCKETS_PER_PARTITION)
        if which == "shared":
            a = _spread(a, z - a - length + 1)
            z = a + length
        digest = mix((total[z] - total[a]) * inverse[a] + (z - a).astype(np.uint64))
        if which == "shared":
            bucket = _bucket(digest, buckets * BUCKETS_PER_PARTITION)
        row = np.searchsorted(border, a, "right") - 1
        yield digest, bucket, ids[row], rows[row], a - border[row], a, z - a


def _cut_chunk(table: pa.Table, buckets: int, length: int, chunk_bits: int) -> Iterator[pa.RecordBatch]:
    """Segments of a chunk's repeated anchors, packed by bucket, and the stretches settled within the chunk."""
    asked = table.filter(pc.equal(table.column("kind"), 0))
    known: dict[str, np.ndarray] = {}
    for name in ("repeated", "shared"):
        keys = [(_unpacked(raw) << np.uint64(20)) | np.uint64(b) for b, raw in zip(asked.column("bucket").to_pylist(), asked.column(name).to_pylist())]
        known[name] = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    chunk = table.column("chunk")[0].as_py()
    parts, texts, base = [], [], 0
    for batch in table.filter(pc.equal(table.column("kind"), 1)).combine_chunks().to_batches():
        for part, data, border in blocks(batch, "text"):
            for digest, bucket, ids, rows, at, a, size in _segments(part, data, border, known, buckets, length, chunk_bits):
                parts.append((digest, bucket, ids, rows, at, base + np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)[:len(size)], size))
                texts.append(data[_spread(a, size)])
                base += len(texts[-1])
    if not base:
        return
    digest, bucket, ids, rows, at, place, size = (np.concatenate(x) for x in zip(*parts))
    text = np.concatenate(texts)
    # equal segments: those of larger ids are settled, every window stands in the smallest id's
    order = np.lexsort((ids, digest))
    start = np.flatnonzero(np.append(True, digest[order][1:] != digest[order][:-1]))
    least = np.repeat(ids[order][start], np.diff(np.append(start, len(order))))
    settled = order[ids[order] > least]
    kept = order[ids[order] == least]
    out = []
    if len(settled):
        gone = list(_united(list(zip(rows[settled].tolist(), at[settled].tolist(), (at + size)[settled].tolist()))))
        pack = lambda k: np.array([g[k] for g in gone], np.uint32)
        out.append((chunk % buckets, 1, chunk, b"", b"", pack(0).astype("<u2").tobytes(), pack(1).tobytes(), (pack(2) - pack(1)).tobytes(), b""))
    home, sub = bucket % buckets, bucket // buckets
    kept = kept[np.argsort(home[kept], kind="stable")]
    edge = np.flatnonzero(np.append(True, home[kept][1:] != home[kept][:-1]))
    for x, y in zip(edge, np.append(edge[1:], len(kept))):
        own = kept[x:y]
        out.append((int(home[own[0]]), 0, chunk, sub[own].astype(np.uint8).tobytes(), ids[own].astype("<i8").tobytes(), rows[own].astype("<u2").tobytes(), at[own].astype("<u4").tobytes(),
                    (size[own] - length).astype("<u2").tobytes(), text[_spread(place[own], size[own])].tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS)], names=_NAMES)


def _united(stretches: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Overlapping and touching (uid, start, stop) joined."""
    uid = a = b = None
    for u, x, y in sorted(stretches):
        if u == uid and x <= b:
            b = max(b, y)
        else:
            if uid is not None:
                yield uid, a, b
            uid, a, b = u, x, y
    if uid is not None:
        yield uid, a, b


class Suffixes:
    """Suffix order of segments (byte strings behind each other), to ``depth`` bytes, of the suffixes of at least ``depth`` bytes."""

    def __init__(self, raw: bytes, sizes: np.ndarray, depth: int):
        self.depth = depth
        self.stop = np.cumsum(sizes)
        start = self.stop - sizes
        n = len(raw)
        padded = np.zeros(n + depth + 16, np.uint8)
        padded[:n] = np.frombuffer(raw, np.uint8)
        self.text = padded
        # first window start after the last one in each segment, from which on nothing needs a place of its own
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.first, self.beyond = start, np.maximum(self.stop - depth + 1, start)
        # the words at every position, big-endian: their order is that of the bytes
        word = np.zeros(n + depth + 8, np.uint64)
        for j in range(8):
            word |= padded[j:j + len(word)].astype(np.uint64) << np.uint64(56 - 8 * j)
        self.word = word

    def sorted(self) -> np.ndarray:
        n = int(self.stop[-1]) if len(self.stop) else 0
        if not n:
            return np.zeros(0, np.int64)
        char = self.text[:n].astype(np.int16) + 1
        after = np.empty(n, np.int16)
        after[:-1] = char[1:]
        ends = self.stop[self.stop > 0] - 1
        after[ends] = 0  # a segment's end is smaller than every byte
        # smaller than its successor: the next different byte is larger
        differs = char != after
        at = np.where(differs, np.arange(n), n)
        nearest = np.minimum.accumulate(at[::-1])[::-1]
        smaller = char[nearest] < after[nearest]
        # needed: window starts, and behind the last one what its place is induced from
        here = np.arange(n)
        first_smaller = np.minimum.accumulate(np.where(smaller, here, n)[::-1])[::-1]
        first_smaller = np.append(first_smaller, n)
        limit = np.minimum(first_smaller[np.minimum(self.beyond, n)], self.stop - 1)
        needed = here <= limit[self.owner]
        directly = here[needed & smaller]
        order = self._direct(directly)
        # stage two: places of the others, bucket of first bytes by bucket
        lists: list[list[np.ndarray]] = [[] for _ in range(258)]

        def induce(places: np.ndarray, least: int) -> np.ndarray:
            """Predecessors that are larger than their successor, at their first byte's bucket; those of the same bucket are returned."""
            q = places - 1
            q = q[places > self.first[self.owner[np.minimum(places, n - 1)]]] if len(places) else q
            q = q[~smaller[q]]
            c = char[q]
            same = q[c == least]
            other = q[c > least]
            if len(other):
                c = char[other]
                by = np.argsort(c, kind="stable")
                other, c = other[by], c[by]
                cut = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
                for x, y in zip(cut, np.append(cut[1:], len(c))):
                    lists[c[x]].append(other[x:y])
            return same

        # ends of segments: the suffix behind the last byte is empty and smallest
        lasting = self.stop[limit == self.stop - 1] - 1
        lasting = lasting[(lasting >= 0) & ~smaller[np.maximum(lasting, 0)]] if len(lasting) else lasting
        if len(lasting):
            lasting = np.unique(lasting)
            c = char[lasting]
            by = np.argsort(c, kind="stable")
            for x in np.split(lasting[by], np.flatnonzero(np.diff(c[by])) + 1):
                lists[char[x[0]]].append(x)
        out = []
        first_byte = char[order]
        edge = np.searchsorted(first_byte, np.arange(259))
        for c in range(1, 257):
            round_ = np.concatenate(lists[c]) if lists[c] else np.zeros(0, np.int64)
            larger = []
            while len(round_):
                larger.append(round_)
                round_ = induce(round_, c)
            out += larger
            own = order[edge[c]:edge[c + 1]]
            if len(own):
                out.append(own)
                induce(own, c)
        every = np.concatenate(out) if out else np.zeros(0, np.int64)
        return every[every < self.beyond[self.owner[every]]]

    def _direct(self, places: np.ndarray) -> np.ndarray:
        """Sorted by their first bytes up to the depth, word by word; only ties go on."""
        stop = self.stop[self.owner[places]]
        order = np.arange(len(places))
        group = np.zeros(len(places), np.int64)
        open_ = np.arange(len(places))  # positions in `order` whose place is still shared
        for at in range(0, self.depth, 8):
            if not len(open_):
                break
            member = order[open_]
            p = places[member] + at
            left = np.clip(stop[member] - p, 0, 8).astype(np.uint64)
            key = self.word[np.minimum(p, len(self.word) - 1)]
            shift = (np.uint64(8) - left) * np.uint64(8)
            key = np.where(left == 0, np.uint64(0), (key >> np.minimum(shift, np.uint64(63))) << np.minimum(shift, np.uint64(63)))
            by = np.lexsort((key, group[open_]) if left.min() == 8 else (left, key, group[open_]))
            order[open_] = member[by]
            g, k, f = group[open_][by], key[by], left[by]
            new = np.append(True, (g[1:] != g[:-1]) | (k[1:] != k[:-1]) | (f[1:] != f[:-1]))
            group[open_] = np.cumsum(new)
            open_ = open_[~(new & np.append(new[1:], True))]
        return places[order]

    def same_as_before(self, order: np.ndarray) -> np.ndarray:
        """Whether each suffix of ``order`` shares ``depth`` bytes with the one before it."""
        same = np.zeros(len(order), bool)
        if len(order) > 1:
            same[1:] = True
            a, b = order[1:], order[:-1]
            for at in [*range(0, self.depth - 7, 8), self.depth - 8]:
                same[1:] &= self.word[a + at] == self.word[b + at]
        return same


def _settle(batches: Iterator[pa.RecordBatch], length: int, chunk_bits: int) -> Iterator[pa.RecordBatch]:
    """uid, start, stop of what a bucket's segments have in common with smaller ids."""
    for table in _groups(batches, "bucket"):
        kinds = table.column("kind").to_numpy()
        edge = int(np.searchsorted(kinds, 1))  # sorted by kind too
        stretches = table.slice(edge)
        if stretches.num_rows:
            start, size = _column(stretches, "starts", "<u4").astype(np.int64), _column(stretches, "sizes", "<u4").astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(_uids(stretches, chunk_bits)), pa.array(start), pa.array(start + size)], names=["uid", "start", "stop"])
        table = table.slice(0, edge)
        subs, sizes = _column(table, "subs", np.uint8), _column(table, "sizes", "<u2").astype(np.int64) + length
        columns = _column(table, "ids", "<i8").astype(np.int64), _uids(table, chunk_bits), _column(table, "starts", "<u4"), sizes
        text = _column(table, "bytes", np.uint8)
        place = np.cumsum(sizes) - sizes
        order = np.argsort(subs, kind="stable")
        for x, y in _runs(np.bincount(subs, sizes, BUCKETS_PER_PARTITION), np.bincount(subs, minlength=BUCKETS_PER_PARTITION)):
            own = order[x:y]
            ids, uids, starts, size = (c[own] for c in columns)
            yield from _settled(ids, uids, starts.astype(np.int64), size, text[_spread(place[own], size)].tobytes(), length)


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    """The numbers packed in a binary column, those of all rows behind each other."""
    parts = []
    for chunk in table.column(name).cast(pa.large_binary()).chunks:
        _, at, raw = chunk.buffers()
        border = np.frombuffer(at, np.int64)[chunk.offset:chunk.offset + len(chunk) + 1] if len(chunk) else ()
        if len(border) and border[-1] > border[0]:
            parts.append(np.frombuffer(raw, np.uint8)[border[0]:border[-1]].view(kind))
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, kind)


def _uids(table: pa.Table, chunk_bits: int) -> np.ndarray:
    """uid of each segment or stretch of the rows."""
    each = pc.binary_length(table.column("rows")).to_numpy() // 2
    return (np.repeat(table.column("chunk").to_numpy(), each) << chunk_bits) + _column(table, "rows", "<u2")


def _runs(weight: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last place of the segments that are sorted together: those of consecutive buckets, up to SORT_BYTES or a single one."""
    x = y = total = 0
    for w, n in zip(weight.tolist(), count.tolist()):
        if y > x and total + w > SORT_BYTES:
            yield x, y
            x, total = y, 0
        y, total = y + n, total + w
    if y > x:
        yield x, y


def _settled(ids, uids, starts, sizes, raw: bytes, length: int) -> Iterator[pa.RecordBatch]:
    """The suffix order of one bucket's segments, and what of them smaller ids hold."""
    suffixes = Suffixes(raw, sizes, length)
    order = suffixes.sorted()
    if not len(order):
        return
    run = np.flatnonzero(~suffixes.same_as_before(order))
    doc = ids[suffixes.owner[order]]
    least = np.repeat(np.minimum.reduceat(doc, run), np.diff(np.append(run, len(order))))
    gone = np.sort(order[doc > least])
    if not len(gone):
        return
    own = suffixes.owner[gone]
    new = np.append(True, (own[1:] != own[:-1]) | (gone[1:] > gone[:-1] + length))
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(gone)) - 1
    at = starts[own[a]] - suffixes.first[own[a]]
    yield pa.RecordBatch.from_arrays([pa.array(uids[own[a]]), pa.array(gone[a] + at), pa.array(gone[z] + at + length)], names=["uid", "start", "stop"])


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def removed_stretches(rows: DataFrame, length: int = LENGTH, shared_by: int = SHARED_BY, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """uid, start, stop (bytes; may overlap) of what repeats smaller ids; ``rows``: uid, id (long), text, with different texts."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = min(1 << 20, parts)
    chunked = rows.withColumn("chunk", F.shiftright("uid", chunk_bits))
    sent = chunked.select("chunk", "text").mapInArrow(lambda b: _send(b, buckets, length), "bucket int, chunk bigint, once binary, more binary")
    asked = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: _answer(b, shared_by), "chunk bigint, bucket int, repeated binary, shared binary")
    asked = stored(asked, "anchors")
    none = lambda kind: F.lit(None).cast(kind)
    texts = chunked.select("chunk", F.lit(1).alias("kind"), none("int").alias("bucket"), none("binary").alias("repeated"), none("binary").alias("shared"), "uid", "id", "text")
    answers = asked.select("chunk", F.lit(0).alias("kind"), "bucket", "repeated", "shared", none("bigint").alias("uid"), none("bigint").alias("id"), none("string").alias("text"))
    together = texts.unionByName(answers).repartition(parts, "chunk").sortWithinPartitions("chunk", "kind")

    def cut(batches):
        for table in _groups(batches, "chunk"):
            yield from _cut_chunk(table, buckets, length, chunk_bits)

    segments = together.mapInArrow(cut, CUT).repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")
    return segments.mapInArrow(lambda b: _settle(b, length, chunk_bits), "uid bigint, start bigint, stop bigint")


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   shared_by: int = SHARED_BY, chunk_bits: int | None = None) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans (maximal removed
    runs) and kept_sha256 (of the remaining bytes).

    Texts are UTF-8 bytes; null is empty. Rows with one id never repeat each
    other; a row without an id neither loses bytes nor counts as smaller than
    any. Texts shorter than ``length`` stay. Other columns are not read; an
    empty table gives an empty result. ``length`` is at least 8. A task holds a
    chunk of 2 ** ``chunk_bits`` texts at once, by default so many (``CHUNK_BITS``
    at most) that the longest text so often is no more than ``CHUNK_BYTES``.
    """
    rows = docs.select(row_ids(docs), docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    facts = stored(rows.select("uid", "id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("digest")), "facts")
    long = facts.where((F.col("n_bytes") >= length) & F.col("id").isNotNull())
    if chunk_bits is None:
        longest = long.agg(F.max("n_bytes")).first()[0] or 1
        chunk_bits = max(0, min(CHUNK_BITS, (CHUNK_BYTES // longest).bit_length() - 1))
    classes = long.groupBy("digest", "n_bytes").agg(F.min(F.struct("id", "uid")).alias("best"))
    ranked = stored(long.join(classes, ["digest", "n_bytes"]).select("uid", "id", F.col("best.id").alias("least"), F.col("best.uid").alias("first")), "classes")
    others = ranked.where("uid <> first").select("uid")
    texts = rows.where((F.octet_length("text") >= length) & F.col("id").isNotNull()).join(_small(others), "uid", "left_anti")
    stretches = stored(removed_stretches(texts, length, shared_by, chunk_bits), "stretches")
    by_text = stretches.groupBy("uid").agg(F.collect_list(F.struct("start", "stop")).alias("gone"))  # bounded by the text
    picked = rows.select("uid", "text").join(_small(stretches.select("uid").distinct()), "uid", "left_semi").join(by_text, "uid")

    def keep(batches):
        for batch in batches:
            out = []
            for text, gone in zip(batch.column("text"), batch.column("gone")):
                raw, pieces, n, spans, at = text.as_py().encode("utf-8"), [], 0, 0, 0
                for _, a, b in _united([(0, g["start"], g["stop"]) for g in gone.as_py()]):
                    pieces.append(raw[at:a])
                    n, spans, at = n + b - a, spans + 1, b
                out.append((n, spans, hashlib.sha256(b"".join([*pieces, raw[at:]])).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())],
                                             names=["first", "n_removed", "n_spans", "kept_sha256"])

    cut = picked.mapInArrow(keep, "first bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    known = ranked.join(cut, "first", "left").select(
        "uid", (F.col("id") > F.col("least")).alias("copy"), "n_removed", "n_spans", "kept_sha256")
    out = facts.join(known, "uid", "left")
    whole = F.coalesce("copy", F.lit(False))
    return out.select(
        F.col("id").alias(id_col), "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"))
