"""Arrow text columns as numpy byte blocks, words and word shingles.

A block is a run of whole rows whose texts sit behind each other in one byte
array, with the row borders beside it. Blocks hold a few MB (one longer row is
a block of its own), so the memory of a task does not depend on the batch.
Words are maximal runs of "word bytes"; every separator used here is ASCII, so
working on UTF-8 bytes gives the same words as working on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
_RNG = np.random.RandomState(20240229)


def _random_u64(n: int) -> np.ndarray:
    hi, lo = _RNG.randint(0, 1 << 32, n, dtype=np.uint64), _RNG.randint(0, 1 << 32, n, dtype=np.uint64)
    return (hi << np.uint64(32)) | lo


BYTE_VALUE = _random_u64(256)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
STEP = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_VALUE = BYTE_VALUE[LOWER]

# Word bytes: everything but ASCII white space / ASCII letters, digits and non-ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of BASE (or of its inverse), modulo 2**64."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        step = np.full(max(n, BLOCK_BYTES + 2), BASE_INVERSE if inverse else BASE, np.uint64)
        step[0] = 1
        made = np.multiply.accumulate(step)
        if n > 8 * BLOCK_BYTES:  # for one very long row: not kept
            return made
        _powers[key] = have = made
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_array(col) -> pa.Array:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    return pc.fill_null(col, "")


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, borders) for runs of rows of about ``limit`` bytes; null texts are empty."""
    n = batch.num_rows
    if not n:
        return
    col = text_array(batch.column(column))
    _, at, chars = col.buffers()
    border = np.frombuffer(at, np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(chars, np.uint8) if chars is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(border, border[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield batch.slice(lo, hi - lo), data[border[lo]:border[hi]], border[lo:hi + 1] - border[lo]
        lo = hi


def word_spans(data: np.ndarray, border: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the first word of each row (plus the number of words)."""
    return mask_spans(is_word[data], border)


def mask_spans(inside: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes that no row border cuts, and the first run of each row (plus their number)."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    a = border[:-1][border[:-1] < border[1:]]
    b = border[1:][border[:-1] < border[1:]] - 1
    first[a], last[b] = inside[a], inside[b]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, border)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray = LOWER_VALUE) -> np.ndarray:
    """64-bit hashes of the words; ``value`` maps bytes (by default with A-Z lower-cased)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    term = np.zeros(n + 1, np.uint64)
    np.multiply(value[data], powers(n)[:n], out=term[:n])
    pairs = np.empty(2 * len(starts), np.int64)
    pairs[0::2], pairs[1::2] = starts, ends
    total = np.add.reduceat(term, pairs)[0::2]
    return mix(total * powers(n, inverse=True)[starts] + (ends - starts).astype(np.uint64) * STEP)


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words, borders between rows not heeded."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= BASE
        out += words[j:j + n]
    return mix(out)


def shingles(words: np.ndarray, word_at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles row by row, and their row borders. A row
    with fewer words gives its whole sequence as one; a row without words none."""
    count = np.diff(word_at)
    number = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(number)])
    out = np.empty(at[-1], np.uint64)
    every = rolling(words, k)
    if len(every):
        room = np.diff(np.concatenate([word_at, [len(words)]]))[:-1]
        row = np.repeat(np.arange(len(count)), room)
        valid = (np.arange(len(words)) + k <= word_at[1:][row])[:len(every)]
        long_rows = np.repeat(count >= k, number)
        out[long_rows] = every[valid]
    for i in np.flatnonzero((count > 0) & (count < k)):
        own = words[word_at[i]:word_at[i + 1]]
        out[at[i]] = rolling(own, len(own))[0] ^ np.uint64(len(own))
    return out, at


def distinct_by_row(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and their row borders."""
    parts = [np.unique(values[at[i]:at[i + 1]]) for i in range(len(at) - 1)]
    border = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else values[:0]), border
