"""SimHash near-duplicates, candidates pruned by the pigeonring.

1. One pass over the texts gives each document the 64-bit fingerprint of its
   word shingles, repeats included. Documents with equal fingerprints are one
   class from here on (combined map-side).
2. A fingerprint is cut into ``SEGMENTS`` segments in a ring. If two differ in
   at most ``bits`` bits, there is a segment from which every chain of l
   consecutive segments differs in at most l * bits / SEGMENTS bits (rounded
   down). With three segments and two bits: one segment equal, it and the next
   within one bit, all within two. A class goes to a bucket for each segment's
   value; in its task, two of a bucket are candidates if each chain from that
   segment stays within its budget, and only then get the whole Hamming check.
3. A bucket of more than ``CHUNK`` classes is not compared as such: its rows go
   on to buckets of the chain of two segments, the second one with every change
   its budget allows on one side, and a bucket still larger is dealt into
   pairs of chunks. No bucket is capped, and tasks hold some 2 * CHUNK rows.
4. Tasks give out links that connect what all verified links connect, at most
   one a class and batch; components are found over these.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_ids, stored
from .components import connected_components
from .groups import dealt_pairs, spanning, whole_groups
from .textblocks import LOWER, NOT_SPACE, blocks, word_spans

SEGMENTS = 3
#: Classes of a bucket that are compared as they are.
CHUNK = 2048
#: Class names are broadcast up to so many rows (16 bytes each), else joined by a shuffle.
BROADCAST_CLASSES = 1_000_000


@dataclass(frozen=True)
class Ring:
    """Fingerprints of ``words``-word shingles, hashed with ``seed``; linked at ``bits`` or fewer differing bits."""
    words: int = 3
    bits: int = 2
    seed: int = 42
    segments: int = SEGMENTS
    chunk: int = CHUNK

    def budget(self, chain: int) -> int:
        return chain * self.bits // self.segments

    def places(self) -> list[tuple[int, int]]:
        """(first bit, number of bits) of the segments."""
        cut = [64 * i // self.segments for i in range(self.segments + 1)]
        return [(lo, hi - lo) for lo, hi in zip(cut, cut[1:])]

    def masks(self) -> list[int]:
        return [((1 << n) - 1) << lo for lo, n in self.places()]

    def chains(self) -> np.ndarray:
        """[start, length - 1]: the bits of that chain of segments."""
        m = self.masks()
        out = np.zeros((self.segments, self.segments), np.uint64)
        for s in range(self.segments):
            bits = 0
            for n in range(self.segments):
                bits |= m[(s + n) % self.segments]
                out[s, n] = bits
        return out


def _shingle_hashes(data: np.ndarray, border: np.ndarray, ring: Ring) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the shingles (words joined by one space, A-Z lower-cased) row by row, and their row borders."""
    starts, ends, at = word_spans(data, border, NOT_SPACE)
    size = ends - starts
    first = np.concatenate([[0], np.cumsum(size + 1)])
    spaced = np.full(first[-1], 0x20, np.uint8)
    spaced[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = LOWER[data[NOT_SPACE[data]]]
    count, k = np.diff(at), ring.words
    number = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    row_at = np.concatenate([[0], np.cumsum(number)])
    row = np.repeat(np.arange(len(count)), number)
    lo = at[:-1][row] + np.arange(row_at[-1]) - row_at[:-1][row]
    hi = lo + np.minimum(count[row], k) - 1
    text, digest, seed = spaced.tobytes(), xxhash.xxh64_intdigest, ring.seed
    hashes = np.fromiter((digest(text[x:y], seed) for x, y in zip(first[lo].tolist(), (first[hi] + size[hi]).tolist())), np.uint64, len(lo)) if len(lo) else np.zeros(0, np.uint64)
    return hashes, row_at


def fingerprints(rows: DataFrame, ring: Ring = Ring()) -> DataFrame:
    """uid, id, text -> uid, id, fp (the fingerprint's 64 bits as a long). A bit
    is set if it is in over half the hashes; no words: zero."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, border in blocks(batch, "text"):
                hashes, at = _shingle_hashes(data, border, ring)
                fp = np.zeros(part.num_rows, np.uint64)
                full = np.flatnonzero(np.diff(at))
                if len(full):
                    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    ones = np.add.reduceat(bits, at[:-1][full], axis=0, dtype=np.int64)
                    most = 2 * ones > np.diff(at)[full][:, None]
                    fp[full] = np.packbits(most, axis=1, bitorder="little").view(np.uint64)[:, 0]
                yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("id"), pa.array(fp.view(np.int64))], names=["uid", "id", "fp"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("uid", "id", "text").mapInArrow(sign, f"uid bigint, id {kind}, fp bigint")


def _buckets(classes: DataFrame, ring: Ring) -> DataFrame:
    """fp -> key, start, fp: a row for each segment."""
    value = [F.col("fp").bitwiseAND(F.lit(np.uint64(m).view(np.int64).item())) for m in ring.masks()]
    rows = F.array(*[F.struct(F.xxhash64(F.lit(s), v).alias("key"), F.lit(s).alias("start")) for s, v in enumerate(value)])
    return classes.select("fp", F.inline(rows)).select("key", "start", "fp")


def _longer(rows: DataFrame, ring: Ring) -> DataFrame:
    """key, start, fp -> the rows of buckets of two segments: the class with its
    own (``base``), and with each change of the second segment that the budget allows."""

    def flips(place: tuple[int, int]) -> np.ndarray:
        lo, n = place
        return np.array([sum(1 << (lo + b) for b in c) for k in range(1, ring.budget(2) + 1) for c in combinations(range(n), k)], np.uint64)

    changes, chains = [flips(p) for p in ring.places()], ring.chains()

    def extend(batches):
        mix = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                fp, start = part.column("fp").to_numpy().view(np.uint64), part.column("start").to_numpy()
                for s in np.unique(start):
                    own = fp[start == s]
                    change = np.concatenate([[np.uint64(0)], changes[(s + 1) % ring.segments]])
                    pair = (own[:, None] ^ change[None, :]) & chains[s, 1]
                    key = (pair * mix) ^ (pair >> np.uint64(29)) ^ np.uint64(s)
                    n = len(change)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.ravel().view(np.int64)), pa.array(np.full(len(own) * n, s, np.int32)), pa.array(np.repeat(own, n).view(np.int64)),
                         pa.array(np.tile(np.arange(n) == 0, len(own)))], names=["key", "start", "fp", "base"])

    return rows.mapInArrow(extend, "key bigint, start int, fp bigint, base boolean")


def _links(rows: DataFrame, ring: Ring) -> DataFrame:
    """key, cell, own, start, fp, base -> (a, b), links that connect all linked fingerprints of a cell."""
    chains = ring.chains()
    budgets = [ring.budget(n + 1) for n in range(ring.segments)]

    def find(batches):
        for table, _ in whole_groups(batches, ["key", "cell"]):
            key, cell, own, start = (table.column(c).to_numpy() for c in ("key", "cell", "own", "start"))
            fp = table.column("fp").to_numpy().view(np.uint64)
            base = table.column("base").to_numpy()
            outer = (cell >> 32) != (cell & 0xFFFFFFFF)  # a cell of two chunks: each pair has one of either
            found = []
            i, step = np.arange(len(key) - 1), 0
            while len(i):  # rows `step` apart in one cell
                step += 1
                i = i[i + step < len(key)]
                i = i[(key[i] == key[i + step]) & (cell[i] == cell[i + step])]
                j = i + step
                x, s = fp[i] ^ fp[j], start[i]
                ok = (s == start[j]) & (base[i] | base[j]) & (~outer[i] | (own[i] != own[j]))
                ok &= (x & chains[s, 0]) == 0
                a = i[ok]
                for n in range(1, ring.segments):  # chain by chain, the last one is the whole ring
                    a = a[np.bitwise_count((fp[a] ^ fp[a + step]) & chains[start[a], n]) <= budgets[n]]
                a = a[np.bitwise_count(fp[a] ^ fp[a + step]) <= ring.bits]
                if len(a):
                    found.append((a, a + step))
            if found:
                a, b = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                more, least = spanning(fp[a].view(np.int64), fp[b].view(np.int64))
                if len(more):
                    yield pa.RecordBatch.from_arrays([pa.array(more), pa.array(least)], names=["a", "b"])

    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.select("key", "cell", "own", "start", "fp", "base")
    return rows.repartition(parts, "key", "cell").sortWithinPartitions("key", "cell").mapInArrow(find, "a bigint, b bigint")


def linked(classes: DataFrame, ring: Ring = Ring()) -> DataFrame:
    """fp (distinct) -> (a, b): links whose components are those of all pairs
    of fingerprints that differ in at most ``ring.bits`` bits."""
    rows = stored(_buckets(classes, ring), "segments")
    size = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    small, large = size.where(F.col("c") <= ring.chunk).select("key"), size.where(F.col("c") > ring.chunk).select("key")
    zero = F.lit(0).cast("long")
    links = _links(rows.join(small, "key", "left_semi").select("*", zero.alias("cell"), zero.alias("own"), F.lit(True).alias("base")), ring)
    hot = stored(rows.join(large, "key", "left_semi"), "hot_segments")
    if not hot.isEmpty():
        links = links.unionByName(_links(dealt_pairs(_longer(hot, ring), "key", "fp", ring.chunk), ring))
    return stored(links, "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ring: Ring = Ring()) -> DataFrame:
    """One row per row of ``docs``: uid, the id, fingerprint (16 hexadecimal
    digits) and component_id, the smallest id reachable over links of
    fingerprints that differ in at most ``ring.bits`` bits, its own included.

    Words are maximal runs of other than ASCII white space, A-Z lower-cased; a
    text with fewer words than a shingle has its whole sequence as its one
    shingle. Null and empty texts and texts without words have fingerprint zero
    and are linked like any other. Texts are taken whole. Repeated rows are
    linked and keep a row each; a null id counts as larger than any. Other
    columns are not read; an empty table gives none."""
    rows = docs.select(row_ids(docs), docs[id_col].alias("id"), docs[text_col].alias("text"))
    signed = stored(fingerprints(rows, ring), "fingerprints")
    classes = stored(signed.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("c")), "classes")
    labels = connected_components(linked(classes.select("fp"), ring))
    own = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").where("c > 1 or component is not null")
    own = stored(own.select("fp", "least", F.coalesce("component", "fp").alias("component")), "members")
    names = own.groupBy("component").agg(F.min("least").alias("name"))
    named = stored(own.join(names, "component").select("fp", "name"), "names")
    named = F.broadcast(named) if named.count() <= BROADCAST_CLASSES else named
    out = signed.join(named.withColumn("known", F.lit(True)), "fp", "left")
    return out.select("uid", F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.when(F.col("known"), F.col("name")).otherwise(F.col("id")).alias("component_id"))
