"""MinHash near-duplicates by tensored banding, links verified on full sets.

1. One pass over the texts gives each document its distinct word shingles
   (64-bit), a 128-bit digest of that set and ``COLLECTIONS`` small hash
   collections of ``PER_COLLECTION`` minhashes. Documents with equal sets are
   one class from here on (combined map-side, so thousands of copies cost a
   row per task).
2. Tensoring: a table's key is a *pair* of collections. 14 collections of 2
   minhashes give 91 tables of 4 minhashes each, from 28 minhashes instead of
   364. A pair of similarity 0.8 is missed only if fewer than two collections
   agree: probability 1.6e-5; 0.85: 8e-7.
3. Inside a bucket, links are looked for star by star. First every class is
   paired with one pivot, that first class of its buckets with which it shares
   most tables; while far too many pairs are left, a round pairs the classes of
   a bucket with another pivot, unless the two are already in one component or
   their sizes rule the similarity out. Pairs are verified on the full shingle
   sets and verified links merge components. Once the pairs left between
   components are in proportion to the buckets' rows (or a round found no
   link), tasks compare them, first giving each class its likeliest partner
   only, then all that is left between components. Two classes are compared in
   the first table they share only, by bitmaps as wide as their sets are large
   (``BITS_A_SHINGLE`` bits a shingle): bits of one set that the other lacks are
   shingles it lacks, which bounds the similarity from above, closely enough
   that little but links and pairs just below the threshold passes. These are
   verified on the full sets. No bucket is capped: every pair of a bucket is
   verified, ruled out by an exact bound, or already connected. A bucket's
   largest component and the rows outside of it are dealt into chunks that meet
   in pairs, so no task holds either whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_ids, stored
from .components import connected_components
from .groups import whole_groups
from .textblocks import NOT_SPACE, blocks, distinct_by_row, mix, shingles, word_hashes, word_spans

COLLECTIONS, PER_COLLECTION = 14, 2
#: The low bits of a key are its table's number.
TABLE = 127
#: Once the pairs left over are at most so many times the buckets' rows, all are compared by bitmaps.
REST_PAIRS_PER_ROW = 256
BITS_A_SHINGLE, LEAST_BITS = 8, 512
#: Rows of a bucket's largest component, and outside of it, that a task holds at once.
CHUNK = 4096
#: Text rows of the candidates are picked by a broadcast list up to so many ids (8 bytes each), else by a shuffle join.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Links:
    """``percent``: two sets are linked if 100 * intersection >= percent * union."""
    words: int = 5
    percent: int = 80
    is_word: np.ndarray | None = None

    def letters(self) -> np.ndarray:
        return NOT_SPACE if self.is_word is None else self.is_word


def _multipliers() -> np.ndarray:
    return mix(np.arange(1, COLLECTIONS * PER_COLLECTION + 1, dtype=np.uint64)) | np.uint64(1)


def _sets(batches: Iterator[pa.RecordBatch], links: Links):
    """(rows, set values, borders) of each block."""
    letters = links.letters()
    for batch in batches:
        for part, data, border in blocks(batch, "text"):
            starts, ends, at = word_spans(data, border, letters)
            values, own = shingles(word_hashes(data, starts, ends), at, links.words)
            yield part, *distinct_by_row(values, own)


def signatures(rows: DataFrame, links: Links) -> DataFrame:
    """uid, id -> uid, id, n (set size), node (64 bits of the set's digest), rest (the other 64), sig."""

    def sign(batches):
        factor = _multipliers()
        for part, values, at in _sets(batches, links):
            n = part.num_rows
            size = np.diff(at)
            sig = np.zeros((n, len(factor)), np.uint32)
            full = np.flatnonzero(size)
            if len(full):
                for j, f in enumerate(factor):
                    sig[full, j] = np.minimum.reduceat(values * f, at[:-1][full]) >> np.uint64(32)
            digest = np.frombuffer(b"".join(hashlib.blake2b(values[at[i]:at[i + 1]].tobytes(), digest_size=16).digest() for i in range(n)), np.int64).reshape(n, 2)
            empty = size == 0
            yield pa.RecordBatch.from_arrays(
                [part.column("uid"), part.column("id"), pa.array(size.astype(np.int64)),
                 pa.array(digest[:, 0], mask=empty), pa.array(digest[:, 1], mask=empty),
                 pa.array([s.tobytes() for s in sig], pa.binary())],
                names=["uid", "id", "n", "node", "rest", "sig"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(sign, f"uid bigint, id {kind}, n bigint, node bigint, rest bigint, sig binary")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each table of each class."""
    pairs = [(i, j) for i in range(COLLECTIONS) for j in range(i + 1, COLLECTIONS)]
    left, right = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    salt = mix(np.arange(1, len(pairs) + 1, dtype=np.uint64) << np.uint64(32))
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(part.num_rows, COLLECTIONS, PER_COLLECTION)
            own = np.zeros((part.num_rows, COLLECTIONS), np.uint64)
            for r in range(PER_COLLECTION):
                own = mix(own ^ sig[:, :, r].astype(np.uint64)) + np.uint64(r + 1)
            key = mix(mix(own[:, left] + salt) ^ own[:, right]) & ~np.uint64(TABLE) | np.arange(len(pairs), dtype=np.uint64)
            repeat = lambda name, n=len(pairs): pa.array(np.repeat(part.column(name).to_numpy(), n))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), repeat("node"), repeat("n")], names=["key", "node", "n"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key another row has too. Streams: a
    bucket may be longer than a batch, or than memory."""
    kept: pa.RecordBatch | None = None  # the last row, not yet given out
    kept_out = False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if kept is None else pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
        key = rows.column("key").to_numpy()
        same = key[1:] == key[:-1]
        give = np.zeros(len(key), bool)
        give[1:] |= same
        give[:-1] |= same
        if kept is not None and kept_out:
            give[0] = False
        last_given = bool(give[-1]) or (len(key) == 1 and kept_out)
        out = rows.filter(pa.array(give))
        if out.num_rows:
            yield out
        kept, kept_out = rows.slice(len(key) - 1, 1), last_given
        if len(key) > 1 and same[-1]:
            kept_out = True


def _similar(pairs: DataFrame, sets: DataFrame, links: Links) -> DataFrame:
    """The pairs (a, b) whose full sets are linked."""
    full = (pairs.join(sets.select(F.col("node").alias("b"), F.col("values").alias("vb")), "b")
            .join(sets.select(F.col("node").alias("a"), F.col("values").alias("va")), "a"))

    def verify(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            va, vb = batch.column("va"), batch.column("vb")
            for i in range(batch.num_rows):
                x, y = np.frombuffer(va[i].as_buffer(), np.uint64), np.frombuffer(vb[i].as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok[i] = 100 * both >= links.percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], names=["a", "b"])

    return full.select("a", "b", "va", "vb").mapInArrow(verify, "a bigint, b bigint")


def _sizes_fit(x: str, y: str, links: Links):
    return F.least(x, y) * 100 >= F.greatest(x, y) * links.percent


def _bitmaps(values: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A bitmap of each set: a power of two of bits, at least ``BITS_A_SHINGLE`` a shingle."""
    out = []
    for lo, hi in zip(at[:-1], at[1:]):
        width = max(LEAST_BITS, 1 << int(BITS_A_SHINGLE * int(hi - lo) - 1).bit_length())
        marks = np.zeros(width, bool)
        marks[(values[lo:hi] >> np.uint64(20)) % np.uint64(width)] = True
        out.append(np.packbits(marks).tobytes())
    return out


def _folded(bits: bytes, width: int) -> np.ndarray:
    """A bitmap at a narrower width: shingles keep their place modulo the width."""
    words = np.frombuffer(bits, np.uint64)
    return np.bitwise_or.reduce(words.reshape(-1, width // 64), axis=0)


def _first_table(sig: np.ndarray, i: int, j: np.ndarray) -> np.ndarray:
    """The first table that row i shares with each of the rows j: that of the first two collections that agree (else -1)."""
    agree = (sig[j] == sig[i]).all(2)
    first = agree.argmax(1)
    agree[np.arange(len(j)), first] = False
    second = agree.argmax(1)
    both = agree[np.arange(len(j)), second]
    return np.where(both, first * COLLECTIONS - first * (first + 1) // 2 + second - first - 1, -1)


def _dealt(rows: DataFrame, inside: DataFrame) -> DataFrame:
    """``rows`` with inner (whether of the bucket's largest component), cell,
    own (the row's chunk) and outer (whether rows outside that component are
    compared in this cell: those of different chunks, or of one in its own cell)."""
    top = inside.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.max("c").alias("c"), F.sum("c").alias("all"))
    zero = F.lit(0).cast("long")
    top = top.select("key", "top", F.ceil(F.col("c") / CHUNK).alias("ni"), F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("c")) / CHUNK)).alias("no"))
    rows = rows.join(top, "key").withColumn("inner", F.col("comp") == F.col("top"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("inner"), F.col("ni")).otherwise(F.col("no"))))
    ni, no, own = F.col("ni"), F.col("no"), F.col("own")
    # cells of an outer and an inner chunk come first, then those of two outer chunks
    with_outer = F.transform(F.sequence(zero, no - 1), lambda a: F.struct((a * ni + own).alias("cell"), F.lit(False).alias("outer")))
    with_inner = F.transform(F.sequence(zero, ni - 1), lambda b: F.struct((own * ni + b).alias("cell"), ((no == 1) & (b == 0)).alias("outer")))
    outer = F.when(no == 1, F.array().cast("array<struct<cell:bigint,outer:boolean>>")).otherwise(F.transform(F.sequence(zero, no - 1), lambda a: F.struct(
        (ni * no + F.least(a, own) * no + F.greatest(a, own)).alias("cell"), (F.lit(True)).alias("outer"))))
    cells = F.when(F.col("inner"), with_outer).otherwise(F.concat(with_inner, outer))
    rows = rows.select("key", "node", "n", "comp", "inner", "own", "ni", "no", F.inline(cells))
    at = F.col("cell") - ni * no
    same = F.col("outer") & (no > 1) & (at == own * no + own)
    return rows.select("key", "cell", "node", "n", "comp", "inner", "own", "outer", (same | (no == 1)).alias("same"))


def _rest_pairs(rows: DataFrame, inside: DataFrame, sets: DataFrame, links: Links, best: bool) -> DataFrame:
    """(a, b) between different components of a bucket that sizes and bitmaps
    leave, each pair from the first table the two share; with ``best`` only the
    likeliest partner of each class."""
    dealt = _dealt(rows, inside).join(sets.select("node", "bits", "sig"), "node")
    dealt = dealt.select("key", "cell", "node", "n", "comp", "inner", "own", "outer", "same", "bits", "sig")
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def pairs_of(table, node, n, comp, inner, own, outer, same, bits, sig):
        order = np.argsort(n, kind="stable")
        node, n, comp, inner, own, sig = node[order], n[order], comp[order], inner[order], own[order], sig[order]
        bits = [bits[k] for k in order]
        stop = np.searchsorted(n, n * 100 // links.percent, "right")
        width = np.array([8 * len(b) for b in bits])
        maps, first = np.zeros((0, 0), np.uint64), 0  # the bitmaps of rows first, first + 1, ... at row i's width, which no larger set's is below
        for i in range(len(n) - 1):
            j = np.arange(i + 1, stop[i])
            j = j[(comp[j] != comp[i]) & ~(inner[j] & inner[i])]
            if not (inner[i] or outer):
                j = j[inner[j]]
            elif not inner[i] and not same:
                j = j[inner[j] | (own[j] != own[i])]
            if len(j):
                j = j[_first_table(sig, i, j) == table]
            if not len(j):
                continue
            if maps.shape[1] * 64 != width[i]:
                first, last = i, stop[np.searchsorted(width, width[i], "right") - 1]
                maps = np.stack([_folded(b, width[i]) for b in bits[first:last]])
            mine, theirs = maps[i - first], maps[j - first]
            less = np.bitwise_count(mine & ~theirs).sum(1, dtype=np.int64)
            more = np.bitwise_count(theirs & ~mine).sum(1, dtype=np.int64)
            both = np.minimum(n[i] - less, n[j] - more)
            fits = 100 * both >= links.percent * (n[i] + n[j] - both)
            if best and fits.any():
                fits = np.arange(len(j)) == np.argmax(both / (n[i] + n[j] - both))
            j = j[fits]
            if len(j):
                yield np.full(len(j), node[i]), node[j]

    def compare(batches):
        for table, cut in whole_groups(batches, ["key", "cell"]):
            key, node, n, comp, own = (table.column(c).to_numpy() for c in ("key", "node", "n", "comp", "own"))
            inner, outer, same = (table.column(c).to_numpy() for c in ("inner", "outer", "same"))
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(node), COLLECTIONS, PER_COLLECTION)
            bits = table.column("bits").to_pylist()
            out = []
            for lo, hi in zip(cut[:-1], cut[1:]):
                if hi - lo > 1:
                    out += pairs_of(int(key[lo]) & TABLE, node[lo:hi], n[lo:hi], comp[lo:hi], inner[lo:hi], own[lo:hi],
                                    outer[lo:hi].any(), same[lo:hi].any(), bits[lo:hi], sig[lo:hi])
            if out:
                a, b = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return dealt.repartition(parts, "key", "cell").sortWithinPartitions("key", "cell").mapInArrow(compare, "a bigint, b bigint")


def _labelled(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Buckets with each class's component; buckets within one component go."""
    if labels is None:
        return buckets.withColumn("comp", F.col("node"))
    rows = buckets.join(labels.withColumnRenamed("component", "comp"), "node", "left")
    rows = rows.withColumn("comp", F.coalesce("comp", "node"))
    open_keys = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    return rows.join(open_keys, "key", "left_semi").select("key", "node", "n", "comp")


def _unite(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    edges = links if labels is None else links.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return stored(connected_components(edges), "labels")


def _components(buckets: DataFrame, sets_of, links: Links) -> DataFrame | None:
    """Components of the classes that share a bucket with another one."""
    labels = tested = None
    turn, linked, best = 0, True, True
    while True:
        rows = stored(_labelled(buckets, labels), "buckets")
        inside = rows.groupBy("key", "comp").agg(F.count("*").alias("c"))
        left, = inside.groupBy("key").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q")).agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()
        if not left:
            return labels
        buckets = rows.drop("comp")
        turn += 1
        inner = turn > 1 and (not best or not linked or left <= REST_PAIRS_PER_ROW * rows.count())
        last = inner and not best
        if inner:
            pairs = _rest_pairs(rows, inside, sets_of(), links, best)
            best = False
        else:
            # the first class of each bucket; later another one, by a hash that changes with the round
            first = F.col("node") if turn == 1 else F.xxhash64("node", F.lit(turn))
            pivots = rows.groupBy("key").agg(F.min(F.struct(first.alias("by"), "node", "n", "comp")).alias("p"))
            pairs = rows.join(pivots, "key").where("p.node <> node").select(
                F.col("p.node").alias("a"), F.col("p.n").alias("n"), F.col("p.comp").alias("comp"),
                F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
            pairs = pairs.where((F.col("comp") != F.col("cb")) & _sizes_fit("n", "nb", links)).select("a", "b")
            if turn == 1:  # one pair a class: most copies are united by these
                pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("c")).groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a"))
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        found = stored(_similar(pairs, sets_of(), links), "links")
        if not last:
            tested = pairs if tested is None else tested.unionByName(pairs)
        linked = found.limit(1).count() > 0
        if linked:
            labels = _unite(labels, found)
        if last:
            return labels


def _small(rows: DataFrame) -> DataFrame:
    """Stored rows, to be broadcast if they are counted to be few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", links: Links = Links()) -> DataFrame:
    """One row per row of ``docs``: uid (monotonically_increasing_id of the
    input's rows), id, n_shingles (long), component_id (the smallest id
    reachable over links, its own included) and first (true for exactly one
    row of each component, the one with the smallest id, then uid).

    Words are lower-cased (A-Z only); a text with fewer words than a shingle
    has its whole sequence as its one shingle. Null and empty texts and texts
    without words have no shingles and are linked with nothing. Equal rows
    are linked (but for empty ones) and keep a row each; a null id counts as
    larger than any. Other columns are not read; an empty table gives none.
    """
    rows = docs.select(row_ids(docs), docs[id_col].alias("id"), docs[text_col].alias("text"))
    signed = stored(signatures(rows.select("uid", "id", "text"), links), "signatures")
    classes = signed.where("n > 0").groupBy("node", "rest").agg(F.min("uid").alias("uid"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    keys = classes.select("node", "n", "sig").mapInArrow(_keys, "key bigint, node bigint, n bigint")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    buckets = stored(keys.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_shared, "key bigint, node bigint, n bigint"), "buckets")
    made: list[DataFrame] = []

    def sets_of() -> DataFrame:
        """Full sets of the classes that share a bucket, one text each."""
        if not made:
            wanted = stored(classes.select("node", "uid", "sig").join(buckets.select("node").distinct(), "node"), "wanted")
            if wanted.count() <= BROADCAST_IDS:
                picked = rows.join(F.broadcast(wanted), "uid")
            else:
                picked = rows.join(wanted, "uid")

            def full(batches):
                for part, values, at in _sets(batches, links):
                    yield pa.RecordBatch.from_arrays(
                        [part.column("node"), part.column("sig"), pa.array([values[at[i]:at[i + 1]].tobytes() for i in range(part.num_rows)], pa.binary()),
                         pa.array(_bitmaps(values, at), pa.binary())], names=["node", "sig", "values", "bits"])

            made.append(stored(picked.select("node", "sig", "text").mapInArrow(full, "node bigint, sig binary, values binary, bits binary"), "sets"))
        return made[0]

    labels = _components(buckets, sets_of, links)
    rows = signed.drop("sig")
    if labels is None:
        rows = rows.withColumn("component", F.col("node"))
    else:
        rows = rows.join(_small(labels), "node", "left").withColumn("component", F.coalesce("component", "node"))
    order = F.struct(F.col("id").isNull().alias("absent"), "id", "uid")
    best = rows.where("n > 0").groupBy("component").agg(F.min(order).alias("best"), F.count("*").alias("members")).where("members > 1")
    out = rows.join(_small(stored(best.select("component", "best"), "best")), "component", "left")
    named = F.col("best").isNotNull()
    return out.select(
        "uid", "id", F.col("n").alias("n_shingles"), F.when(named, F.col("best.id")).otherwise(F.col("id")).alias("component_id"),
        F.when(named, F.col("best.uid") == F.col("uid")).otherwise(F.lit(True)).alias("first")).withColumnRenamed("id", id_col)
