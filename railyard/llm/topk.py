"""Exact top-k inner products: norm-sorted blocks, SVD-rotated partial sums.

1. Vectors become integers. Their Gram matrix (dimensions squared, summed per
   task) gives the rotation: its eigenvectors are the right singular vectors
   of the whole table, so the first rotated components carry most of each
   inner product.
2. Candidates are sorted by descending length into blocks of ``BLOCK`` rows;
   queries are cut into blocks likewise. Blocks are binary rows, numbered by
   their place in that order.
3. Blocks are met in this order, in rounds of ``GROWTH`` times as many: first
   the longest one, then those after it. After each round a query's k-th best
   score so far is its threshold for the next. A block is still needed by a
   block of queries if some query's length times the block's longest vector
   reaches that query's threshold; as lengths descend, these blocks are the
   first so many, so pairs are an equi-join on their numbers.
4. Inside a pair of blocks, the products of the first ``LEAD`` rotated
   components plus the Cauchy-Schwarz bound of the rest (product of the two
   residual lengths) prune; what remains is scored exactly: in doubles where
   the lengths show that no sum reaches 2 ** 53, in 64-bit integers below
   2 ** 62, else in integers of any size. Bounds get a slack that covers floating
   point, and only what is strictly below the threshold goes, so ties are kept.
5. The k best of each block pair are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK = 4096
LEAD = 16
#: Blocks of the next round, as a multiple of those met so far.
GROWTH = 4
#: So many block lengths (of evenly spaced blocks, if there are more) come to the driver and the tasks.
LENGTHS = 100_000
LARGEST = (1 << 63) - 1


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """id, dim, vec (int64 bytes), norm2: floor(scale * x) of every component
    (as double). Vectors that are null, empty or hold null or non-finite
    components take no part, nor do rows with a null id. A component beyond 63
    bits counts as the largest number of 63 bits with its sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("vec")
            n = batch.num_rows
            at = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0)))])
            flat = col.flatten()
            value = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
            good = np.isfinite(value) & ~np.asarray(flat.is_null())
            bad = np.concatenate([[0], np.cumsum(~good)])
            keep = (np.diff(at) > 0) & (bad[at[1:]] == bad[at[:-1]])
            ints = np.zeros(len(value), np.int64)
            with np.errstate(over="ignore"):
                scaled = np.floor(value[good] * scale)
            far = np.abs(scaled) >= 2.0 ** 63
            ints[good] = np.where(far, 0, scaled).astype(np.int64)
            ints[np.flatnonzero(good)[far]] = np.where(scaled[far] > 0, LARGEST, -LARGEST)
            own = [ints[at[i]:at[i + 1]] for i in np.flatnonzero(keep)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").filter(pa.array(keep)), pa.array([len(v) for v in own], pa.int32()), pa.array([v.tobytes() for v in own], pa.binary()),
                 pa.array([float(np.dot(v.astype(float), v.astype(float))) for v in own], pa.float64())], names=["id", "dim", "vec", "norm2"])

    import pyarrow.compute  # noqa: F401  (pa.compute)

    rows = rows.select(rows[id_col].cast("long").alias("id"), rows[vec_col].alias("vec")).where("id is not null and vec is not null")
    return rows.mapInArrow(run, "id bigint, dim int, vec binary, norm2 double")


def _matrix(vectors, dim: int) -> np.ndarray:
    """Rows of int64 vectors; shorter ones are padded with zeros."""
    out = np.zeros((len(vectors), dim), np.int64)
    for i, v in enumerate(vectors):
        x = np.frombuffer(v, np.int64)
        out[i, :len(x)] = x
    return out


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all vectors, the largest singular value first (dim x dim)."""

    def gram(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column("vec").to_pylist(), dim).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(list(total))], names=["i", "row"])

    parts = vectors.select("vec").mapInArrow(gram, "i int, row array<double>")
    # summed by Spark first, so that dim x dim numbers reach the driver
    rows = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    total = np.zeros((dim, dim))
    total[rows["i"], rows["j"]] = rows["x"]
    return np.linalg.eigh(total)[1][:, ::-1].copy()


def _blocks(vectors: DataFrame, dim: int, size: int, by_norm: bool) -> DataFrame:
    """block, ids, vecs (packed int64), longest (norm) for runs of ``size`` rows."""
    order = (F.col("norm2").desc(), F.col("id")) if by_norm else (F.col("id"),)

    def pack(batches):
        rest: list[pa.RecordBatch] = []
        have = 0

        def out(table: pa.Table):
            m = _matrix(table.column("vec").to_pylist(), dim)
            norms = table.column("norm2").to_numpy()
            return pa.RecordBatch.from_arrays(
                [pa.array([table.column("id").to_numpy().astype(np.int64).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), pa.array([float(np.sqrt(norms.max()))])],
                names=["ids", "vecs", "longest"])

        for batch in batches:
            while batch.num_rows:
                take = batch.slice(0, size - have)
                rest.append(take)
                have += take.num_rows
                batch = batch.slice(take.num_rows)
                if have == size:
                    yield out(pa.Table.from_batches(rest))
                    rest, have = [], 0
        if have:
            yield out(pa.Table.from_batches(rest))

    parts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed = vectors.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pack, "ids binary, vecs binary, longest double")
    packed = stored(packed.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"), "*"), "blocks")
    # a row per partition: the number of blocks before it
    before, rows = 0, []
    for part, n in sorted(map(tuple, packed.groupBy("part").agg((F.max("at") + 1).alias("n")).collect())):
        rows.append((part, before))
        before += n
    offsets = vectors.sparkSession.createDataFrame(rows, "part int, before long")
    return packed.join(F.broadcast(offsets), "part").select("ids", "vecs", "longest", (F.col("before") + F.col("at")).alias("block"))


def _exact(q: np.ndarray, c: np.ndarray):
    """A function of a row of q and rows of c (integer matrices): their inner
    products, exact; beyond 63 bits the largest number with their sign."""
    # by Cauchy-Schwarz no partial sum is larger than the product of the lengths
    longest = [np.sqrt((m.astype(float) ** 2).sum(1).max(initial=0)) for m in (q, c)]
    most = longest[0] * longest[1] * (1 + 1e-9) + 1
    if most < 2.0 ** 53:
        qf, cf = q.astype(float), c.astype(float)
        return lambda i, live: (cf[live] @ qf[i]).astype(np.int64)
    if most < 2.0 ** 62:
        return lambda i, live: c[live] @ q[i]

    def large(i, live):
        exact = [sum(x * y for x, y in zip(row, q[i].tolist())) for row in c[live].tolist()]
        return np.array([max(-LARGEST, min(LARGEST, x)) for x in exact], np.int64)

    return large


def _best(ids_q, qr, ids_c, cr, scores, k, floor):
    """(query row, candidate row, score) of the k best candidates of each query
    among one block, ties to the smaller id. ``qr`` and ``cr``: rotated vectors;
    ``scores``: of :func:`_exact`."""
    lead = min(LEAD, qr.shape[1])
    rest_q, rest_c = (np.sqrt(np.maximum((x[:, lead:] ** 2).sum(1), 0)) for x in (qr, cr))
    bound = qr[:, :lead] @ cr[:, :lead].T + np.outer(rest_q, rest_c)
    slack = 1e-6 * (1 + np.abs(qr).max(initial=0) * np.abs(cr).max(initial=0) * qr.shape[1])
    out = []
    for i in range(len(qr)):
        live = np.flatnonzero((bound[i] + slack >= floor[i]) & (ids_c != ids_q[i]))
        if not len(live):
            continue
        score = scores(i, live)
        if len(live) > k:
            least = np.partition(score, len(live) - k)[len(live) - k]
            pick = np.flatnonzero(score >= least)
            pick = pick[np.lexsort((ids_c[live][pick], -score[pick]))[:k]]
            live, score = live[pick], score[pick]
        out.append((np.full(len(live), i), live, score))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def _pairs(joined: DataFrame, dim: int, turn: np.ndarray, k: int) -> DataFrame:
    """Block pairs (ids, vecs, q_ids, q_vecs, floors) -> the k best of each query in the block."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids_q, ids_c = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                q, c = (np.frombuffer(r[n], np.int64).reshape(-1, dim) for n in ("q_vecs", "vecs"))
                qr, cr = q.astype(float) @ turn, c.astype(float) @ turn
                scores = _exact(q, c)
                floor = np.frombuffer(r["floors"], float) if r["floors"] is not None else np.full(len(q), -np.inf)
                for lo in range(0, len(q), 256):  # bounds the size of the score matrix
                    part = slice(lo, lo + 256)
                    a, b, s = _best(ids_q[part], qr[part], ids_c, cr, lambda i, live, lo=lo: scores(lo + i, live), k, floor[part])
                    yield pa.RecordBatch.from_arrays([pa.array(ids_q[part][a]), pa.array(ids_c[b]), pa.array(s)], names=["query_id", "vec_id", "score"])

    return joined.select("ids", "vecs", "q_ids", "q_vecs", "floors").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _floored(asked: DataFrame, best: DataFrame | None, k: int, dim: int, lengths: np.ndarray, step: int, blocks: int) -> DataFrame:
    """q_block, q_ids, q_vecs, floors (each query's k-th best score so far, -inf
    if it has fewer) and needed (how many of the first blocks can still matter)."""
    if best is None:
        return asked.select("q_block", "q_ids", "q_vecs", F.lit(None).cast("binary").alias("floors"), F.lit(blocks).cast("long").alias("needed"))
    kth = best.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k)

    def with_ids(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("q_block"), pa.array([np.frombuffer(x.as_py(), np.int64) for x in batch.column("q_ids")], pa.list_(pa.int64()))], names=["q_block", "ids"])

    ids = asked.select("q_block", "q_ids").mapInArrow(with_ids, "q_block bigint, ids array<bigint>").select("q_block", F.explode("ids").alias("query_id"))
    known = ids.join(kth, "query_id").groupBy("q_block").agg(F.collect_list(F.struct("query_id", "floor")).alias("f"))  # BLOCK entries at most

    def pack(batches):
        for batch in batches:
            for r in batch.to_pylist():
                have = {f["query_id"]: float(f["floor"]) for f in r["f"] or []}
                floor = np.array([have.get(i, -np.inf) for i in np.frombuffer(r["q_ids"], np.int64).tolist()])
                norm = np.sqrt((np.frombuffer(r["q_vecs"], np.int64).reshape(-1, dim).astype(float) ** 2).sum(1))
                # the shortest vector that could still enter some query's list
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(floor <= 0, 0.0, np.where(norm > 0, floor / norm, np.inf)).min() * (1 - 1e-9)
                # lengths descend: of each step-th block; those up to the first that is too short
                needed = min(blocks, int(np.searchsorted(-lengths, -need, "right")) * step)
                yield pa.RecordBatch.from_arrays([pa.array([r["q_block"]]), pa.array([r["q_ids"]], pa.binary()), pa.array([r["q_vecs"]], pa.binary()),
                                                  pa.array([floor.tobytes()], pa.binary()), pa.array([needed], pa.int64())], names=["q_block", "q_ids", "q_vecs", "floors", "needed"])

    rows = asked.join(known, "q_block", "left").select("q_block", "q_ids", "q_vecs", "f")
    return stored(rows.mapInArrow(pack, "q_block bigint, q_ids binary, q_vecs binary, floors binary, needed bigint"), "floored")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer
    inner products among all other rows (all, if fewer), ties to the smaller id.

    ``queries`` are rows of the same form. Vectors that are null or hold null
    or non-finite components take no part; of different lengths, the shorter
    are padded with zeros; a null id takes no part; of rows with one id each
    counts as a candidate, queries of one id share a list, and a query's own id is
    no candidate. Scores are exact for
    components of any size; one beyond 63 bits is given and ranked as the
    largest number of 63 bits with its sign, and so is a component. Other
    columns are not read. Empty tables give no rows.
    """
    spark: SparkSession = rows.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    vectors = stored(integer_vectors(rows, id_col, vec_col, scale), "vectors")
    dim = vectors.agg(F.max("dim")).first()[0]
    if dim is None:
        return empty
    turn = rotation(vectors, dim)
    asked = integer_vectors(queries, id_col, vec_col, scale).withColumn("dim", F.least("dim", F.lit(dim)))
    candidates = stored(_blocks(vectors, dim, BLOCK, True), "candidate_blocks")
    asked = stored(_blocks(asked, dim, BLOCK, False).select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs")), "query_blocks")
    blocks = candidates.count()
    if not asked.limit(1).count():
        return empty
    step = -(-blocks // LENGTHS)
    lengths = np.array([r[0] for r in candidates.where(F.col("block") % step == 0).select("longest", "block").orderBy("block").collect()])
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best, lo, hi = None, 0, 1
    while lo < blocks:
        floored = _floored(asked, best, k, dim, lengths, step, blocks)
        pairs = floored.where(F.col("needed") > lo).select("q_block", F.explode(F.sequence(F.lit(lo).cast("long"), F.least(F.col("needed"), F.lit(hi)) - 1)).alias("block"))
        if best is not None and pairs.isEmpty():
            break
        met = pairs.join(floored, "q_block").join(candidates.where((F.col("block") >= lo) & (F.col("block") < hi)), "block").repartition(parts, "q_block", "block")
        found = _pairs(met, dim, turn, k)
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = stored(found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k), "best")
        lo, hi = hi, hi * GROWTH
    return best.select("query_id", "rank", "vec_id", "score")
