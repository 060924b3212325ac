"""Merkle manifest of a dataset, and proofs climbed by a recursive query.

1. Every row is hashed where it is read; only its order columns and digests
   travel on. A range sort by (group, order, digest) splits groups of any size,
   and one count per partition and group turns places in partitions into
   positions in groups.
2. The levels of each group's tree are built ``RUNG`` levels at a time: one
   shuffle brings the at most 2**RUNG nodes of a block together. All built
   levels are stored as node rows, parent-linked: a row has its digest, its
   siblings up to the end of its rung (null where the run has no other) and
   the node above (``up_*``). The top tree over the groups is built alike.
3. A recursive query (``WITH RECURSIVE``) starts at every leaf, joins the node
   rows on the node reached, appends the siblings and folds the leaf's changed
   digest (the original where nothing changed), until it stands at the root.
   ``RUNG`` levels a step, not one, since each step writes every leaf's row
   once; ``RUNG = 1`` is the plain climb and gives the same rows.

H is the lowercase hexadecimal SHA-256 of its inputs one after the other,
digests as text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_ids, stored

#: Levels of a tree that one shuffle builds and one step of the recursion climbs.
RUNG = 12
#: Nodes that end a rung are broadcast to a step up to so many (some 1 KB each), else joined by a shuffle.
BROADCAST_NODES = 20_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Trees: groups are numbered from 0; the tree over their roots; beyond its root.
TOP, DONE = -1, -2


def field_text(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(v) for v in values]), 256)


def _leaves(docs: DataFrame, fields: Sequence[str], group: str, order: str, changed: Mapping[str, Column], where: Column) -> DataFrame:
    """tree, pos, n (rows of the tree), key (the order column), digest, changed (null where nothing changed), group."""
    values = {f: docs[f] for f in fields}
    rows = docs.select(
        row_ids(docs), docs[group].alias("group"), docs[order].alias("key"), leaf_digest(list(values.values())).alias("digest"),
        F.when(where, leaf_digest([changed.get(f, v) for f, v in values.items()])).alias("changed"))
    rows = stored(rows, "merkle_hashed")  # the range sort samples its input first: texts are hashed once
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # equal rows may land in any order: the last key only deals out repeated ones
    by = [F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("digest").asc(), (F.col("uid") % 1024).asc()]
    sorted_rows = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("uid")
    placed = stored(sorted_rows.select(
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"), "*"), "merkle_rows")
    # at most a row for each partition and each group: neighbours in the sort share their partitions
    runs = placed.groupBy("part", "group").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    in_group = Window.partitionBy("group").orderBy("part")
    runs = runs.select("part", "group", "first", (F.sum("c").over(in_group) - F.col("c")).alias("before"),
                       F.sum("c").over(Window.partitionBy("group")).alias("n"),
                       (F.dense_rank().over(Window.orderBy(F.col("group").asc_nulls_first())) - 1).cast("long").alias("tree"))
    runs = stored(runs, "merkle_runs").withColumnsRenamed({"part": "p", "group": "g"})
    return placed.join(runs, (F.col("part") == F.col("p")) & F.col("group").eqNullSafe(F.col("g"))).select(
        "tree", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "n", "key", "digest", "changed", "group")


def _rung(rows: DataFrame, level: int, rung: int, payload: Sequence[str]) -> DataFrame:
    """tree, pos, n, digest (and payload) of one level -> node rows of this
    and the next levels of the rung. Blocks hold 2**rung rows at most."""
    block = rows.groupBy("tree", "n", F.shiftright("pos", rung).alias("blk")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", *payload))).alias("own"))
    # bits of n - 1: the levels from n nodes to one
    block = block.withColumn("steps", F.expr(f"if(n = 1, 0, least({rung}, length(bin(n - 1))))"))
    levels = F.expr(
        f"""aggregate(slice(sequence(1, {rung}), 1, steps), array(own.digest), (made, l) -> concat(made, array(
              transform(sequence(1, (size(element_at(made, -1)) + 1) div 2), i -> sha2(concat(
                get(element_at(made, -1), int(2 * i - 2)), coalesce(get(element_at(made, -1), int(2 * i - 1)), '')), 256)))))""")
    # as rows of a generator: what follows names the levels many times, and the optimizer would put the expression there each time
    block = block.select("*", F.explode(F.array(levels)).alias("levels"))
    block = block.withColumn("left", F.expr(f"if(n = 1, n, (n + shiftleft(1L, steps) - 1) div shiftleft(1L, steps))"))
    more = "".join(f", '{p}', if(l = 0, own[i].{p}, null)" for p in payload)
    block = block.withColumn("nodes", F.expr(
        f"""flatten(transform(sequence(0, greatest(steps - 1, 0)), l -> transform(get(levels, l), (digest, i) -> named_struct(
              'l', l, 'i', i, 'digest', digest, 'siblings', transform(slice(sequence(0, {rung - 1}), l + 1, steps - l),
              m -> get(get(levels, m), shiftright(i, m - l) ^ 1)){more}))))"""))
    nodes = block.select("tree", "blk", "steps", "left", F.element_at("levels", -1)[0].alias("last"), F.inline("nodes"))
    done = F.col("left") == 1
    return nodes.select(
        "tree", (F.col("l") + level).cast("int").alias("level"), F.expr(f"shiftleft(blk, {rung} - l) + i").alias("pos"), "digest", "siblings",
        F.when(done & (F.col("tree") == TOP), DONE).when(done, TOP).otherwise(F.col("tree")).cast("long").alias("up_tree"),
        F.when(done, 0).otherwise(F.lit(level) + F.col("steps")).cast("int").alias("up_level"),
        F.when(done & (F.col("tree") == TOP), 0).when(done, F.col("tree")).otherwise(F.col("blk")).cast("long").alias("up_pos"),
        F.when((F.col("l") == 0) & (F.col("i") == 0), F.col("last")).alias("top"), *payload, "left")


def _trees(rows: DataFrame, rung: int, payload: Sequence[str]) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """(leaf rows with payload, other node rows, roots) of all trees; roots: tree, digest."""
    leaves = inner = roots = None
    level = 0
    while True:
        made = stored(_rung(rows, level, rung, payload if leaves is None else ()), "merkle_nodes")
        if leaves is None:
            leaves = made.where("level = 0")
            above = made.where("level > 0").drop(*payload)
        else:
            above = made
        inner = above if inner is None else inner.unionByName(above)
        ends = made.where("top is not null").select("tree", F.col("up_tree"), F.col("up_pos").alias("pos"), F.col("left").alias("n"), F.col("top").alias("digest"))
        ended = ends.where("n = 1").select("tree", "digest")
        roots = ended if roots is None else roots.unionByName(ended)
        rows = ends.where("n > 1").select("tree", "pos", "n", "digest")
        level += rung
        if rows.isEmpty():
            return leaves, inner, roots


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id",
             changed: Mapping[str, Column] | None = None, where: Column | None = None, rung: int = RUNG) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves, nodes, subroots) as stored tables. ``leaves``: key, group, changed
    and the node row (tree, pos, digest, siblings, up_*) of every row of ``docs``;
    ``nodes``: the rows of all other nodes; ``subroots``: tree, group, digest.

    ``changed`` and ``where`` describe a tampering: the columns put in place of
    fields, and the rows where; it does not touch the manifest itself."""
    rows = stored(_leaves(docs, fields, group, order, changed or {}, F.lit(False) if where is None else where), "merkle_leaves")
    leaves, nodes, roots = _trees(rows.drop("group"), rung, ("key", "changed"))
    groups = rows.where("pos = 0").select("tree", "group")
    subroots = stored(roots.join(groups, "tree"), "merkle_subroots")
    top = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("n"), "digest")
    first, above, _ = _trees(top, rung, ())
    return leaves, nodes.unionByName(first).unionByName(above), subroots


def climb(leaves: DataFrame, nodes: DataFrame, rung: int = RUNG) -> DataFrame:
    """key, tree, digest, folded, proof (the siblings met, as 32 bytes each) of
    every leaf, by a recursive query over the parent-linked node rows."""
    spark = leaves.sparkSession
    ends = nodes.where(f"level % {rung} = 0")
    hint = "/*+ BROADCAST(n) */" if ends.count() <= BROADCAST_NODES else ""
    fold = """aggregate({n}.siblings, named_struct('m', 0, 'h', {h}), (a, s) -> named_struct('m', a.m + 1, 'h', sha2(
      CASE WHEN s IS NULL THEN a.h WHEN shiftright({n}.pos, a.m) & 1 = 1 THEN concat(s, a.h) ELSE concat(a.h, s) END, 256)), a -> unhex(a.h))"""
    met = "unhex(array_join({n}.siblings, ''))"
    sql = f"""
    WITH RECURSIVE climb(key, leaf, tree, at_tree, at_level, at_pos, folded, proof) AS (
      SELECT l.key, unhex(l.digest), l.tree, l.up_tree, l.up_level, l.up_pos, {fold.format(n='l', h='coalesce(l.changed, l.digest)')}, {met.format(n='l')}
      FROM {{leaves}} l
      UNION ALL
      SELECT {hint} c.key, c.leaf, c.tree, n.up_tree, n.up_level, n.up_pos, {fold.format(n='n', h='lower(hex(c.folded))')}, concat(c.proof, {met.format(n='n')})
      FROM climb c JOIN {{nodes}} n ON n.tree = c.at_tree AND n.level = c.at_level AND n.pos = c.at_pos)
    SELECT key, tree, lower(hex(leaf)) AS digest, lower(hex(folded)) AS folded, proof FROM climb WHERE at_tree = {DONE}"""
    return _without_row_limit(spark, lambda: stored(spark.sql(sql, leaves=leaves, nodes=ends), "merkle_proofs"))


def _without_row_limit(spark: SparkSession, run):
    """The recursion's rows grow with the table: Spark's guard of a million rows is lifted while it runs."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        return run()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def verified_leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id",
                    changed: Mapping[str, Column] | None = None, where: Column | None = None, rung: int = RUNG) -> DataFrame:
    """One row per row of ``docs``: the order column, leaf, subroot, root,
    proof_sha256 (H of the siblings from the leaf to the root, all untampered),
    folded_root (recomputed from the tampered leaf, else the original one) and verified.

    Rows are ordered in their group by the order column (null first), then by
    digest; repeated rows keep a leaf each. A null group is a group of its own
    and comes first. A group of one row has its leaf as subroot, one group its
    subroot as root. Null fields hash as ``-``, empty texts as ``0:``; texts
    are hashed whole. An empty table gives none; other columns are not read."""
    leaves, nodes, subroots = manifest(docs, fields, group, order, changed, where, rung)
    root = nodes.where(f"tree = {TOP} and up_tree = {DONE} and top is not null").select(F.max("top")).scalar()
    proofs = climb(leaves, nodes, rung)
    out = proofs.join(subroots.select("tree", F.col("digest").alias("subroot")), "tree").withColumn("root", root)
    return out.select(
        F.col("key").alias(order), F.col("digest").alias("leaf"), "subroot", "root",
        F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"))
