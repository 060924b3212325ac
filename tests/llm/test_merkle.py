"""Merkle manifest against hashlib, with every leaf's proof."""
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from .support import SMALL
from railyard.llm import merkle
from railyard.llm.queries import QUERIES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, digest string, pos long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, more=0):
    d, source, lang, n, text = row[:5]
    return h(*[field(v) for v in (d, source, lang, None if n is None else n + more, text)])


def climb(level, i):
    """(root, [(sibling, is left) or None]) from place i of a level."""
    path = []
    while len(level) > 1:
        other = i ^ 1
        path.append((level[other], i % 2 == 1) if other < len(level) else None)
        level = [h(*level[k:k + 2]) for k in range(0, len(level), 2)]
        i //= 2
    return level[0], path


def brute(rows, tampered):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    roots = {x: climb([leaf(r) for r in trees[x]], 0)[0] for x in langs}
    out = []
    for g, x in enumerate(langs):
        leaves = [leaf(r) for r in trees[x]]
        for i, r in enumerate(trees[x]):
            root, high = climb([roots[y] for y in langs], g)
            path = climb(leaves, i)[1] + high
            folded = leaf(r, 1 if tampered(r) else 0)
            for p in path:
                folded = h(folded) if p is None else h(p[0], folded) if p[1] else h(folded, p[0])
            out.append((r[0], leaves[i], roots[x], root, h(*[p[0] for p in path if p]), folded, folded == root))
    return sorted(out, key=str)


def tampered(row):
    return row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0


def run(docs, **more):
    where = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    got = merkle.verified_leaves(docs, changed={"n_chars": F.col("n_chars") + 1}, where=where, **more)
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("rung", [1, 2, 3, 12])
def test_trees_of_many_sizes(stored_docs, rung):
    rng = random.Random(rung)
    rows = []
    for lang, n in (("en", 70), ("de", 17), ("é", 16), (None, 3), ("z", 1), ("", 2), ("fr", 5)):
        rows += [(rng.randrange(10 ** 6), rng.choice(["web", None, "ü"]), lang, rng.choice([None, 7, 0]), rng.choice(["text", "", None, "✓ ünï" * 50]), 1, "x", 2) for _ in range(n)]
    rng.shuffle(rows)
    assert run(stored_docs(rows, SCHEMA, files=4), rung=rung) == brute(rows, tampered)


def test_repeated_rows_null_ids_and_long_texts(stored_docs):
    rows = [(5, "a", "en", 3, "abc", None, None, None)] * 40 + [(None, None, None, None, None, 0, "", 0)] * 3
    rows += [(None, "a", "en", 1, "x", 0, "", 0), (5, "b", "en", None, "é" * 300_000, 0, "", 0), (2 ** 62, "b", "en", 2, "", 0, "", 0), (-14, "b", "en", 2, "", 0, "", 0)]
    assert run(stored_docs(rows, SCHEMA, files=3)) == brute(rows, tampered)


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", 3, "abc", 1, "", 1)], [(1, "a", "en", 3, "abc", 1, "", 1), (14, "a", "de", 3, "abc", 1, "", 1)]])
def test_empty_table_one_row_and_lone_leaves(stored_docs, rows):
    docs = stored_docs(rows, SCHEMA, files=1)
    got = merkle.verified_leaves(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert run(docs) == brute(rows, tampered)


def test_node_rows_are_the_tree(stored_docs):
    rows = [(i, "s", "en" if i < 600 else "de", i, str(i), 0, "", 0) for i in range(700)]
    leaves, nodes, subroots = merkle.manifest(stored_docs(rows, SCHEMA, files=2), rung=4)
    every = leaves.select("tree", "level", "pos", "digest").unionByName(nodes.select("tree", "level", "pos", "digest")).collect()
    have = {(r.tree, r.level, r.pos): r.digest for r in every}
    assert len(have) == len(every)
    for (tree, level, pos), d in have.items():
        if level:
            assert d == h(have[tree, level - 1, 2 * pos], have.get((tree, level - 1, 2 * pos + 1), ""))
    assert {r.group for r in subroots.collect()} == {"en", "de"}


def test_query_over_the_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = QUERIES["op13_merkle_manifest"](spark, SMALL)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, tampered)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000000"
