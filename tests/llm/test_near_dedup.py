import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from .support import LOWER, SMALL
from railyard.llm import near_dedup
from railyard.llm.components import connected_components
from railyard.llm.near_dedup import Links
from railyard.llm.queries import QUERIES


def sets_of(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent=80):
    """(n, component) per row by comparing all pairs."""
    sets = [sets_of(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10 ** 6)}"
    return words


@pytest.mark.parametrize("k", [2, 5])
def test_families_against_brute_force(stored_docs, k):
    rng = random.Random(k)
    rows, i = [], 0
    for family in range(6):
        base = [f"f{family}x{rng.randrange(400)}" for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(25):
            rows.append((i, " ".join(edited(rng, base, rng.choice([0, 0, 1, 2, 4, 8, 12])))))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \t"), (i + 3, "one"), (i + 4, "ONE"), (i + 5, "one two")]
    rng.shuffle(rows)
    got = near_dedup.near_duplicates(stored_docs(rows, files=3), links=Links(words=k)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, k)
    firsts = [r.component_id for r in got if r["first"]]
    assert len(firsts) == len(set(firsts)) == len({r.component_id for r in got})


def test_whole_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = QUERIES["op10_near_dedup"](spark, SMALL).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(odd_docs, stored_docs):
    got = near_dedup.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    one = [r for r in got if r.component_id == 1]
    assert len(one) == 3 and sum(r["first"] for r in one) == 1  # two equal rows and one without an id
    assert all(r["first"] for r in got if r.n_shingles == 0)
    assert near_dedup.near_duplicates(stored_docs([])).count() == 0


def test_rest_pairs_deal_large_components(spark, stored_docs, monkeypatch):
    """A bucket whose largest component is dealt into several chunks gives the same pairs."""
    rng = random.Random(8)
    base = [f"x{i}" for i in range(100)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([1, 3, 6, 9])))) for i in range(60)]
    monkeypatch.setattr(near_dedup, "CHUNK", 7)
    got = near_dedup.near_duplicates(stored_docs(rows), links=Links(words=2)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 2)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (5, 5), (200, 201), (201, 200)]
    got = {tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(100, 100), (101, 100), (102, 100), (200, 200), (201, 200)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_miss_probability_of_the_tables():
    rng = np.random.RandomState(0)
    agree = (rng.rand(200_000, near_dedup.COLLECTIONS, near_dedup.PER_COLLECTION) < 0.8).all(2).sum(1)
    assert (agree < 2).mean() < 1e-4


def test_buckets_stream_over_batches():
    import pyarrow as pa
    key = [1, 2, 2, 2, 3, 4, 4, 5]
    rows = pa.RecordBatch.from_arrays([pa.array(key), pa.array(range(8))], names=["key", "node"])
    for cut in ([8], [1] * 8, [3, 5], [2, 1, 4, 1]):
        parts, at = [], 0
        for n in cut:
            parts.append(rows.slice(at, n))
            at += n
        assert [x for b in near_dedup._shared(iter(parts)) for x in b.column("node").to_pylist()] == [1, 2, 3, 5, 6]


def test_half_alike_long_texts_give_out_few_pairs(stored_docs, monkeypatch):
    """Texts of similarity 0.6 share buckets, but their pairs do not leave the tasks."""
    rng = random.Random(6)
    common = [f"c{rng.randrange(10 ** 6)}" for _ in range(2250)]
    rows = [(i, " ".join(common + [f"u{i}x{k}" for k in range(750)])) for i in range(400)]
    given = []
    plain = near_dedup._rest_pairs

    def counted(*args):
        out = plain(*args)
        given.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "_rest_pairs", counted)
    got = near_dedup.near_duplicates(stored_docs(rows, files=3)).collect()
    assert all(r.component_id == r.doc_id and r.first for r in got) and len(got) == 400
    assert given and sum(given) < 10 * len(rows)


def test_first_shared_table_and_folded_bitmaps():
    rng = np.random.RandomState(3)
    sig = rng.randint(0, 2, (50, near_dedup.COLLECTIONS, near_dedup.PER_COLLECTION)).astype(np.uint32)
    tables = [(x, y) for x in range(near_dedup.COLLECTIONS) for y in range(x + 1, near_dedup.COLLECTIONS)]
    for i in range(50):
        got = near_dedup._first_table(sig, i, np.arange(50))
        for j in range(50):
            agree = (sig[i] == sig[j]).all(1)
            assert got[j] == next((t for t, (x, y) in enumerate(tables) if agree[x] and agree[y]), -1)
    values = np.sort(rng.randint(0, 1 << 62, 3000).astype(np.uint64))
    wide, = near_dedup._bitmaps(values, np.array([0, 3000]))
    narrow = near_dedup._folded(wide, 1024)
    marks = np.zeros(1024, bool)
    marks[(values >> np.uint64(20)) % np.uint64(1024)] = True
    assert narrow.tobytes() == np.packbits(marks).tobytes()
