"""SimHash fingerprints and their components against comparing all pairs."""
import random
import re

import numpy as np
import pytest
import xxhash

from .support import LOWER, SMALL
from railyard.llm import simhash
from railyard.llm.queries import QUERIES
from railyard.llm.simhash import Ring


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, bits=2):
    """The smallest place reachable from each place of the list."""
    fps = np.array(fps, np.uint64)
    label = np.arange(len(fps))
    near = [np.flatnonzero(np.bitwise_count(fps ^ f) <= bits) for f in fps]
    changed = True
    while changed:
        changed = False
        for i, n in enumerate(near):
            least = label[n].min()
            if (label[n] != least).any():
                label[n], changed = least, True
    return label


def brute(rows):
    fps = [fingerprint(t) for _, t in rows]
    label = components(fps)
    least = {}
    for (d, _), c in zip(rows, label):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    return sorted(((d, f"{f:016x}", least.get(c)) for (d, _), f, c in zip(rows, fps, label)), key=str)


def test_whole_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_simhash"](spark, SMALL)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_near_copies_odd_rows(stored_docs, odd_docs):
    rng = random.Random(3)
    rows = []
    for family in range(12):
        base = [f"w{rng.randrange(900)}" for _ in range(400)]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 30])):
                words[rng.randrange(400)] = f"v{rng.randrange(10 ** 6)}"
            rows.append((len(rows), rng.choice([" ", "\t", " \n "]).join(words).upper()))
    rows += [(None, rows[0][1]), (-5, rows[0][1]), (-5, rows[0][1]), (None, "lone text of a row without id")]
    got = simhash.near_duplicates(stored_docs(rows, files=3)).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == brute(rows)
    odd = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = simhash.near_duplicates(odd_docs).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == brute(odd)
    assert {r.fingerprint for r in got if r.doc_id in (2, 3, 4)} == {"0" * 16}


def test_empty_table(stored_docs):
    assert simhash.near_duplicates(stored_docs([], files=1)).collect() == []


@pytest.mark.parametrize("chunk", [2, 9, 2048])
@pytest.mark.parametrize("segments,bits", [(3, 2), (4, 2), (5, 3), (2, 1)])
def test_links_of_crowded_buckets(spark, segments, bits, chunk):
    """Fingerprints around few centres: buckets are hot, links are many; rows given out are not."""
    rng = random.Random(segments * 100 + chunk)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = set()
    while len(fps) < 500:
        f = rng.choice(centres)
        for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 5])):
            f ^= 1 << b
        fps.add(f)
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    classes = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = simhash.linked(classes, Ring(bits=bits, segments=segments, chunk=chunk)).collect()
    place = {f: i for i, f in enumerate(signed)}
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in got:
        assert (fps[place[r.a]] ^ fps[place[r.b]]) or r.a == r.b
        x, y = sorted((find(place[r.a]), find(place[r.b])))
        up[y] = x
    assert [find(i) for i in range(len(fps))] == components(fps, bits).tolist()
    if chunk == 2048:
        assert len(got) <= segments * len(fps)
