import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from .support import SMALL
from railyard.llm import suffix_dedup
from railyard.llm.queries import QUERIES
from railyard.llm.suffix_dedup import Suffixes


def brute(rows, length):
    """(id, n, removed, spans, digest) by the definition."""
    holders = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1) if i is not None else ():
            w = b[p:p + length]
            holders[w] = min(holders.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1) if i is not None else ():
            if holders[b[p:p + length]] < i:
                gone[p:p + length] = True
        spans = int((gone[1:] < gone[:-1]).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order(seed):
    """Two-stage order equals the sorted suffixes, to the depth, segment by segment."""
    rng = random.Random(seed)
    depth = rng.choice([8, 12, 50])
    letters = [b"ab", b"a", bytes(range(256)), b"\x00\xff", b"abcd \n"][seed % 5]
    segments = [bytes(rng.choice(letters) for _ in range(depth + rng.randint(0, 40))) for _ in range(60)]
    segments += segments[:20]
    raw, sizes = b"".join(segments), np.array([len(s) for s in segments])
    suffixes = Suffixes(raw, sizes, depth)
    order = suffixes.sorted()
    stop = np.cumsum(sizes)
    starts = [p for s, z in zip(stop - sizes, stop) for p in range(s, z - depth + 1)]
    assert sorted(order.tolist()) == starts
    first = [raw[p:p + depth] for p in order]
    assert first == sorted(first)
    same = suffixes.same_as_before(order)
    assert same.tolist() == [False] + [a == b for a, b in zip(first, first[1:])]


@pytest.mark.parametrize("shared_by,chunk_bits", [(32, 8), (1, 1), (0, 0)])
def test_passages_against_brute_force(stored_docs, shared_by, chunk_bits):
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcdé \n") for _ in range(rng.choice([30, 49, 50, 51, 90, 300]))) for _ in range(12)]
    rows = [(i, "".join(rng.choice([rng.choice(passages), "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60)))]) for _ in range(rng.randint(0, 8)))) for i in range(80)]
    rows += [(200, "z" * 500), (201, "z" * 60), (202, "z" * 49), (203, None), (204, ""), (205, rows[3][1]), (1, rows[7][1]), (None, passages[5]), (206, "z" * 500), (206, "z" * 500)]
    rng.shuffle(rows)
    assert result(suffix_dedup.repeated_bytes(stored_docs(rows, files=3), shared_by=shared_by, chunk_bits=chunk_bits)) == brute(rows, 50)


def test_whole_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert result(QUERIES["op6_suffix_dedup"](spark, SMALL)) == brute(rows, 50)


def test_odd_rows(odd_docs, stored_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert result(suffix_dedup.repeated_bytes(odd_docs)) == brute(rows, 50)
    assert suffix_dedup.repeated_bytes(stored_docs([])).count() == 0


def test_long_text(stored_docs):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    rows = [(1, text[:2600]), (2, "new " + text[1000:4000] + " end"), (3, text)]
    assert result(suffix_dedup.repeated_bytes(stored_docs(rows))) == brute(rows, 50)


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    data = np.frombuffer(random.Random(3).randbytes(4000), np.uint8) % 4
    border = np.array([0, 30, 1500, 1500, 4000])
    windows = lambda x: [(k, w) for k, a, z in zip(*(c.tolist() for c in x)) for w in range(a, z + 1)]
    whole = windows(suffix_dedup.anchors(data, border))
    monkeypatch.setattr(suffix_dedup, "PIECE", 97)
    assert windows(suffix_dedup.anchors(data, border)) == whole
    assert [w for _, w in whole] == [*range(30, 1451), *range(1500, 3951)]


def test_chunks_follow_the_longest_text(stored_docs, monkeypatch):
    """Fewer texts a chunk where one is long; the same result."""
    rng = random.Random(12)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(90))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(60)) + shared * (i % 3)) for i in range(40)] + [(99, shared * 40)]
    used, plain = [], suffix_dedup.removed_stretches
    monkeypatch.setattr(suffix_dedup, "removed_stretches", lambda rows, length, shared_by, bits: used.append(bits) or plain(rows, length, shared_by, bits))
    for most, bits in ((64 << 20, 8), (9_000, 1), (1_000, 0)):
        monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", most)
        assert result(suffix_dedup.repeated_bytes(stored_docs(rows, files=3))) == brute(rows, 50)
        assert used.pop() == bits


def test_a_bucket_is_sorted_in_small_parts(monkeypatch):
    """A task sorts its segments a few at a time however many they are; nothing is lost."""
    rng = random.Random(4)
    own = [rng.randbytes(50 + i % 60).translate(bytes(32 + x % 95 for x in range(256))) for i in range(1500)]
    texts = [b"".join(own[i:i + 10]).decode() for i in range(0, 1500, 10)]
    texts += [texts[i][:300] + texts[i + 1][-300:] for i in range(149)]
    rows = pa.table({"uid": pa.array(range(len(texts)), pa.int64()), "id": pa.array(range(len(texts)), pa.int64()), "text": texts, "chunk": pa.array([i // 256 for i in range(len(texts))], pa.int64())})
    sent = pa.Table.from_batches(suffix_dedup._send(iter(rows.to_batches()), 1, 50))
    answers = pa.Table.from_batches(suffix_dedup._answer(iter(sent.to_batches()), 2000)).append_column("kind", pa.array([0] * 2, pa.int32()))
    together = pa.concat_tables([answers, rows.append_column("kind", pa.array([1] * len(texts), pa.int32()))], promote_options="default").sort_by([("chunk", "ascending"), ("kind", "ascending")])
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 4096, raising=False)
    sizes, plain = [], suffix_dedup._settled
    monkeypatch.setattr(suffix_dedup, "_settled", lambda *a: sizes.append(len(a[4])) or plain(*a))
    cut = [b for table in suffix_dedup._groups(iter(together.to_batches()), "chunk") for b in suffix_dedup._cut_chunk(table, 1, 50, 8)]
    gone = pa.Table.from_batches(suffix_dedup._settle(iter(pa.Table.from_batches(cut).sort_by("kind").combine_chunks().to_batches()), 50, 8)).to_pylist()
    assert sum(sizes) > 60_000 and max(sizes) <= 2 * 4096
    held = {}
    for i, text in enumerate(texts):
        for p in range(len(text) - 49):
            held.setdefault(text[p:p + 50], i)
    want = [{p + k for p in range(len(text) - 49) if held[text[p:p + 50]] < i for k in range(50)} for i, text in enumerate(texts)]
    have = [set() for _ in texts]
    for r in gone:
        have[r["uid"]] |= set(range(r["start"], r["stop"]))
    assert have == want
