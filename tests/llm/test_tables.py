"""WARC, URL filter, top-k search, quality classifier and the pipeline."""
import base64
import collections
import datetime as dt
import gzip
import hashlib
import math
import os
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from .support import LOWER, SMALL
from railyard.llm import quality, topk, url_filter, warc
from railyard.llm.queries import QUERIES

PAGES = "page_id long, url string, html string, key string, digest int"


def brute_warc(rows):
    best = {}
    for i, _, h, *_ in rows:
        best[h or ""] = max(best.get(h or "", -math.inf), -math.inf if i is None else i)
    out = []
    for i, _, h, *_ in rows:
        p = (h or "").encode()
        first = best[h or ""]
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    return sorted(out, key=repr)


def test_warc_against_brute_force(stored_docs):
    rng = random.Random(4)
    bodies = ["<p>one</p>", "", None, "é\r\n\r\nWARC/1.1\r\n\r\n", "x" * 200000, "<p>two</p>"]
    rows = [(i, rng.choice(["http://a.b/c", None, "http://x/\r\nevil: 1"]), rng.choice(bodies), "k", 1) for i in range(60)]
    got = warc.deduplicated_archive(stored_docs(rows, PAGES)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute_warc(rows)


def test_warc_files(spark, stored_docs, tmp_path):
    rows = [(1, "http://a/", "same", "k", 1), (2, "http://b/", "same", "k", 1), (3, "http://c/", "other", "k", 1)]
    path = str(tmp_path / "out")
    warc.deduplicated_archive(stored_docs(rows, PAGES), path=path).count()
    files = [f for f in os.listdir(path) if f.endswith(".warc.gz")]
    records = [r for f in files for r in warc.parse(gzip.open(f"{path}/{f}").read())]
    infos = [h for h, _ in records if h["warc-type"] == "warcinfo"]
    assert len(infos) == len(files) and not any(f.endswith(".txt") for f in os.listdir(path))
    records = [(h, b) for h, b in records if h["warc-type"] != "warcinfo"]
    by = {h["x-record-key"]: (h, b) for h, b in records}
    assert all(abs(dt.datetime.now(dt.timezone.utc) - dt.datetime.fromisoformat(h["warc-date"])) < dt.timedelta(hours=1) for h, _ in records)
    assert len(records) == 3 and by["1"][0]["warc-type"] == "revisit" and by["1"][0]["warc-refers-to"] == by["2"][0]["warc-record-id"]
    assert by["2"][1].endswith(b"\r\n\r\nsame") and by["1"][1].endswith(b"\r\n\r\n") and by["1"][0]["warc-refers-to-target-uri"] == "http://b/"
    full = warc.read_archive(spark, path, payload=True)
    assert {bytes(r.payload) for r in full.collect()} == {b"same", b"other", b""}


def members(data):
    """Unpacked members of a gzip file, one by one, with nothing between or after them."""
    out = []
    while data:
        one = zlib.decompressobj(31)
        out.append(one.decompress(data))
        assert one.eof
        data = one.unused_data
    return out


def test_warc_members_are_records(spark, stored_docs, tmp_path, monkeypatch):
    """A member per record, a warcinfo first in each file; files by records and bytes; one record over 16 MiB."""
    rows = [(i, "http://a/", f"<p>{i % 5}</p>", "k", 1) for i in range(25)] + [(99, "http://b/", "long " * 4_000_000, "k", 1)]
    docs = stored_docs(rows, PAGES, files=1)
    assert warc.records_per_file(docs) == 13
    monkeypatch.setattr(warc, "FILE_BYTES", 100_000_000)
    path = str(tmp_path / "members")
    got = warc.deduplicated_archive(docs, path=path).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute_warc(rows)
    count = 0
    for f in os.listdir(path):
        if f.endswith(".warc.gz"):
            own = [m for m in members(open(f"{path}/{f}", "rb").read()) if m]
            kinds = [h["warc-type"] for m in own for h, _ in warc.parse(m)]
            assert len(kinds) == len(own) <= 6 and kinds[0] == "warcinfo" and "warcinfo" not in kinds[1:]
            count += len(kinds) - 1
    assert count == 26


def test_revisits_meet_their_files_by_shuffle_as_well(stored_docs, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", 0)
    rows = [(i, "http://a/", f"<p>{i % 7}</p>", "k", 1) for i in range(60)]
    got = warc.deduplicated_archive(stored_docs(rows, PAGES, files=3)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute_warc(rows)


def test_warc_files_are_not_unpacked_whole(monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 2_000_000)
    record = warc._record([("WARC-Type", "response")], b"x" * 1_000_000)
    content = pa.py_buffer(gzip.compress(record, 1) * 40 + gzip.compress(record * 40, 1))
    tracemalloc.start()
    try:
        sizes = [len(block) for _, block in warc.unpacked(content)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sizes == [1_000_000] * 80 and peak < 10_000_000


def test_warc_payloads_over_batches(spark, stored_docs, tmp_path):
    """Payloads that do not shrink when packed: several batches of a file, every record once."""
    rng = random.Random(9)
    rows = [(i, "http://a/", "".join(map(chr, rng.choices(range(33, 0x2000), k=400_000))), "k", 1) for i in range(12)]
    path = str(tmp_path / "large")
    warc.write_archive(stored_docs(rows, PAGES, files=1), path)
    got = warc.read_archive(spark, path, payload=True).collect()
    assert sorted((int(r.key), bytes(r.payload).decode()) for r in got) == [(i, h) for i, _, h, *_ in rows]


def test_warc_odd_rows(stored_docs):
    rows = [(None, None, None, None, None), (1, None, "p", "a", 0), (1, None, "p", "a", 0), (None, "u", "p", None, None)]
    got = warc.deduplicated_archive(stored_docs(rows, PAGES)).collect()
    p = [r for r in got if r.payload_bytes == 1]
    assert len(got) == 4 and sum(r.record_type == "response" for r in p) == 1 and {r.refers_to for r in p} == {None, 1}
    assert warc.deduplicated_archive(stored_docs([], PAGES)).count() == 0


def brute_url(u):
    h = p = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        m = re.match(r"[^/?#]*", rest)
        h, p = m.group().translate(LOWER), re.match(r"[^?#]*", rest[m.end():]).group()
    best = None
    for act, text in url_filter.RULES:
        rh, _, rp = text.partition("/")
        if (h == rh or h.endswith("." + rh)) and p.startswith("/" + rp) and (best is None or len(text) > len(best[1])):
            best = act, text
    return h, p, best and best[1], best and best[0]


URLS = ["http://a.com/", "http://A.COM", "https://www.example.com/en/x?y#z", "http://example.com/en/", "http://x.example.com/en/1", "http://notexample.com/en/", "ftp://b.net/es/1",
        "b.net/es/1", None, "", "http://", "http://?q", "http://h#f/x", "http://net/fr/", "http://É.net/fr/a b", "http://a://b/c", "http://x.org/p\nq"]


def test_urls_against_brute_force(stored_docs):
    rows = [(i, u, None, "k", 1) for i, u in enumerate(URLS)]
    for r in url_filter.judge(stored_docs(rows, PAGES)).collect():
        h, p, rule, act = brute_url(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (h, p, rule) and r.verdict in ("allow", "block") and (act is None or r.verdict == act)


def test_propagation_against_dense_iteration(spark):
    rng = random.Random(6)
    hosts = [f"h{i}" for i in range(12)]
    edges = [(a, b, float(rng.randint(1, 3))) for a in hosts for b in hosts if a != b and rng.random() < 0.2]
    seeds = [("trust", "h0", 3.0), ("trust", "h1", 1.0), ("distrust", "h7", 2.0)]
    got = url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame(seeds, "kind string, host string, weight double"), settled=1e-9)
    got = {(r.kind, r.host): r.score for r in got.collect()}
    for kind in ("trust", "distrust"):
        m = np.zeros((12, 12))
        for a, b, w in edges:
            i, j = hosts.index(a), hosts.index(b)
            m[(i, j) if kind == "trust" else (j, i)] += w
        out = m.sum(1, keepdims=True)
        m = np.divide(m, out, out=np.zeros_like(m), where=out > 0)
        s = np.zeros(12)
        for k, h, w in seeds:
            s[hosts.index(h)] += w * (k == kind)
        s /= s.sum()
        x = s
        for _ in range(1000):
            x = 0.15 * s + 0.85 * x @ m
        assert all(abs(x[i] - got.get((kind, h), 0.0)) < 1e-8 for i, h in enumerate(hosts))


def test_ranks_have_settled(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double")
    got = url_filter.propagate(edges, spark.createDataFrame([("trust", "a", 1.0)], "kind string, host string, weight double"))
    got = {r.host: r.score for r in got.collect()}
    assert abs(got["a"] - 0.15 / (1 - 0.85 ** 2)) < 1e-6 and abs(got["b"] - 0.85 * 0.15 / (1 - 0.85 ** 2)) < 1e-6


def test_verdicts_of_the_whole_small_table(spark):
    """Rules and propagated verdicts against a dense walk over the table's host edges."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    rows = pages.select("page_id", "url").collect()
    edges = [(r.src, r.dst, r.weight) for r in url_filter.host_edges(pages).collect()]
    judged = {r.page_id: brute_url(r.url) for r in rows}
    hosts = sorted({h for h, *_ in judged.values() if h} | {x for e in edges for x in e[:2]})
    place = {h: i for i, h in enumerate(hosts)}
    score = {}
    for kind, act in (("trust", "allow"), ("distrust", "block")):
        m, s = np.zeros((len(hosts), len(hosts))), np.zeros(len(hosts))
        for a, b, w in edges:
            m[(place[a], place[b]) if kind == "trust" else (place[b], place[a])] += w
        for h, _, _, verdict in judged.values():
            s[place[h]] += bool(h) and verdict == act
        m = np.divide(m, m.sum(1, keepdims=True), out=np.zeros_like(m), where=m.sum(1, keepdims=True) > 0)
        x = s = s / max(s.sum(), 1)
        for _ in range(500):
            x = 0.15 * s + 0.85 * x @ m
        score[kind] = x
    for r in QUERIES["op4_url_filter"](spark, SMALL).collect():
        h, p, rule, verdict = judged[r.page_id]
        far = score["distrust"][place[h]] - score["trust"][place[h]] if h else 0.0
        assert (r.host, r.path, r.rule) == (h, p, rule)
        assert r.verdict == (verdict or ("block" if far > 0 else "allow")) or abs(far) < 1e-6


def test_url_rows_repeated_and_without_keys(stored_docs):
    rows = [(1, "http://a.com/x", None, "k", 1)] * 3 + [(None, "http://b.net/es/1", "<a href=//a.com>", "k", 1)] * 2 + [(None, None, None, None, None)]
    got = url_filter.judge(stored_docs(rows, PAGES)).collect()
    assert sorted((r.page_id or 0, r.host, r.verdict) for r in got) == [(0, "", "allow"), (0, "b.net", "block"), (0, "b.net", "block"), *[(1, "a.com", "allow")] * 3]


def test_links_and_domains_spread_distrust(stored_docs):
    html = '<a href="http://bad.net/es/">x</a><a href=//HUB.org/y>z</a><a href="/local">l</a>'
    rows = [(1, "http://bad.net/es/1", None, "k", 1), (2, "http://friend.org/a", html, "k", 1), (3, "http://far.org/a", None, "k", 1), (4, "http://sub.bad.net/xx/", None, "k", 1)]
    docs = stored_docs(rows, PAGES)
    edges = {(r.src, r.dst) for r in url_filter.host_edges(docs, domains=False).collect()}
    assert edges == {("friend.org", "bad.net"), ("friend.org", "hub.org")}
    got = {r.page_id: r.verdict for r in url_filter.judge(docs).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block"}
    assert url_filter.judge(stored_docs([], PAGES)).count() == 0


def brute_top(rows, queries, k=20):
    most, good = 2 ** 63 - 1, []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [max(-most, min(most, math.floor(64 * x))) if math.isfinite(64 * x) else math.copysign(1, x) * most for x in v]))
    out = []
    for q, v in good:
        if queries(q):
            best = sorted((-max(-most, min(most, sum(int(x) * int(y) for x, y in zip(v, w)))), i) for i, w in good if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 16])
def test_top_k_against_brute_force(stored_docs, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.RandomState(block)
    rows = [(int(i), [float(x) for x in rng.normal(size=24) * rng.choice([0.1, 1, 3]) * (0.5 ** np.arange(24))]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]  # many equal vectors: ties
    rows += [(2000, None), (2020, [1.0, None]), (2040, [float("nan")]), (2060, [float("inf"), 1.0]), (2080, []), (None, [1.0]), (2100, [0.0] * 24), (2120, [1.0, 2.0])]
    docs = stored_docs(rows, "vec_id long, embedding array<float>", files=3)
    exact = [(r.vec_id, r.embedding) for r in docs.collect()]
    got = topk.top_k(docs, docs.where("vec_id % 20 = 0"), 20).collect()
    assert sorted(tuple(r) for r in got) == brute_top(exact, lambda q: q % 20 == 0)


@pytest.mark.parametrize("size", [3e6, 1e9, 1e17, 1e300])
def test_top_k_of_large_components(stored_docs, monkeypatch, size):
    """Scores beyond what doubles, and longs, hold exactly; repeated ids and clashing columns."""
    monkeypatch.setattr(topk, "BLOCK", 8)
    rng = np.random.RandomState(7)
    rows = [(int(i) // 2 * 2 if i % 9 == 0 and i != 81 else int(i), [float(x) for x in rng.normal(size=16) * size * rng.choice([1, 1, 0.01, 1e-6])], 1, 2, b"") for i in range(120)]
    rows += [(500, [size] * 16, 1, 2, b""), (520, [size, *[0.0] * 15], 1, 2, b""), (540, [-size] * 16, 1, 2, b"")]
    docs = stored_docs(rows, "vec_id long, embedding array<double>, block long, score int, ids binary", files=2)
    got = topk.top_k(docs, docs.where("vec_id % 20 = 0"), 7).collect()
    assert sorted(tuple(r) for r in got) == brute_top([r[:2] for r in rows], lambda q: q % 20 == 0, 7)


def test_top_k_joins_blocks_by_number(spark, monkeypatch):
    from railyard.llm import common
    plans = []

    def noted(df, tag):
        out = common.stored(df, tag)
        plans.append(df._jdf.queryExecution().toString())
        return out

    monkeypatch.setattr(topk, "stored", noted)
    QUERIES["op3_top_k"](spark, SMALL).collect()
    assert plans and not any("NestedLoopJoin" in p or "Cartesian" in p for p in plans)


def test_top_k_few_rows(stored_docs):
    docs = stored_docs([(20, [1.0]), (21, [2.0]), (40, [-1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(docs, docs.where("vec_id % 20 = 0"), 20).collect()) == [(20, 1, 21, 8192), (20, 2, 40, -4096), (40, 1, 20, -4096), (40, 2, 21, -8192)]
    empty = stored_docs([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty, empty).count() == 0


def test_top_k_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op3_top_k"](spark, SMALL).collect()) == brute_top(rows, lambda q: q % 20 == 0)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op5_quality"](spark, sf)
    assert got.count() == 1000 and got.where("score < 0 or score > 1 or predicted <> cast(score >= 0.7 as int)").count() == 0
    held = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(held) > 50 and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum(r.predicted == r.quality for r in held) / len(held) >= 0.95


def plain_statistics(text):
    raw = (text or "").encode()
    sets = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:?'\"-()"]
    kind = lambda b: 7 if b >= 128 else next((i for i, x in enumerate(sets) if b in x), 6)
    kinds = collections.Counter(kind(b) for b in raw)
    order = [0, 1, 2, 3, 4, 5, 6, 7]
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n = max(len(w), 1)
    mean = sum(map(len, w)) / n
    spread = math.sqrt(max(sum(len(x) ** 2 for x in w) / n - mean ** 2, 0))
    odd = sum(33 <= x[-1] < 127 and kind(x[-1]) in (5, 6) for x in w) / n
    return [kinds[k] / max(len(raw), 1) for k in order] + [math.log1p(len(w)), mean, spread, odd, math.log(n / (raw.count(b"\n") + 1)), len({x.lower() for x in w}) / n]


def test_scores_against_a_dense_fit(spark):
    """All labelled rows at once in NumPy: the same statistics, ridge and isotonic curve."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.doc_id in rows}
    own = {r.doc_id: r.own for r in docs.select("doc_id", (F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(4)) == 0).alias("own")).collect()}
    x = np.array([plain_statistics(rows[d]) for d in known])
    y, keep = np.array(list(known.values()), float), np.array([own[d] for d in known])
    mean, scale = x.mean(0), np.sqrt(np.maximum((x ** 2).mean(0) - x.mean(0) ** 2, 1e-12))
    m = quality.fourier(np.clip((x - mean) / scale, -6, 6))
    a, b = m[~keep], y[~keep]
    weight = np.linalg.solve(a.T @ a + quality.RIDGE * len(a) / quality.FEATURES * np.eye(m.shape[1]), a.T @ b)
    at = np.clip(((m[keep] @ weight + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    bins = sorted(set(at))
    n, good = np.array([(at == i).sum() for i in bins]), np.array([y[keep][at == i].sum() for i in bins])
    # the isotonic curve by its definition: the largest of the least means
    curve = [max(min(good[j:k + 1].sum() / n[j:k + 1].sum() for k in range(i, len(bins))) for j in range(i + 1)) for i in range(len(bins))]
    edges = (np.array(bins) + 0.5) / quality.BINS * 2 - 0.5
    ids = sorted(rows)
    z = quality.fourier(np.clip((np.array([plain_statistics(rows[d]) for d in ids]) - mean) / scale, -6, 6))
    want = dict(zip(ids, np.clip(np.interp(z @ weight, edges, curve), 0, 1)))
    for r in QUERIES["op5_quality"](spark, SMALL).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-6 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_held_out_labels_are_not_learned(spark, stored_docs):
    """Turning the held-out labels round changes no score."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({r.doc_id: round(r.score, 9) for r in quality.quality(docs, x).collect()} for x in (labels, turned))
    assert one == two


def test_quality_scan_keeps_its_tasks(spark, stored_docs, monkeypatch):
    """The scan of the documents for the fit is not narrowed to the 16 tasks of its outcome."""
    plans: list[str] = []
    monkeypatch.setattr(quality, "stored", lambda df, tag: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    labels = stored_docs([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    assert quality.fit(stored_docs([(i, f"text {i}") for i in range(400)]), labels) is not None
    plan, = plans
    above = plan[:plan.index("MapInArrow")]
    assert "Repartition 16, true" in above and "Repartition 16, false" not in above


def test_quality_odd_rows(spark, odd_docs, stored_docs):
    labels = stored_docs([(1, 1), (3, 0), (5, 0), (5, None), (None, 1), (6, 1)], "doc_id long, quality int")
    got = quality.quality(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    none = stored_docs([], "doc_id long, quality int")
    assert {r.score for r in quality.quality(odd_docs, none).collect()} == {1.0}
    assert quality.quality(stored_docs([]), labels).count() == 0
    assert quality.good_documents(odd_docs, none).schema == odd_docs.schema


def test_increasing_curve():
    assert quality.increasing(np.array([0.0, 1.0, 0.5, 0.7]), np.ones(4)).tolist() == pytest.approx([0.0, 0.7333333333, 0.7333333333, 0.7333333333])


def test_pipeline(spark):
    import corpus_pipeline
    from railyard.llm import decontaminate, near_dedup, pieces, secrets
    from railyard.llm.common import read_table, stored
    sf = "/root/testdata/sf0.01"
    docs = read_table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "secrets", "sentencepiece"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    one = stored(corpus_pipeline.keep_good(spark, docs, sf), "t1")
    assert one.columns == docs.columns
    assert ids(one) == ids(quality.quality(docs, read_table(spark, sf, "labels")).where("predicted = 1"))
    two = stored(corpus_pipeline.keep_one_of_each(spark, one, sf), "t2")
    assert two.columns == docs.columns and ids(two) == ids(near_dedup.near_duplicates(one).where("doc_id = component_id"))
    three = stored(corpus_pipeline.keep_clean(spark, two, sf), "t3")
    assert three.columns == docs.columns and ids(three) == ids(two) - ids(decontaminate.contained_items(two, read_table(spark, sf, "benchmark")))
    four = stored(corpus_pipeline.redact_secrets(spark, three, sf), "t4")
    assert four.columns == docs.columns and four.schema["n_chars"].dataType == docs.schema["n_chars"].dataType and ids(four) == ids(three)
    assert secrets.secret_spans(four).where("n_assign + n_access + n_hex > 0").count() == 0
    five = corpus_pipeline.tokens(spark, four, sf)
    want = {(r.doc_id, r.ids_sha256) for r in pieces.tokenized(four).collect()}
    assert {(r.doc_id, r.ids_sha256) for r in five.collect()} == want
    assert {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect()} == want
