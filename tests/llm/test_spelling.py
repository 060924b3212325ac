"""Spelling variants against counting and comparing in plain Python."""
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from .support import LOWER, SMALL
from railyard.llm import spelling
from railyard.llm.queries import QUERIES


def brute_words(rows):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{d}:{run}".encode())
            if d is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 3}


def brute_near(words):
    """Near words by deleted letters: a key for each place of each word."""
    by_rest, near = defaultdict(list), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by_rest[i, w[:i] + w[i + 1:]].append(w)
            if w[:i] + w[i + 1:] in words:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for group in by_rest.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    return near


def brute(rows):
    words = brute_words(rows)
    near, form = brute_near(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=str)


def as_rows(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


def test_whole_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = as_rows(QUERIES["op12_spelling_variants"](spark, SMALL))
    assert got == brute(rows)
    assert any(r[1] for r in got) and any(r[4] for r in got)


def test_odd_rows_letters_and_chains(stored_docs, odd_docs):
    chain = "abcdefgh " * 3 + "abcdefg " * 6 + "abcdef " * 12 + "abcdex " * 24 + "ÀÉÿ×÷ " * 3 + "ÀÉÿ×÷ß " * 9 + "Straße STRASSE straße ſtraße " * 3 + "naïve_naïve-naïve 5naïve5 " * 3
    long = "a" * 5000 + "b" * 5000
    text = " ".join([chain, *[long] * 3, *[long[1:]] * 9, *["c" + long] * 4, *["x" * 70, "x" * 69 + "y"] * 3])
    rows = [(1, text), (None, text), (2, None), (3, ""), (1, text), (4, "ééééé " * 300)]
    assert as_rows(spelling.variants(stored_docs(rows))) == brute(rows)
    odd = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert as_rows(spelling.variants(odd_docs)) == brute(odd)
    assert as_rows(spelling.variants(stored_docs([], files=1))) == []


def test_deleted_letters_follow_the_checksum():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.choice([1, 5, 9, 63, 64, 65, 300]))) for _ in range(4000)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    border = np.array([0, len(data)])
    for every in (1, 3):
        want = Counter()
        for w in words:
            h = zlib.crc32(f"77:{w}".encode())
            if h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 5:
                want[w] += 1
        assert spelling._count(data, border, [77], 5, every) == want


@pytest.mark.parametrize("prefixes,chunk", [(4096, 2048), (200, 3), (10 ** 9, 50)])
def test_near_words_at_any_dictionary_and_list_length(spark, monkeypatch, prefixes, chunk):
    """Crowded words over few letters: long lists, many near words, repeated grams."""
    monkeypatch.setattr(spelling, "FREQUENT", 2)
    rng = random.Random(chunk)
    words = {"".join(rng.choice("ab") for _ in range(rng.choice([5, 6, 7, 12]))) for _ in range(400)}
    words |= {"".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.choice([5, 8]))) for _ in range(300)}
    for w in list(words)[:200]:
        i = rng.randrange(len(w))
        words.add(rng.choice([w[:i] + "q" + w[i:], w[:i] + "q" + w[i + 1:], w + "z", "z" + w]))
    frame = spark.createDataFrame([(w, len(w)) for w in sorted(words)], "word string, n long").repartition(3)
    got = spelling.near_words(frame, prefixes, chunk).collect()
    near = brute_near(words)
    assert {(r.a, r.b) for r in got} == {(a, b) for a in near for b in near[a] if a < b}
    assert len(got) == len({(r.a, r.b) for r in got})


def test_every_word_has_a_gram_beyond_its_bound():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 12))) for _ in range(2000)]
    for share in (0, 0.3, 1):
        text, _ = spelling._padded(words)
        codes = np.unique(np.concatenate([spelling._codes(text, 2), spelling._codes(text, 3)]))
        g = spelling.Grams(words, np.sort(codes[np.array([rng.random() < share for _ in codes], bool)]))
        assert (np.bincount(g.row, minlength=len(words)) - g.bound >= 1).all()
