"""Licence scan, decontamination and tokenisation against brute force."""
import collections
import random
import re

import pytest

from .support import LOWER, SMALL
from railyard.llm import decontaminate, licenses, pieces
from railyard.llm.pieces import SPACE, Vocabulary
from railyard.llm.queries import QUERIES

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = [("cc by".split(), "cc-by"), ("general public license".split(), "gpl"), ("all rights reserved".split(), "reserved")]


def words(text):
    return re.findall(WORD, (text or "").translate(LOWER))


def base_places(text):
    w = words(text)
    at = [(i, label) for p, label in PHRASES for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    s = [i for i, _ in at]
    return len(w), len(at), min(s, default=None), max(s, default=None), ",".join(sorted({x for _, x in at}))


def test_licenses_against_brute_force(stored_docs):
    rng = random.Random(1)
    bits = ["cc", "by", "CC BY", "general", "public", "license", "General Public License", "all rights", "reserved", "All rights reserved.", "é", "x-y", "\n", "4.0",
            licenses.TEXTS[0].text, licenses.TEXTS[2].text]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(300)] + [(900, None), (901, ""), (902, "cc by " * 20000), (7, "cc by")]
    got = licenses.license_scan(stored_docs(rows)).collect()
    want = sorted((i, *base_places(t)) for i, t in rows)
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(want, key=key)
    texts = dict(rows)
    for r in got:
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        if r.doc_id < 7 or 7 < r.doc_id < 900:
            assert ("mit" in r.labels.split(",")) >= (licenses.TEXTS[0].text in texts[r.doc_id])


def test_license_with_changed_words(stored_docs):
    text = licenses.TEXTS[0].text
    changed = text.replace("obtaining", "who gets")
    got = {r.doc_id: r for r in licenses.license_scan(stored_docs([(1, "intro " + text), (2, "some words " + changed), (3, "permission is granted to nobody")])).collect()}
    assert got[1].labels == "mit" and got[1].score == 1.0
    assert got[2].labels == "mit" and 0.5 <= got[2].score < 1 and got[3].labels == ""


def test_licenses_of_repeated_and_dual_notices(stored_docs):
    by, nc, mit = "Licensed under CC BY 4.0. ", "Licensed under CC BY-NC 4.0. ", licenses.TEXTS[0].text + ". "
    torn = mit.replace("obtaining", "who gets").replace("software", "whole software")
    cases = [(by * 3, "cc-by,cc-by-4.0"), (by + "or " + by, "cc-by,cc-by-4.0"), (by + "two words " + by, "cc-by,cc-by-4.0"), (by * 500, "cc-by,cc-by-4.0"),
             (f"Text: {nc}Images: {by}", "cc-by,cc-by-4.0,cc-by-nc"), (f"Text: {by}Images: {nc}", "cc-by,cc-by-4.0,cc-by-nc"),
             (mit * 3, "mit"), (torn, "mit"), (torn * 2, "mit"), (torn * 40, "mit"), ("free of charge to any free of charge to any " + torn, "mit"),
             ("permission is hereby granted " * 9, "")]  # one k-gram, however often, is one k-gram
    got = {r.doc_id: r for r in licenses.license_scan(stored_docs([(i, t) for i, (t, _) in enumerate(cases)])).collect()}
    assert [got[i].labels for i in range(len(cases))] == [want for _, want in cases]
    assert all(got[i].score == 1 for i in range(7)) and all(0.5 <= got[i].score < 1 for i in range(7, 11)) and got[11].score == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_aligned_words_against_plain_alignment():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        places = {w: sum(1 << i for i, x in enumerate(b) if x == w) for w in b}
        assert licenses.common_words(a, places, len(b)) == lcs(a, b)


def test_places_are_verified_on_the_words(stored_docs):
    """Whole licenses, with changed words, and their sentences in another order, which votes alone take for them."""
    from railyard.llm import license_texts
    mit = words(license_texts.MIT)
    runs_of_six = [mit[i:i + 6] for i in range(0, len(mit), 6)]
    shuffled = [w for i in (*range(1, len(runs_of_six), 2), *range(0, len(runs_of_six), 2)) for w in runs_of_six[i]]
    changed = ["other" if i % 9 == 0 else w for i, w in enumerate(mit)]
    whole = [t for t in licenses.WHOLE if t.name == "mit_whole"]
    docs = [(1, "x " * 30 + license_texts.MIT), (2, " ".join(changed)), (3, " ".join(shuffled)), (4, " ".join(reversed(mit))), (5, license_texts.BSD_3), (6, license_texts.ZLIB.upper())]
    table = licenses.BASE + tuple(licenses.Template(t.name, t.label, t.text, 0.8) for t in whole)
    got = {r.doc_id: r for r in licenses.license_scan(stored_docs(docs), templates=table).collect()}
    assert {i: r.labels for i, r in got.items()} == {1: "mit", 2: "mit", 3: "", 4: "", 5: "", 6: ""}
    assert got[1].score == 1 and got[2].score == lcs(changed, mit) / len(mit)
    every = {r.doc_id: set(r.labels.split(",")) for r in licenses.license_scan(stored_docs(docs)).collect()}
    assert every[1] == {"mit"} and every[5] == {"bsd"} and every[6] == {"zlib"}


def test_templates_of_a_table(spark, stored_docs):
    rows = [("own", "house", "this text belongs to the house and to nobody else at all", None), (None, "none", None, 1.0), ("empty", "none", " .", 1.0), ("strict", "exact", "take it or leave it as it is", 1.0)]
    table = licenses.templates_from(spark.createDataFrame(rows, "name string, label string, text string, share double"))
    assert [t.label for t in table] == ["cc-by", "gpl", "reserved", "exact", "house"]
    got = licenses.license_scan(stored_docs([(1, "note: this text belongs to the house and to nobody, all rights reserved"), (2, "take it or leave it, as it was")]), templates=table).collect()
    assert {r.doc_id: r.labels for r in got} == {1: "house,reserved", 2: ""}


def test_license_scan_of_odd_rows(odd_docs, stored_docs):
    text = licenses.TEXTS[0].text
    rows = [(1, text, "a", 1, 2)] * 3 + [(None, text, None, None, None), (None, None, None, None, None), (2, "", "b", 0, 0), (3, "cc by " + "word " * 50000 + text, "c", 0, 0)]
    docs = stored_docs(rows, "doc_id long, text string, id string, uid int, n_words int")
    got = licenses.license_scan(docs).collect()
    assert sorted((r.doc_id or 0, r.labels, r.n_base) for r in got) == [(0, "", 0), (0, "mit", 0), *[(1, "mit", 0)] * 3, (2, "", 0), (3, "cc-by,mit", 1)]
    assert licenses.license_scan(odd_docs).count() == odd_docs.count() and licenses.license_scan(stored_docs([], files=1)).collect() == []


def test_license_places_are_split_not_dropped(stored_docs):
    mit = licenses.TEXTS[0].text + ". "
    torn = mit.replace("obtaining", "who gets").replace("software", "whole software")
    # scraps of the text whose diagonals join all copies to one run
    copy = torn + "software and associated documentation a copy of this any person obtaining a free of charge to "
    size, length = len(words(copy)), len(words(mit))
    places = licenses.license_places(*licenses.template_votes(stored_docs([(1, copy * 40)]))).collect()
    assert all(0 < p.stop - p.start <= 4 * length for p in places)
    assert all(any(p.start < (i + 1) * size and p.stop > i * size for p in places) for i in range(40))


def test_license_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op9_license_scan"](spark, SMALL).collect()
    assert len(got) == len(texts)
    assert all((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_places(texts[r.doc_id]) for r in got)


def grams(text, k=5):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def runs(t, n):
    w = words(t)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def contained(docs, items, percent=80):
    sets = {i: grams(t) for i, t in items}
    out = []
    for d, t in docs:
        own = grams(t) | {g for n in range(1, 5) for g in runs(t, n)}
        for i, s in sets.items():
            if s and 100 * len(s & own) >= percent * len(s):
                out.append((d, i, len(s), len(s & own)))
    return sorted(out)


def test_containment_against_brute_force(stored_docs):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 6, 9, 17, 40, 60])))) for i in range(60)]
    docs = []
    for d in range(200):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 50, 3000]))]
        for _, t in rng.sample(items, 2):
            own = t.split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = own
        docs.append((d, " ".join(w)))
    docs += [(500, None), (501, "")] + [(600 + i, t) for i, t in items[:20]]
    items_df = stored_docs([*items, (100, None), (101, ""), (None, "w1 w2 w3 w4 w5 w6")], "item_id long, text string")
    got = decontaminate.contained_items(stored_docs(docs), items_df).collect()
    want = contained(docs, items)
    assert sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got) == want and len(want) > 100


def test_items_of_one_to_four_words_inside_texts(stored_docs):
    items = [(1, "the answer is forty"), (2, "Forty two!"), (3, "is"), (4, "answer, the"), (5, "a b c d e")]
    docs = [(1, "what is said before the answer is forty two is said"), (2, "forty-two"), (3, "the answer was: forty"), (4, "this answer"), (5, "is"), (6, "a b c d"), (7, "the"), (8, None)]
    got = decontaminate.contained_items(stored_docs(docs), stored_docs(items, "item_id long, text string", files=1)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (1, 2), (1, 3), (2, 2), (5, 3)]
    assert sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got) == contained(docs, items)


def test_short_items_in_sql(spark, stored_docs):
    import duckdb
    from railyard.llm import oracles
    con = duckdb.connect()
    docs = [(1, "what is said before the answer is forty two is said"), (2, "forty-two"), (3, "one two three four five six"), (4, None), (5, "is")]
    items = [(1, "the answer is forty"), (2, "Forty two!"), (3, "is"), (4, "one two three four five"), (5, "")]
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    want = sorted(r[:4] for r in con.execute(oracles.DECONTAMINATE).fetchall())
    got = decontaminate.contained_items(stored_docs(docs), stored_docs(items, "item_id long, text string", files=1)).collect()
    assert sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got) == want == contained(docs, items) and len(want) == 6


def test_bitmaps_follow_the_items(spark):
    grams = spark.createDataFrame([(g,) for g in (0, 1, 63, 64, -1, 1 << 40, 12345678901)], "gram long")
    for bits in (7, 20, 24):
        import numpy as np
        have = decontaminate._bitmap(grams, bits)
        probe = np.array([0, 1, 2, 63, 64, 65, 1 << 40, 12345678901, (1 << 64) - 1], np.uint64)
        mask = (1 << bits) - 1
        want = [int(p) & mask in {g & mask for g in (0, 1, 63, 64, -1, 1 << 40, 12345678901)} for p in probe]
        assert decontaminate._holds(have, probe).tolist() == want


def test_containment_of_odd_rows(odd_docs, stored_docs):
    items = stored_docs([(1, "beta gamma delta epsilon zeta eta")], "item_id long, text string")
    got = decontaminate.contained_items(odd_docs, items).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == [(False, 1), (False, 1), (True, None)]
    empty = stored_docs([], "item_id long, text string")
    assert decontaminate.contained_items(odd_docs, empty).count() == 0
    assert decontaminate.contained_items(stored_docs([]), items).count() == 0


def test_containment_counts_candidates_only(stored_docs, monkeypatch):
    """Documents that hold a gram of many items, but nothing else of them, give rows for their candidates only."""
    rng = random.Random(4)
    stem = "which of the following statements is"
    items = [(i, f"{stem} " + " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(40))) for i in range(60)]
    docs = [(i, f"{stem} x{i} y{i} z{i}") for i in range(50)] + [(100 + i, t) for i, t in items[:5]]
    made = []
    held = decontaminate._held
    monkeypatch.setattr(decontaminate, "_held", lambda found, candidates, grams: made.append((found, candidates, grams)) or held(found, candidates, grams))
    got = decontaminate.contained_items(stored_docs(docs), stored_docs(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got) == contained(docs, items) and len(got) == 5
    (found, candidates, grams), = made
    rows, pairs = held(found, candidates, grams), {(r.uid, r.item) for r in candidates.collect()}
    assert {(r.uid, r.item) for r in rows.select("uid", "item").collect()} <= pairs
    assert rows.count() < found.join(grams, "gram").count()


def test_decontaminate_query(spark):
    read = lambda t, k: [(r[k], r.text) for r in spark.read.parquet(f"{SMALL}/{t}.parquet").collect()]
    want = contained(read("documents", "doc_id"), read("benchmark", "item_id"))
    got = QUERIES["op8_decontaminate"](spark, SMALL).collect()
    assert sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got) == want


def brute_viterbi(v, s):
    best = [(0, ())]
    for e in range(1, len(s) + 1):
        c = [(best[e - n][0] + v.scores[s[e - n:e]][1], best[e - n][1] + (v.scores[s[e - n:e]][0],)) for n in range(min(e, 16), 0, -1) if s[e - n:e] in v.scores]
        top = max((a for a, _ in c), default=None)
        u = best[e - 1][0] + v.unknown
        best.append((u, best[e - 1][1] + tuple(v.byte_ids[b] for b in s[e - 1].encode())) if top is None or u > top else next(x for x in c if x[0] == top))
    return list(best[-1][1])


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load()


def test_viterbi_against_brute_force(vocabulary, spark):
    texts = [r.text[:300] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()][:120]
    texts += ["  a  b ", "\n\n", "𓀀 x", " ", "a" * 300, "日本語 text", "\t", "x" * 70 + " y"]
    table = vocabulary.decoder()
    for t in texts:
        ids = vocabulary.encode(t)
        assert ids == brute_viterbi(vocabulary, SPACE + t.replace(" ", SPACE)) if t else ids == []
        assert pieces.decode(ids, table) == t


def unigram_model(texts_pieces, byte_fallback=False, **rules):
    """A model file put together by hand: (piece, score) pairs, no training."""
    from sentencepiece import sentencepiece_model_pb2 as proto
    m, kinds = proto.ModelProto(), proto.ModelProto.SentencePiece
    m.pieces.add(piece="<unk>", score=0, type=kinds.UNKNOWN)
    m.pieces.add(piece="<s>", score=0, type=kinds.CONTROL)
    if byte_fallback:
        for b in range(256):
            m.pieces.add(piece=f"<0x{b:02X}>", score=0, type=kinds.BYTE)
    for p, x in texts_pieces:
        m.pieces.add(piece=p, score=x, type=kinds.NORMAL)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = proto.TrainerSpec.UNIGRAM, byte_fallback
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = True, False, True
    for k, v in rules.items():
        setattr(m.normalizer_spec, k, v)
    return m.SerializeToString()


@pytest.mark.parametrize("byte_fallback", [False, True])
@pytest.mark.parametrize("rules", [{}, {"add_dummy_prefix": False}, {"remove_extra_whitespaces": True}, {"add_dummy_prefix": False, "remove_extra_whitespaces": True}])
def test_ids_of_a_unigram_model_are_the_librarys(stored_docs, tmp_path, byte_fallback, rules):
    import sentencepiece
    rng = random.Random(11)
    some = {"".join(rng.choice("abcé▁") for _ in range(rng.choice([1, 2, 3, 5]))) for _ in range(150)} | {"▁"}
    raw = unigram_model([(p, -rng.random() * 12) for p in sorted(some)], byte_fallback, **rules)
    own, lib = Vocabulary.parse(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = ["".join(rng.choice("aabbcéx✓ ") for _ in range(rng.randrange(60))) for _ in range(400)] + ["", " ", "   ", "xx", " ✓✓ ✓", "a  b", "ab ", "\t a"]
    score = {i: x for i, x in own.scores.values()}
    total = lambda ids: sum(score.get(i, 0) for i in ids)
    same = {t: own.encode(t) == lib.encode(t) for t in texts}
    # the library adds up in single precision: of segmentations with equal scores it may give either
    assert all(ok or total(own.encode(t)) == total(lib.encode(t)) for t, ok in same.items()) and sum(same.values()) > 0.98 * len(same)
    path = str(tmp_path / "m.model")
    with open(path, "wb") as f:
        f.write(raw)
    rows = pieces.tokenized(stored_docs(list(enumerate(texts))), model=path, with_ids=True).collect()
    assert {r.doc_id: r.ids for r in rows} == {i: own.encode(t) for i, t in enumerate(texts)}
    if byte_fallback:
        assert all(r.round_trip for r in rows)


def test_given_pieces_against_the_librarys_unigram_search(vocabulary, spark):
    """The library's unigram search over the same pieces and scores gives the same ids, word by word (ties aside)."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto
    with open(pieces.MODEL, "rb") as f:
        m = proto.ModelProto.FromString(f.read())
    m.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    for p in m.pieces:
        if p.type == proto.ModelProto.SentencePiece.NORMAL:
            p.score = vocabulary.scores[p.piece][1] / pieces.SCALE
    lib = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    words = sorted({w for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() for w in (r.text or "").split(" ") if len(w) < 60})
    assert len(words) > 1000
    score = {i: x for i, x in vocabulary.scores.values()}
    other = [(vocabulary.encode(w), lib.encode(w)) for w in words if vocabulary.encode(w) != lib.encode(w)]
    # of segmentations with equal scores the library may give either
    assert all(sum(score.get(i, 0) for i in a) == sum(score.get(i, 0) for i in b) for a, b in other) and len(other) < 0.02 * len(words)


def test_about_as_many_tokens_as_the_librarys_merges(spark):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = {r.doc_id: r.n_tokens for r in QUERIES["op1_sentencepiece"](spark, SMALL).collect()}
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert sum(rows.values()) <= 1.05 * sum(len(lib.encode(r.text or "")) for r in texts)


def test_models_of_other_kinds_are_refused():
    from sentencepiece import sentencepiece_model_pb2 as proto
    m = proto.ModelProto.FromString(unigram_model([("a", -1.0)]))
    m.trainer_spec.model_type = proto.TrainerSpec.WORD
    with pytest.raises(ValueError):
        Vocabulary.parse(m.SerializeToString())
    m.trainer_spec.model_type, m.trainer_spec.treat_whitespace_as_suffix = proto.TrainerSpec.UNIGRAM, True
    with pytest.raises(ValueError):
        Vocabulary.parse(m.SerializeToString())


def test_tokens_of_odd_rows(odd_docs, stored_docs):
    got = pieces.tokenized(odd_docs, with_ids=True).collect()
    assert len(got) == odd_docs.count() and all(r.round_trip for r in got) and all(len(r.ids) == r.n_tokens for r in got)
    encoded = pieces.encode(odd_docs)
    texts = collections.Counter((r.doc_id, r.text) for r in odd_docs.collect())
    assert collections.Counter((r.doc_id, r.text) for r in pieces.decoded(encoded).collect()) == texts
    assert pieces.tokenized(stored_docs([])).count() == 0
    r, = pieces.tokenized(stored_docs([(1, "a▁b")])).collect()
    assert not r.round_trip


def test_token_query(spark):
    got = QUERIES["op1_sentencepiece"](spark, SMALL).collect()
    assert len(got) == spark.read.parquet(f"{SMALL}/documents.parquet").count() and all(r.round_trip for r in got)
