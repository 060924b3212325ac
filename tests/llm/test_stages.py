"""Every stage of the corpus pipeline on nulls, empty texts, repeated rows and an empty table."""
import pytest

import corpus_pipeline
from .support import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = "The committee met on Tuesday to discuss the budget, and the members agreed that the plan should be revised before the end of the year. " * 4


@pytest.fixture(scope="module")
def item(spark):
    return spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first().text


def odd(item):
    rows = [(1, GOOD, "en", "web", len(GOOD)), (1, GOOD, "en", "web", len(GOOD)), (2, GOOD + "One more sentence follows here.", "en", None, None), (3, None, None, None, None),
            (4, "", "en", "web", 0), (None, GOOD.upper(), "en", "web", 1), (None, None, None, None, None), (5, "intro words " + item + " and more", "en", "b", 3),
            (6, 'password = "abcdefghij123456"', "en", "c", 5), (7, "wort " * 40000, "de", "d", 200000)]
    return rows


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, stored_docs, item, name, stage):
    docs = stored_docs(odd(item), SCHEMA, files=2)
    rows = [tuple(r) for r in docs.collect()]
    out = stage(spark, docs, SMALL)
    if name == corpus_pipeline.STAGES[-1][0]:
        got = out.collect()
        assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(r[0]) for r in rows) and all(r.round_trip and len(r.ids) == r.n_tokens for r in got)
        return
    assert out.schema == docs.schema or out.dtypes == docs.dtypes
    got = [tuple(r) for r in out.collect()]
    if name == "secrets":  # the secret goes, and nothing else changes but the length
        assert len(got) == len(rows) and not any("abcdefghij123456" in (r[1] or "") for r in got)
        assert sorted(r[1] for r in got if r[1] and "[SECRET]" not in r[1]) == sorted(r[1] for r in rows if r[1] and "password" not in r[1])
        return
    assert all(got.count(r) <= rows.count(r) for r in got)  # rows as they were
    kept = [r[0] for r in got]
    if name == "near_dedup":
        # one of the good texts stays, those without words all stay
        assert sum(bool(r[1]) and r[1].lower().startswith(GOOD.lower()[:60]) for r in got) == 1 and 1 in kept and sum(not r[1] for r in got) == 3
    if name == "decontaminate":
        assert 5 not in kept and len(kept) == len(rows) - 1


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_an_empty_table(spark, stored_docs, name, stage):
    out = stage(spark, stored_docs([], SCHEMA, files=1), SMALL)
    assert out.collect() == [] and (name == "sentencepiece" or out.columns == [c.split()[0] for c in SCHEMA.split(", ")])
