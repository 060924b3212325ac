"""The registered queries of the operators, each over its whole table.

A query is thin: it applies its operator with production parameters and
derives the digest columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, merkle, near_dedup, oracles, pieces, quality, secrets, simhash, spelling, suffix_dedup, topk, url_filter, warc
from .common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: SQL where it can express the whole result; the other queries are tested
#: against brute force, a round trip or held-out accuracy in tests/llm.
ORACLE: dict[str, str] = {
    "op3_top_k": oracles.TOP_K,
    "op7_warc": oracles.WARC,
    "op8_decontaminate": oracles.DECONTAMINATE,
    "op10_near_dedup": oracles.NEAR_DEDUP,
    "op12_spelling_variants": oracles.SPELLING,
    "op13_merkle_manifest": oracles.MERKLE,
}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents encoded into pieces and decoded again."""
    return pieces.tokenized(read_table(spark, sf_dir, "documents"))


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    return secrets.secret_spans(read_table(spark, sf_dir, "documents"))


@query
def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every 20th vector among all others."""
    rows = read_table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 20 = 0"), 20)


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url: by rule, else by its host's trust and distrust."""
    judged = url_filter.judge(read_table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text of documents, learned from labels.quality."""
    return quality.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents that 50-byte strings share with smaller ids."""
    return suffix_dedup.repeated_bytes(read_table(spark, sf_dir, "documents"))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record, read back, resolved and deduplicated."""
    return warc.deduplicated_archive(read_table(spark, sf_dir, "pages"))


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items contained in documents: one row per document and item."""
    found = decontaminate.contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_shared", "containment")


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and license texts in every whole text of documents."""
    return licenses.license_scan(read_table(spark, sf_dir, "documents"))


@query
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents over 2-word shingles."""
    links = near_dedup.Links(words=2, percent=80)
    rows = near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), links=links)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicate components of documents."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents with their near words, forms and roots."""
    rows = spelling.variants(read_table(spark, sf_dir, "documents"))
    return rows.select("word", "form", "root", "n", "n_near", "form_n")


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle trees of documents by lang; every leaf's proof climbed, every seventh leaf tampered with."""
    more = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    where = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.verified_leaves(read_table(spark, sf_dir, "documents"), changed=more, where=where)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline: every stage on all that its predecessor kept."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
