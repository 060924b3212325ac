"""Corpus pipeline over ``documents``: quality, near-duplicates, benchmark
decontamination, secrets, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.

Rows stay as they are but for the secrets stage, which changes texts and their
n_chars. A null text counts as an empty one: the classifier scores it like any
other; it is near nothing, contains no item and no secret, and has no tokens.
Of equal rows the near-duplicate stage keeps one (but for those without words,
which are linked with nothing), the other stages treat each alike. A row
without doc_id goes through all stages and is the last that its component would
keep. Texts are taken whole, of any length. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railyard.llm import decontaminate, near_dedup, pieces, quality, secrets
from railyard.llm.common import read_table, stored, without_rows


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    return quality.good_documents(docs, read_table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: the document with the smallest id of each component stays (5-word shingles, similarity 0.8)."""
    return without_rows(docs, near_dedup.near_duplicates(docs).where("not first"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that contain a benchmark item go."""
    return without_rows(docs, decontaminate.contained_items(docs, read_table(spark, sf_dir, "benchmark")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every span found becomes [SECRET]; n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: the ids of every text, and whether decoding them gives the text."""
    return pieces.tokenized(docs, with_ids=True)


STAGES = [("quality", keep_good), ("near_dedup", keep_one_of_each), ("decontaminate", keep_clean), ("secrets", redact_secrets), ("sentencepiece", tokens)]

# A trained classifier, MinHash and a Viterbi search have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage_{name}")
    return docs
