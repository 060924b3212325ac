"""Benchmark decontamination: size-partitioned MinHash containment search.

A short test item is contained in a long document if at least ``percent`` of
the item's distinct word shingles stand in the document. Items are partitioned
by the size of their shingle set (powers of two); for a partition with at most
u shingles, the item's signature is its u - ceil(percent * u) + 1 smallest
shingle hashes (one random order for all, so these are its minhashes): a
document that holds ``percent`` of the item lacks at most u - ceil(...) of its
shingles, hence holds at least one hash of the signature. The search therefore
loses no contained item, however long the document is -- a banded MinHash
index would, as the Jaccard similarity of 30 shingles and 20,000 is next to 0.
An item with fewer words than a shingle is one gram of its own, all its words;
documents are read for grams of these few sizes as well, so it is found
wherever its words stand in a row.

The signature hashes are the table that documents probe. One pass over the
texts hashes every gram; a document with a hash in the signature bitmap
gives a row for each distinct hash in the bitmap of all item grams.
Joins with the signature table (candidates) and of the candidates' item grams
with the document's (exact containment) follow. The bitmaps grow with the number
of item grams up to 16 MB; they only save rows, the joins decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_ids, stored
from .textblocks import ALNUM, blocks, distinct_by_row, rolling, shingles, word_hashes, word_spans

WORDS, PERCENT = 5, 80
#: Bits of the two bitmaps, as powers of two: at least, at most, and for each gram.
LEAST_BITS, MOST_BITS, BITS_A_GRAM = 20, 27, 3


def _hashes(batches: Iterator[pa.RecordBatch], words: int):
    """(rows, grams, borders, numbers of words) of items: the shingles, or all words of a shorter item as one."""
    for batch in batches:
        for part, data, border in blocks(batch, "text"):
            starts, ends, at = word_spans(data, border, ALNUM)
            yield part, *shingles(word_hashes(data, starts, ends), at, words), np.diff(at)


def _runs(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of ``size`` words within a row."""
    every = rolling(words, size)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:len(every)]
    inside = np.arange(len(every)) + size <= at[1:][row]
    return every[inside], row[inside]


def _document_grams(batches: Iterator[pa.RecordBatch], words: int, short: list[int]):
    """(rows, grams, row of each gram) of documents: the shingles, and the runs of so many words as ``short`` items have."""
    for batch in batches:
        for part, data, border in blocks(batch, "text"):
            starts, ends, at = word_spans(data, border, ALNUM)
            hashes = word_hashes(data, starts, ends)
            found = [_runs(hashes, at, words)]
            for size in short:  # hashed as an item of that size is
                run, row = _runs(hashes, at, size)
                found.append((run ^ np.uint64(size), row))
            yield part, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """item, n (distinct grams), gram, partition (bits of n), signed (whether the
    gram is in the item's signature) and short (the words of an item that has fewer than a shingle, else 0)."""

    def split(batches):
        for part, values, at, count in _hashes(batches, words):
            short = np.where(count < words, count, 0)
            grams, cut = distinct_by_row(values, at)
            n = np.diff(cut)
            size = np.array([int(x).bit_length() for x in n])
            upper = (1 << size) - 1
            # unsigned order of the hashes is the random order; signatures follow the partition's upper size
            length = np.minimum(n, upper - (upper * percent + 99) // 100 + 1)
            rank = np.arange(len(grams)) - np.repeat(cut[:-1], n)
            yield pa.RecordBatch.from_arrays(
                [part.column("item").take(pa.array(np.repeat(np.arange(part.num_rows), n))), pa.array(np.repeat(n, n)), pa.array(grams.view(np.int64)),
                 pa.array(np.repeat(size, n).astype(np.int32)), pa.array(rank < np.repeat(length, n)),
                 pa.array(np.repeat(short, n).astype(np.int32))], names=["item", "n", "gram", "partition", "signed", "short"])

    rows = items.select(items[id_col].alias("item"), items[text_col].alias("text"))
    kind = rows.schema["item"].dataType.simpleString()
    # equal rows of one item id count once
    return rows.where(F.col("item").isNotNull()).mapInArrow(split, f"item {kind}, n bigint, gram bigint, partition int, signed boolean, short int").distinct()


def _bitmap(grams: DataFrame, bits: int) -> np.ndarray:
    """2 ** ``bits`` bits, set by the grams' low bits; united by Spark in words of 64 bits."""
    slot = F.col("gram").bitwiseAND((1 << bits) - 1)
    words = grams.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, int((gram & {(1 << bits) - 1}L) & 63))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for batch in words.toArrow().to_batches():
        out[batch.column("word").to_numpy()] = batch.column("bits").to_numpy()
    return out.view(np.uint64)


def _holds(bitmap: np.ndarray, grams: np.ndarray) -> np.ndarray:
    slot = grams & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _held(found: DataFrame, candidates: DataFrame, grams: DataFrame) -> DataFrame:
    """A row for each gram of a candidate's item that the document holds. The
    candidates come first: a gram that many items share gives no row elsewhere."""
    return candidates.join(grams.select("item", "n", "gram"), ["item", "n"]).join(found, ["uid", "gram"])


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                    item_text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document row and item contained in it: uid (of the document
    row, monotonically_increasing_id), document id, item id, n_item (the item's
    distinct shingles), n_shared and containment.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII
    characters. An item with fewer words than a shingle is contained where all
    its words stand in a row. Null and empty items or texts contain nothing and
    are contained nowhere; items with a null id take no part; item rows with
    one id and different texts are different items under that id; repeated
    document rows give their own rows. Texts are taken whole; other columns are
    not read; an empty table on either side gives none.
    """
    grams = stored(item_shingles(items, item_id, item_text, words, percent), "items")
    count, = grams.agg(F.count_distinct("gram")).first()
    bits = min(MOST_BITS, max(LEAST_BITS, int(count).bit_length() + BITS_A_GRAM))
    signature, every = _bitmap(grams.where("signed"), bits), _bitmap(grams, bits)
    short = sorted(r[0] for r in grams.where("short > 0").select("short").distinct().collect())

    def probe(batches):
        for part, values, row in _document_grams(batches, words, short):
            wanted = np.zeros(part.num_rows, bool)
            wanted[row[_holds(signature, values)]] = True
            own = wanted[row]
            own[own] = _holds(every, values[own])
            found = np.unique(np.rec.fromarrays([row[own], values[own]], names="row,gram"))
            if len(found):
                yield pa.RecordBatch.from_arrays(
                    [part.column("uid").take(pa.array(found["row"])), part.column("id").take(pa.array(found["row"])), pa.array(found["gram"].view(np.int64))],
                    names=["uid", "id", "gram"])

    rows = docs.select(row_ids(docs), docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = stored(rows.mapInArrow(probe, f"uid bigint, id {kind}, gram bigint"), "probed")
    candidates = found.join(grams.where("signed").select("item", "n", "gram"), "gram").select("uid", "item", "n").distinct()
    inside = _held(found, candidates, grams).groupBy("uid", "item", "n").agg(F.count("*").alias("n_shared"), F.first("id").alias("id"))
    return inside.where(F.col("n_shared") * 100 >= F.col("n") * percent).select(
        "uid", F.col("id").alias(id_col), F.col("item").alias(item_id), F.col("n").alias("n_item"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"))
