"""License scans by diagonal voting.

Templates are word sequences (phrases and license texts). Every rolling word
k-gram of a document is looked up among the templates' k-grams: one pass over
the texts hashes all k-grams and keeps those whose hash falls into a bitmap of
the template hashes (a semi-join of fixed size), and a Spark join with the
template positions turns each survivor into votes for a diagonal, the
document's word position minus the template's. Votes are gathered per document,
template and diagonal, and a place is a candidate if the share of the template's
k-grams that voted (each counted once) reaches what the template's threshold
leaves of them (:func:`votes_needed`). A
diagonal that reaches it alone is a place. Of the others, votes of neighbouring
diagonals within twice the template's length count together (words were
inserted or left out). More votes never take a place away. Base phrases need
every k-gram on one diagonal, which is the phrase standing there word for word.

Votes say where to look. Every other place is then verified on the words: the
document's words there (and ``NEIGHBOURS`` on either side) are aligned with the
template's, and the share of the template in their longest common subsequence
is the place's score, which must reach the threshold too.

Templates are the caller's (:func:`templates_from` takes a table) or the
library's own; their k-grams and words are sent to every task, so their number
is bounded (``MOST_WORDS``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import license_texts
from .common import row_ids, stored
from .textblocks import ALNUM, blocks, mix, rolling, word_hashes, word_spans

#: Longest k-gram; a template with fewer words uses its whole length.
GRAM = 4
#: Diagonals so near each other vote together.
NEIGHBOURS = 8
#: Words of all templates at most, and bits of the bitmap of their k-grams as a power of two.
MOST_WORDS, BITMAP_BITS = 200_000, 20
#: Documents with places to verify are picked by a broadcast list up to so many, else by a shuffle.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    text: str
    share: float = 0.5
    base: bool = False


# The base phrases of the contract and their labels.
BASE = (
    Template("phrase_cc_by", "cc-by", "cc by", 1.0, True),
    Template("phrase_gpl", "gpl", "general public license", 1.0, True),
    Template("phrase_reserved", "reserved", "all rights reserved", 1.0, True),
)
# Opening or grant sentences of well-known public licenses.
TEXTS = (
    Template("mit", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("bsd", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("apache", "apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    Template("gpl_notice", "gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("mpl", "mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc_text", "cc", "This work is licensed under a Creative Commons Attribution"),
    Template("cc_by_nc", "cc-by-nc", "Licensed under CC BY-NC 4.0", 0.9),
    Template("cc_by_sa", "cc-by-sa", "Licensed under CC BY-SA 4.0", 0.9),
    Template("cc_by_4", "cc-by-4.0", "Licensed under CC BY 4.0", 0.9),
    Template("reserved_notice", "reserved", "Unauthorized copying or reproduction of this material without permission is prohibited", 0.6),
)
# The same licenses as a whole.
WHOLE = (
    Template("mit_whole", "mit", license_texts.MIT), Template("isc_whole", "isc", license_texts.ISC), Template("bsd_2_whole", "bsd", license_texts.BSD_2),
    Template("bsd_3_whole", "bsd", license_texts.BSD_3, 0.8), Template("zlib_whole", "zlib", license_texts.ZLIB), Template("apache_whole", "apache-2.0", license_texts.APACHE_NOTICE),
    Template("mpl_whole", "mpl-2.0", license_texts.MPL_NOTICE), Template("gpl_whole", "gpl", license_texts.GPL_NOTICE), Template("lgpl_whole", "lgpl", license_texts.LGPL_NOTICE, 0.8),
    Template("unlicense_whole", "unlicense", license_texts.UNLICENSE), Template("cc_by_deed", "cc", license_texts.CC_BY_DEED),
)
TEMPLATES = BASE + TEXTS + WHOLE


def templates_from(rows: DataFrame, base: tuple[Template, ...] = BASE) -> tuple[Template, ...]:
    """Templates of a table (name, label, text, share: null is 0.5) after the
    base phrases. Rows without a label or a word are left out; texts of more
    than ``MOST_WORDS`` words in all raise ValueError."""
    found = rows.select("name", "label", "text", "share").where("label is not null and text is not null").orderBy("label", "name", "text").limit(MOST_WORDS + 1).collect()
    given = tuple(Template(r.name or r.label, r.label, r.text, 0.5 if r.share is None else float(r.share)) for r in found if len(_words(r.text)))
    if sum(len(_words(t.text)) for t in given) > MOST_WORDS:
        raise ValueError(f"the templates have more than {MOST_WORDS} words")
    return base + given


def _words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
    return word_hashes(data, starts, ends)


def _sized(grams: np.ndarray, k: int) -> np.ndarray:
    return mix(grams + np.uint64(k))


def template_grams(templates: tuple[Template, ...]) -> list[tuple[int, int, int, int, int]]:
    """(template, position, k, words of the template, k-gram hash) of every k-gram."""
    out = []
    for i, t in enumerate(templates):
        words = _words(t.text)
        k = min(GRAM, len(words))
        for p, g in enumerate(_sized(rolling(words, k), k)):
            out.append((i, p, k, len(words), int(g.view(np.int64))))
    return out


def template_votes(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text_col: str = "text", id_col: str = "doc_id"
                   ) -> tuple[DataFrame, DataFrame]:
    """(uid, id, n_words and the surviving k-grams of each row; the template positions table)."""
    grams = template_grams(templates)
    sizes = sorted({g[2] for g in grams})
    mask = (1 << BITMAP_BITS) - 1
    bitmap = {k: np.zeros(1 << BITMAP_BITS, bool) for k in sizes}
    for _, _, k, _, g in grams:
        bitmap[k][g & mask] = True

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, border in blocks(batch, "text"):
                starts, ends, at = word_spans(data, border, ALNUM)
                words = word_hashes(data, starts, ends)
                place, value = [], []
                for k in sizes:
                    own = _sized(rolling(words, k), k)
                    p = np.flatnonzero(bitmap[k][(own & np.uint64(mask)).astype(np.int64)])
                    row = np.searchsorted(at, p, "right") - 1
                    p = p[p + k <= at[row + 1]]
                    place.append(p)
                    value.append(own[p])
                p, v = np.concatenate(place), np.concatenate(value)
                order = np.argsort(p, kind="stable")
                p, v = p[order], v[order]
                row = np.searchsorted(at, p, "right") - 1
                cut = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                hits = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays(
                    [pa.array((p - at[row]).astype(np.int64)), pa.array(v.view(np.int64))], names=["at", "gram"]))
                yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("id"), pa.array(np.diff(at).astype(np.int64)), hits], names=["uid", "id", "n_words", "hits"])

    rows = docs.select(row_ids(docs), docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    # three later steps read the survivors: written once, the texts are scanned once
    scanned = stored(rows.mapInArrow(scan, f"uid bigint, id {kind}, n_words bigint, hits array<struct<at:bigint,gram:bigint>>"), "grams")
    spark: SparkSession = docs.sparkSession
    table = spark.createDataFrame(grams, "template int, pos bigint, k int, length bigint, gram bigint")
    return scanned, table


def votes_needed(share: float) -> float:
    """The share of k-grams that makes a place a candidate: a changed word takes
    ``GRAM`` k-grams away, but with less than three in ten no place is looked at."""
    return min(share, max(0.3, 1 - GRAM * (1 - share)))


def license_places(scanned: DataFrame, table: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Places by votes: uid, template, start, stop (words), share of the template's k-grams that voted."""
    votes = (scanned.where(F.size("hits") > 0).select("uid", F.explode("hits").alias("h")).select("uid", "h.at", "h.gram")
             .join(F.broadcast(table), "gram")  # a row per word of the templates, at most MOST_WORDS
             .groupBy("uid", "template", (F.col("at") - F.col("pos")).alias("diagonal"))
             .agg(F.collect_set("pos").alias("voted"), F.min("at").alias("first"), F.max(F.col("at") + F.col("k")).alias("last"),
                  F.first("k").alias("k"), F.first(F.col("length") - F.col("k") + 1).alias("grams"), F.first("length").alias("length"))
             .withColumn("share", F.size("voted") / F.col("grams")))
    enough = F.col("share") >= spark_map({i: votes_needed(t.share) for i, t in enumerate(templates)})[F.col("template")]
    base = F.col("template").isin([i for i, t in enumerate(templates) if t.base])
    exact = votes.where(base & (F.size("voted") == F.col("grams"))).select(
        "uid", "template", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("length")).alias("stop"), F.lit(1.0).alias("share"))
    # a diagonal that reaches the share is a place, whatever stands beside it
    alone = votes.where(~base & enough).select("uid", "template", F.col("first").alias("start"), F.col("last").alias("stop"), "share")
    # of the others, those in a run of near diagonals vote together: a further vote can only join runs, never part them
    along = Window.partitionBy("uid", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > NEIGHBOURS, F.lit(True))
    rest = (votes.where(~base & ~enough).withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(along))
            .select("uid", "template", "run", "k", "grams", "length", "diagonal", F.explode("voted").alias("pos"))
            .withColumn("start", F.col("diagonal") + F.col("pos")))
    # from each vote on, the run's votes within twice the template's length; the frame has the length of the longest template
    frame = Window.partitionBy("uid", "template", "run").orderBy("start").rangeBetween(0, 2 * max(len(_words(t.text)) for t in templates))
    near = F.filter("ahead", lambda v: v["start"] + F.col("k") <= F.col("start") + 2 * F.col("length"))
    spans = (rest.withColumn("ahead", F.collect_list(F.struct("start", "pos")).over(frame)).withColumn("near", near)
             .select("uid", "template", "run", "length", "start", (F.array_max("near.start") + F.col("k")).alias("stop"),
                     (F.size(F.array_distinct("near.pos")) / F.col("grams")).alias("share")).where(enough))
    # spans that overlap are one place, split where they go on for more than twice the template's length
    before = Window.partitionBy("uid", "template", "run").orderBy("start", "stop")
    apart = F.coalesce(F.col("start") >= F.max("stop").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    island = Window.partitionBy("uid", "template", "run", "island")
    merged = (spans.withColumn("apart", apart.cast("int")).withColumn("island", F.sum("apart").over(before))
              .withColumn("part", F.floor((F.col("start") - F.min("start").over(island)) / (2 * F.col("length"))))
              .groupBy("uid", "template", "run", "island", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("share").alias("share"))
              .select("uid", "template", "start", "stop", "share"))
    return exact.unionByName(alone).unionByName(merged)


def common_words(words: list[int], template: dict[int, int], size: int) -> int:
    """Length of the longest common subsequence of the words and a template of
    ``size`` words, given as the bit set of each word's places (bit-parallel)."""
    every = (1 << size) - 1
    row = every
    for w in words:
        met = row & template.get(w, 0)
        row = ((row + met) | (row - met)) & every
    return size - row.bit_count()


def verified(docs: DataFrame, places: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text_col: str = "text") -> DataFrame:
    """``places`` of base phrases as they are, of the others those whose words
    align with enough of the template; share is then the aligned share."""
    base = F.col("template").isin([i for i, t in enumerate(templates) if t.base])
    places = stored(places, "places")
    asked = stored(places.where(~base).groupBy("uid").agg(F.collect_set(F.struct("template", "start", "stop")).alias("places")), "to_verify")
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked
    sets: dict[int, tuple[dict[int, int], int]] = {}
    for i, t in enumerate(templates):
        if not t.base:
            at: dict[int, int] = {}
            words = _words(t.text).tolist()
            for p, w in enumerate(words):
                at[w] = at.get(w, 0) | 1 << p
            sets[i] = (at, len(words))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, border in blocks(batch, "text"):
                starts, ends, at = word_spans(data, border, ALNUM)
                words = word_hashes(data, starts, ends)
                out = []
                for row, (uid, own) in enumerate(zip(part.column("uid").to_pylist(), part.column("places").to_pylist())):
                    text = words[at[row]:at[row + 1]]
                    for p in own:
                        near = text[max(0, p["start"] - NEIGHBOURS):p["stop"] + NEIGHBOURS].tolist()
                        share = common_words(near, *sets[p["template"]]) / sets[p["template"]][1]
                        if share >= templates[p["template"]].share:
                            out.append((uid, p["template"], p["start"], p["stop"], share))
                if out:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["uid", "template", "start", "stop", "share"])

    rows = docs.select(row_ids(docs), docs[text_col].alias("text")).join(asked, "uid")
    found = rows.select("uid", "text", "places").mapInArrow(align, "uid bigint, template int, start bigint, stop bigint, share double")
    return places.where(base).select("uid", "template", "start", "stop", "share").unionByName(found)


def spark_map(values: dict):
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per document: id, n_words, n_base (places of base phrases),
    first_word and last_word (their smallest and largest start, else null),
    base_labels and labels (distinct, sorted, comma-joined; labels holds the
    base ones too) and score: the largest share of a template's words that a
    place has in their order (0 without any place).

    Words are lower-cased (A-Z). Null or empty texts have no words and no
    places; texts are taken whole; equal rows and equal or null ids keep a row
    each; other columns are not read; an empty table gives an empty result.
    """
    scanned, table = template_votes(docs, templates, text_col, id_col)
    places = verified(docs, license_places(scanned, table, templates), templates, text_col)
    base = F.col("template").isin([i for i, t in enumerate(templates) if t.base])
    label = spark_map({i: t.label for i, t in enumerate(templates)})[F.col("template")]
    found = places.groupBy("uid").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"), F.collect_set(F.when(base, label)).alias("b"),
        F.collect_set(label).alias("l"), F.max("share").alias("score"))
    text = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return scanned.select("uid", "id", "n_words").join(found, "uid", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        text("b").alias("base_labels"), text("l").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
