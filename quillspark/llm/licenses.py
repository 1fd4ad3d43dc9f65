"""License notices by diagonal voting.

All rolling word 2-gram hashes of the texts are joined with the positions at which templates hold them.  A hit votes for its
diagonal: word position in the text less position in the template.  Votes are counted for each (text, template,
diagonal); neighbouring diagonals, which a word more or less in the text sets apart, are merged, at most ``GAP`` of them; a merged
diagonal is verified by the share of template positions it covers, and by the words that tell its template from others, each of which
must stand in a covered 2-gram.  Verified ones that overlap are one span, that of the best cover.  As diagonals of one span are
no more than ``GAP`` apart, its words lie together: scattered 2-grams of a long text never add up to a notice.  The short base
phrases must be covered whole on a single diagonal, which means that their words stand there consecutively.

The templates are a fixed list, so their side of the join is broadcast.  Only hits are moved, after they are counted within tasks.

Null texts count as empty; empty texts have no words and no labels.  Texts of any length are read whole.  Rows repeated with id and
text get the same answer each; ids and texts are told apart by id and the text's hash.  Empty tables give no rows.  Columns of the
input other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower

WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Share of a template's 2-grams that a merged diagonal must cover.
COVER = 0.7
#: Diagonals at most so far apart are merged: words that a notice may have more or less than its template.
GAP = 4

# Base phrases with their labels.
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
# Opening words of public license notices, with labels and the words without which a notice is another one.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0", "apache 2"),
    ("licensed under the mit license", "mit", "mit"),
    ("released under the mit license", "mit", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", ""),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", ""),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2.0", "mozilla"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", ""),
    ("this work is licensed under a creative commons attribution", "creative-commons", "commons"),
    ("this is free and unencumbered software released into the public domain", "unlicense", ""),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu", "gnu-notice", "gnu"),
    ("licensed under cc by nc", "cc-by-nc", "nc"),
    ("licensed under cc by sa", "cc-by-sa", "sa"),
    ("licensed under cc by nd", "cc-by-nd", "nd"),
    ("licensed under cc by nc sa", "cc-by-nc-sa", "nc sa"),
    ("licensed under cc by nc nd", "cc-by-nc-nd", "nc nd"),
)


def rolling(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of all 2-grams from the hashes of single words."""
    first, second = words[:-1], words[1:]
    mixed = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode())


def templates(spark: SparkSession, base=BASE, notices=NOTICES) -> DataFrame:
    """A row for each 2-gram of each template; ``own`` has a bit for each of the template's own words that the 2-gram holds, ``needs``
    the bits of all of them."""
    rows = []
    for no, (phrase, label, *own) in enumerate([*base, *notices]):
        words, own = phrase.split(" "), " ".join(own).split()
        hashes = rolling(np.array([word_hash(w) for w in words], np.uint64)).view(np.int64)
        bits = [sum(1 << b for b, w in enumerate(own) if w in words[i : i + 2]) for i in range(len(hashes))]
        rows += [(no, no < len(base), label, i, len(hashes), bits[i], (1 << len(own)) - 1, int(h)) for i, h in enumerate(hashes)]
    return spark.createDataFrame(rows, "template int, is_base boolean, label string, place int, places int, own int, needs int, hash long")


#: Word hashes that a task remembers.
REMEMBER = 500_000
#: Rows after which a task hands on what it has.
FLUSH = 200_000


def counted(texts: DataFrame) -> DataFrame:
    """(doc_id, th, n_words) of texts (doc_id, th, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = re.compile(WORDS).findall
        for batch in batches:
            n = [len(cut(ascii_lower(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64())], names=["doc_id", "th", "n_words"])

    return texts.mapInArrow(run, "doc_id long, th long, n_words long")


def grams_of(texts: DataFrame) -> DataFrame:
    """(doc_id, th, at, hash) of every 2-gram of texts (doc_id, th, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cut = {}, re.compile(WORDS).findall

        def hashed(word: str) -> int:
            if (h := known.get(word)) is None:
                h = word_hash(word)
                if len(known) < REMEMBER:
                    known[word] = h
            return h

        held, n_held = [], 0

        def flush() -> pa.RecordBatch:
            sizes = [len(h) for _, _, h in held]
            ids = pa.array([d for d, _, _ in held], pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), sizes)))
            columns = [ids, pa.array(np.repeat(np.array([t for _, t, _ in held], np.int64), sizes)), pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])), pa.array(np.concatenate([h for _, _, h in held]))]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for doc_id, th, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text")), strict=True):
                words = cut(ascii_lower(text))
                if len(words) > 1:
                    held.append((doc_id, th, rolling(np.fromiter(map(hashed, words), np.uint64, len(words))).view(np.int64)))
                    n_held += len(words) - 1
                if n_held >= FLUSH:
                    yield flush()
                    held, n_held = [], 0
        if held:
            yield flush()

    return texts.mapInArrow(run, "doc_id long, th long, at int, hash long")


def scan(spark: SparkSession, docs: DataFrame, base=BASE, notices=NOTICES) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts has a row for each row of docs: doc_id, th, n_words; spans has a row for each verified place: doc_id,
    th, template, is_base, label, first_word, last_word (of the place), cover."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    texts = counted(keyed)
    hits = grams_of(keyed).join(F.broadcast(templates(spark, base, notices)), "hash")
    keys = ["doc_id", "th", "template", "is_base", "label", "places", "needs"]
    diagonals = hits.groupBy(*keys, (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("covered"), F.bit_or("own").alias("own"), F.min("at").alias("low"), F.max("at").alias("high"))
    # What a diagonal covers together with those just above it; those of a base phrase stand alone.
    near = Window.partitionBy("doc_id", "th", "template").orderBy("diagonal").rangeBetween(0, GAP)
    merged = diagonals.select(*keys, "diagonal", *[F.when(F.col("is_base"), own).otherwise(wide).alias(name) for name, own, wide in (
        ("covered", F.col("covered"), F.array_distinct(F.flatten(F.collect_list("covered").over(near)))),
        ("own", F.col("own"), F.bit_or("own").over(near)),
        ("first_word", F.col("low"), F.min("low").over(near)),
        ("last_word", F.col("high") + 1, F.max("high").over(near) + 1),
    )])
    cover = F.size("covered") / F.col("places")
    verified = merged.where(cover >= F.when(F.col("is_base"), 1.0).otherwise(COVER)).where("own = needs").withColumn("cover", cover)
    # Spans of a template that begin within the reach of the one before are the same notice.
    order = Window.partitionBy("doc_id", "th", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("is_base"), 0).otherwise(GAP)
    spans = verified.withColumn("span", F.sum(F.coalesce(apart.cast("int"), F.lit(1))).over(order))
    best = F.max_by(F.struct("first_word", "last_word", "cover"), F.struct("cover", -F.col("diagonal"))).alias("best")
    spans = spans.groupBy("doc_id", "th", "template", "is_base", "label", "span").agg(best)
    return texts, spans.select("doc_id", "th", "template", "is_base", "label", "best.first_word", "best.last_word", "best.cover")


def summary(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """A row for each text: counts, places and labels."""
    base = F.col("is_base")
    start = F.when(base, F.col("first_word"))
    found = spans.groupBy(F.col("doc_id").alias("of"), F.col("th").alias("of_th")).agg(
        F.sum(base.cast("long")).alias("n_base"),
        F.min(start).cast("long").alias("first_word"),
        F.max(start).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
    )
    joined = texts.join(found, texts.doc_id.eqNullSafe(found.of) & (texts.th == found.of_th), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
