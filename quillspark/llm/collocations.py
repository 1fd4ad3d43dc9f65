"""Phrase collocations: runs of words that stand together more often than their parts would by chance.

All phrases of 1 to ``max_n`` words are exploded into rows, language by language, and counted by hash aggregation.  A task adds up the phrases
of a block of text (``BLOCK_CHARS`` bytes of one language) before it emits them, so that a phrase that every document repeats costs a row
a block.  Phrases that occur ``least`` times or more stay, and with them all of their parts, which occur at least as often: the counts of
prefixes and suffixes are found by joins of that table with itself.  Scores are whole numbers, worked out in 38-digit decimals.  A candidate goes
if a candidate one word longer holds it and is at least ``inside`` percent as frequent.  Longer ones need not be asked: what stands between
is at least as frequent, and is a candidate too.  The best ``top`` of each language are ranked.

Null and empty texts have no words.  Null languages count as ``und``, together with rows that say so.  Texts of any length are read
whole; a block ends after the text that fills it.  Repeated rows count each time.  Ties are broken by frequency, then by the bytes of
the phrase.  Empty tables give no rows.  Of the input only the language and the text are read, so names of other columns are free.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import partitions, quoted, tidy, written
from quillspark.llm.words import Words, classes, column_bytes

#: Bytes of text that a task counts at a time.
BLOCK_CHARS = 32_000_000
#: Bytes of text whose phrases one task of the aggregation gets.
PART_CHARS = 12_000_000
#: Rows of a batch.
ROWS = 1 << 16
UNKNOWN = "und"
#: Shares of a language that are ranked apart before the last ranking.
SALTS = 64
# What ends a piece, and what parts the words of one.
BREAKS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"


def phrases_of(texts: list[bytes | None], max_n: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(phrases, how often): the number of words under the empty phrase, then phrases of 1 to ``max_n`` words in turn, none across a piece."""
    words = Words(texts, classes(SPACES, BREAKS))
    yield pa.array([""]), np.array([len(words)])
    if not len(words):
        return
    # Ids in the order of the words: neighbouring rows are alike and compress well.
    order = pc.sort_indices(words.distinct).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ids, distinct, n_words = rank[words.ids], words.distinct.take(pa.array(order)), len(order)
    piece, before, parts, counts = words.piece, ids, [np.arange(n_words)], np.bincount(ids, minlength=n_words)
    del words
    for n in range(1, max_n + 1):
        if n > 1:
            starts = np.flatnonzero(piece[: len(ids) - n + 1] == piece[n - 1 :])
            if not len(starts):
                return
            keys = before[starts] * n_words + ids[starts + n - 1]
            if n < max_n:
                keys, places, counts = np.unique(keys, return_inverse=True, return_counts=True)
                before = np.zeros(len(ids), np.int64)
                before[starts] = places
            else:
                keys, counts = np.unique(keys, return_counts=True)
            parts = [*(p[keys // n_words] for p in parts), keys % n_words]
        for i in range(0, len(counts), ROWS):
            own = [distinct.take(pa.array(p[i : i + ROWS])) for p in parts]
            yield (pc.binary_join_element_wise(*own, " ") if n > 1 else own[0]), counts[i : i + ROWS]


def exploded(docs: DataFrame, max_n: int, lang: str = "lang", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, f): every phrase of every text, added up within a block; ``f`` of the empty phrase is the number of words.  The key is the language, a
    line feed, which no phrase holds, and the phrase: binary and one column, which is the cheapest to shuffle and to aggregate."""
    schema = pa.schema([("key", pa.binary()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(list), defaultdict(int)

        def block(language: str) -> Iterator[pa.RecordBatch]:
            size.pop(language)
            for phrases, counts in phrases_of(held.pop(language), max_n):
                keys = pc.binary_join_element_wise(language, phrases, "\n").cast(pa.binary())
                yield pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64())], schema=schema)

        for batch in batches:
            for language, data in zip(batch.column("lang").to_pylist(), column_bytes(batch.column("text")), strict=True):
                held[language].append(data)
                size[language] += len(data or b"") + 64
                if sum(size.values()) >= block_chars:
                    yield from block(max(size, key=size.__getitem__))
        for language in list(held):
            yield from block(language)

    chosen = docs.select(F.coalesce(F.col(quoted(lang)).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(quoted(text)).alias("text"))
    return chosen.mapInArrow(tidy(run), "key binary, f long")


def counted(spark: SparkSession, docs: DataFrame, max_n: int, least: int, lang: str = "lang", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(lang, phrase, n, f) of all phrases that occur ``least`` times or more, and for each language the number of its words as n = 0."""
    chars = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(quoted(text)))), F.lit(0)).alias("n")).first()["n"]
    # Rows are added up already: they go to their tasks as they are, and are aggregated there.
    dealt = exploded(docs, max_n, lang, text, block_chars).repartition(max(partitions(spark), -(-chars // PART_CHARS)), "key")
    total = dealt.groupBy("key").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.substring("key", -1, 1) == F.lit(b"\n")))
    total = total.select("f", F.col("key").cast("string").alias("key")).select("f", "key", F.substring_index("key", "\n", -1).alias("phrase"))
    words = F.when(F.col("phrase") == "", 0).otherwise(F.length("phrase") - F.length(F.translate("phrase", " ", "")) + 1)
    return written(spark, total.select(F.expr("substring(key, 1, length(key) - length(phrase) - 1)").alias("lang"), "phrase", words.alias("n"), "f"), "collocations")


def first_words(phrase: Column, k: Column | int) -> Column:
    return F.substring_index(phrase, F.lit(" "), k) if isinstance(k, int) else F.call_function("substring_index", phrase, F.lit(" "), k)


def collocations(spark: SparkSession, docs: DataFrame, max_n: int = 3, least: int = 10, inside: int = 50, top: int = 2000, scale: int = 1_000_000, lang: str = "lang", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of 2 to ``max_n`` words: ``a`` how often it occurs, ``l`` and ``r`` how often
    the parts of its lowest-scoring cut do, ``n`` the words of the language, score floor(scale * a * a / (l * r))."""
    found = counted(spark, docs, max_n, least, lang, text, block_chars)
    candidates = found.where("n >= 2").select("lang", "phrase", F.col("n").alias("words"), F.col("f").alias("a"))
    of = lambda part, f: found.where("n >= 1").select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"head": first_words(F.col("phrase"), F.col("k")), "tail": first_words(F.col("phrase"), F.col("k") - F.col("words"))})
    cuts = cuts.join(of("head", "l"), ["lang", "head"]).join(of("tail", "r"), ["lang", "tail"])
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    exact = F.expr("(CAST(a AS decimal(16,0)) * CAST(a AS decimal(16,0)) * CAST({scale} AS decimal(7,0))) div (l_ * r_)".format(scale=scale))
    cuts = cuts.withColumns({"l_": whole("l"), "r_": whole("r")}).withColumn("score", exact)
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # The parts of a candidate that lack its first or its last word, and the most frequent candidate that each of them stands in.
    longer = candidates.where("words >= 3")
    parts = longer.select("lang", F.explode(F.array(first_words(F.col("phrase"), F.col("words") - 1), first_words(F.col("phrase"), 1 - F.col("words")))).alias("phrase"), "a")
    holder = parts.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    covered = candidates.join(holder, ["lang", "phrase"]).where(F.col("most").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * inside).select("lang", "phrase")
    order = (F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase"))
    kept = best.join(covered, ["lang", "phrase"], "left_anti").withColumn("salt", F.pmod(F.hash("phrase"), F.lit(SALTS)))
    # What is not among the best of its salt is not among the best of its language: no task gets more than SALTS times top rows of one.
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = found.where("n = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
