"""Language identification: words first, then shorter and shorter character n-grams.

A word that was learned scores the log of its frequency in each language.  For an unseen word, each position takes the longest learned
n-gram that starts there, down to a single character, with a constant penalty for each step down; grams include a mark at
both ends of the word.  The language with the largest sum over all words of the text wins; ties go to the first name.

The model is fitted to at most ``PER_LANGUAGE`` documents of each language, chosen by the hash of their id; words and n-grams are
counted over whole texts.  Scoring reads every word of every text, moves no row, and uses nothing but the text.

Texts that are null or have no letter get ``und`` and score 0, as do all texts if nothing was learned.  Rows without a language are not learned
from.  Texts of any length are read whole.  Repeated rows get equal answers; empty tables give no rows.  Of the input's columns only
those asked for and the text are read; lang_pred and score, which are added, must not be among them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import quoted, written

#: Documents of each language that the model learns from, at most.
PER_LANGUAGE = 3000
#: Occurrences in one language before a word or n-gram has an entry.
LEAST = {0: 3, 1: 1, 2: 2, 3: 3, 4: 4}
ORDERS = (4, 3, 2, 1)
#: Log of the penalty for each shorter order.
STEP = math.log(0.4)
#: Unseen words whose scores a task remembers.
REMEMBER = 100_000
UNKNOWN = "und"
RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; runs of other numerals are not words."""
    if not text:
        return []
    found = RUN.findall(text.lower())
    return found if all(map(str.isalpha, found)) else [w for w in found if any(map(str.isalpha, w))]


def grams(word: str, order: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


@dataclass
class Model:
    languages: list[str]
    words: dict[str, tuple[float, ...]]
    grams: dict[str, tuple[float, ...]]
    floor: tuple[float, ...]


class Scorer:
    """A model as matrices: a row of log frequencies for each learned word and gram, and for unseen words as they come."""

    def __init__(self, model: Model):
        self.languages, n = model.languages, max(1, len(model.languages))
        self.rows = dict(zip(model.words, range(len(model.words))))
        self.table = np.zeros((len(self.rows) + REMEMBER, n))
        self.table[: len(self.rows)] = np.array(list(model.words.values())).reshape(-1, n)
        self.grams = dict(zip(model.grams, range(1, len(model.grams) + 1)))  # row 0: no gram at all
        self.gram_table = np.array([model.floor, *model.grams.values()]).reshape(-1, n)
        self.full = len(self.table)

    def unseen(self, word: str) -> np.ndarray:
        marked, get, rows, steps = f"<{word}>", self.grams.get, [], 0
        n = len(marked)
        for i in range(n):
            row = 0
            for step, order in enumerate(ORDERS):
                if i + order <= n and (found := get(marked[i : i + order])) is not None:
                    row = found
                    steps += step
                    break
            rows.append(row)
        return self.gram_table[rows].sum(axis=0) + steps * STEP

    def total(self, words: list[str]) -> np.ndarray:
        get, known, late = self.rows.get, [], 0.0
        for word in words:
            row = get(word)
            if row is None:
                own = self.unseen(word)
                row = len(self.rows)
                if row >= self.full:
                    late = late + own
                    continue
                self.table[row] = own
                self.rows[word] = row
            known.append(row)
        return self.table[known].sum(axis=0) + late

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words_of(text)
        if not found or not self.languages:
            return UNKNOWN, 0.0
        total = self.total(found)
        best = int(total.argmax())
        # Words of a text depend on each other: the more there are, the less each counts.
        odds = np.exp((total - total[best]) / max(1.0, math.sqrt(len(found))))
        return self.languages[best], float(1.0 / odds.sum())


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(text, lang) of at most ``per_language`` documents of each language; docs holds the training side alone."""
    docs = docs.select(F.col("doc_id").cast("string").alias("id"), "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    count = docs.groupBy("lang").agg(F.count("*").alias("n"))
    order = F.xxhash64("id", F.lit("langid"))
    # A row for each language: the model itself holds a column for each.
    likely = docs.select("lang", "id", order.alias("order"), F.xxhash64("text").alias("h")).join(F.broadcast(count), "lang")
    likely = likely.where(F.pmod("order", F.lit(1_000_000)) < 1_300_000.0 * per_language / F.col("n"))
    # Of rows that share an id one is read, however many there are.
    likely = likely.groupBy("lang", "id", "order").agg(F.min("h").alias("h"))
    chosen = likely.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "id"))).where(F.col("rank") <= per_language)
    # At most per_language rows a language.
    found = docs.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen.select("id", "lang", "h")), ["id", "lang", "h"])
    return found.groupBy("id", "lang").agg(F.min("text").alias("text")).select("text", "lang")


def fit(spark: SparkSession, texts: DataFrame) -> Model:
    """A model from (text, lang); what comes to the driver is bounded by the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                for word, n in Counter(words_of(text)).items():
                    found[lang, 0, word] += n
                    for order in ORDERS:
                        for gram in grams(word, order):
                            found[lang, order, gram] += n
        keys = list(found)
        yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in keys], "size": [k[1] for k in keys], "gram": [k[2] for k in keys], "n": list(found.values())}, pa.schema([("lang", pa.string()), ("size", pa.int32()), ("gram", pa.string()), ("n", pa.int64())]))

    counts = written(spark, texts.select("text", "lang").mapInArrow(run, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")), "langid")
    totals = {(r["lang"], r["size"]): r["n"] for r in counts.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    languages = sorted({lang for lang, _ in totals})
    least = F.element_at(F.create_map(*[F.lit(x) for item in LEAST.items() for x in item]), F.col("size"))
    wide = counts.groupBy("size", "gram").agg(*[F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(languages)], F.max("n").alias("most")) if languages else None
    words: dict[str, tuple[float, ...]] = {}
    pieces: dict[str, tuple[float, ...]] = {}
    if wide is not None:
        kept = wide.where(F.col("most") >= least).toPandas()
        for size, gram, *rest in kept.itertuples(index=False, name=None):
            own = tuple(math.log((n + 0.5) / (totals.get((lang, size), 0) + 1.0)) for n, lang in zip(rest, languages))
            (words if size == 0 else pieces)[gram] = own
    floor = tuple(math.log(0.5 / (totals.get((lang, 1), 0) + 1.0)) + len(ORDERS) * STEP for lang in languages)
    return Model(languages, words, pieces, floor)


def with_language(spark: SparkSession, docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns`` of docs, lang_pred and score."""
    shipped = spark.sparkContext.broadcast(model)
    # The reader of batches takes no name with a dot.
    own = [f"c{i}" for i in range(len(columns))]
    read = docs.select(*[F.col(quoted(c)).alias(o) for c, o in zip(columns, own, strict=True)], F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in batches:
            found = [scorer.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(o) for o in own), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*columns, "lang_pred", "score"])

    return read.mapInArrow(run, docs.select(*map(quoted, columns)).schema.add("lang_pred", "string").add("score", "double"))
