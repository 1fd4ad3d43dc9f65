"""Toxicity by class-conditional Kneser-Ney models that share their lower orders.

The chance of a word after a history in a class is written P(w | h, c) = P(w | h) P(c | h, w) / P(c | h).  P(w | h) comes from counts that
both classes share and cancels where they are compared; the class parts are interpolated Kneser-Ney estimates:

    P(c | x) = (max(n(x, c) - D, 0) + sum over both classes of min(D, n(x, c)) * Q(c)) / n(x)

n counts the documents of the sample that hold a bigram, a word or the beginning of a word (``STEMS`` letters).  Q is the next
shorter expression: a bigram backs off to its two words as if these were independent, a word to its longest beginning, a
beginning to the next shorter one, and that to the classes' shares.  As in modified Kneser-Ney there are discounts for n of 1, 2 and
``LEVELS`` or more.  They are estimated for each order by leaving one out: how often does an expression that was seen n times in one
class alone turn up in the other?  Where nearly all words are neutral, that is most of the time: discounts come out near n, and
expressions too rare to tell the classes apart weigh alike in both.

A document's difference is the sum of its words' log ratios divided by their number.  A logistic curve over it and over its product with
the square root of that number, whose chance part has the same width at every length, gives the score.

Departures from a plain model, all of which only drop what would add noise: expressions of fewer than ``LEAST`` documents are left to the
backoff (a count cut-off), and so are entries whose own counts gain less than ``GAIN`` nats of likelihood over their backoff
or that differ from it by less than ``PRUNE`` (likelihood pruning).  Otherwise the classes' chance shares of topics or languages
would add to every word of a text, and sixty neutral words outweigh the one that matters.  Copies count once (``without_copies``).

Models are fitted to a bounded sample of labelled documents (``PER_CLASS`` of each class, by the hash of their id).  The curve is learned
from a fifth of it (all of it, if that lacks a class), for a model of the other four; the model itself then counts all of
it.  Scoring reads every word of every text, whatever its length, moves no row, and uses nothing but the text.

Null and empty texts have no words and a difference of 0.  Null labels and ids are not learned from; if labels disagree, toxic
holds.  Without labelled documents of both classes every score is 0.  Repeated rows get equal scores.  Empty tables give no
rows.  Columns of the input other than those asked for are not read, and the score may have any name that is not among those.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import quoted, tidy, written

#: Labelled documents of each class that a model learns from, at most.
PER_CLASS = 6000
#: Documents that hold an expression before it has an entry of its own.
LEAST = {"pair": 4, "word": 4, "stem": 4}
#: Log ratio by which an entry must differ from its backoff.
PRUNE = 0.25
#: Log-likelihood (nats) that an entry must add to its own counts.
GAIN = 10.0
#: Counts up to which discounts are told apart.
LEVELS = 3
STEMS = (3, 4, 5, 6, 7)
#: Begins the entry of a stem; no word holds it.
STEM = "^"
#: Words of the sequences by which copies are known.
SHINGLE = 5
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")
#: Entries after which a counting task hands on what it has; unseen words whose stems a task remembers.
HOLD, REMEMBER = 400_000, 200_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def sample(docs: DataFrame, labels: DataFrame, training: Column, per_class: int = PER_CLASS) -> tuple[DataFrame, dict[int, float]]:
    """(text, toxic, fold) of at most ``per_class`` labelled training documents of each class, and for each class how many documents one
    of the sample stands for."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(training).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    share = F.create_map(*[F.lit(x) for k in (0, 1) for x in (k, min(1.0, 1.3 * per_class / max(1, count.get(k, 0))))])
    likely = known.withColumn("order", order).where(F.pmod("order", F.lit(1_000_000)) < share[F.col("toxic")] * 1_000_000)
    # The first of each class in order; every task keeps no more than that many.
    first = [likely.where(F.col("toxic") == k).orderBy("order", "doc_id").limit(per_class) for k in (0, 1)]
    chosen = first[0].union(first[1]).select("doc_id", F.col("toxic").cast("int").alias("toxic"), (F.pmod(F.xxhash64("order"), F.lit(5)) == 0).cast("int").alias("fold"))
    # At most 2 * per_class rows of three numbers.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Of rows that share an id one is read: the bound is one of rows, too.
    found = found.groupBy("doc_id", "toxic", "fold").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first")).select("first.text", "toxic", "fold")
    return found, {k: max(1.0, n / per_class) for k, n in count.items()}


def without_copies(texts: DataFrame) -> DataFrame:
    """One row of (text, toxic, fold) for each class and smallest hash of the text's ``SHINGLE``-word sequences: copies and most near copies
    are one witness, not many, and do not stand in both folds."""
    fields = pa.schema([("text", pa.string()), ("toxic", pa.int32()), ("fold", pa.int32()), ("least", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            least = []
            for text in batch.column("text").to_pylist():
                own = words_of(text)
                least.append(min(xxhash.xxh3_64_intdigest(" ".join(own[i : i + SHINGLE]).encode()) for i in range(max(1, len(own) - SHINGLE + 1))) >> 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("text", "toxic", "fold")), pa.array(least, pa.int64())], schema=fields)

    marked = texts.select("text", "toxic", "fold").mapInArrow(tidy(run), "text string, toxic int, fold int, least long")
    first = F.min(F.struct(F.xxhash64("text").alias("order"), "fold", "text"))
    return marked.groupBy("toxic", "least").agg(first.alias("first")).select("first.text", "toxic", "first.fold")


def logit(p):
    return np.log(p) - np.log1p(-p)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Discounts:
    """One order's discounts by count (1 to ``LEVELS``, and the last beyond) and the toxic share of its counts."""

    by_count: np.ndarray
    share: float

    def toxic(self, toxic: np.ndarray, plain: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Log odds of the toxic class, given those of the backoff."""
        n = np.maximum(toxic + plain, 1)
        d = self.by_count[np.minimum(n, LEVELS).astype(int) - 1]
        spare, q = np.minimum(d, toxic) + np.minimum(d, plain), sigmoid(below)
        return np.log(np.maximum(toxic - d, 0) + spare * q) - np.log(np.maximum(plain - d, 0) + spare * (1 - q))


def discounts(cells: dict[tuple[int, int], int], toxic: float, plain: float) -> Discounts:
    """From the number of expressions by their counts (toxic, plain), and all counts of both classes.  Leaving out one occurrence of an expression
    with (n, 1) or (1, n) meets the other class after n of one; leaving out one of (n + 1, 0) or (0, n + 1) does not."""
    share, found, get = toxic / (toxic + plain), [], lambda a, b: cells.get((a, b), 0)
    for n in range(1, LEVELS + 1):
        other = get(n, 1) + get(1, n) if n > 1 else 2 * get(1, 1)
        by_chance = (1 - share) * ((n + 1) * get(n + 1, 0) + get(n, 1)) + share * ((n + 1) * get(0, n + 1) + get(1, n))
        # One expression more of each kind, so that few of them say little: the discount then stays at the value for neutral words.
        d = n * (other + 1.0) / (by_chance + 1.0)
        found.append(min(float(n), max(d, found[-1] if found else 0.5)))
    return Discounts(np.array(found), share)


@dataclass
class Model:
    """Log ratios, toxic to ordinary.  ``value`` by index: of words, and of beginnings, for words without an entry; the last is 0."""

    index: dict[str, int]
    value: np.ndarray
    #: Bigrams (history * size + word), ascending, and their log ratios.
    pair: np.ndarray
    pair_value: np.ndarray
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)
    seen: dict[str, int] = field(default_factory=dict, repr=False)

    def place(self, word: str) -> int:
        if (i := self.seen.get(word)) is None:
            i = next((i for n in reversed(STEMS) if len(word) >= n and (i := self.index.get(STEM + word[:n])) is not None), len(self.index))
            if len(self.seen) < REMEMBER:
                self.seen[word] = i
        return i

    def difference(self, words: list[str]) -> float:
        """Length-normalised log-likelihood under toxic less that under ordinary."""
        if not words:
            return 0.0
        size, get = len(self.index) + 1, self.index.get
        at = np.fromiter((i if (i := get(w)) is not None else self.place(w) for w in words), np.int64, len(words))
        value = self.value[at]
        if len(self.pair):
            code = at[:-1] * size + at[1:]
            where = np.minimum(np.searchsorted(self.pair, code), len(self.pair) - 1)
            value[1:] = np.where(self.pair[where] == code, self.pair_value[where], value[1:])
        return float(value.sum() / len(words))

    def features(self, words: list[str]) -> tuple[float, float]:
        d, n = self.difference(words), len(words)
        return d, d * math.sqrt(n)

    def score(self, words: list[str]) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.features(words), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


COUNTS = ("plain", "toxic", "plain_held", "toxic_held")


def count_expressions(texts: DataFrame) -> DataFrame:
    """(h, w, plain, toxic, plain_held, toxic_held): documents of each class, in the folds 0 and 1, that hold a bigram or, where h is null, a
    word or a beginning."""
    schema = pa.schema([("h", pa.string()), ("w", pa.string()), *((c, pa.int64()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Counter() for _ in COUNTS]

        def flush() -> Iterator[pa.RecordBatch]:
            for k, own in enumerate(held):
                n, none = list(own.values()), [0] * len(own)
                yield pa.RecordBatch.from_pydict({"h": [x[0] for x in own], "w": [x[1] for x in own], **{c: n if i == k else none for i, c in enumerate(COUNTS)}}, schema)
                own.clear()

        for batch in batches:
            for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                words = words_of(text)
                kinds, own = set(words), held[toxic + 2 * fold]
                own.update(set(zip(words, words[1:])))
                own.update((None, w) for w in kinds)
                own.update((None, b) for b in {STEM + w[:n] for w in kinds for n in STEMS if len(w) >= n})
                if sum(map(len, held)) > HOLD:
                    yield from flush()
        yield from flush()

    return texts.select("text", "toxic", "fold").mapInArrow(tidy(run), "h string, w string, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("h", "w").agg(*[F.sum(c).alias(c) for c in COUNTS])


def measured(counts: DataFrame) -> Discounts | None:
    """Discounts of an order from (toxic, plain); a row for each small pair of counts comes to the driver."""
    total = counts.agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain")).first()
    if not total["toxic"] or not total["plain"]:
        return None
    small = counts.where((F.col("toxic") + F.col("plain")) <= LEVELS + 1).groupBy("toxic", "plain").agg(F.count("*").alias("n")).collect()
    return discounts({(r["toxic"], r["plain"]): r["n"] for r in small}, total["toxic"], total["plain"])


def assemble(words: pd.DataFrame, stems: pd.DataFrame, pairs: pd.DataFrame, of: dict[str, Discounts], least_gain: float = GAIN, prune: float = PRUNE) -> Model:
    """A model without its curve from (w, toxic, plain) of words and beginnings and (h, w, toxic, plain) of bigrams."""
    prior = {k: float(logit(d.share)) for k, d in of.items()}
    kept: dict[str, float] = {}

    def below(word: str, longest: int) -> float:
        """The log ratio of the longest kept beginning with at most ``longest`` letters."""
        return next((v for n in reversed(STEMS) if n <= longest and len(word) >= n and (v := kept.get(STEM + word[:n])) is not None), 0.0)

    def settle(rows: pd.DataFrame, order: str, backoff: list[float]) -> np.ndarray:
        return of[order].toxic(rows["toxic"].to_numpy(float), rows["plain"].to_numpy(float), np.array(backoff) + prior[order]) - prior[order]

    def worth(rows: pd.DataFrame, order: str, own: np.ndarray, backoff: np.ndarray) -> np.ndarray:
        """Likelihood pruning: what its own counts gain over their backoff, in nats, and what the entry differs by."""
        toxic, plain, b = rows["toxic"].to_numpy(float), rows["plain"].to_numpy(float), np.array(backoff) + prior[order]
        at_best = lambda n: n * np.log(np.maximum(n, 1) / (toxic + plain))
        gain = at_best(toxic) + at_best(plain) + toxic * np.logaddexp(0, -b) + plain * np.logaddexp(0, b)
        return (gain >= least_gain) & (np.abs(own - np.array(backoff)) >= prune)

    size = stems["w"].str.len() - len(STEM)
    for n in STEMS:
        own = stems[size == n]
        if len(own):
            back = [below(w[len(STEM):], n - 1) for w in own["w"]]
            new = settle(own, "stem", back)
            keep = worth(own, "stem", new, back)
            kept.update(zip(own["w"][keep], new[keep], strict=True))
    ratio: dict[str, float] = {}
    if len(words):
        back = [below(w, len(w)) for w in words["w"]]
        own = settle(words, "word", back)
        keep = worth(words, "word", own, back)
        ratio = dict(zip(words["w"], own, strict=True))
        kept.update(zip(words["w"][keep], own[keep], strict=True))
    single = lambda w: v if (v := kept.get(w)) is not None else below(w, len(w))
    found: dict[tuple[str, str], float] = {}
    if len(pairs):
        first, second = np.array([ratio.get(h, 0.0) for h in pairs["h"]]), np.array([single(w) for w in pairs["w"]])
        own = settle(pairs, "pair", first + second)
        keep = worth(pairs, "pair", own, first + second)
        found = dict(zip(zip(pairs["h"][keep], pairs["w"][keep], strict=True), (own - first)[keep], strict=True))
    for h, w in found:  # a word of a bigram has an index, and what it would have without
        for x in (h, w):
            kept.setdefault(x, single(x))
    index = {w: i for i, w in enumerate(kept)}
    code = np.array([index[h] * (len(index) + 1) + index[w] for h, w in found], np.int64)
    order = np.argsort(code)
    return Model(index, np.array([*kept.values(), 0.0]), code[order], np.array([*found.values()], float)[order])


def learn(counts: DataFrame, least_gain: float = GAIN, prune: float = PRUNE) -> Model | None:
    """A model without its curve from (h, w, plain, toxic)."""
    begun, single = F.col("w").startswith(STEM), counts.where("h IS NULL").select("w", "toxic", "plain")
    orders = {"word": single.where(~begun), "stem": single.where(begun), "pair": counts.where("h IS NOT NULL").select("h", "w", "toxic", "plain")}
    of = {k: measured(c) for k, c in orders.items()}
    if of["word"] is None:
        return None
    of = {k: d or of["word"] for k, d in of.items()}
    enough = {k: c.where(F.col("toxic") + F.col("plain") >= LEAST[k]).toPandas().sort_values(c.columns[:-2], ignore_index=True) for k, c in orders.items()}
    return assemble(enough["word"], enough["stem"], enough["pair"], of, least_gain, prune)


def fit(spark: SparkSession, texts: DataFrame, stands_for: dict[int, float]) -> Model | None:
    """A model from (text, toxic, fold).  What comes to the driver is bounded by the sample."""
    texts = written(spark, without_copies(texts), "toxicity-sample")
    counts = written(spark, count_expressions(texts), "toxicity-counts")
    whole = learn(counts.select("h", "w", (F.col("plain") + F.col("plain_held")).alias("plain"), (F.col("toxic") + F.col("toxic_held")).alias("toxic")))
    if whole is None:
        return None
    # The curve is learned on documents that its own model has not seen, where there are any of both classes.
    held_out = {r["toxic"] for r in texts.where("fold = 1").select("toxic").distinct().collect()} == {0, 1}  # two rows
    part = learn(counts.select("h", "w", "plain", "toxic")) if held_out else None
    shipped = spark.sparkContext.broadcast(part or whole)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shipped.value.features(words_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.float64()), batch.column("toxic")], names=["a", "b", "toxic"])

    held = texts.where("fold = 1" if part else "true").mapInArrow(tidy(measure), "a double, b double, toxic int").toPandas().sort_values(["a", "b", "toxic"], ignore_index=True)
    weights = logistic(held[["a", "b"]].to_numpy(), held["toxic"].to_numpy(), np.array([stands_for.get(int(k), 1.0) for k in held["toxic"]]))
    return Model(whole.index, whole.value, whole.pair, whole.pair_value, weights)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Coefficients (constant first) of a slightly ridged logistic regression.  Newton's steps are halved until the penalised likelihood
    does not fall, which for this concave function ends at its only maximum."""
    if len(y) == 0:
        return (0.0,) * (x.shape[1] + 1)
    scale = np.maximum(x.std(axis=0), 1e-9)
    design = np.column_stack([np.ones(len(y)), x / scale])
    ridge = np.array([1e-6] + [0.05] * x.shape[1])

    def value(beta: np.ndarray) -> float:
        z = design @ beta
        return float((weight * (y * z - np.logaddexp(0, z))).sum() - 0.5 * (ridge * beta * beta).sum())

    beta = np.zeros(design.shape[1])
    best = value(beta)
    for _ in range(200):
        p = sigmoid(design @ beta)
        gradient = design.T @ (weight * (y - p)) - ridge * beta
        step = np.linalg.solve(design.T @ (design * (weight * p * (1 - p))[:, None]) + np.diag(ridge), gradient)
        while (new := value(beta + step)) < best and np.abs(step).max() > 1e-12:
            step /= 2
        if new <= best + 1e-10:
            break
        beta, best = beta + step, new
    return (float(beta[0]), *(float(b / s) for b, s in zip(beta[1:], scale, strict=True)))


def with_score(spark: SparkSession, docs: DataFrame, model: Model | None, columns: list[str], name: str = "score") -> DataFrame:
    """``columns`` of docs and a score between 0 and 1 called ``name``, which must not be among them."""
    if model is None:
        return docs.select(*map(quoted, columns), F.lit(0.0).alias(name))
    shipped = spark.sparkContext.broadcast(model)
    read = [*columns, *(["text"] if "text" not in columns else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shipped.value.score(words_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found, pa.float64())], names=[*columns, name])

    return docs.select(*map(quoted, read)).mapInArrow(tidy(run), docs.select(*map(quoted, columns)).schema.add(name, "double"))
