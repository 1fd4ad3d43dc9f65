"""Language-model scores from a subword lattice.

A text is a sequence of words, each beginning with the word mark, and one end.  The lattice of a word holds every way to cut
it into pieces of an existing vocabulary, drawn independently, and, for a word of the training documents, one more edge
that spans the whole word.  Its probability is the sum over all paths, found by forward recursion in log space; that of a
document is the product over its words and its end.

Piece weights start from the vocabulary's own scores and are fitted by one step of expectation maximisation over
every distinct training word.  A character without a piece falls back to its bytes.  The spanning edge has the word's relative
frequency after an absolute discount D = n1 / (n1 + 2 n2), and the discounted mass is what the piece paths share, so
that the probabilities of all words and the end sum to 1.

Null and empty texts hold only the end.  Words never cross white space (space and ASCII 9 to 13), A-Z are lower-cased.
Repeated rows each count; a null id belongs to the training side as crc32 of the empty text does.  Texts and single words may be of any
length: a word costs one number a character.  Empty tables give no rows; without training documents only the pieces' existing
weights are left.  Of the input's columns only doc_id, text and training are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import blocks as B
from quillspark.llm.common import ascii_lower, tidy

MARK = "▁"
#: Weight of the existing scores against the expected counts of the corpus.
PRIOR_WEIGHT = 1000.0
#: Characters of a word up to which the pieces of its lattice are held between the two passes of an expectation.
KEPT = 4096


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with log weights that, with those of the 256 fallback bytes, sum to 1."""

    pieces: dict[str, float]
    byte: tuple[float, ...]
    longest: int
    #: By their last two characters, the length of the longest piece.
    reach: dict[str, int]


def reach_of(pieces) -> dict[str, int]:
    found: dict[str, int] = {}
    for piece in pieces:
        if len(piece) > found.get(piece[-2:], 1):
            found[piece[-2:]] = len(piece)
    return found


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a piece model, without control symbols and bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def from_scores(scored: list[tuple[str, float]]) -> Vocabulary:
    """Initial weights: a score of -r makes the piece as likely as rank r in Zipf's law; bytes have what the last rank has."""
    ranked = sorted(scored, key=lambda p: (-p[1], p[0]))
    weights = {piece: 1.0 / (2.7 + i) for i, (piece, _) in enumerate(ranked)}
    least = 1.0 / (2.7 + len(ranked))
    total = sum(weights.values()) + 256 * least
    return Vocabulary({p: math.log(w / total) for p, w in weights.items()}, (math.log(least / total),) * 256, max(map(len, weights), default=1), reach_of(weights))


def refit(prior: Vocabulary, expected: dict[str, float], byte: dict[int, float]) -> Vocabulary:
    """Weights in proportion to expected counts plus PRIOR_WEIGHT times the earlier weights."""
    total = sum(expected.values()) + sum(byte.values()) + PRIOR_WEIGHT
    lift = lambda weight, seen: math.log((seen + PRIOR_WEIGHT * math.exp(weight)) / total)
    return Vocabulary({p: lift(w, expected.get(p, 0.0)) for p, w in prior.pieces.items()}, tuple(lift(w, byte.get(i, 0.0)) for i, w in enumerate(prior.byte)), prior.longest, prior.reach)


def ending(word: str, j: int, v: Vocabulary) -> list[tuple[int, float, str]]:
    """The pieces that end at a position: (start, log weight, piece; empty for fallback bytes)."""
    get, here = v.pieces.get, []
    for i in range(max(0, j - (v.reach.get(word[j - 2 : j], 1) if j > 1 else 1)), j):
        piece = word[i:j]
        weight = get(piece)
        if weight is not None:
            here.append((i, weight, piece))
        elif j - i == 1:
            here.append((i, sum(v.byte[b] for b in piece.encode("utf-8", "surrogatepass")), ""))
    return here


def forward(word: str, v: Vocabulary, kept: list | None = None) -> list[float]:
    """Log of the summed probability of all ways to reach each position: one number a character, however long the word.  ``kept``, if given,
    gets the pieces that end at each position."""
    exp, log, alpha = math.exp, math.log, [0.0]
    for j in range(1, len(word) + 1):
        here = ending(word, j, v)
        if kept is not None:
            kept.append(here)
        ways = [alpha[i] + w for i, w, _ in here]
        if len(ways) == 1:
            alpha.append(ways[0])
        else:
            top = max(ways)
            alpha.append(top + log(sum([exp(x - top) for x in ways])))
    return alpha


def log_probability(word: str, v: Vocabulary) -> float:
    """Natural log of the marginal probability of a word over all its cuts into pieces."""
    return forward(MARK + word, v)[-1]


def log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)


@dataclass(frozen=True)
class Spans:
    """Edges that span a whole training word: ``n`` tokens, ``distinct`` of them, words seen once and twice."""

    n: int
    distinct: int
    once: int
    twice: int

    @property
    def discount(self) -> float:
        """Between 0.1 and 0.95; 0.5 where no word is seen once or none twice."""
        return min(0.95, max(0.1, self.once / (self.once + 2 * self.twice))) if self.once and self.twice else 0.5

    def edge(self, times: int) -> float:
        return math.log((times - self.discount) / self.n) if times > 0 else -math.inf

    @property
    def pieces(self) -> float:
        """Log of the mass that all paths of pieces share; all of it where nothing was learned."""
        return math.log(self.discount * self.distinct / self.n) if self.n else 0.0


def expect(word: str, times: float, v: Vocabulary, pieces: dict, byte: Counter) -> None:
    """Add the expected piece counts of ``times`` occurrences of a word."""
    word = MARK + word
    kept = [] if len(word) <= KEPT else None  # the pieces of a longer word are looked up again
    alpha, n, exp = forward(word, v, kept), len(word), math.exp
    # share[j]: posterior probability that a cut lies at j, passed backwards along the pieces that end there.
    share = [0.0] * n + [times]
    for j in range(n, 0, -1):
        if share[j] <= 1e-12:
            continue
        base = alpha[j]
        for i, weight, piece in kept[j - 1] if kept is not None else ending(word, j, v):
            part = share[j] * exp(alpha[i] + weight - base)
            share[i] += part
            if piece:
                pieces[piece] = pieces.get(piece, 0.0) + part
            else:
                for b in word[i:j].encode("utf-8", "surrogatepass"):
                    byte[b] += part


def words():
    """Tokens are cut here, and the end is added as a document's length is known."""
    found = re.compile("[^\\x20\\x09-\\x0D]+").findall
    return lambda text: found(ascii_lower(text))


def score(spark: SparkSession, docs: DataFrame, scored: list[tuple[str, float]], block_chars: int = B.BLOCK_CHARS) -> DataFrame:
    """docs (doc_id, text, training boolean) to one row a document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score and score (both log10)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.coalesce(F.col("training"), F.lit(False)).cast("int").alias("flag"))
    blocks, tokens, parts = B.cut_and_write(spark, docs, words, "lm", counted=True, block_chars=block_chars)
    start = spark.sparkContext.broadcast(from_scores(scored))  # fixed size: the vocabulary's

    def totals(rows: list[dict]) -> Counter:
        found: Counter = Counter()
        for row in rows:
            for word, times in zip(B.unpack_words(row["data"]), B.unpack_array(row["counts"], "<i8").tolist(), strict=True):
                found[word] += times
        return found

    def expectations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, pieces, byte, n, distinct, seen = start.value, {}, Counter(), 0, 0, Counter()
        for rows in B.by_part(batches):
            for word, times in totals(rows).items():
                if times:
                    n, distinct = n + times, distinct + 1
                    seen[times] += times < 3
                    expect(word, 1.0, v, pieces, byte)
        keys = [f"p{p}" for p in pieces] + [f"b{b}" for b in byte] + ["n", "v", "1", "2"]
        yield pa.RecordBatch.from_pydict({"name": keys, "expected": [*pieces.values(), *byte.values(), float(n), float(distinct), float(seen[1]), float(seen[2])]}, pa.schema([("name", pa.string()), ("expected", pa.float64())]))

    # At most one row for each piece of the fixed vocabulary comes to the driver.
    summed = {r["name"]: r["total"] for r in B.dealt(tokens, parts).mapInArrow(tidy(expectations), "name string, expected double").groupBy("name").agg(F.sum("expected").alias("total")).collect()}
    ends = int(blocks.agg(F.coalesce(F.sum(F.aggregate("flags", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("n")).first()["n"])
    n_train, n_distinct = int(summed.pop("n", 0)) + ends, int(summed.pop("v", 0)) + (ends > 0)
    spans = Spans(n_train, n_distinct, int(summed.pop("1", 0)), int(summed.pop("2", 0)))
    fitted = spark.sparkContext.broadcast(refit(start.value, {k[1:]: x for k, x in summed.items() if k[0] == "p"}, {int(k[1:]): x for k, x in summed.items() if k[0] == "b"}))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = fitted.value
        for rows in B.by_part(batches):
            found = totals(rows)
            known = {w: (times, log_add(spans.edge(times), spans.pieces + log_probability(w, v))) for w, times in found.items()}
            for row in rows:
                own = [known[w] for w in B.unpack_words(row["data"])]
                yield B.answer(row, B.pack_array(np.array([[t for t, _ in own], [p for _, p in own]], "<f8")))

    answers = B.dealt(tokens, parts).mapInArrow(tidy(values), B.ANSWER)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Without training documents nothing is known of the end; it then has probability 1.
        each, end = math.log10(n_train + n_distinct + 1), spans.edge(ends) if ends else 0.0
        for row in B.rows_of(batches):
            n, answers = B.answers_of(row)
            times, weight = np.zeros(n), np.zeros(n)
            for at, data in answers:
                found = B.unpack_array(data, "<f8").reshape(2, -1)
                times[at[: found.shape[1]]], weight[at[: found.shape[1]]] = found
            smoothed, flat, begin, out = np.log10(times + 1), B.unsqueeze(row["data"]), 0, {c: [] for c in schema.names}
            for doc_id, flag, length in zip(row["ids"], row["flags"], row["lens"], strict=True):
                at = flat[begin : begin + length]
                begin += length
                out["doc_id"].append(doc_id)
                out["held_out"].append(not flag)
                out["n_tokens"].append(length + 1)
                out["n_known"].append(int((times[at] > 0).sum()) + (ends > 0))
                out["train_tokens"].append(n_train)
                out["base_score"].append(float(smoothed[at].sum() + math.log10(ends + 1) - (length + 1) * each))
                out["score"].append(float((weight[at].sum() + end) / math.log(10)))
            yield pa.RecordBatch.from_pydict(out, schema)

    return B.rejoin(blocks, answers).mapInArrow(tidy(reassemble), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
