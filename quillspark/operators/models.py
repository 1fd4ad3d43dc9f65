"""Places where a model plugs in, with deterministic stand-ins that need none.

An embedder turns batches of texts into vectors, a reranker scores pairs of texts, a chat model answers a prompt, a judge is a chat model whose reply
holds a score.  Each is a plain function that runs over Arrow batches in the executors, with retries where the service may be busy.
"""

from __future__ import annotations

import json
import re
import time
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType

from quillspark.functions.text import TOKEN, tokens

BATCH = 64


class Busy(Exception):
    """The service asks to try again, after ``wait`` seconds if it says so."""

    def __init__(self, message: str = "", wait: float | None = None):
        super().__init__(message)
        said = re.search(r"try again in ([\d.]+)s", message)
        self.wait = wait if wait is not None else float(said[1]) if said else None


def patient(call: Callable, tries: int = 5, first: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` repeated while it is busy, each pause twice the last unless the service names one; other errors are final."""

    def run(*args):
        pause = first
        for left in range(tries - 1, -1, -1):
            try:
                return call(*args)
            except Busy as busy:
                if not left:
                    raise
                sleep(busy.wait if busy.wait is not None else pause)
                pause *= 2

    return run


def embedder(encode: Callable[[list[str]], list[list[float]]], batch: int = BATCH):
    """A column function from texts to vectors; ``encode`` sees at most ``batch`` texts at a time, in order."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(text: pd.Series) -> pd.Series:
        texts, out = text.fillna("").tolist(), []
        for begin in range(0, len(texts), batch):
            out += encode(texts[begin : begin + batch])
        return pd.Series(out)

    return embed


def hashed(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Stand-in embedder: signed word counts in hashed places, of unit length."""
    out = np.zeros((len(texts), dim))
    for row, text in zip(out, texts, strict=True):
        for word in re.findall(r"\w+", text.lower()):
            h = zlib.crc32(word.encode())
            row[h % dim] += 1 if h >> 16 & 1 else -1
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32).tolist()


def prefixed(text: Column, role: str, model: str) -> Column:
    """Texts as e5 models want them, ``query: `` or ``passage: `` first; other models take them as they are."""
    return F.concat(F.lit(f"{role}: "), text) if "e5" in model.lower() else text


def mean_pool(vectors: Column) -> Column:
    """The mean of an array of vectors of equal length."""
    n = F.size(vectors)
    zero = F.transform(vectors[0], lambda _: F.lit(0.0))
    return F.transform(F.aggregate(vectors, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double"))), lambda x: x / n)


def reranker(score: Callable[[list[str], list[str]], list[float]]):
    """A column function from questions and texts to scores."""

    @F.pandas_udf(DoubleType())
    def rank(question: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(score(question.fillna("").tolist(), text.fillna("").tolist()), dtype="float64")

    return rank


def overlap(question: Column, text: Column) -> Column:
    """Stand-in reranker: the share of a question's words that a text holds."""
    words = F.array_distinct(tokens(question))
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, tokens(text))) / F.size(words)).otherwise(0.0)


def replies(answer: Callable[[str], str]):
    """A column function from prompts to (text, error): one of the two is null, so that one prompt neither ends a batch nor fails unseen."""

    @F.pandas_udf("text string, error string")
    def ask(prompt: pd.Series) -> pd.DataFrame:
        out = []
        for p in prompt:
            try:
                out.append((answer(p), None))
            except Exception as error:
                out.append((None, f"{type(error).__name__}: {error}"))
        return pd.DataFrame(out, columns=["text", "error"], dtype=object)

    return ask


def chat(answer: Callable[[str], str]):
    """A column function from prompts to answers, null where ``replies`` has an error."""
    ask = replies(answer)
    return lambda prompt: ask(prompt)["text"]


def extractive(question: Column, context: Column) -> Column:
    """Stand-in for a chat model: the line of the context that holds most of the question's words, the first of equals; a refusal without any."""
    words = F.array_distinct(tokens(question))
    lines = F.filter(F.split(F.coalesce(context, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    rated = F.zip_with(lines, F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))), lambda x, i: F.struct(F.size(F.array_intersect(words, F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(TOKEN), F.lit(0)))).alias("n"), (-i).alias("i"), x.alias("x")))
    best = F.array_max(rated)
    return F.when(best["n"] > 0, best["x"]).otherwise("no information")


def judged(reply: Column) -> Column:
    """The score in a judge's reply: the first JSON object's ``score``, held between 0 and 1; null without one."""
    body = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\{.*\}", 0)
    score = F.get_json_object(F.nullif(body, F.lit("")), "$.score").try_cast("double")
    return F.when(score.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


#: What each judge is asked to rate, and which of question, context, answer and reference it sees.
JUDGES = {
    "faithfulness": ("how far every statement of the answer is supported by the context", ("context", "answer")),
    "answer_relevancy": ("how directly the answer addresses the question", ("question", "answer")),
    "context_precision": ("how much of the context is needed to answer the question", ("question", "context")),
    "context_recall": ("how much of the reference answer the context contains", ("context", "reference")),
    "answer_correctness": ("how far the answer agrees with the reference answer in facts and figures", ("question", "answer", "reference")),
}


def judge_prompt(name: str, **given: Column) -> Column:
    """The prompt of a judge from columns by name; those that it does not see are ignored."""
    what, sees = JUDGES[name]
    parts = [F.concat(F.lit(f"{part.capitalize()}:\n"), F.coalesce(given[part], F.lit(""))) for part in sees]
    return F.concat_ws("\n\n", F.lit(f"Rate {what}, from 0 (not at all) to 1 (wholly)."), *parts, F.lit('Reply with one JSON object: {"score": number, "why": text}.'))


def judges(answer: Callable[[str], str], names=tuple(JUDGES)):
    """A function from columns question, context, answer and reference to a score column for each named judge, held between 0 and 1."""
    ask = chat(answer)
    return lambda **given: {name: judged(ask(judge_prompt(name, **given))) for name in names}


def judge(answer: Callable[[str], str], criterion: str):
    """A column function (question, context, answer) to a score by an injected chat model."""
    ask = chat(answer)

    def rate(question: Column, context: Column, given: Column) -> Column:
        return judged(ask(F.concat_ws("\n\n", F.lit(f"Rate the {criterion} of the answer from 0 to 1. Reply with JSON: {json.dumps({'score': 0.5})}"), F.concat(F.lit("Question: "), question), F.concat(F.lit("Context: "), context), F.concat(F.lit("Answer: "), given))))

    return rate
