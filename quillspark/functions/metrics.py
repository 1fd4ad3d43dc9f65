"""Answer and retrieval metrics.  What does not apply is null, never NaN."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType

from quillspark.functions.numbers import canonical, numbers_in
from quillspark.functions.text import tokens


@F.pandas_udf(ArrayType(StringType()))
def bag(words: pd.Series) -> pd.Series:
    """Words with their place among equal words: sets of these behave as multisets.  One pass; as a column expression, each word would build the table of
    all words anew."""
    out = []
    for row in words:
        seen: dict[str, int] = {}
        numbered = []
        for w in row if row is not None else []:
            seen[w] = seen.get(w, 0) + 1
            numbered.append(f"{w}\u0001{seen[w]}")
        out.append(numbered)
    return pd.Series(out)


def overlap_f1(pairs: DataFrame, key: list[str], a: str, b: str, name: str) -> DataFrame:
    """Token F1 of two texts as multisets, by exploding and counting each side: no list of a hot group is built twice."""
    side = lambda c, n: pairs.select(*key, F.explode(tokens(F.col(c))).alias("word")).groupBy(*key, "word").agg(F.count("*").alias(n))
    shared = side(a, "x").join(side(b, "y"), [*key, "word"]).groupBy(*key).agg(F.sum(F.least("x", "y")).alias("shared"))
    sized = pairs.select(*key, F.size(tokens(F.col(a))).alias("na"), F.size(tokens(F.col(b))).alias("nb"))
    f1 = F.when(F.col("shared") > 0, 2 * F.col("shared") / (F.col("na") + F.col("nb"))).otherwise(0.0)
    return sized.join(shared, key, "left").select(*key, F.coalesce("shared", F.lit(0)).cast("long").alias("shared"), F.coalesce(f1, F.lit(0.0)).alias(name))


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit rows: one big-integer step for each word of ``a``."""
    at: dict[str, int] = {}
    for j, word in enumerate(b):
        at[word] = at.get(word, 0) | 1 << j
    row = (1 << len(b)) - 1
    full = row
    for word in a:
        hit = row & at.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


@F.pandas_udf(DoubleType())
def rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of two token arrays."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = list(x if x is not None else []), list(y if y is not None else [])
        n = _lcs(x, y) if x and y else 0
        out.append(2.0 * n / (len(x) + len(y)) if n else 0.0)
    return pd.Series(out)


@F.pandas_udf(IntegerType())
def token_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance of two token arrays: words become code points, one row of costs at a time."""
    out = []
    for x, y in zip(a, b, strict=True):
        ids: dict[str, int] = {}
        p, q = ([ids.setdefault(w, len(ids)) for w in (s if s is not None else [])] for s in (x, y))
        q = np.array(q, np.int64)
        row = np.arange(len(q) + 1)
        for i, w in enumerate(p, 1):
            step = np.minimum(row[1:] + 1, row[:-1] + (q != w))
            row = np.minimum.accumulate(np.concatenate([[i], step]) - np.arange(len(q) + 1)) + np.arange(len(q) + 1)
        out.append(int(row[-1]))
    return pd.Series(out)


def number_recall(context: Column, gold: Column) -> Column:
    """Share of distinct gold numbers that a text holds; null without gold numbers."""
    want = F.array_distinct(F.filter(F.transform(gold, canonical), lambda x: x.isNotNull()))
    return F.when(F.size(want) > 0, F.size(F.array_intersect(want, numbers_in(context))) / F.size(want))


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, ks=(1, 3, 5, 8)) -> DataFrame:
    """ranked (qid, id, rank from 1) and relevant (qid, id) to a row for each question that has relevant ids: recall, precision, hit and
    ndcg at each k, and mrr and ap."""
    size = relevant.distinct().groupBy("qid").agg(F.count("*").alias("n"))
    hits = ranked.join(relevant.distinct(), ["qid", "id"]).select("qid", "rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")).alias("so_far"))
    depth = ranked.groupBy("qid").agg(F.max("rank").alias("depth"))
    gain = lambda r: F.log(F.lit(2.0)) / F.log(r + 1.0)
    sums = [F.coalesce(F.sum((F.col("rank") <= k).cast("int")), F.lit(0)).alias(f"h{k}") for k in ks]
    gains = [F.sum(F.when(F.col("rank") <= k, gain(F.col("rank")))).alias(f"g{k}") for k in ks]
    found = hits.groupBy("qid").agg(*sums, *gains, F.min("rank").alias("first"), F.sum(F.col("so_far") / F.col("rank")).alias("precisions"))
    df = size.join(depth, "qid", "left").join(found, "qid", "left")
    out = []
    for k in ks:
        n = F.coalesce(F.col(f"h{k}"), F.lit(0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + F.log(F.lit(2.0)) / F.log(i + 1.0))
        top = F.least(F.coalesce("depth", F.lit(0)), F.lit(k))
        out += [(n / F.col("n")).alias(f"recall_{k}"), F.when(top > 0, n / top).otherwise(0.0).alias(f"precision_{k}"), (n > 0).cast("int").alias(f"hit_{k}"), (F.coalesce(F.col(f"g{k}"), F.lit(0.0)) / ideal).alias(f"ndcg_{k}")]
    return df.select("qid", *out, F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.coalesce("precisions", F.lit(0.0)) / F.col("n")).alias("ap"))
