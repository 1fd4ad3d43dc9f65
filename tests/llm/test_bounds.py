"""Bounds that hold whatever a table looks like: samples with an id on a third of all rows, ranges by the thousand, names that clash."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import digest, langid, simhash, toxicity


def hot(spark, rows=3000):
    """A third of the rows have the id 7, each with a text of its own."""
    return spark.range(rows).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))


def test_samples_are_bounded_in_rows(spark):
    docs = hot(spark)
    labels = docs.select("doc_id").distinct().withColumn("toxic", (F.col("doc_id") % 2).cast("int"))
    texts, _ = toxicity.sample(docs, labels, F.lit(True), per_class=50)
    found = texts.groupBy("toxic").count().collect()
    assert {r["toxic"] for r in found} == {0, 1} and all(0 < r["count"] <= 50 for r in found)
    every, _ = toxicity.sample(docs, labels, F.lit(True), per_class=10_000)
    assert every.count() == docs.select("doc_id").distinct().count()
    assert langid.sample(docs, 40).count() <= 40
    assert langid.sample(docs, 10_000).count() == docs.select("doc_id").distinct().count()


def test_ranges_are_found_by_halving():
    rng = random.Random(1)
    cuts = sorted({(rng.randint(-5, 40), rng.randint(-9, 9)) for _ in range(60)})
    first, second = (np.array(c, np.int64) for c in zip(*cuts))
    rows = [(k, h) for k, h in ((rng.randint(-5, 45), rng.randint(-9, 9)) for _ in range(3000)) if (k, h) >= cuts[0]] + cuts
    got = digest.places(first, second, *(np.array(c, np.int64) for c in zip(*rows)))
    assert got.tolist() == [2 * (sum(c <= r for c in cuts) - 1) + (r in cuts) for r in rows]


def test_successors_with_very_many_partitions(spark, none):
    docs = hot(spark, 300).select("doc_id", "text")
    want = digest.fingerprints(spark, docs).select("doc_id", "n_chars", "edited_sha256").collect()
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    try:
        assert sorted(digest.fingerprints(spark, docs).select("doc_id", "n_chars", "edited_sha256").collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_names_of_the_callers_columns_are_free(spark):
    docs = hot(spark, 30).withColumns({"__text": F.lit("mine"), "a.b": F.lit(1)})
    got = simhash.fingerprints(docs.withColumnRenamed("a.b", "ab"), ["doc_id", "__text", "text"])
    assert {r["__text"] for r in got.collect()} == {"mine"} and got.columns == ["doc_id", "__text", "text", "fp"]
    model = langid.fit(spark, langid.sample(docs))
    assert langid.with_language(spark, docs, model, ["doc_id", "a.b"]).columns == ["doc_id", "a.b", "lang_pred", "score"]
