"""Scores of answers, and of recognised pages against gold pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.metrics import bag, number_recall, rouge_l, token_distance
from quillspark.functions.numbers import canonical, numbers_in, signed_numbers_in
from quillspark.functions.text import is_refusal, plain_text, tokens


def numeric_match(answer: Column, gold: Column) -> Column:
    """(n_gold, n_matched, recall, all_present) of distinct gold numbers in an answer; null without any."""
    want = F.array_distinct(F.filter(F.transform(gold, canonical), lambda x: x.isNotNull()))
    n = F.size(F.array_intersect(want, numbers_in(answer)))
    return F.when(F.size(want) > 0, F.struct(F.size(want).alias("n_gold"), n.alias("n_matched"), (n / F.size(want)).alias("recall"), (n == F.size(want)).cast("int").alias("all_present")))


def year_coverage(years: Column, found: Column) -> Column:
    """Share of the years asked about that the retrieved documents have; null if none was asked about."""
    return F.when(F.size(years) > 0, F.size(F.array_intersect(years, found)) / F.size(F.array_distinct(years)))


def f1(shared: Column, a: Column, b: Column) -> Column:
    return F.when(a + b > 0, 2 * shared / (a + b)).otherwise(1.0)


def answers(items: DataFrame) -> DataFrame:
    """items (id, answer_type, answer, ground_truth, gold_numbers, context, relevant_years, found_years) and a score for each metric.

    Unanswerable items are scored by refusing, the others by everything else; what does not apply is null."""
    plain = F.col("answer_type") != "unanswerable"
    shared = F.size(F.array_intersect(bag(tokens(F.col("answer"))), bag(tokens(F.col("ground_truth")))))
    sizes = F.size(tokens(F.col("answer"))), F.size(tokens(F.col("ground_truth")))
    return items.select(
        "id", "answer_type",
        F.when(plain, numeric_match(F.col("answer"), F.col("gold_numbers"))["recall"]).alias("numeric_recall"),
        F.when(plain, number_recall(F.col("context"), F.col("gold_numbers"))).alias("context_recall"),
        F.when(plain, F.when(shared > 0, 2 * shared / (sizes[0] + sizes[1])).otherwise(0.0)).alias("token_f1"),
        F.when(plain, rouge_l(tokens(F.col("answer")), tokens(F.col("ground_truth")))).alias("rouge_l"),
        F.when(plain, year_coverage(F.col("relevant_years"), F.col("found_years"))).alias("year_coverage"),
        F.when(~plain, is_refusal(F.col("answer")).cast("double")).alias("abstention"),
        F.when(plain, is_refusal(F.col("answer")).cast("double")).alias("false_abstention"),
    )


def rollup(scored: DataFrame, by: str = "answer_type") -> DataFrame:
    """Means of all metrics by ``by`` and overall, and the number of items."""
    metrics = [c for c, kind in scored.dtypes if kind == "double"]
    return scored.groupingSets([[by], []], by).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in metrics])


def pages(pairs: DataFrame) -> DataFrame:
    """pairs (page, pred, gold) to character, word and number scores of the normalised texts."""
    df = pairs.select("page", plain_text(F.col("pred")).alias("p"), plain_text(F.col("gold")).alias("g"))
    words = lambda c: F.filter(F.split(F.col(c), " "), lambda w: w != "")
    df = df.select("page", "p", "g", words("p").alias("pw"), words("g").alias("gw"), signed_numbers_in(F.col("p")).alias("pn"), signed_numbers_in(F.col("g")).alias("gn"))
    df = df.withColumns({"char_distance": F.levenshtein("p", "g"), "word_distance": token_distance("pw", "gw"), "words_shared": F.size(F.array_intersect(bag(F.col("pw")), bag(F.col("gw")))), "numbers_shared": F.size(F.array_intersect(bag(F.col("pn")), bag(F.col("gn"))))})
    cer, wer = (F.col(d) / F.greatest(n, F.lit(1)) for d, n in (("char_distance", F.length("g")), ("word_distance", F.size("gw"))))
    return df.select(
        "page", cer.alias("cer"), wer.alias("wer"), F.greatest(F.lit(0.0), 1 - cer).alias("char_accuracy"), F.greatest(F.lit(0.0), 1 - wer).alias("word_accuracy"),
        "words_shared", F.size("pw").alias("n_words"), F.size("gw").alias("n_gold_words"), f1(F.col("words_shared"), F.size("pw"), F.size("gw")).alias("word_f1"),
        "numbers_shared", F.size("pn").alias("n_numbers"), F.size("gn").alias("n_gold_numbers"), f1(F.col("numbers_shared"), F.size("pn"), F.size("gn")).alias("number_f1"),
    )


def pages_total(scored: DataFrame) -> DataFrame:
    """Means over pages, and word and number F1 over all pages together."""
    s = lambda c: F.sum(c)
    return scored.agg(F.count("*").alias("pages"), *[F.round(F.avg(c), 4).alias(c) for c in ("cer", "wer", "char_accuracy", "word_f1", "number_f1")], F.round(f1(s("words_shared"), s("n_words"), s("n_gold_words")), 4).alias("micro_word_f1"), F.round(f1(s("numbers_shared"), s("n_numbers"), s("n_gold_numbers")), 4).alias("micro_number_f1"))
