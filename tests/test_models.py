import math

import pytest
from pyspark.sql import functions as F

from quillspark.operators import evaluation, models
from quillspark.streaming import jobs


def test_patience_doubles_pauses_and_ends():
    pauses, calls = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 4:
            raise models.Busy("try again in 7s" if len(calls) == 2 else "")
        return x * 2

    assert models.patient(flaky, sleep=pauses.append)(4) == 8 and pauses == [1.0, 7.0, 4.0]
    with pytest.raises(models.Busy):
        models.patient(lambda: (_ for _ in ()).throw(models.Busy()), tries=2, sleep=pauses.append)()
    with pytest.raises(ValueError):
        models.patient(lambda: (_ for _ in ()).throw(ValueError()), sleep=pauses.append)()


def test_embedder_keeps_order_in_batches(spark):
    sizes = models.embedder(lambda texts: [[float(len(texts)), float(len(t))] for t in texts], batch=2)
    df = spark.createDataFrame([(i, "x" * i) for i in range(5)], "i long, t string").coalesce(1)
    got = {r["i"]: list(r["v"]) for r in df.select("i", sizes(F.col("t")).alias("v")).collect()}
    assert got == {0: [2.0, 0.0], 1: [2.0, 1.0], 2: [2.0, 2.0], 3: [2.0, 3.0], 4: [1.0, 4.0]}
    unit = models.hashed(["a b c", ""])
    assert math.isclose(sum(x * x for x in unit[0]), 1.0, rel_tol=1e-5) and not any(unit[1])


def test_chat_judge_and_stand_ins(spark):
    df = spark.createDataFrame([("net revenue", "cost 5\nnet revenue 12\n", "12"), ("zzz", "cost", "?")], "q string, c string, a string")

    def reply(prompt):
        if "zzz" in prompt:
            raise RuntimeError("offline")
        return 'Well {"score": 1.7}'

    rate = models.judge(reply, "faithfulness")
    got = df.select(rate(F.col("q"), F.col("c"), F.col("a")).alias("s"), models.extractive(F.col("q"), F.col("c")).alias("x"), models.overlap(F.col("q"), F.col("c")).alias("o")).collect()
    assert [tuple(r) for r in got] == [(1.0, "net revenue 12", 1.0), (None, "no information", 0.0)]
    pooled = df.select(models.mean_pool(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(6.0)))).alias("p")).first()["p"]
    assert list(pooled) == [2.0, 4.0]
    assert df.select(models.prefixed(F.col("q"), "query", "multilingual-e5"), models.prefixed(F.col("q"), "query", "other")).first()[0:2] == ("query: net revenue", "net revenue")


def test_page_and_answer_scores(spark):
    pairs = spark.createDataFrame([(1, "Doanh thu 125.780.761", "| Doanh thu | 125.780.761 |"), (2, "a 10", "a 11")], "page long, pred string, gold string")
    got = {r["page"]: r for r in evaluation.pages(pairs).collect()}
    assert got[1]["cer"] == 0 and got[1]["char_accuracy"] == 1 and got[1]["number_f1"] == 1
    assert got[2]["number_f1"] == 0 and got[2]["numbers_shared"] == 0 and got[2]["wer"] == 0.5
    items = spark.createDataFrame([("a", "numeric", "là 4,5 và 7", "x", ["4,50", "8"], "4,5", [2021], [2020]), ("b", "unanswerable", "Không tìm thấy", "", [], "", [], [])], "id string, answer_type string, answer string, ground_truth string, gold_numbers array<string>, context string, relevant_years array<int>, found_years array<int>")
    scored = {r["id"]: r for r in evaluation.answers(items).collect()}
    assert (scored["a"]["numeric_recall"], scored["a"]["context_recall"], scored["a"]["year_coverage"], scored["a"]["abstention"]) == (0.5, 0.5, 0.0, None)
    assert scored["b"]["abstention"] == 1.0 and scored["b"]["token_f1"] is None


def test_index_stream_records_status_and_resumes(spark, tmp_path):
    source = tmp_path / "in"
    spark.range(5).write.parquet(str(source))
    stream = lambda: jobs.stream(spark, str(source), spark.range(1).schema, 100)
    run = lambda: jobs.index_stream(stream(), lambda b: b, str(tmp_path / "out"), str(tmp_path / "status"), str(tmp_path / "state")).awaitTermination()
    run()
    spark.range(5, 8).write.mode("append").parquet(str(source))
    run()
    assert [r["rows"] for r in spark.read.parquet(str(tmp_path / "status")).orderBy("batch_id").collect()] == [5, 3]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8
