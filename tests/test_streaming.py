"""Chat memory that lapses, and indexing with progress that can be called off."""

import time

import pytest
from pyspark.sql import functions as F

from quillspark.streaming import memory, progress

TURNS = "conv_id long, turn long, role string, text string, ms long"


@pytest.fixture
def timers(spark):
    memory.with_timers(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def plain(batches, n, ttl, history=None):
    """Windows after each batch, and who lapsed in the end."""
    held, out = {}, []
    for no, rows in enumerate(batches):
        said = set()
        for conv, turn, role, text, at in sorted(rows, key=lambda r: (r[4], r[1])):
            window, until = held.get(conv, ([], None))
            if until is None or at > until:
                window = [h for h in (history or {}).get(conv, []) if h[0] < turn]
            held[conv] = ([*window, (turn, role, text)][-n:], max(at + ttl, until or 0))
            said.add(conv)
        out.append({c: held[c] for c in said})
        now = max(r[4] for so_far in batches[: no + 1] for r in so_far)
        gone = {c: u for c, (_, u) in held.items() if u <= now}
        out.append(gone)
        for c in gone:
            del held[c]
    return out


def run(spark, batches, tmp_path, n, ttl, history=None):
    got = []
    for no, rows in enumerate(batches):
        df = spark.createDataFrame(rows, TURNS).withColumn("at", F.timestamp_millis("ms")).drop("ms")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        found = {}

        def keep(batch, _, found=found):
            for r in batch.collect():
                found.setdefault(r["lapsed"], {})[r["conv_id"]] = ([tuple(t) for t in r["turns"]], r["until_ms"])

        source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        memory.chat_memory(source, n, ttl, history=history).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        got += [found.get(False, {}), {c: u for c, (_, u) in found.get(True, {}).items()}]
    return got


def test_chat_memory_lapses_and_begins_anew(spark, tmp_path, timers):
    first = [(1, t, "user", f"a{t}", 1000 * t) for t in range(8)] + [(2, 0, "user", "b", 0), (2, 1, "user", "c", 3000), (3, 0, "user", None, 6500)]
    second = [(1, 8, "user", "late", 8900), (2, 2, "user", "again", 20_000), (3, 1, None, "kept", 8400)]
    batches = [first, second, [(3, 2, "user", "new", 50_000), (2, 3, "user", "z", 50_000)]]
    assert run(spark, batches, tmp_path, 3, 2000) == plain(batches, 3, 2000)


def test_chat_memory_is_primed_from_history(spark, tmp_path, timers):
    turns = "array<struct<turn:long,role:string,text:string>>"
    kept = {1: [(0, "user", "old"), (1, "assistant", "older"), (9, "user", "later")], 5: [(0, "user", "q")]}
    history = spark.createDataFrame([(c, [dict(zip(("turn", "role", "text"), h)) for h in hs]) for c, hs in kept.items()], f"conv_id long, turns {turns}")
    batches = [[(1, 4, "user", "x", 100), (1, 5, "user", "y", 90_000), (2, 0, "user", "none", 100)]]
    got = run(spark, batches, tmp_path, 4, 1000, history)
    assert got == plain(batches, 4, 1000, kept)
    assert got[0][1][0] == [(0, "user", "old"), (1, "assistant", "older"), (5, "user", "y")]


def test_progress_is_told_every_five_points():
    told = []
    p = progress.Progress("n", 1000, told.append)
    event = lambda name, rows: type("E", (), {"progress": type("P", (), {"name": name, "numInputRows": rows})})
    for rows in (10, 30, 20, 0, 500, 439, 1):
        p.onQueryProgress(event("n", rows))
        p.onQueryProgress(event("other", 5000))
    assert told == [5, 10, 55, 94, 95] and p.done == 1000
    assert [progress.percent(d, 100) for d in (0, 50, 100)] == [5, 50, 95] and progress.percent(0, 0) == 95


def pieces(spark, path, files):
    for no in range(files):
        spark.range(no * 50, no * 50 + 50).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(path)


def test_index_job_runs_to_its_end(spark, tmp_path):
    source, told = pieces(spark, f"{tmp_path}/in", 6), []
    job = progress.IndexJob(spark, "whole", 300, told.append)
    write = lambda batch, no: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/b={no}")
    assert job.start(source, write, f"{tmp_path}/state").wait() == "ready"
    assert job.steps == told == [5, 20, 35, 50, 65, 80, 95, 100]
    assert spark.read.parquet(f"{tmp_path}/out").count() == 300 and not job.cancel()


def test_index_job_is_called_off_and_goes_on_later(spark, tmp_path):
    source = pieces(spark, f"{tmp_path}/in", 6)
    slow = F.udf(lambda i: (time.sleep(0.05), i)[1], "long")

    def write(batch, no):
        own = batch.coalesce(1).select(slow("id").alias("id")) if no else batch
        own.write.mode("overwrite").parquet(f"{tmp_path}/out/b={no}")

    job = progress.IndexJob(spark, "cut", 300).start(source, write, f"{tmp_path}/state")
    until = time.time() + 60
    while len(job.steps) < 2 and time.time() < until:
        time.sleep(0.05)
    assert job.cancel() and job.wait() == "cancelled" and not job.cancel()
    assert job.steps[:2] == [5, 20] and job.steps[-1] < 100
    written = spark.read.parquet(f"{tmp_path}/out").count()
    assert 0 < written < 300 and written % 50 == 0
    # Other jobs of the session are left alone, and a later job takes up what is left.
    assert spark.range(10).count() == 10
    rest = progress.IndexJob(spark, "rest", 300 - written)
    assert rest.start(source, lambda b, no: b.write.mode("overwrite").parquet(f"{tmp_path}/out/b={no}"), f"{tmp_path}/state").wait() == "ready"
    assert spark.read.parquet(f"{tmp_path}/out").select("id").distinct().count() == 300


def test_index_job_that_fails(spark, tmp_path):
    def write(batch, no):
        raise ValueError("broken")

    job = progress.IndexJob(spark, "bad", 50).start(pieces(spark, f"{tmp_path}/in", 1), write, f"{tmp_path}/state")
    assert job.wait() == "failed" and "broken" in str(job.error)


def test_memory_lapse_over_files_in_any_order(spark, data, tmp_path):
    """The same answer from one file and from several whose event time goes backwards: no file makes the next one late."""
    from quillspark.plans import search_queries

    turns = spark.read.parquet(f"{data}/conversations.parquet")
    ids = [r["conv_id"] for r in turns.select("conv_id").distinct().orderBy(F.desc("conv_id")).collect()]
    for part in range(3):
        turns.where(F.col("conv_id").isin(ids[part::3])).coalesce(1).write.mode("append").parquet(str(tmp_path / "conversations.parquet"))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(search_queries.stream_memory_lapse(spark, str(tmp_path))) == rows(search_queries.stream_memory_lapse(spark, data))
