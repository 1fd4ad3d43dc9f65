"""The retrieval path: many questions at once, each on a way of its own.

A question's words say what it is about: a statement, a note, a year, or several periods.  From that follow its *attempts*, filtered searches of which
each stands in for the one before:

* a question about periods makes one search for each of them, with what else it names, then by the year alone; periods without any chunk are
  skipped, and if all are, one search goes without the year;
* any other question searches with all it names, then without the year, then without a filter.

Which attempt counts is found by existence, before anything is ranked: a row of ``chosen`` is one search.  Every search is hybrid, in both branches
under its own filter and with its own limit.  Searches of periods are taken in turns.  Then, question by question: the gate, parents in
place of their fragments, the k first for several periods (``min(max(k, 2 * periods), candidates)``) or k by marginal relevance for others,
and, for those others, the whole note in place of its fragments where most hits come from one note that is longer than a parent may be.

All of it is joins and windows keyed by question; only marginal relevance is a Python function of one question's candidates.

questions: qid, session, question, vector.  chunks: id, session, text, vector, doc_id, doc_name, page, heading, year, statement_type, note_no,
parent_id, parent_text, ordinal.  Empty strings and nulls mean no statement, note, year or parent.  Null and empty texts are never the text of a note; a
null or blank question finds nothing.  Ids of chunks are distinct.  Ties go by id.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import retrieval, sections

#: Characters of a parent that are shown; a note must be longer to take the place of its fragments.
PARENT = 4000
#: Characters of a whole note.
NOTE = 12_000
FILTERS = ("statement_type", "note_no", "year")
SHOWN = ("doc_id", "doc_name", "page", "heading", "note_no")


def attempts(questions: DataFrame, known: Column, candidates: int) -> DataFrame:
    """questions to (qid, session, periods, bucket, step, statement_type, note_no, year, limit): all searches that each may come to.  Buckets from 0 are
    periods in order, or the one search of a question without any; -1 is the last resort of a question about periods."""
    asked = questions.where(F.trim("question") != "").select("qid", "session", "question")
    routed = sections.with_route(asked).withColumn("span", sections.periods(F.col("question"), known))
    routed = routed.withColumn("periods", F.size("span"))
    named = (F.col("statement_type") != "") | F.col("note_no").isNotNull()
    none = F.lit(None).cast("int")

    def attempt(bucket, step, with_name: bool, year, needed, limit) -> Column:
        kind, note = (F.col("statement_type"), F.col("note_no")) if with_name else (F.lit(""), none)
        return F.struct(bucket.cast("int").alias("bucket"), F.lit(step).alias("step"), kind.alias("statement_type"), note.alias("note_no"), year.cast("int").alias("year"), needed.alias("needed"), limit.cast("int").alias("limit"))

    yes, every = F.lit(True), F.lit(candidates)
    share = F.greatest(F.lit(2), F.floor(F.lit(candidates) / F.col("periods")) + 1)
    of_period = lambda y, i: F.array(attempt(i, 0, True, y, yes, share), attempt(i, 1, False, y, named, share))
    spanning = F.concat(F.flatten(F.transform("span", of_period)), F.array(attempt(F.lit(-1), 0, True, none, yes, every)))
    single = F.array(attempt(F.lit(0), 0, True, F.col("year"), yes, every), attempt(F.lit(0), 1, True, none, named & F.col("year").isNotNull(), every), attempt(F.lit(0), 2, False, none, yes, every))
    rows = routed.select("qid", "session", "periods", F.explode(F.when(F.col("periods") > 0, spanning).otherwise(single)).alias("a"))
    return rows.select("qid", "session", "periods", "a.*").where("needed").drop("needed")


def chosen(tried: DataFrame, chunks: DataFrame) -> DataFrame:
    """The attempts that count: in each bucket the first that some chunk of the session passes; last resorts only of questions without another."""
    tags = chunks.select("session", F.coalesce("statement_type", F.lit("")).alias("statement_type"), "note_no", "year").distinct()
    # Every filter that a tag passes: each part of it named or not.
    part = lambda c: F.explode(F.array(F.struct(F.lit(True).alias("any"), F.lit(None).cast(tags.schema[c].dataType).alias("value")), F.struct(F.lit(False).alias("any"), F.col(c).alias("value")))).alias(f"f_{c}")
    passed = tags
    for c in FILTERS:
        passed = passed.select("*", part(c))
    blank = {"statement_type": F.lit(""), "note_no": F.lit(-1), "year": F.lit(-1)}
    keys = {c: F.when(F.col(f"f_{c}")["any"], blank[c]).otherwise(F.col(f"f_{c}")["value"]).alias(c) for c in FILTERS}
    passed = passed.select("session", *keys.values()).dropna().distinct()
    filled = tried.select("*", *[F.coalesce(F.col(c), blank[c]).alias(f"k_{c}") for c in FILTERS])
    there = filled.join(passed.select("session", *[F.col(c).alias(f"k_{c}") for c in FILTERS]), ["session", *[f"k_{c}" for c in FILTERS]], "left_semi").select(tried.columns)
    first = there.withColumn("least", F.min("step").over(Window.partitionBy("qid", "bucket"))).where("step = least").drop("least")
    return first.withColumn("most", F.max("bucket").over(Window.partitionBy("qid"))).where("bucket >= 0 OR most < 0").drop("most")


def lexical(searches: DataFrame, questions: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """(qid, bucket, id, score, rank, limit): BM25 under each search's filter, as many as its branch takes; ``most`` is the largest limit."""
    asked = searches.join(questions.select("qid", "question"), "qid").select(F.struct("qid", "bucket", "limit").alias("search"), "question", "session", *FILTERS)
    asked = asked.withColumn("statement_type", F.nullif("statement_type", F.lit("")))
    found = retrieval.bm25_top_k(asked.withColumnRenamed("search", "qid"), chunks, retrieval.branch_limit(most), ("session", *FILTERS))
    return _branch(found.select("qid.qid", "qid.bucket", "id", "score", "qid.limit"))


def dense(searches: DataFrame, questions: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """The same by cosine; ``most`` is the largest limit."""
    asked = searches.join(questions.select("qid", "vector"), "qid").select(F.struct("qid", "bucket", "limit").alias("search"), "vector", "session", *FILTERS)
    asked = asked.withColumn("statement_type", F.nullif("statement_type", F.lit("")))
    found = retrieval.dense_top_k(asked.withColumn("qid", F.struct("search.*")), chunks, retrieval.branch_limit(most), ("session", *FILTERS))
    return _branch(found.select("qid.qid", "qid.bucket", "id", "score", "qid.limit"))


def _branch(scored: DataFrame) -> DataFrame:
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "bucket").orderBy(F.col("score").desc(), "id")))
    return ranked.where(F.col("rank") <= F.greatest(F.col("limit") * 2, F.col("limit") + 10))


def fused(branches: list[DataFrame], k: int = 2) -> DataFrame:
    """(qid, bucket, id, score, rank): reciprocal ranks of the branches added up, as many as each search's limit."""
    votes = branches[0]
    for other in branches[1:]:
        votes = votes.unionByName(other)
    total = votes.groupBy("qid", "bucket", "id", "limit").agg(F.round(F.sum(1.0 / (k + F.col("rank") - 1)), retrieval.DIGITS).alias("score"))
    ranked = total.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "bucket").orderBy(F.col("score").desc(), "id")))
    return ranked.where(F.col("rank") <= F.col("limit")).drop("limit")


def in_turns(found: DataFrame, candidates: int) -> DataFrame:
    """found (qid, bucket, id, score, rank, periods, doc_id, page, text) with ``place``: searches in turns by rank.  What repeats document, page and the first 60 characters in a
    question about periods goes, and what is beyond ``candidates``."""
    spans = F.col("periods") > 0
    same = Window.partitionBy("qid", F.when(spans, F.struct("doc_id", "page", F.substring("text", 1, 60))), F.when(~spans, F.struct("bucket", "id"))).orderBy("rank", "bucket")
    first = found.withColumn("o", F.row_number().over(same)).where("o = 1").drop("o")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "bucket"))
    return first.withColumn("place", place).where(F.col("place") <= candidates)


def parents(hits: DataFrame) -> DataFrame:
    """hits in order of ``place``: the first of each parent stays and shows the parent's text; places close up."""
    has = F.coalesce("parent_id", F.lit("")) != ""
    own = Window.partitionBy("qid", F.when(has, F.col("parent_id")), F.when(~has, F.col("id"))).orderBy("place")
    shown = F.when(has, F.substring(F.coalesce(F.nullif("parent_text", F.lit("")), "text"), 1, PARENT)).otherwise(F.col("text"))
    kept = hits.withColumn("o", F.row_number().over(own)).where("o = 1").drop("o").withColumn("text", shown)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("place")))


def width(k: int, periods: Column, candidates: int) -> Column:
    """How many hits a question about several periods keeps."""
    return F.least(F.greatest(F.lit(k), 2 * periods), F.lit(candidates))


def notes(chunks: DataFrame, wanted: DataFrame, budget: int = NOTE) -> DataFrame:
    """wanted (session, doc_id, note_no) with ``whole``: the text of each note in document order, a parent once in place of its fragments, no further than
    the part that reaches the budget, and cut to it."""
    keys = ["session", "doc_id", "note_no"]
    body = F.coalesce(F.nullif("parent_text", F.lit("")), "text")
    rows = chunks.join(wanted.select(keys).distinct(), keys).select(*keys, "id", "ordinal", body.alias("body"), F.coalesce(F.nullif("parent_id", F.lit("")), F.substring(body, 1, 80)).alias("key"))
    rows = rows.where(F.col("body") != "")
    order = [F.coalesce("ordinal", F.lit(0)), F.col("id")]
    once = rows.withColumn("o", F.row_number().over(Window.partitionBy(*keys, "key").orderBy(*order))).where("o = 1")
    placed = once.select(*keys, "body", order[0].alias("ordinal"), "id")
    kept = retrieval.within_budget(placed, keys, ["ordinal", "id"], F.length("body"), budget)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id", "body"))), lambda p: p["body"])
    return kept.groupBy(*keys).agg(F.substring(F.array_join(parts, "\n\n"), 1, budget).alias("whole"))


def with_whole_notes(hits: DataFrame, chunks: DataFrame, least: int = PARENT) -> DataFrame:
    """hits (qid, session, place, id, text, doc_id, note_no, ...), the note that most hits of a question come from (the first such on a tie) in place of its
    fragments, where it is longer than ``least``: it comes first, as what its first fragment was, then the others in order."""
    noted = hits.where(F.col("note_no").isNotNull() & (F.coalesce(F.col("doc_id").cast("string"), F.lit("")) != ""))
    counted = noted.groupBy("qid", "session", "doc_id", "note_no").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    best = counted.withColumn("o", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("n").desc(), "first"))).where("o = 1")
    found = best.join(notes(chunks, best), ["session", "doc_id", "note_no"]).where(F.length("whole") > least)
    found = found.select("qid", F.col("doc_id").alias("n_doc"), F.col("note_no").alias("n_no"), "first", "whole")
    df = hits.join(found, "qid", "left")
    part = F.coalesce((F.col("doc_id") == F.col("n_doc")) & (F.col("note_no") == F.col("n_no")), F.lit(False))
    stands = part & (F.col("place") == F.col("first"))
    df = df.where(~part | stands).withColumns({"text": F.when(stands, F.col("whole")).otherwise(F.col("text")), "whole_note": stands, "place": F.when(stands, 0).otherwise(F.col("place"))})
    return df.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("place"))).drop("n_doc", "n_no", "first", "whole")


def routed(questions: DataFrame, chunks: DataFrame, known: Column, candidates: int = 30) -> DataFrame:
    """The hits of every question in order: (qid, session, periods, bucket, step, place, id, score) and the columns of the chunk."""
    searches = chosen(attempts(questions, known, candidates), chunks)
    found = fused([lexical(searches, questions, chunks, candidates), dense(searches, questions, chunks, candidates)])
    found = found.join(searches.select("qid", "session", "periods", "bucket", "step"), ["qid", "bucket"]).join(chunks.drop("session"), "id")
    return in_turns(found, candidates)


def retrieve(questions: DataFrame, chunks: DataFrame, known: Column, k: int = 8, candidates: int = 30, threshold: float = 0.0, weight: float = 0.6, whole_notes: bool = True) -> DataFrame:
    """questions to (qid, rank, id, text, doc_id, doc_name, page, heading, note_no, score, periods, whole_note)."""
    hits = routed(questions, chunks, known, candidates)
    if threshold > 0:
        hits = retrieval.gate(hits, threshold)
    hits = parents(hits)
    multi = F.col("periods") > 1
    wide = hits.where(multi).where(F.col("place") <= width(k, F.col("periods"), candidates))
    picked = retrieval.mmr(hits.where(~multi).select("qid", "id", F.col("place").alias("rank"), "score", "vector"), k, weight).select("qid", "id", F.col("place").alias("picked"))
    narrow = hits.where(~multi).join(picked, ["qid", "id"]).withColumn("place", F.col("picked").cast("int")).drop("picked")
    narrow = with_whole_notes(narrow, chunks) if whole_notes else narrow.withColumn("whole_note", F.lit(False))
    shown = wide.withColumn("whole_note", F.lit(False)).unionByName(narrow)
    return shown.select("qid", F.col("place").alias("rank"), "id", "text", *SHOWN, F.round("score", 4).alias("score"), "periods", "whole_note")
