"""Queries over indexes and along the whole retrieval path."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import pathway, retrieval
from quillspark.operators.lexical_index import LexicalIndex
from quillspark.operators.vector_index import VectorIndex
from quillspark.plans.common import plain, table
from quillspark.plans.retrieval_queries import BM25, RANK, WORDS, asked, chunks, every_fiftieth, vectors
from quillspark.streaming import jobs, memory

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
    return f"{base.rstrip('/')}/{kind}/{spark.range(1).select(F.uuid().alias('u')).first()['u']}"


@query(f"WITH {BM25} SELECT * FROM (SELECT qid, id, score, {RANK} AS rank FROM bm) WHERE rank <= 10")
def indexed_topk(spark, sf):
    """BM25 of every question from an index, ranges of documents that cannot reach the best ten left out."""
    index = LexicalIndex(spark, folder(spark, "lexical"))
    index.add(0, chunks(spark, sf))
    return index.search(asked(spark, sf), 10)


_KEPT = BM25.replace("FROM documents)", "FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 4 THEN reverse(text) ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3))", 1)


@query(f"WITH {_KEPT} SELECT * FROM (SELECT qid, id, score, {RANK} AS rank FROM bm) WHERE rank <= 10")
def maintained_topk(spark, sf):
    """The same from an index that a stream of three batches built: the second changes every tenth text, then every seventh document is deleted, and
    what lives is compacted."""
    at = folder(spark, "maintained")
    docs = chunks(spark, sf).select("id", "text")
    changed = F.when(F.col("id") % 10 == 4, F.reverse("text")).otherwise(F.col("text"))
    docs.where("id % 3 = 0 OR id % 10 = 4").write.parquet(f"{at}/in/0")
    docs.where("id % 3 = 1 OR id % 10 = 4").withColumn("text", changed).write.parquet(f"{at}/in/1")
    docs.where("id % 3 = 2 AND id % 10 <> 4").write.parquet(f"{at}/in/2")
    index = LexicalIndex(spark, f"{at}/index")
    for no in range(3):
        # Files come one after another, as they would from an upload folder.
        source = spark.readStream.schema("id long, text string").parquet(f"{at}/in/{no}")
        jobs.maintain(source, index, f"{at}/state/{no}", no).awaitTermination()
    index.delete(3, docs.where("id % 7 = 3"))
    index.compact()
    return index.search(asked(spark, sf), 10)


@query()
def ann_topk(spark, sf):
    """Vectors whose id is divisible by 50 against an inverted-file index of all vectors, probing as many cells as a recall of 0.95 takes."""
    index = VectorIndex.build(spark, vectors(spark, sf), folder(spark, "vectors"))
    return index.search(every_fiftieth(spark, sf), 20, recall=0.95)


# Documents as chunks of files with statements, notes, years and parents; questions that name some of them.

_CHUNKS = """c AS (SELECT doc_id AS id, 's' || doc_id % 2 AS session, coalesce(text, '') AS text, 'f' || doc_id % 24 AS file, doc_id % 5 AS page,
  CASE WHEN doc_id % 24 < 20 OR doc_id % 2 = 1 THEN 2019 + (doc_id % 24) // 4 END AS year, list_extract(['cdkt', 'kqkd', 'lctt', 'thuyet_minh', ''], (doc_id % 5 + 1)::INT) AS statement_type,
  CASE WHEN doc_id % 5 = 3 THEN (doc_id // 24) % 3 + 1 END AS note_no, CASE WHEN doc_id % 4 = 0 THEN 'p' || doc_id % 24 || '-' || doc_id // 48 END AS parent_id FROM documents)"""
_SUFFIX = ("' từ 2019 đến 2021'", "' doanh thu 2020 và 2024'", "' thuyết minh số ' || (item_id % 3 + 1) || ' năm 2022'", "' tổng tài sản năm 2021'", "' qua các năm'", "''", "' dòng tiền 2019-2024'", "' lợi nhuận 1999 và 2001'")
_QUESTIONS = f"""q AS (SELECT item_id AS qid, 's' || item_id % 2 AS session, text || CASE item_id % 8 {' '.join(f'WHEN {i} THEN {s}' for i, s in enumerate(_SUFFIX))} END AS question FROM benchmark)"""

#: What a question names, by patterns; then its attempts, the ones that count, both branches under their filters, and their fusion in turns.
_ROUTED = rf"""{_CHUNKS}, {_QUESTIONS}, known AS (SELECT list_sort(list(DISTINCT year)) AS ys FROM c WHERE year IS NOT NULL),
t AS (SELECT *, try_cast(nullif(regexp_extract(question, '(?i)thuyết minh số (\d+)', 1), '') AS BIGINT) AS note, (question LIKE '%tài sản%')::INT AS a, regexp_matches(question, 'doanh thu|lợi nhuận')::INT AS b, (question LIKE '%dòng tiền%')::INT AS d,
  list_sort(list_distinct(list_transform(regexp_extract_all(question, '(?:19|20)\d\d'), lambda y: y::BIGINT))) AS ys, regexp_extract(question, '(20\d\d)\s*(?:-|đến)\s*(20\d\d)', ['lo', 'hi']) AS span FROM q),
r AS (SELECT qid, t.session, question, note, CASE WHEN note IS NOT NULL THEN 'thuyet_minh' WHEN a + b + d <> 1 THEN '' WHEN a = 1 THEN 'cdkt' WHEN b = 1 THEN 'kqkd' ELSE 'lctt' END AS kind, t.ys[1] AS year,
  CASE WHEN span.lo <> '' THEN range(try_cast(span.lo AS BIGINT), try_cast(span.hi AS BIGINT) + 1) WHEN len(t.ys) >= 2 THEN t.ys WHEN question LIKE '%qua các năm%' THEN known.ys ELSE [] END AS periods FROM t CROSS JOIN known),
p AS (SELECT r.*, unnest(range(len(periods))) AS bucket FROM r),
tries AS (SELECT qid, session, len(periods) AS periods, bucket, 0 AS step, kind, note, periods[bucket + 1] AS year, greatest(2, 30 // len(periods) + 1) AS lim FROM p
  UNION ALL SELECT qid, session, len(periods), bucket, 1, '', NULL, periods[bucket + 1], greatest(2, 30 // len(periods) + 1) FROM p WHERE kind <> '' OR note IS NOT NULL
  UNION ALL SELECT qid, session, len(periods), -1, 0, kind, note, NULL, 30 FROM r WHERE len(periods) > 0
  UNION ALL SELECT qid, session, 0, 0, 0, kind, note, year, 30 FROM r WHERE len(periods) = 0
  UNION ALL SELECT qid, session, 0, 0, 1, kind, note, NULL, 30 FROM r WHERE len(periods) = 0 AND year IS NOT NULL AND (kind <> '' OR note IS NOT NULL)
  UNION ALL SELECT qid, session, 0, 0, 2, '', NULL, NULL, 30 FROM r WHERE len(periods) = 0),
hit AS (SELECT * FROM tries x WHERE EXISTS (SELECT 1 FROM c WHERE c.session = x.session AND (x.kind = '' OR c.statement_type = x.kind) AND (x.note IS NULL OR c.note_no = x.note) AND (x.year IS NULL OR c.year = x.year))),
s AS (SELECT * FROM (SELECT *, min(step) OVER (PARTITION BY qid, bucket) AS least, max(bucket) OVER (PARTITION BY qid) AS most FROM hit) WHERE step = least AND (bucket >= 0 OR most < 0)),
f AS (SELECT s.qid, s.bucket, s.lim, c.id FROM s JOIN c ON c.session = s.session AND (s.kind = '' OR c.statement_type = s.kind) AND (s.note IS NULL OR c.note_no = s.note) AND (s.year IS NULL OR c.year = s.year)),
w AS (SELECT id, {WORDS.format("text")} AS w FROM c), len AS (SELECT id, len(w) AS n FROM w), corpus AS (SELECT count(*) AS n, avg(n) AS mean FROM len),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM w) GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT qid, unnest(list_distinct({WORDS.format("question")})) AS term FROM q),
bm AS (SELECT qt.qid, post.id, round(sum(ln(1 + (k.n - df.df + 0.5) / (df.df + 0.5)) * post.tf * 2.2 / (post.tf + 1.2 * (0.25 + 0.75 * len.n / k.mean))), 6) AS score FROM qt JOIN post USING (term) JOIN df USING (term) JOIN len ON len.id = post.id CROSS JOIN corpus k GROUP BY qt.qid, post.id),
v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v),
cos AS (SELECT f.qid, f.bucket, f.lim, f.id, CASE WHEN b.e IS NULL THEN 0 ELSE round(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])), 6) END AS score FROM f JOIN u a ON a.id = f.qid LEFT JOIN u b ON b.id = f.id),
ranked AS (SELECT qid, bucket, lim, id, row_number() OVER (PARTITION BY qid, bucket ORDER BY score DESC, id) AS rank FROM cos
  UNION ALL SELECT qid, bucket, lim, id, row_number() OVER (PARTITION BY qid, bucket ORDER BY score DESC, id) FROM f JOIN bm USING (qid, id)),
votes AS (SELECT qid, bucket, lim, id, round(sum(1.0::DOUBLE / (1 + rank)), 6) AS score FROM ranked WHERE rank <= greatest(2 * lim, lim + 10) GROUP BY ALL),
fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, bucket ORDER BY score DESC, id) AS rank FROM votes) WHERE rank <= lim),
j AS (SELECT fu.qid, fu.bucket, fu.id, fu.score, fu.rank, s.periods, s.step, c.session, c.text, c.file, c.page, c.note_no, c.parent_id FROM fu JOIN s USING (qid, bucket) JOIN c USING (id)),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, CASE WHEN periods > 0 THEN file || '|' || page || '|' || substr(text, 1, 60) ELSE 'id' || id END ORDER BY rank, bucket) AS o FROM j) WHERE o = 1),
turns AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, bucket) AS place FROM once) WHERE place <= 30)"""


def filed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    n, own = F.col("doc_id"), table(spark, sf, "documents")
    parent = F.when(n % 4 == 0, F.concat(F.lit("p"), (n % 24).cast("string"), F.lit("-"), F.floor(n / 48).cast("string")))
    df = own.select(
        n.alias("id"), F.concat(F.lit("s"), (n % 2).cast("string")).alias("session"), F.coalesce("text", F.lit("")).alias("text"), F.concat(F.lit("f"), (n % 24).cast("string")).alias("file"), (n % 5).alias("page"),
        F.when((n % 24 < 20) | (n % 2 == 1), 2019 + F.floor(n % 24 / 4)).cast("int").alias("year"), F.element_at(F.array(*map(F.lit, ("cdkt", "kqkd", "lctt", "thuyet_minh", ""))), (n % 5 + 1).cast("int")).alias("statement_type"),
        F.when(n % 5 == 3, F.floor(n / 24) % 3 + 1).cast("int").alias("note_no"), parent.alias("parent_id"), F.repeat(F.concat(F.lit("row of "), parent, F.lit(" ")), F.lit(50)).alias("parent_text"), n.alias("ordinal"),
    )
    df = df.withColumns({"doc_name": F.concat("file", F.lit(".md")), "heading": F.lit("")}).withColumnRenamed("file", "doc_id")
    return df.join(vectors(spark, sf), "id", "left")


def filed_questions(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("item_id")
    ends = (" từ 2019 đến 2021", " doanh thu 2020 và 2024", None, " tổng tài sản năm 2021", " qua các năm", "", " dòng tiền 2019-2024", " lợi nhuận 1999 và 2001")
    note = F.concat(F.lit(" thuyết minh số "), (n % 3 + 1).cast("string"), F.lit(" năm 2022"))
    end = F.coalesce(*[F.when(n % 8 == i, note if e is None else F.lit(e)) for i, e in enumerate(ends)])
    df = table(spark, sf, "benchmark").select(n.alias("qid"), F.concat(F.lit("s"), (n % 2).cast("string")).alias("session"), F.concat("text", end).alias("question"))
    return df.join(vectors(spark, sf).withColumnRenamed("id", "qid"), "qid")


def known_years(parts: DataFrame):
    """The years of the chunks as a literal: a short list."""
    return F.array(*[F.lit(r["year"]) for r in parts.where("year IS NOT NULL").select("year").distinct().orderBy("year").collect()])


@query(f"WITH {_ROUTED} SELECT qid, bucket, step, id, score, place, periods FROM turns")
def period_fanout(spark, sf):
    """Hybrid search of every question on the way its words ask for: a search for each period with its own fallback, or a cascade of filters."""
    parts = filed_chunks(spark, sf)
    return pathway.routed(filed_questions(spark, sf), parts, known_years(parts)).select("qid", "bucket", "step", "id", "score", "place", "periods")


@query(f"""WITH {_ROUTED}, top AS (SELECT * FROM turns WHERE periods <= 1 AND place <= 8),
dom AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, first) AS o FROM (SELECT qid, session, file, note_no, count(*) AS n, min(place) AS first FROM top WHERE note_no IS NOT NULL GROUP BY ALL)) WHERE o = 1),
body AS (SELECT c.*, CASE WHEN parent_id IS NULL THEN text ELSE repeat('row of ' || parent_id || ' ', 50) END AS body FROM c),
part AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, file, note_no, coalesce(parent_id, substr(body, 1, 80)) ORDER BY id) AS o FROM body WHERE body <> '' AND note_no IS NOT NULL) WHERE o = 1),
run AS (SELECT *, coalesce(sum(len(body)) OVER (PARTITION BY session, file, note_no ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM part),
note AS (SELECT session, file, note_no, substr(string_agg(body, chr(10) || chr(10) ORDER BY id), 1, 12000) AS whole FROM run WHERE before < 12000 GROUP BY ALL),
sub AS (SELECT dom.qid, dom.file, dom.note_no, first, whole FROM dom JOIN note USING (session, file, note_no) WHERE len(whole) > 4000),
done AS (SELECT t.qid, t.id, t.place, t.text, sub.whole, sub.file IS NOT NULL AND t.file = sub.file AND t.note_no IS NOT DISTINCT FROM sub.note_no AS part, t.place = sub.first AS lead FROM top t LEFT JOIN sub USING (qid))
SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN part THEN 0 ELSE place END) AS place, part AS whole_note, md5(CASE WHEN part THEN whole ELSE text END) AS text_md5 FROM done WHERE NOT part OR lead""")
def whole_notes(spark, sf):
    """The best eight hits of each question without several periods, the note most of them come from in place of its fragments if it is long."""
    parts = filed_chunks(spark, sf)
    top = pathway.routed(filed_questions(spark, sf), parts, known_years(parts)).where("periods <= 1 AND place <= 8")
    return pathway.with_whole_notes(top, parts).select("qid", "id", "place", "whole_note", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query()
def retrieve(spark, sf):
    """The whole path, each question on its own way: route, periods, cascade, parents, diversity or width, whole notes."""
    parts = filed_chunks(spark, sf)
    return pathway.retrieve(filed_questions(spark, sf), parts, known_years(parts))


_TIMED = "epoch_ms(TIMESTAMP '2024-01-01') + conv_id * 60000 + turn * 600000 + CASE WHEN conv_id % 3 = 0 AND turn >= 2 THEN 172800000 ELSE 0 END"


@query(f"""WITH e AS (SELECT conv_id, turn, {_TIMED} AS ms FROM conversations),
g AS (SELECT *, (ms > lag(ms) OVER (PARTITION BY conv_id ORDER BY ms, turn) + 86400000)::INT AS anew FROM e),
s AS (SELECT *, coalesce(sum(anew) OVER (PARTITION BY conv_id ORDER BY ms, turn), 0) AS part FROM g),
l AS (SELECT conv_id, part, count(*) AS n, max(turn) AS last, max(ms) + 86400000 AS until FROM s GROUP BY conv_id, part QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY part DESC) = 1)
SELECT conv_id, until <= (SELECT max(ms) FROM e) AS lapsed, CASE WHEN until <= (SELECT max(ms) FROM e) THEN 0 ELSE least(n, 6) END::BIGINT AS n_turns, CASE WHEN until > (SELECT max(ms) FROM e) THEN last END AS last_turn, until AS until_ms FROM l""")
def stream_memory_lapse(spark, sf):
    """Chat memory in event time: every third conversation pauses for two days and begins anew, the others have lapsed when those are done."""
    at = folder(spark, "memory")
    memory.with_timers(spark)
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    ms = F.unix_millis(F.lit("2024-01-01 00:00:00").cast("timestamp")) + conv * 60_000 + turn * 600_000 + F.when((conv % 3 == 0) & (turn >= 2), 172_800_000).otherwise(0)
    turns = jobs.stream(spark, f"{sf}/conversations.parquet", table(spark, sf, "conversations").schema, None).select(conv.alias("conv_id"), turn.alias("turn"), "role", "text", F.timestamp_millis(ms).alias("at"))
    write = lambda batch, no: batch.write.mode("overwrite").parquet(f"{at}/out/batch_id={no}")
    memory.chat_memory(turns).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.schema(f"{memory.MEMORY}, batch_id long").parquet(f"{at}/out").groupBy("conv_id").agg(F.max_by(F.struct("turns", "until_ms", "lapsed"), F.struct("batch_id", "lapsed")).alias("m"))
    return last.select("conv_id", "m.lapsed", F.size("m.turns").alias("n_turns"), F.get("m.turns", F.size("m.turns") - 1)["turn"].alias("last_turn"), "m.until_ms")
