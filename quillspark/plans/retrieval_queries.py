"""Queries over documents, questions and vectors."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import metrics, numbers, text
from quillspark.operators import chunking, retrieval, sections, sessions, tables
from quillspark.plans.common import plain, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def bm25(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """The k best documents of every question."""
    return retrieval.bm25_top_k(asked(spark, sf), chunks(spark, sf), k)


WORDS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+')"
BM25 = rf"""d AS (SELECT doc_id AS id, {WORDS.format("text")} AS w FROM documents),
len AS (SELECT id, len(w) AS n FROM d),
corpus AS (SELECT count(*) AS n, avg(n) AS mean FROM len),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM d) GROUP BY id, term),
q AS (SELECT item_id AS qid, unnest(list_distinct({WORDS.format("text")})) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (SELECT q.qid, p.id, round(sum(ln(1 + (c.n - df.df + 0.5) / (df.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.n / c.mean))), 6) AS score
  FROM q JOIN post p USING (term) JOIN df USING (term) JOIN len l ON l.id = p.id CROSS JOIN corpus c GROUP BY q.qid, p.id)"""
RANK = "row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)"


@query(f"WITH {BM25} SELECT * FROM (SELECT qid, id, score, {RANK} AS rank FROM bm) WHERE rank <= 10")
def bm25_topk(spark, sf):
    """BM25 of every question over all documents."""
    return bm25(spark, sf, 10)


UNIT = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v)"
COS = "round(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])), 6)"


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def every_fiftieth(spark, sf):
    return vectors(spark, sf).where("id % 50 = 0").select(F.col("id").alias("qid"), "vector")


@query(f"WITH {UNIT}, s AS (SELECT a.id AS qid, b.id, {COS} AS score FROM u a CROSS JOIN u b WHERE a.id % 50 = 0) SELECT * FROM (SELECT qid, id, score, {RANK} AS rank FROM s) WHERE rank <= 20")
def dense_topk(spark, sf):
    """Exact cosine search: every vector whose id is divisible by 50 against all."""
    return retrieval.dense_top_k(every_fiftieth(spark, sf), vectors(spark, sf), 20)


HYBRID = f"""{UNIT}, {BM25},
dense AS (SELECT * FROM (SELECT qid, id, {RANK} AS rank FROM (SELECT i.item_id AS qid, b.id, {COS} AS score FROM benchmark i JOIN u a ON a.id = i.item_id CROSS JOIN u b)) WHERE rank <= 20),
sparse AS (SELECT * FROM (SELECT qid, id, {RANK} AS rank FROM bm) WHERE rank <= 20),
fused AS (SELECT qid, id, round(sum(1.0::DOUBLE / (2 + rank - 1)), 6) AS score FROM (SELECT * FROM dense UNION ALL SELECT * FROM sparse) GROUP BY qid, id)"""


def hybrid(spark, sf, limit: int = 10) -> DataFrame:
    """Question i has the vector i, document i the vector i."""
    own = asked(spark, sf).join(vectors(spark, sf).withColumnRenamed("id", "qid"), "qid").select("qid", "vector")
    n = retrieval.branch_limit(limit)
    return retrieval.rrf([retrieval.dense_top_k(own, vectors(spark, sf), n), bm25(spark, sf, n)], limit)


@query(f"WITH {HYBRID} SELECT * FROM (SELECT qid, id, score, {RANK} AS rank FROM fused) WHERE rank <= 10")
def hybrid_rrf(spark, sf):
    """Both branches fused by reciprocal ranks."""
    return hybrid(spark, sf)


@query(f"WITH {BM25} SELECT * FROM (SELECT qid, id, score, {RANK} AS rank FROM bm JOIN documents ON doc_id = id WHERE lang = 'en' AND source = 'src0') WHERE rank <= 10")
def filtered_search(spark, sf):
    """A filter applied before the ranking."""
    wanted = asked(spark, sf).withColumns({"lang": F.lit("en"), "source": F.lit("src0")})
    return retrieval.bm25_top_k(wanted, chunks(spark, sf), 10, ("lang", "source"))


HINTS = "SELECT item_id AS qid, list_extract(['en', 'fr', 'de', 'es', 'xx'], (item_id % 5 + 1)::INT) AS lang, 'src' || (item_id % 25) AS source FROM benchmark"


@query(f"""WITH {BM25}, h AS ({HINTS}),
lv AS (SELECT h.*, CASE WHEN EXISTS (SELECT 1 FROM documents x WHERE x.lang = h.lang AND x.source = h.source) THEN 0 WHEN EXISTS (SELECT 1 FROM documents x WHERE x.source = h.source) THEN 1 ELSE 2 END AS level FROM h),
s AS (SELECT bm.qid, bm.id, bm.score, lv.level FROM bm JOIN lv USING (qid) JOIN documents c ON c.doc_id = bm.id WHERE level = 2 OR (level = 1 AND c.source = lv.source) OR (level = 0 AND c.source = lv.source AND c.lang = lv.lang))
SELECT qid, id, score, level::BIGINT AS level, rank FROM (SELECT *, {RANK} AS rank FROM s) WHERE rank <= 10""")
def fallback_cascade(spark, sf):
    """Language and source, else source, else all: the strictest filter that some document passes."""
    hints = asked(spark, sf).select("qid", F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es", "xx")]), (F.col("qid") % 5 + 1).cast("int")).alias("lang"), F.concat(F.lit("src"), (F.col("qid") % 25).cast("string")).alias("source"))
    levels = [["lang", "source"], ["source"]]
    levelled = retrieval.strictest_level(hints, chunks(spark, sf), levels)
    # A filter that the level leaves out is null.
    free = levelled.select("qid", "level", F.when(F.col("level") == 0, F.col("lang")).alias("lang"), F.when(F.col("level") < 2, F.col("source")).alias("source"))
    found = retrieval.bm25_top_k(asked(spark, sf).join(free, "qid"), chunks(spark, sf), 10, ("lang", "source"))
    return found.join(free.select("qid", "level"), "qid").select("qid", "id", "score", "level", "rank")


@query(f"""WITH {BM25}, s AS (SELECT bm.qid, bm.id, bm.score, c.lang FROM bm JOIN documents c ON c.doc_id = bm.id),
n AS (SELECT qid, count(DISTINCT lang) AS buckets FROM s GROUP BY qid),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, lang ORDER BY score DESC, id) AS rk FROM s),
k AS (SELECT r.* FROM r JOIN n USING (qid) WHERE rk <= greatest(2, 12 // buckets + 1)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY rk, lang) AS once FROM k) WHERE once = 1)
SELECT qid, id, lang, score, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rk, lang, id) AS place FROM f) WHERE place <= 12""")
def fanout_interleave(spark, sf):
    """The best of each language in turns."""
    return retrieval.fan_out(retrieval.bm25_top_k(asked(spark, sf), chunks(spark, sf), 13, bucket="lang"), "lang", 12)


LINES = "l_suppkey AS qid, l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS id, l_extendedprice AS score"
HITS = f"h AS (SELECT * FROM (SELECT {LINES}, l_orderkey AS parent, l_quantity::BIGINT AS quantity, row_number() OVER (PARTITION BY l_suppkey, l_orderkey, l_linenumber, l_partkey ORDER BY l_extendedprice) AS once, count(*) OVER (PARTITION BY l_suppkey, l_orderkey, l_linenumber, l_partkey) AS times FROM lineitem) WHERE times = 1)"


def single_hits(spark, sf):
    """Hits whose key is unique."""
    line = table(spark, sf, "lineitem")
    own = Window.partitionBy("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    return line.withColumn("times", F.count("*").over(own)).where("times = 1").select(F.col("l_suppkey").alias("qid"), (F.col("l_orderkey") * 10000000 + F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("id"), F.col("l_extendedprice").alias("score"), F.col("l_orderkey").alias("parent"), F.col("l_quantity").cast("long").alias("quantity"))


@query(f"WITH {HITS} SELECT qid, id, score, 'order ' || parent AS text FROM (SELECT *, row_number() OVER (PARTITION BY qid, parent ORDER BY score DESC, id) AS n FROM h) WHERE n = 1")
def parent_collapse(spark, sf):
    """The best line of each order stands for the order and shows its text."""
    df = single_hits(spark, sf).select("qid", "id", "score", F.col("parent").cast("string").alias("parent_id"), F.concat(F.lit("order "), F.col("parent").cast("string")).alias("parent_text"), F.col("id").cast("string").alias("text"))
    return retrieval.collapse_parents(df).select("qid", "id", "score", "text")


@query(f"""WITH {HITS}, t AS (SELECT * FROM (SELECT *, {RANK} AS rank FROM h) WHERE rank <= 8),
g AS (SELECT qid, parent FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, first, parent) AS o FROM (SELECT qid, parent, count(*) AS n, min(rank) AS first FROM t GROUP BY qid, parent)) WHERE o = 1),
e AS (SELECT g.qid, g.parent, h.id, h.quantity, CAST(coalesce(sum(h.quantity) OVER (PARTITION BY g.qid ORDER BY h.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM g JOIN h ON h.parent = g.parent)
SELECT qid, parent, id, before, least(quantity, 60 - before) AS cut FROM e WHERE before < 60""")
def dominant_group_expand(spark, sf):
    """The order that most of a supplier's best lines belong to, with all its lines up to a budget."""
    all_hits = single_hits(spark, sf)
    group = retrieval.dominant_group(retrieval.top_k(all_hits, 8), "parent")
    lines = all_hits.select("parent", "id", "quantity").join(group, "parent")
    return retrieval.within_budget(lines, ["qid"], ["id"], F.col("quantity"), 60).select("qid", "parent", "id", "before", F.col("cut").cast("long").alias("cut"))


@query(f"WITH {BM25}, t AS (SELECT *, {RANK} AS rank, max(score) OVER (PARTITION BY qid) AS best FROM bm) SELECT qid, id, score, rank, best FROM t WHERE rank <= 5 AND best >= 60")
def score_gate(spark, sf):
    """Nothing for questions whose best score is too low."""
    return retrieval.gate(bm25(spark, sf, 5), 60.0)


@query()
def mmr_select(spark, sf):
    """Eight of twenty candidates by maximal marginal relevance."""
    found = retrieval.dense_top_k(every_fiftieth(spark, sf), vectors(spark, sf), 20)
    return retrieval.mmr(found.join(vectors(spark, sf), "id"), 8)


@query()
def hybrid_context(spark, sf):
    """Hybrid candidates, one per source and language as parent, diversity, prompt context."""
    found = hybrid(spark, sf, 30).join(chunks(spark, sf), "id")
    parents = found.withColumns({"parent_id": F.concat_ws("/", "source", "lang"), "parent_text": F.lit("")})
    kept = retrieval.collapse_parents(parents)
    ranked = retrieval.top_k(kept.drop("rank"), 20)
    chosen = retrieval.mmr(ranked.join(vectors(spark, sf), "id").select("qid", "id", "rank", "score", "vector"), 8)
    return retrieval.context(chosen.join(kept.select("qid", "id", "text", "source"), ["qid", "id"]).select("qid", F.col("place").alias("rank"), "source", "text"))


@query(f"WITH {BM25}, t AS (SELECT * FROM (SELECT *, {RANK} AS rank FROM bm) WHERE rank <= 3) SELECT qid, string_agg('[' || rank || '] (source: ' || source || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM t JOIN documents ON doc_id = id GROUP BY qid")
def context_assembly(spark, sf):
    """Prompt contexts of the best three documents."""
    return retrieval.context(bm25(spark, sf, 3).join(chunks(spark, sf), "id"))


RELEVANT = "rel AS (SELECT DISTINCT i.item_id AS qid, l.doc_id AS id FROM benchmark i JOIN documents c ON c.source = 'src' || (i.item_id % 20) JOIN labels l ON l.doc_id = c.doc_id AND l.quality = 1)"
_K = ", ".join(f"h{k} / n AS recall_{k}, CASE WHEN depth > 0 THEN h{k} / least(depth, {k}) ELSE 0 END AS precision_{k}, (h{k} > 0)::BIGINT AS hit_{k}, round(g{k} / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, {k})::BIGINT + 1) t(i)), 6) AS ndcg_{k}" for k in (1, 3, 5, 8))
_H = ", ".join(f"count(*) FILTER (r.rank <= {k} AND rel.id IS NOT NULL) AS h{k}, coalesce(sum(1 / log2(r.rank + 1)) FILTER (r.rank <= {k} AND rel.id IS NOT NULL), 0) AS g{k}" for k in (1, 3, 5, 8))
IR = rf"""{BM25}, {RELEVANT}, top AS (SELECT * FROM (SELECT *, {RANK} AS rank FROM bm) WHERE rank <= 50),
n AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid),
hit AS (SELECT top.qid, top.rank, row_number() OVER (PARTITION BY top.qid ORDER BY top.rank) AS so_far FROM top JOIN rel ON rel.qid = top.qid AND rel.id = top.id),
p AS (SELECT qid, min(rank) AS first, sum(so_far / rank) AS precisions FROM hit GROUP BY qid),
k AS (SELECT r.qid, max(r.rank) AS depth, {_H} FROM top r LEFT JOIN rel ON rel.qid = r.qid AND rel.id = r.id GROUP BY r.qid),
ir AS (SELECT n.qid, {_K}, coalesce(1 / first, 0) AS mrr, coalesce(precisions, 0) / n AS ap FROM n JOIN k USING (qid) LEFT JOIN p USING (qid))"""
IR_COLUMNS = [f"{m}_{k}" for k in (1, 3, 5, 8) for m in ("recall", "precision", "hit", "ndcg")]


def ir(spark, sf) -> DataFrame:
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    relevant = asked(spark, sf).select("qid", F.concat(F.lit("src"), (F.col("qid") % 20).cast("string")).alias("source")).join(good, "source").select("qid", F.col("doc_id").alias("id"))
    return metrics.ranking_metrics(bm25(spark, sf, 50), relevant)


@query(f"WITH {IR} SELECT qid, " + ", ".join(c if c.startswith("hit") else f"round({c}, 6) AS {c}" for c in IR_COLUMNS) + ", round(mrr, 6) AS mrr, round(ap, 6) AS ap FROM ir")
def ir_metrics_at_k(spark, sf):
    """Recall, precision, hits and nDCG at 1, 3, 5 and 8, reciprocal rank and average precision."""
    return ir(spark, sf).select("qid", *[F.col(c) if c.startswith("hit") else F.round(c, 6).alias(c) for c in IR_COLUMNS], F.round("mrr", 6).alias("mrr"), F.round("ap", 6).alias("ap"))


@query(f"WITH {IR}, t AS (SELECT 'kind' || (qid % 4) AS answer_type, CASE WHEN qid % 4 <> 3 THEN mrr END AS mrr, recall_8 FROM ir) SELECT answer_type, count(*) AS n, round(avg(mrr), 6) AS mrr, round(avg(recall_8), 6) AS recall_8 FROM t GROUP BY GROUPING SETS ((answer_type), ())")
def metric_rollup(spark, sf):
    """Means by answer type and overall; metrics that do not apply are null and count nowhere."""
    df = ir(spark, sf).withColumn("answer_type", F.concat(F.lit("kind"), (F.col("qid") % 4).cast("string"))).withColumn("mrr", F.when(F.col("qid") % 4 != 3, F.col("mrr")))
    return df.groupingSets([["answer_type"], []], "answer_type").agg(F.count("*").alias("n"), F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("recall_8"), 6).alias("recall_8"))


def turn_pairs(spark, sf) -> DataFrame:
    """Each turn with the next one of its conversation."""
    turns = table(spark, sf, "conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return turns.select("conv_id", "turn", F.col("text").alias("a")).join(following, ["conv_id", "turn"])


PAIRS = "p AS (SELECT a.conv_id, a.turn, a.text AS a, b.text AS b FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"
BAGS = f"""{PAIRS}, x AS (SELECT conv_id, turn, word, count(*) AS n FROM (SELECT conv_id, turn, unnest({WORDS.format("a")}) AS word FROM p) GROUP BY ALL),
y AS (SELECT conv_id, turn, word, count(*) AS n FROM (SELECT conv_id, turn, unnest({WORDS.format("b")}) AS word FROM p) GROUP BY ALL),
s AS (SELECT conv_id, turn, CAST(sum(least(x.n, y.n)) AS BIGINT) AS shared FROM x JOIN y USING (conv_id, turn, word) GROUP BY conv_id, turn)"""


@query(f"WITH {BAGS} SELECT conv_id, turn, coalesce(shared, 0) AS shared, coalesce(round(CASE WHEN shared > 0 THEN 2 * shared / (len({WORDS.format('a')}) + len({WORDS.format('b')})) END, 6), 0) AS f1 FROM p LEFT JOIN s USING (conv_id, turn)")
def token_f1(spark, sf):
    """Token F1 of each turn and the next."""
    return metrics.overlap_f1(turn_pairs(spark, sf), ["conv_id", "turn"], "a", "b", "f1").withColumn("f1", F.round("f1", 6))


@query(f"WITH {BAGS} SELECT conv_id, turn, shared FROM s")
def multiset_intersect(spark, sf):
    """Words that both of two turns hold, counted as often as both hold them, from arrays alone."""
    a, b = metrics.bag(text.tokens(F.col("a"))), metrics.bag(text.tokens(F.col("b")))
    return turn_pairs(spark, sf).select("conv_id", "turn", a.alias("a"), b.alias("b")).select("conv_id", "turn", F.size(F.array_intersect("a", "b")).alias("shared")).where("shared > 0")


@query()
def rouge_l(spark, sf):
    """Longest common subsequence F1 of each turn and the next."""
    return turn_pairs(spark, sf).select("conv_id", "turn", F.round(metrics.rouge_l(text.tokens(F.col("a")), text.tokens(F.col("b"))), 6).alias("rouge_l"))


@query()
def word_error_rate(spark, sf):
    """Edit distance in words of each turn to the next, as a share of its words."""
    a, b = text.tokens(F.col("a")), text.tokens(F.col("b"))
    return turn_pairs(spark, sf).select("conv_id", "turn", metrics.token_distance(a, b).alias("distance"), F.round(metrics.token_distance(a, b) / F.greatest(F.size(b), F.lit(1)), 6).alias("wer"))


@query("SELECT p_partkey, levenshtein(p_name, p_type)::BIGINT AS distance, round(levenshtein(p_name, p_type) / greatest(length(p_type), 1), 6) AS cer, round(greatest(0, 1 - levenshtein(p_name, p_type) / greatest(length(p_type), 1)), 6) AS char_accuracy FROM part")
def cer_char_accuracy(spark, sf):
    """Character error rate and accuracy of one short text against another."""
    d = F.levenshtein("p_name", "p_type")
    rate = d / F.greatest(F.length("p_type"), F.lit(1))
    return table(spark, sf, "part").select("p_partkey", d.alias("distance"), F.round(rate, 6).alias("cer"), F.round(F.greatest(F.lit(0.0), 1 - rate), 6).alias("char_accuracy"))


_MARKS = " OR ".join("contains(lower(text), '" + m.replace("'", "''") + "')" for m in text.REFUSALS)


@query(f"SELECT conv_id, turn, ({_MARKS})::BIGINT AS refused FROM conversations WHERE role = 'assistant'")
def abstention_flag(spark, sf):
    """Answers that refuse."""
    return table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", text.is_refusal(F.col("text")).cast("long").alias("refused"))


_CANON = r"""CASE WHEN regexp_matches(t, '^[\d.]*\d[\d.]*,\d{0,2}$') THEN regexp_replace(replace(split_part(t, ',', 1), '.', ''), '^0+(.)', '\1') || CASE WHEN rtrim(split_part(t, ',', 2), '0') <> '' THEN '.' || rtrim(split_part(t, ',', 2), '0') ELSE '' END
WHEN regexp_matches(replace(replace(t, '.', ''), ',', ''), '^\d+$') THEN regexp_replace(replace(replace(t, '.', ''), ',', ''), '^0+(.)', '\1') END"""
NUMBERS = rf"""f AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '\d[\d.,]*\d|\d')) AS m FROM documents),
c AS (SELECT DISTINCT doc_id, {_CANON} AS n FROM (SELECT doc_id, trim(m, '().%') AS t FROM f)),
g AS (SELECT doc_id, list_sort(list(n)) AS numbers FROM c WHERE n IS NOT NULL GROUP BY doc_id)"""


@query(f"WITH {NUMBERS} SELECT doc_id, coalesce(len(numbers), 0) AS n_numbers, coalesce(array_to_string(numbers, ' '), '') AS numbers FROM documents LEFT JOIN g USING (doc_id)")
def extract_numbers(spark, sf):
    """Distinct numbers of every document in canonical form."""
    found = numbers.numbers_in(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", found.alias("found")).select("doc_id", F.size("found").alias("n_numbers"), F.array_join("found", " ").alias("numbers"))


@query(f"WITH {NUMBERS}, w AS (SELECT doc_id, list_distinct([(doc_id % 1000)::VARCHAR, '0', '20']) AS want FROM documents) SELECT doc_id, round(len(list_intersect(want, coalesce(numbers, []))) / len(want), 6) AS recall FROM w LEFT JOIN g USING (doc_id)")
def context_number_recall(spark, sf):
    """Share of gold numbers that a text holds."""
    gold = F.array((F.col("doc_id") % 1000).cast("string"), F.lit("0"), F.lit("20"))
    return table(spark, sf, "documents").select("doc_id", F.round(metrics.number_recall(F.col("text"), gold), 6).alias("recall"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS body FROM pages")
def html_strip_text(spark, sf):
    """Pages without tags."""
    return table(spark, sf, "pages").select("page_id", text.strip_html(F.col("html")).alias("body"))


@query(r"SELECT page_id, (len(html) - len(replace(html, '<table', ''))) // 6 + (len(html) - len(replace(html, '|---', ''))) // 4 AS n_tables, len(html) AS n_chars FROM pages")
def page_counts(spark, sf):
    """Characters and table marks of pages."""
    count = lambda mark: (F.length("html") - F.length(F.replace("html", F.lit(mark), F.lit("")))) / len(mark)
    return table(spark, sf, "pages").select("page_id", (count("<table") + count("|---")).cast("long").alias("n_tables"), F.length("html").alias("n_chars"))


@query("SELECT r_regionkey, 0::BIGINT AS row_idx, 0::BIGINT AS col, 'key' AS cell FROM region UNION ALL SELECT r_regionkey, 0, 1, 'name' FROM region UNION ALL SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 0, n_nationkey::VARCHAR FROM nation UNION ALL SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 1, n_name FROM nation")
def html_table_grid(spark, sf):
    """HTML tables, one a region, parsed back into cells."""
    row = F.concat(F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td> "), F.col("n_name"), F.lit("</td></tr>"))
    html = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.concat(F.lit("<p>x</p><table><tr><th>key</th><th>name</th></tr>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))), lambda s: s["row"]), ""), F.lit("</table>")).alias("html"))
    cells = html.select("r_regionkey", F.posexplode(tables.html_grids(F.col("html"))[0]).alias("row_idx", "cells"))
    return cells.select("r_regionkey", "row_idx", F.posexplode("cells").alias("col", "cell"))


def doc_lines(spark, sf) -> DataFrame:
    return chunking.lines_of(table(spark, sf, "documents"))


ALL_LINES = "l AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS line_no, unnest(w) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents))"


@query(rf"""WITH {ALL_LINES}, k AS (SELECT *, CASE WHEN trim(line) LIKE '|%' AND len(line) - len(replace(line, '|', '')) >= 2 THEN 'table' ELSE 'text' END AS kind FROM l),
c AS (SELECT *, last_value(CASE WHEN kind = 'text' AND trim(line) <> '' THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS caption, (kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no))::INT AS new FROM k),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM c)
SELECT doc_id, CAST(run AS BIGINT) AS run, kind, count(*) AS n_lines, max_by(caption, line_no) AS caption FROM r GROUP BY doc_id, run, kind""")
def line_carry_forward(spark, sf):
    """Runs of table and text lines, with the caption carried forward."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    kind = F.when(text.is_table_line(F.col("line")), "table").otherwise("text")
    df = doc_lines(spark, sf).withColumn("kind", kind)
    df = df.withColumn("caption", F.last(F.when((F.col("kind") == "text") & (F.trim("line") != ""), F.trim("line")), ignorenulls=True).over(w)).withColumn("new", (~F.col("kind").eqNullSafe(F.lag("kind").over(w))).cast("int"))
    return df.withColumn("run", F.sum("new").over(w)).groupBy("doc_id", "run", "kind").agg(F.count("*").alias("n_lines"), F.max_by("caption", "line_no").alias("caption"))


LEVELS = "CASE WHEN len(line) % 5 < 3 AND len(trim(line)) > 0 THEN len(line) % 5 + 1 END"


@query(rf"""WITH RECURSIVE {ALL_LINES}, h AS (SELECT doc_id, line_no, {LEVELS} AS level, line FROM l WHERE {LEVELS} IS NOT NULL),
parent AS (SELECT a.doc_id, a.line_no, max(b.line_no) AS up FROM h a LEFT JOIN h b ON b.doc_id = a.doc_id AND b.line_no < a.line_no AND b.level < a.level GROUP BY ALL),
walk AS (SELECT h.doc_id, h.line_no, p.up, trim(h.line) AS crumb FROM h JOIN parent p USING (doc_id, line_no) UNION ALL SELECT w.doc_id, w.line_no, p.up, trim(h.line) || ' > ' || w.crumb FROM walk w JOIN h ON h.doc_id = w.doc_id AND h.line_no = w.up JOIN parent p ON p.doc_id = w.doc_id AND p.line_no = w.up)
SELECT doc_id, line_no, crumb AS heading FROM walk WHERE up IS NULL""")
def heading_breadcrumb(spark, sf):
    """Lines as headings whose level follows their length, or as text; the breadcrumb of each heading."""
    size = F.length("line")
    head = (size % 5 < 3) & (F.length(F.trim("line")) > 0)
    line = F.when(head, F.concat(F.repeat(F.lit("#"), (size % 5 + 1).cast("int")), F.lit(" "), F.trim("line"))).otherwise(F.concat(F.lit("text "), "line"))
    lines = doc_lines(spark, sf).withColumn("line", line)
    return chunking.with_marks(lines).where("kind = 'heading'").select("doc_id", "line_no", "heading")


_FULL = "w.used + len(l.line) + 1 > 1800"


@query(f"""WITH RECURSIVE {ALL_LINES}, walk AS (SELECT doc_id, line_no, 0 AS group_no, len(line) + 1 AS used, len(line) AS n FROM l WHERE line_no = 0
UNION ALL SELECT l.doc_id, l.line_no, w.group_no + ({_FULL})::INT, CASE WHEN {_FULL} THEN 0 ELSE w.used END + len(l.line) + 1, len(l.line) FROM walk w JOIN l ON l.doc_id = w.doc_id AND l.line_no = w.line_no + 1)
SELECT doc_id, group_no::BIGINT AS group_no, count(*) AS n_lines, CAST(sum(n) + count(*) - 1 AS BIGINT) AS n_chars FROM walk GROUP BY doc_id, group_no""")
def greedy_pack(spark, sf):
    """Lines of documents packed into groups of at most 1800 characters, in one expression."""
    parts = F.split(F.coalesce("text", F.lit("")), "\n")
    groups = chunking.greedy_groups(parts, 1800)
    return table(spark, sf, "documents").select("doc_id", groups.alias("groups")).select("doc_id", F.posexplode("groups").alias("group_no", "lines")).select("doc_id", "group_no", F.size("lines").alias("n_lines"), F.length(F.array_join("lines", "\n")).alias("n_chars"))


@query()
def window_chunks(spark, sf):
    """Overlapping windows of every document that end at sentences, lines or words."""

    def run(batches):
        for pdf in batches:
            rows = [(d, i, piece) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for i, piece in enumerate(chunking.window(t or "", 1800, 250))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece_no", "piece"])

    return table(spark, sf, "documents").select("doc_id", "text").mapInPandas(run, "doc_id long, piece_no int, piece string")


@query()
def chunk_markdown(spark, sf):
    """Chunks of every document, with the file's source as context."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("doc_context"), F.lit(2022).alias("year"))
    return chunking.chunk(docs)


#: Orders whose reports one task writes and cuts.
ORDERS_A_TASK = 5_000


def statements(spark, sf) -> DataFrame:
    """(doc_id, text, doc_context, year): a report for each customer, made of its orders: pages, headings of statements and notes, units, tables of this year and
    last with a row for each line, and the orders' remarks as prose."""
    line = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))).alias("lines"))
    orders = table(spark, sf, "orders").join(line, "o_orderkey", "left")
    heads = ("Báo cáo kết quả hoạt động kinh doanh", "Bảng cân đối kế toán", "Thuyết minh báo cáo tài chính", "Balance sheet", "Remarks")

    def part(order: Column) -> Column:
        key, priority = order["o_orderkey"], order["o_orderpriority"]
        head = F.element_at(F.array(*map(F.lit, heads)), (key % len(heads) + 1).cast("int"))
        columns = F.when(key % 3 == 0, "| Mã số | Năm nay | Năm trước |").when(key % 3 == 1, "| Mã số | Số cuối năm | Số đầu kỳ |").otherwise("| Mã số | Giá |")
        cells = F.transform(F.coalesce(order["lines"], F.array().cast(line.schema["lines"].dataType)), lambda x: F.concat(F.lit("| "), x["l_partkey"].cast("string"), F.lit(" | "), x["l_quantity"].cast("long").cast("string"), F.when(key % 3 < 2, F.concat(F.lit(" | "), x["l_extendedprice"].cast("long").cast("string"))).otherwise(""), F.lit(" |")))
        grid = F.concat_ws("\n", columns, F.when(key % 7 > 0, "|---|---|---|"), cells)
        prose = F.when(key % 4 > 0, F.concat(F.lit("Đơn hàng "), key.cast("string"), F.lit(" ngày "), order["o_orderdate"].cast("string"), F.lit(". "), F.repeat(F.concat(priority, F.lit(" giao đúng hạn, ghi nhận doanh thu. ")), (key % 70).cast("int")))).otherwise("")
        return F.concat_ws(
            "\n", F.when(key % 2 == 0, F.concat(F.lit("<!-- ===== PAGE "), (key % 90 + 1).cast("string"), F.lit(" ===== -->"))), F.concat(F.lit("# "), head), F.when(key % 3 > 0, F.concat(F.repeat(F.lit("#"), (key % 4 + 2).cast("int")), F.lit(" "), (key % 30 + 1).cast("string"), F.lit(". Đơn hàng"))),
            F.when(key % 5 == 0, "Đơn vị tính: triệu đồng"), grid, F.lit(""), prose, F.when(key % 6 == 0, F.concat(F.lit("\n| lẻ |\n\n"), F.repeat(priority, (key % 9).cast("int")))),
        )

    # The orders of one customer travel as rows of figures; their texts, many times as long, are written where they meet.  So the number of partitions
    # follows the orders, not the bytes that were shuffled.
    n = -(-table(spark, sf, "orders").count() // ORDERS_A_TASK) or 1
    df = orders.withColumnRenamed("o_custkey", "doc_id").repartition(n, "doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("o_orderkey", "o_orderdate", "o_orderpriority", "lines")).alias("orders"), F.max(F.year("o_orderdate")).alias("y"))
    parts = F.array_sort(F.transform("orders", lambda o: F.struct(o["o_orderkey"].alias("key"), part(o).alias("part"))))
    df = df.select("doc_id", F.array_join(F.transform(parts, lambda x: x["part"]), "\n").alias("text"), "y")
    return df.select("doc_id", "text", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit(" Khách hàng "), F.col("doc_id").cast("string"))).alias("doc_context"), F.when(F.col("doc_id") % 4 > 0, F.col("y")).alias("year"))


@query()
def chunk_statements(spark, sf):
    """Chunks of reports with pages, headings, tables, units, notes and prose."""
    return chunking.chunk(statements(spark, sf))


#: What questions made of orders are about, and how they name the time; Y is the order's year, 25 years on.
ABOUT = ("doanh thu thuần", "tổng tài sản", "doanh thu và tổng tài sản", "xem thuyết minh số 12 về tiền", "lợi nhuận sau thuế", "DÒNG TIỀN", "Mục lục", "Nợ phải trả")
TIMES = (" năm {0}", " giai đoạn {0}-{3}", " từ {0} đến {2}", " {2} và {0}", " qua các năm", "", " {3} đến {0}", " each year from {1}")
_Y = "(year(o_orderdate) + 25)"
_ABOUT = f"CASE o_custkey % 8 {' '.join(f'WHEN {i} THEN {chr(39)}{a}{chr(39)}' for i, a in enumerate(ABOUT))} END"
_TIME = f"CASE o_orderkey % 8 {' '.join(f'WHEN {i} THEN {chr(39)}' + t.format(*(f'{chr(39)} || ({_Y} + {n}) || {chr(39)}' for n in range(4))) + chr(39) for i, t in enumerate(TIMES))} END"
_ASKED = f"t AS (SELECT o_orderkey AS qid, {_ABOUT} || {_TIME} AS q FROM orders)"
_ANY = {code: "regexp_matches(q, '(?i)(" + "|".join(p.replace("\\b", "") for p in patterns) + ")')" for code, patterns in sections.TOPICS}


def asked_of_orders(spark, sf) -> DataFrame:
    """A question for each order."""
    y = F.year("o_orderdate") + 25
    pieces = lambda t: F.concat(*[(y + int(p)).cast("string") if p.isdigit() and len(p) == 1 else F.lit(p) for p in re.split(r"[{}]", t)])
    pick = lambda key, values: F.coalesce(*[F.when(F.col(key) % len(values) == i, v) for i, v in enumerate(values)])
    question = F.concat(pick("o_custkey", [F.lit(a) for a in ABOUT]), pick("o_orderkey", [pieces(t) for t in TIMES]))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("qid"), question.alias("question"), y.alias("y"))


@query(rf"""WITH {_ASKED}, f AS (SELECT qid, q, {', '.join(f'{v}::INT AS {k}' for k, v in _ANY.items())}, try_cast(nullif(regexp_extract(lower(q), 'thuy[eế]t\s*minh\s*(?:s[oố]\s*)?(\d{{1,3}})', 1), '') AS BIGINT) AS note_no FROM t)
SELECT qid, CASE WHEN note_no IS NOT NULL THEN 'thuyet_minh' WHEN cdkt + kqkd + lctt <> 1 THEN '' WHEN cdkt = 1 THEN 'cdkt' WHEN kqkd = 1 THEN 'kqkd' ELSE 'lctt' END AS statement_type, note_no, try_cast(nullif(regexp_extract(q, '((?:19|20)\d{{2}})', 1), '') AS BIGINT) AS year FROM f""")
def route_questions(spark, sf):
    """Statement, note and year that each question made of an order is about."""
    return sections.with_route(asked_of_orders(spark, sf)).select("qid", "statement_type", "note_no", "year")


@query(rf"""WITH {_ASKED}, known AS (SELECT list_sort(list(DISTINCT {_Y}::BIGINT)) AS known FROM orders),
y AS (SELECT qid, q, known, list_sort(list_distinct(list_transform(regexp_extract_all(q, '(?:19|20)\d\d'), lambda x: x::BIGINT))) AS ys, regexp_extract(q, '(20\d\d)\s*(?:-|đến)\s*(20\d\d)', ['lo', 'hi']) AS span FROM t CROSS JOIN known),
s AS (SELECT *, try_cast(span.lo AS BIGINT) AS lo, try_cast(span.hi AS BIGINT) AS hi FROM y)
SELECT qid, array_to_string(CASE WHEN lo <= hi AND hi - lo <= 30 THEN range(lo, hi + 1) WHEN len(ys) >= 2 THEN ys WHEN regexp_matches(q, 'qua các năm|giai đoạn|each year') THEN list_filter(known, lambda x: x >= coalesce(least(ys[1], known[1]), known[1])) ELSE [] END, ' ') AS periods FROM s""")
def detect_periods(spark, sf):
    """Years that each of these questions spans; the known ones are those of the orders."""
    df = asked_of_orders(spark, sf)
    known = df.agg(F.array_sort(F.collect_set("y")).alias("known"))
    return df.crossJoin(known).select("qid", F.array_join(sections.periods(F.col("question"), F.col("known")).cast("array<string>"), " ").alias("periods"))  # one row


@query("SELECT conv_id, turn, role, text, CAST(count(*) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6")
def chat_window(spark, sf):
    """The last six turns of every conversation."""
    return sessions.last_turns(table(spark, sf, "conversations"), "conv_id", "turn", 6).select("conv_id", "turn", "role", "text", "place")


@query("SELECT conv_id, CAST(1 + 1 + count(*) FILTER (role IN ('user', 'assistant') AND trim(text) <> '') AS BIGINT) AS n_messages, 'system' AS first_role FROM conversations GROUP BY conv_id")
def prompt_messages(spark, sf):
    """Prompt messages of every conversation: system, history, question."""
    history = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda s: F.struct(s["role"].alias("role"), s["content"].alias("content"))).alias("history"))
    return history.select("conv_id", sessions.messages("Answer from the context.", F.col("history"), F.lit("?")).alias("m")).select("conv_id", F.size("m").alias("n_messages"), F.col("m")[0]["role"].alias("first_role"))


@query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '- **k**: ' || CAST(json_extract(props, '$.k') AS VARCHAR) AS bullet FROM events")
def json_props(spark, sf):
    """Properties of events, typed and as bullets."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select("event_id", "event_type", k.cast("long").alias("k"), F.element_at(F.split(tables.json_markdown(F.lit("x"), F.col("props")), "\n"), 3).alias("bullet"))


@query(f"WITH {BM25} SELECT qid, id, round(score, 4) AS score, rank, substr(text, 1, 400) AS snippet FROM (SELECT qid, id, score, {RANK} AS rank FROM bm) JOIN documents ON doc_id = id WHERE rank <= 3")
def citations(spark, sf):
    """Snippets and rounded scores of the best three documents."""
    top = bm25(spark, sf, 3).join(chunks(spark, sf).select("id", "text"), "id")
    return sessions.citations(top).select("qid", "id", "score", "rank", "snippet")


@query("SELECT doc_id, lower(coalesce(lang, '')) || '.md' AS name, 'md' AS kind, NULL::BIGINT AS year, least(99, 5 + CAST(floor((doc_id % 100) / 100 * 90) AS BIGINT)) AS progress FROM documents")
def document_status(spark, sf):
    """Kind, year and progress of uploads."""
    name = F.concat(F.lower(F.coalesce("lang", F.lit(""))), F.lit(".md"))
    return table(spark, sf, "documents").select("doc_id", name.alias("name"), text.file_kind(name).alias("kind"), text.doc_year(name, F.lit("")).alias("year"), text.progress(F.col("doc_id") % 100, F.lit(100)).alias("progress"))


@query("SELECT doc_id, CAST(nullif(regexp_extract(substr(coalesce(text, ''), 1, 2000), '(^|[^0-9])((19|20)[0-9][0-9])([^0-9]|$)', 2), '') AS BIGINT) AS year FROM documents")
def document_year(spark, sf):
    """Year of uploads whose names have none: from the first 2000 characters of the text."""
    return table(spark, sf, "documents").select("doc_id", text.doc_year(F.lit("upload.md"), F.col("text")).alias("year"))


@query(f"WITH {BM25}, t AS (SELECT *, {RANK} AS rank FROM bm), r AS (SELECT t.qid, t.id, t.score, len(text) AS rerank_score FROM t JOIN documents ON doc_id = id WHERE rank <= 10) SELECT qid, id, score, rerank_score, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, score DESC, id) AS rk FROM r) WHERE rk <= 5")
def reranked(spark, sf):
    """Candidates ordered anew by an injected scorer; the retrieval score stays."""
    top = bm25(spark, sf, 10).drop("rank").join(chunks(spark, sf).select("id", "text"), "id").join(asked(spark, sf), "qid")
    return retrieval.rerank(top, lambda question, body: F.length(body).cast("long"), 5).select("qid", "id", "score", "rerank_score", "rank")
