"""Queries over models, evaluation and documents as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.text import plain_text
from quillspark.operators import evaluation, models, tables, validation
from quillspark.plans.common import plain, table
from quillspark.plans.retrieval_queries import PAIRS, WORDS, turn_pairs
from quillspark.plans.statement_queries import HEADER, line_cells
from quillspark.sources.writers import merge_pages

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def hash_embeddings(spark, sf):
    """A vector of every document from the stand-in embedder."""
    return table(spark, sf, "documents").select("doc_id", models.embedder(models.hashed)(F.col("text")).alias("vector"))


@query("SELECT vec_id, round((list_sum(embedding[1:32]) + list_sum(embedding[33:64])) / 2, 5) AS total FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings)")
def mean_pooled(spark, sf):
    """Both halves of each vector pooled into their mean."""
    halves = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    pooled = models.mean_pool(halves)
    return table(spark, sf, "embeddings").select("vec_id", pooled.alias("p")).select("vec_id", F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(f"WITH {PAIRS}, w AS (SELECT conv_id, turn, list_distinct({WORDS.format('a')}) AS q, {WORDS.format('b')} AS t FROM p) SELECT conv_id, turn, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q) ELSE 0 END, 6) AS score FROM w")
def rerank_overlap(spark, sf):
    """The stand-in reranker on each turn and the next."""
    return turn_pairs(spark, sf).select("conv_id", "turn", F.round(models.overlap(F.col("a"), F.col("b")), 6).alias("score"))


@query(f"""WITH {PAIRS}, x AS (SELECT conv_id, turn, list_distinct({WORDS.format('a')}) AS q, string_split(coalesce(b, ''), chr(10)) AS ls FROM p),
y AS (SELECT conv_id, turn, q, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM x),
z AS (SELECT conv_id, turn, line, i, len(list_intersect(q, {WORDS.format('line')})) AS n FROM y WHERE trim(line) <> ''),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, i) AS o FROM z) WHERE o = 1)
SELECT p.conv_id, p.turn, CASE WHEN n > 0 THEN line ELSE 'no information' END AS answer FROM p LEFT JOIN best USING (conv_id, turn)""")
def extractive_answers(spark, sf):
    """The stand-in chat model: each turn answered from the next."""
    return turn_pairs(spark, sf).select("conv_id", "turn", models.extractive(F.col("a"), F.col("b")).alias("answer"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN least(1.0, greatest(0.0, value / 10)) END AS score FROM events")
def judge_scores(spark, sf):
    """Scores read from judges' replies, some of which hold none."""
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('Sure. {"score": '), (F.col("value") / 10).cast("string"), F.lit(', "why": "x"} Done.'))).otherwise("no idea")
    return table(spark, sf, "events").select("event_id", models.judged(reply).alias("score"))


def items(spark, sf):
    """Turn pairs as items: every fifth is unanswerable, every third has gold numbers."""
    key = F.col("conv_id") + F.col("turn")
    kind = F.when(key % 5 == 0, "unanswerable").when(key % 2 == 0, "factual").otherwise("numeric")
    gold = F.when(key % 3 == 0, F.array(F.col("turn").cast("string"), F.lit("7"))).otherwise(F.array().cast("array<string>"))
    return turn_pairs(spark, sf).select(F.concat_ws("-", "conv_id", "turn").alias("id"), kind.alias("answer_type"), F.concat("a", F.lit(" "), F.col("turn").cast("string")).alias("answer"), F.col("b").alias("ground_truth"), gold.alias("gold_numbers"), F.concat(F.lit("7 "), F.col("conv_id").cast("string")).alias("context"), F.when(key % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.lit(2020) + F.col("turn") % 3, F.lit(2021) + F.col("turn") % 3)).alias("relevant_years"), F.array(F.lit(2021) + F.col("conv_id") % 2, F.lit(2022) + F.col("conv_id") % 2).alias("found_years"))


@query()
def evaluate_answers(spark, sf):
    """All answer metrics of every item."""
    return evaluation.answers(items(spark, sf))


@query()
def evaluate_rollup(spark, sf):
    """Their means by answer type and overall."""
    return evaluation.rollup(evaluation.answers(items(spark, sf)))


_ITEMS = "i AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 = 0 THEN 'unanswerable' WHEN (conv_id + turn) % 2 = 0 THEN 'factual' ELSE 'numeric' END AS answer_type FROM p)"


@query(f"WITH {PAIRS}, {_ITEMS} SELECT answer_type, count(*) AS n, round(avg(CASE WHEN answer_type <> 'unanswerable' AND (conv_id + turn) % 7 <> 0 THEN len(list_intersect([2020 + turn % 3, 2021 + turn % 3], [2021 + conv_id % 2, 2022 + conv_id % 2])) / 2 END), 4) AS year_coverage FROM i GROUP BY GROUPING SETS ((answer_type), ())")
def year_coverage(spark, sf):
    """Share of the years asked about that were retrieved, by type and overall."""
    return evaluation.rollup(evaluation.answers(items(spark, sf))).select("answer_type", "n", "year_coverage")


def recognised(spark, sf):
    """Part names as gold pages; recognition swaps letters and drops some words."""
    gold = F.concat_ws(" ", "p_name", "p_brand", "p_type", F.col("p_size").cast("string"))
    pred = F.concat_ws(" ", F.translate("p_name", "aeo", "eao"), "p_brand", F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("page"), pred.alias("pred"), gold.alias("gold"))


_PAGES = "g AS (SELECT p_partkey AS page, trim(regexp_replace(regexp_replace(concat_ws(' ', p_name, p_brand, p_type, p_size), '[|#*`>]', ' ', 'g'), '\\s+', ' ', 'g')) AS gold, trim(regexp_replace(regexp_replace(concat_ws(' ', translate(p_name, 'aeo', 'eao'), p_brand, CASE WHEN p_partkey % 3 <> 0 THEN p_type END, p_size), '[|#*`>]', ' ', 'g'), '\\s+', ' ', 'g')) AS pred FROM part)"


@query(f"WITH {_PAGES} SELECT page, round(levenshtein(pred, gold) / length(gold), 6) AS cer, round(greatest(0, 1 - levenshtein(pred, gold) / length(gold)), 6) AS char_accuracy, len(string_split(pred, ' ')) AS n_words, len(string_split(gold, ' ')) AS n_gold_words FROM g")
def page_scores(spark, sf):
    """Error rates of recognised pages."""
    return evaluation.pages(recognised(spark, sf)).select("page", F.round("cer", 6).alias("cer"), F.round("char_accuracy", 6).alias("char_accuracy"), "n_words", "n_gold_words")


@query()
def page_totals(spark, sf):
    """Means and micro F1 over all recognised pages."""
    return evaluation.pages_total(evaluation.pages(recognised(spark, sf)))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '(?m)^\s*\|?[\s:|-]*-{2,}[\s:|-]*$', ' ', 'g'), '[|#*`>]', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages")
def normalised_text(spark, sf):
    """Pages as plain comparable text."""
    return table(spark, sf, "pages").select("page_id", plain_text(F.col("html")).alias("body"))


@query("SELECT conv_id AS doc_id, string_agg('<!-- ===== page ' || turn || ' ===== -->' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def merged_pages(spark, sf):
    """Turns as pages of one document, each after its marker."""
    return merge_pages(table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text"))


@query("SELECT r_name AS name, '# ' || r_name || chr(10) || chr(10) || '## Table 0' || chr(10) || '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) || chr(10) AS markdown FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def table_export(spark, sf):
    """Nations of each region as an exported table."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), F.col("n_name")).alias("row")))), lambda s: s["row"])
    df = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("name")).agg(rows.alias("rows"))
    return tables.table_export(df.select("name", F.lit(0).alias("index"), F.array(F.lit("key"), F.lit("name")).alias("header"), "rows"))


@query("SELECT conv_id, turn, (length(text) BETWEEN 1 AND 4000 AND role IN ('user', 'assistant'))::BIGINT AS valid FROM conversations")
def valid_requests(spark, sf):
    """Which turns a chat request may hold."""
    ok = F.length("text").between(1, 4000) & F.col("role").isin("user", "assistant")
    return table(spark, sf, "conversations").select("conv_id", "turn", ok.cast("long").alias("valid"))


@query("SELECT o_orderstatus AS status, count(*) AS n, min(o_orderkey) AS first_id FROM orders GROUP BY o_orderstatus")
def status_counts(spark, sf):
    """Files by status."""
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_id"))


@query("SELECT k AS column_name, min(pos) AS first_seen, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k, event_id AS pos FROM events) GROUP BY k")
def union_keys(spark, sf):
    """Columns of a list of objects, by first sight."""
    keys = F.explode(F.json_object_keys("props"))
    return table(spark, sf, "events").select("event_id", keys.alias("column_name")).groupBy("column_name").agg(F.min("event_id").alias("first_seen"), F.count("*").alias("n"))


@query("SELECT l_orderkey::VARCHAR AS file, count(*) AS n_rows, count(DISTINCT l_linenumber) AS n_keys FROM lineitem GROUP BY l_orderkey")
def tables_per_file(spark, sf):
    """Rows and distinct row numbers of each file."""
    return line_cells(spark, sf).groupBy("file").agg(F.count("*").alias("n_rows"), F.count_distinct("row_idx").alias("n_keys"))


@query("SELECT c_custkey AS session, c_name AS name, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer QUALIFY place <= 50")
def latest_sessions(spark, sf):
    """The fifty sessions that a list shows first."""
    top = table(spark, sf, "customer").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(50)
    from pyspark.sql import Window

    return top.select(F.col("c_custkey").alias("session"), F.col("c_name").alias("name"), F.row_number().over(Window.orderBy(F.col("c_acctbal").desc(), "c_custkey")).alias("place"))


_TURN = "(list_min(list_transform(range(1, 6), lambda i: CASE WHEN (i + l_orderkey - 1) % 5 = {} THEN i END)))"


@query(f"SELECT l_orderkey AS id, {_TURN.format(2)} AS ref_column, {_TURN.format(3)} AS current_column FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def header_columns(spark, sf):
    """Where a table's header names the reference and the current figure, counted from 1; each file has its columns in an order of its own."""
    names = F.array(*[F.lit(h) for h in HEADER])
    order = F.transform(F.sequence(F.lit(0), F.lit(len(HEADER) - 1)), lambda i: F.get(names, ((i + F.col("id")) % len(HEADER)).cast("int")))
    header = F.transform(order, lambda h, i: F.when(i % 2 == 0, F.upper(h)).otherwise(F.replace(h, F.lit(" "), F.lit("  "))))
    ids = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")).distinct().withColumn("header", header)
    return ids.select("id", (validation.find_column(F.col("header"), "thuyết minh") + 1).alias("ref_column"), (validation.find_column(F.col("header"), "năm nay") + 1).alias("current_column"))
