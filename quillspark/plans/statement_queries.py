"""Queries over line items, validation and sessions."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import numbers
from quillspark.functions.text import pipe_table
from quillspark.operators import facts, sessions, validation
from quillspark.plans.common import plain, table
from quillspark.streaming import jobs

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Order priorities take the part of line items.
CODES = (("1-URGENT", "01"), ("2-HIGH", "02"), ("3-MEDIUM", "10"), ("4-NOT SPECIFIED", "11"), ("5-LOW", "20"))
_CASE = "CASE p " + " ".join(f"WHEN '{p}' THEN '{c}'" for p, c in CODES) + " END"
_LABEL = "CASE code " + " ".join(f"WHEN '{c}' THEN '{facts.INCOME[c]}'" for _, c in CODES) + " END"
_GROUPED = "replace(format('{{:,}}', {}), ',', '.')"
_SHOWN = "CASE WHEN code = '02' THEN '(' || " + _GROUPED + " || ')' ELSE " + _GROUPED + " END"
FACTS = f"""y AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, o_orderpriority AS p, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY ALL),
c AS (SELECT year, {_CASE} AS code, cents FROM y),
w AS (SELECT a.year, a.code, a.cents, coalesce(b.cents, 0) + CASE WHEN a.code = '11' AND a.year % 3 = 0 THEN 1 ELSE 0 END AS prior FROM c a LEFT JOIN c b ON b.code = a.code AND b.year = a.year - 1),
f AS (SELECT 'kqkd' AS statement, code, {_LABEL} AS label, year, {_SHOWN.format("cents", "cents")} AS value_raw, CAST(CASE WHEN code = '02' THEN -cents ELSE cents END AS DOUBLE) AS value, 'triệu VND' AS unit, {_SHOWN.format("prior", "prior")} AS prior_raw, cents, prior FROM w),
k AS (SELECT a.statement, a.code, count(*) AS checks, bool_and(a.cents = b.prior) AS agree FROM f a JOIN f b ON b.code = a.code AND b.year = a.year + 1 GROUP BY a.statement, a.code),
g AS (SELECT f.* FROM f ANTI JOIN (SELECT * FROM k WHERE NOT agree) USING (statement, code))"""


def statement_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly totals by priority as printed statements: a report a year, with the year before beside it."""
    codes = F.create_map(*[F.lit(x) for pair in CODES for x in pair])
    totals = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year"), codes[F.col("o_orderpriority")].alias("code")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    before = totals.select((F.col("year") + 1).alias("year"), "code", F.col("cents").alias("prior"))
    slip = F.when((F.col("code") == "11") & (F.col("year") % 3 == 0), 1).otherwise(0)
    df = totals.join(before, ["year", "code"], "left").withColumn("prior", F.coalesce("prior", F.lit(0)) + slip)
    shown = lambda c: F.when(F.col("code") == "02", F.concat(F.lit("("), numbers.grouped(F.col(c)), F.lit(")"))).otherwise(numbers.grouped(F.col(c)))
    label = F.create_map(*[F.lit(x) for _, c in CODES for x in (c, facts.INCOME[c])])[F.col("code")]
    return df.select(F.col("year").alias("report_year"), F.lit(0).alias("table_idx"), F.col("code").cast("int").alias("row_idx"), F.array("code", label, F.lit("30.1"), shown("cents"), shown("prior")).alias("cells"))


def found(spark, sf) -> DataFrame:
    return facts.facts(spark, statement_cells(spark, sf))


def kept(spark, sf) -> DataFrame:
    return facts.consistent(found(spark, sf))


@query(f"WITH {FACTS} SELECT statement, code, label, year, value_raw, value, unit, prior_raw FROM f")
def facts_from_rows(spark, sf):
    """Printed rows to facts: the statement is recognised, codes get labels, figures are parsed."""
    return found(spark, sf)


@query(f"WITH {FACTS} SELECT statement, code, list_aggregate(list(year || '=' || value_raw ORDER BY year), 'string_agg', ' ') AS points, count(*) AS n FROM f GROUP BY statement, code")
def facts_series(spark, sf):
    """The series of every line item, oldest first."""
    point = F.concat(F.col("year").cast("string"), F.lit("="), F.col("value_raw"))
    return found(spark, sf).groupBy("statement", "code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("year", point.alias("p")))), lambda s: s["p"]), " ").alias("points"), F.count("*").alias("n"))


@query(f"WITH {FACTS} SELECT 'fact:kqkd:' || code || ':' || year AS src, 'item:kqkd:' || code AS dst, 'OF_ITEM' AS rel FROM f UNION ALL SELECT 'fact:kqkd:' || code || ':' || year, 'period:' || year, 'IN_PERIOD' FROM f")
def fact_graph(spark, sf):
    """Edges of the fact graph."""
    return facts.graph(found(spark, sf))[1]


@query(f"WITH {FACTS} SELECT statement, code, checks, agree FROM k")
def consistency_check(spark, sf):
    """Whether each report agrees with the prior column of the next."""
    return facts.consistency(found(spark, sf))


_PAIRS = "m AS (SELECT *, lag(year) OVER s AS year_before, lag(value) OVER s AS value_before FROM g WINDOW s AS (PARTITION BY statement, code ORDER BY year))"
_DIRECTION = "CASE WHEN value > value_before THEN 'tăng' WHEN value < value_before THEN 'giảm' ELSE 'không đổi' END AS direction"


@query(f"WITH {FACTS}, {_PAIRS} SELECT code, year, year_before, {_DIRECTION} FROM m WHERE year_before IS NOT NULL")
def yoy_change(spark, sf):
    """Direction of each yearly change of consistent items."""
    return facts.changes(kept(spark, sf)).select("code", "year", "year_before", "direction")


@query(f"WITH {FACTS}, {_PAIRS} SELECT code, year, value - value_before AS delta FROM m WHERE year_before IS NOT NULL")
def yoy_delta(spark, sf):
    """Amount of each yearly change."""
    return facts.changes(kept(spark, sf)).select("code", "year", "delta")


@query(f"WITH {FACTS} SELECT code, count(*) AS points, round(max_by(value, year) / min_by(value, year), 6) AS multiple FROM g GROUP BY code HAVING count(*) >= 4 AND max_by(value, year) > 0 AND min_by(value, year) > 0")
def growth_multiple(spark, sf):
    """Last point over first of series with four points or more."""
    return facts.growth(kept(spark, sf)).select("code", "points", F.round("multiple", 6).alias("multiple"))


@query(f"WITH {FACTS} SELECT code, year, value FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY value DESC, year) AS o, count(*) OVER (PARTITION BY code) AS n FROM g) WHERE o = 1 AND n >= 4")
def argmax_year(spark, sf):
    """The year of each series' largest value."""
    return facts.peak(kept(spark, sf)).select("code", "year", "value")


@query("SELECT CAST(year(l_shipdate) AS BIGINT) AS year, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice) * 100, 6) AS percent FROM lineitem GROUP BY ALL")
def ratio_margin(spark, sf):
    """Discounted over gross revenue by year, as two line items."""
    line = table(spark, sf, "lineitem")
    sums = line.groupBy(F.year("l_shipdate").alias("year")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("20"), F.sum("l_extendedprice").alias("10"))
    items = sums.unpivot(["year"], ["20", "10"], "code", "value").select(F.lit("kqkd").alias("statement"), "code", "year", "value", F.col("value").cast("string").alias("value_raw"))
    return facts.ratio(items, "20", "10").select("year", F.round("percent", 6).alias("percent"))


@query(f"WITH {FACTS} SELECT code, year, value_raw, prior_raw, value - CASE WHEN code = '02' THEN -prior ELSE prior END AS moved FROM f WHERE prior <> 0")
def opening_vs_closing(spark, sf):
    """Closing against opening figure of each report."""
    df = found(spark, sf).withColumn("opening", numbers.figure(F.col("prior_raw"))).where("opening <> 0")
    return df.select("code", "year", "value_raw", "prior_raw", (F.col("value") - F.col("opening")).alias("moved"))


@query()
def qa_generate(spark, sf):
    """The question set over consistent facts."""
    return facts.questions(spark, found(spark, sf), "Orders")


_Q = f"WITH {FACTS}, {_PAIRS}, s AS (SELECT code, count(*) AS n, max_by(value, year) AS l, min_by(value, year) AS f FROM g GROUP BY code)"


_HEAD = "('01', '10', '11', '20')"


@query(f"""{_Q} SELECT answer_type, difficulty, lang, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'numeric_single' AS answer_type, CASE WHEN code IN ('01', '10', '440') THEN 'easy' ELSE 'medium' END AS difficulty, 'vi' AS lang, count(*) AS n FROM g GROUP BY ALL
UNION ALL SELECT 'numeric_compare', 'medium', 'vi', count(*) FROM m WHERE year_before IS NOT NULL UNION ALL SELECT 'multi_year', 'hard', 'vi', count(*) FROM s WHERE n >= 4
UNION ALL SELECT 'numeric_single', 'medium', 'en', count(*) FROM g WHERE code IN ('10', '20')
UNION ALL SELECT 'reasoning', 'hard', 'vi', (SELECT count(*) FROM s WHERE n >= 4 AND code IN {_HEAD} AND f > 0 AND l > 0) + (SELECT count(*) FROM s WHERE n >= 4 AND code IN {_HEAD})
  + (SELECT count(*) FROM f a JOIN f b ON b.year = a.year AND a.code = '20' AND b.code = '10' AND b.value <> 0) + (SELECT count(*) FROM m WHERE year_before IS NOT NULL AND code IN {_HEAD}))
GROUP BY ALL HAVING sum(n) > 0""")
def qa_counts(spark, sf):
    """Questions by type, difficulty and language."""
    return facts.questions(spark, found(spark, sf), "Orders").groupBy("answer_type", "difficulty", "lang").agg(F.count("*").alias("n"))


PRINTED = "CASE WHEN o_orderkey % 4 = 0 THEN '(' || " + _GROUPED.format("CAST(round(o_totalprice * 100) AS BIGINT)") + " || ')' WHEN o_orderkey % 4 = 1 THEN 'n/a' WHEN o_orderkey % 4 = 2 THEN '-' || " + _GROUPED.format("CAST(round(o_totalprice * 100) AS BIGINT)") + " ELSE CAST(CAST(round(o_totalprice * 100) AS BIGINT) // 100 AS VARCHAR) || ',' || lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') END"
_VALUE = "CASE WHEN o_orderkey % 4 IN (0, 2) THEN -CAST(round(o_totalprice * 100) AS BIGINT)::DOUBLE WHEN o_orderkey % 4 = 3 THEN round(CAST(round(o_totalprice * 100) AS BIGINT) / 100, 2) END"


def printed(spark, sf) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    shown = numbers.grouped(cents)
    turn = F.col("o_orderkey") % 4
    raw = F.when(turn == 0, F.concat(F.lit("("), shown, F.lit(")"))).when(turn == 1, "n/a").when(turn == 2, F.concat(F.lit("-"), shown)).otherwise(F.concat((cents / 100).cast("long").cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0")))
    return table(spark, sf, "orders").select("o_orderkey", raw.alias("raw"))


@query(f"SELECT o_orderkey, {PRINTED} AS raw, {_VALUE} AS value FROM orders")
def vn_number_parse(spark, sf):
    """Printed numbers to values."""
    return printed(spark, sf).withColumn("value", numbers.parse_number(F.col("raw")))


_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN {_CENTS}::VARCHAR WHEN o_orderkey % 4 = 3 THEN ({_CENTS} // 100)::VARCHAR || CASE WHEN {_CENTS} % 100 = 0 THEN '' ELSE '.' || rtrim(lpad(({_CENTS} % 100)::VARCHAR, 2, '0'), '0') END END AS canonical FROM orders")
def canon_number(spark, sf):
    """Printed numbers in canonical form; a leading minus is no part of the notation, such cells have none."""
    return printed(spark, sf).select("o_orderkey", numbers.canonical(F.col("raw")).alias("canonical"))


HEADER = ("Mã số", "Chỉ tiêu", "Thuyết minh", "Năm nay", "Năm trước")


def line_cells(spark, sf) -> DataFrame:
    """Line items as rows of a table: a code, a label, a reference, two figures; closed lines of the last number lack a cell."""
    cells = F.array(F.col("l_linenumber").cast("string"), F.concat(F.lit("Khoản mục "), F.col("l_suppkey").cast("string")), F.col("l_partkey").cast("string"), numbers.grouped((F.col("l_quantity") * 100).cast("long")), numbers.grouped((F.col("l_quantity") * 100 * (1 + F.col("l_linenumber") % 2)).cast("long")))
    short = (F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 7)
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("file"), F.lit(0).alias("table_idx"), F.lit(5).alias("n_cols"), F.array(*[F.lit(h) for h in HEADER]).alias("header"), F.col("l_linenumber").alias("row_idx"), F.when(short, F.slice(cells, 1, 4)).otherwise(cells).alias("cells"))


_Q100 = "CAST(l_quantity * 100 AS BIGINT)"
_ROWS = f"r AS (SELECT l_orderkey::VARCHAR AS file, l_linenumber::BIGINT AS row, l_linestatus = 'F' AND l_linenumber = 7 AS short, {_Q100} AS a, CAST(l_quantity * 100 * (1 + l_linenumber % 2) AS BIGINT) AS b, l_partkey FROM lineitem)"


def _rule(spark, sf, rule: str) -> DataFrame:
    return validation.structural(line_cells(spark, sf)).where(F.col("rule") == rule).select("file", "row", "value", "severity")


@query(f"WITH {_ROWS} SELECT file, row, {_GROUPED.format('a')} AS value, 'high' AS severity FROM r WHERE a >= 1000 AND (l_partkey = a OR (NOT short AND a = b))")
def adjacent_duplicate(spark, sf):
    """Equal large figures side by side."""
    return _rule(spark, sf, "adjacent_duplicate")


@query(f"WITH {_ROWS} SELECT file, row, '' AS value, 'low' AS severity FROM r WHERE short")
def ragged_row(spark, sf):
    """Rows narrower than the header."""
    return _rule(spark, sf, "ragged_row")


@query(f"WITH {_ROWS} SELECT file, row, l_partkey::VARCHAR AS value, 'high' AS severity FROM r WHERE l_partkey >= 1000")
def ref_col_big(spark, sf):
    """Large figures in the reference column."""
    return _rule(spark, sf, "big_num_in_ref_col")


_IDENTITY = "i AS (SELECT l_orderkey::VARCHAR AS file, CAST(round(sum(l_extendedprice)) AS BIGINT) AS a, CAST(round(sum(l_extendedprice * l_discount)) AS BIGINT) AS b, CAST(round(sum(l_extendedprice * (1 - l_discount))) AS BIGINT) + l_orderkey % 3 AS c FROM lineitem GROUP BY l_orderkey)"


def summed(values: Column) -> Column:
    """Sum of an array in its order, nulls left out; null without a value."""
    known = F.filter(values, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, b: a + b))


def identity_cells(spark, sf) -> DataFrame:
    """Orders as income statements whose net revenue is off by up to two."""
    # Doubles are added in the order of the table's rows, as SQL does on one thread: a sum that ends in half a unit rounds either way by the order, and
    # partial sums would have it follow from where files are cut and which task ends first.  An order has a handful of lines.
    line = table(spark, sf, "lineitem").select("l_orderkey", F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"), "l_extendedprice", "l_discount").alias("line"))
    line = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    total = lambda f: F.round(summed(F.transform("lines", lambda x: f(x["l_extendedprice"], x["l_discount"])))).cast("long")
    line = line.select("l_orderkey", total(lambda price, _: price).alias("a"), total(lambda price, off: price * off).alias("b"), total(lambda price, off: price * (1 - off)).alias("net"))
    line = line.withColumn("c", F.col("net") + F.col("l_orderkey") % 3)
    shown = {"01": numbers.grouped(F.col("a")), "02": F.concat(F.lit("("), numbers.grouped(F.col("b")), F.lit(")")), "10": numbers.grouped(F.col("c")), "20": numbers.grouped(F.col("c")), "11": F.lit("0")}
    rows = F.explode(F.array(*[F.struct(F.lit(int(code)).alias("row_idx"), F.array(F.lit(code), F.lit(facts.INCOME[code]), F.lit(""), value, F.lit("0")).alias("cells")) for code, value in shown.items()]))
    return line.select(F.col("l_orderkey").cast("string").alias("file"), F.lit(0).alias("table_idx"), F.lit(5).alias("n_cols"), F.array(*[F.lit(h) for h in HEADER]).alias("header"), rows.alias("r")).select("file", "table_idx", "n_cols", "header", "r.row_idx", "r.cells")


@query(f"WITH {_IDENTITY} SELECT file, '10' AS ma_so, {_GROUPED.format('c')} AS value, 'kỳ vọng 01+02=' || {_GROUPED.format('a - b')} || ', OCR=' || {_GROUPED.format('c')} AS detail FROM i WHERE abs(a - b - c) > 1")
def arith_identity(spark, sf):
    """Statements in which a sum does not add up."""
    return validation.arithmetic(identity_cells(spark, sf)).select("file", "ma_so", "value", "detail")


def yearly_cells(spark, sf) -> DataFrame:
    """The printed statements in the form that validation reads."""
    df = statement_cells(spark, sf)
    return df.select(F.col("report_year").cast("string").alias("file"), "table_idx", F.lit(5).alias("n_cols"), F.array(*[F.lit(h) for h in HEADER]).alias("header"), "row_idx", "cells")


_MISMATCH = f"WITH {FACTS} SELECT a.year::VARCHAR AS file, lower(a.label)[1:50] AS label, 'Năm trước (vs ' || b.year || ')' AS \"column\", {_GROUPED.format('a.prior')} AS value FROM f a JOIN f b ON b.code = a.code AND b.year = a.year - 1 WHERE a.prior <> b.cents"


@query(_MISMATCH)
def cross_year_mismatch(spark, sf):
    """Prior columns that differ from the report of the year before."""
    return validation.cross_year(yearly_cells(spark, sf)).select("file", "label", "column", "value")


@query(f"""WITH {_ROWS}, {_IDENTITY}, {FACTS}, a AS (SELECT 'adjacent_duplicate' AS rule, 'high' AS severity, count(*) AS n FROM r WHERE a >= 1000 AND (l_partkey = a OR (NOT short AND a = b))
UNION ALL SELECT 'ragged_row', 'low', count(*) FROM r WHERE short UNION ALL SELECT 'big_num_in_ref_col', 'high', count(*) FROM r WHERE l_partkey >= 1000
UNION ALL SELECT 'arithmetic_mismatch', 'medium', count(*) FROM i WHERE abs(a - b - c) > 1
UNION ALL SELECT 'cross_year_mismatch', 'high', count(*) FROM f a JOIN f b ON b.code = a.code AND b.year = a.year - 1 WHERE a.prior <> b.cents)
SELECT rule, severity, CAST(sum(n) AS BIGINT) AS n FROM a WHERE n > 0 GROUP BY GROUPING SETS ((rule, severity), (severity), ())""")
def findings_report(spark, sf):
    """Counts of all findings by rule and severity, with totals."""
    every = validation.structural(line_cells(spark, sf)).unionByName(validation.arithmetic(identity_cells(spark, sf))).unionByName(validation.cross_year(yearly_cells(spark, sf)))
    return validation.counts(every)


@query("SELECT c_custkey, c_name, coalesce(n, 0) AS n_documents, round(coalesce(t, 0), 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def session_summary(spark, sf):
    """Orders and their sum for every customer, none included."""
    df = sessions.summary(table(spark, sf, "customer").select("c_custkey", "c_name"), table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_totalprice")
    return df.withColumn("total", F.round("total", 2))


@query("SELECT p_brand, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand")
def code_label_lookup(spark, sf):
    """Revenue by brand: a dimension lookup whose join Spark chooses by size."""
    line = table(spark, sf, "lineitem").select("l_partkey", "l_extendedprice")
    return line.join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count("*").alias("n_lines"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def anti_exclude(spark, sf):
    """Orders of customers that are not flagged."""
    return sessions.without(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def upsert_rows(spark, sf):
    """Rows of one segment replaced."""
    base = table(spark, sf, "customer")
    new = base.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit(0.0).alias("c_acctbal"))
    return sessions.upsert(base.select("c_custkey", "c_acctbal"), new, ["c_custkey"])


@query("SELECT n_regionkey, '| key | name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey")
def markdown_table(spark, sf):
    """Nations of each region as a pipe table."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), F.col("n_name")).alias("row")))), lambda s: s["row"])
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(rows.alias("rows")).select("n_regionkey", pipe_table(F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), "rows")).alias("markdown"))


@query("SELECT o_custkey AS doc_id, count(*) AS n_pages, CAST(sum(length(o_orderpriority)) AS BIGINT) AS n_chars, round(sum(o_totalprice), 2) AS seconds, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders GROUP BY o_custkey")
def document_totals(spark, sf):
    """Pages, characters, seconds and failures of each document."""
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.count("*").alias("n_pages"), F.sum(F.length("o_orderpriority")).alias("n_chars"), F.round(F.sum("o_totalprice"), 2).alias("seconds"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"))


_PRF = "m AS (SELECT o_orderpriority AS page, count(*) AS gold, count(*) FILTER (o_orderstatus <> 'P') AS pred, count(*) FILTER (o_orderstatus = 'F') AS hit FROM orders GROUP BY 1)"


@query(f"WITH {_PRF} SELECT round(sum(hit) / sum(pred), 4) AS micro_p, round(sum(hit) / sum(gold), 4) AS micro_r, round(2 * sum(hit) / (sum(pred) + sum(gold)), 4) AS micro_f1, round(avg(2 * hit / (pred + gold)), 4) AS macro_f1 FROM m")
def micro_macro_f1(spark, sf):
    """Precision, recall and F1 over all pages, and the mean over pages."""
    m = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("gold"), F.count_if(F.col("o_orderstatus") != "P").alias("pred"), F.count_if(F.col("o_orderstatus") == "F").alias("hit"))
    s = lambda c: F.sum(c)
    return m.agg(F.round(s("hit") / s("pred"), 4).alias("micro_p"), F.round(s("hit") / s("gold"), 4).alias("micro_r"), F.round(2 * s("hit") / (s("pred") + s("gold")), 4).alias("micro_f1"), F.round(F.avg(2 * F.col("hit") / (F.col("pred") + F.col("gold"))), 4).alias("macro_f1"))


@query("SELECT l_orderkey AS file, l_linestatus AS label, min(l_returnflag) AS flag, min(l_suppkey) AS supplier FROM lineitem GROUP BY l_orderkey, l_linestatus HAVING count(DISTINCT (l_returnflag, l_suppkey)) = 1")
def unambiguous_labels(spark, sf):
    """Labels of a file with one distinct pair of values."""
    one = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("file"), F.col("l_linestatus").alias("label"))
    return one.agg(F.count_distinct("l_returnflag", "l_suppkey").alias("n"), F.min("l_returnflag").alias("flag"), F.min("l_suppkey").alias("supplier")).where("n = 1").drop("n")


def _folder(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='quillspark-stream-')}"
    name = spark.range(1).select(F.uuid().alias("u")).first()["u"]
    return f"{base.rstrip('/')}/quillspark-stream/{name}"


@query("SELECT count(*) AS n_rows, 'ready' AS state FROM events")
def stream_status(spark, sf):
    """Events indexed by micro-batch; the status of each batch."""
    at = _folder(spark)
    source = jobs.stream(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema)
    jobs.index_stream(source, lambda b: b.select("event_id", "event_type", "value"), f"{at}/sink", f"{at}/status", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/status").select(F.col("rows").alias("n_rows"), "state")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf):
    """Daily counts of events by type, as a stream with a watermark that runs until its input ends."""
    at = _folder(spark)
    counted = jobs.windowed_counts(jobs.stream(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema))
    write = lambda batch, no: batch.write.mode("overwrite").parquet(f"{at}/out/batch_id={no}")
    counted.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    last = out.agg(F.max("batch_id").alias("batch_id"))
    return out.join(last, "batch_id").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT conv_id, count(*) AS n_turns, max(turn) AS last_turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6 GROUP BY conv_id")
def stream_memory_ttl(spark, sf):
    """The last six turns of every conversation from a stream with state that lapses."""
    at = _folder(spark)
    turns = jobs.memory_stream(jobs.stream(spark, f"{sf}/conversations.parquet", table(spark, sf, "conversations").schema), expire=False)
    write = lambda batch, no: batch.write.mode("overwrite").parquet(f"{at}/out/batch_id={no}")
    turns.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    latest = out.groupBy("conv_id").agg(F.max_by("turns", "batch_id").alias("turns"))
    return latest.select("conv_id", F.size("turns").alias("n_turns"), F.element_at("turns", -1)["turn"].alias("last_turn"))
