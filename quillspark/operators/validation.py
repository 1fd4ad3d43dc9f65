"""Suspicious cells of statement tables, in three tiers.  Findings are reported, never repaired.

Tables come as (file, table_idx, n_cols, header, row_idx, cells), a row of the table each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.numbers import grouped, parse_number
from quillspark.functions.text import label_key

FIELDS = "file string, table int, row int, ma_so string, label string, column string, value string, rule string, severity string, detail string"
LARGE = 1000
#: Result code, its operands.
IDENTITIES = (("10", ("01", "02")), ("20", ("10", "11")), ("60", ("50", "51", "52")))
SEVERITY = ("high", "medium", "low")
# What findings say.
RAGGED = "số cột khác header → bảng có thể bị vỡ"
IN_REFERENCE = "cột Thuyết minh chứa số lớn → OCR điền nhầm ô"
TWICE = "hai ô số kề nhau trùng giá trị"


def find_column(header: Column, *keywords: str) -> Column:
    """Index of the first header cell that holds a keyword, whatever its case and blanks, else null."""
    pattern = "(?iu)" + "|".join(r"\s+".join(k.split(" ")) for k in keywords)
    return F.nullif(F.array_position(F.transform(header, lambda h: h.rlike(pattern)), F.lit(True)), F.lit(0)).cast("int") - 1


def longest(cells: Column) -> Column:
    """The longest cell, the first of equals."""
    size = F.array_max(F.transform(cells, lambda c: F.length(c)))
    return F.coalesce(F.get(F.filter(cells, lambda c: F.length(c) == size), F.lit(0)), F.lit(""))


def _finding(df: DataFrame, **values) -> DataFrame:
    return df.select(*[F.lit(values[n]).cast(t).alias(n) if not isinstance(values[n], Column) else values[n].cast(t).alias(n) for n, t in (f.split(" ") for f in FIELDS.split(", "))])


def code_of(cells: Column) -> Column:
    first = F.get(cells, F.lit(0))
    return F.coalesce(F.when(F.trim(first).rlike(r"^\d{1,3}$"), first), F.lit(""))


def structural(rows: DataFrame) -> DataFrame:
    """Tier 1: ragged rows of data, large figures in the reference column, equal large figures side by side (the first pair of a row).
    Each row is parsed once; what it shows comes out as an array of at most three findings."""
    n, at = F.size("cells"), F.col("at")
    df = rows.withColumns({"numbers": F.transform("cells", parse_number), "at": find_column(F.col("header"), "thuyết minh", "thuyet minh")})
    pairs = F.filter(F.sequence(F.lit(0), F.greatest(F.size("numbers") - 2, F.lit(0))), lambda i: (F.get("numbers", i) == F.get("numbers", i + 1)) & (F.abs(F.get("numbers", i)) >= LARGE))
    df = df.withColumn("twice", F.get(pairs, F.lit(0)))
    found = lambda column, value, rule, severity, detail: F.struct(*[(x if isinstance(x, Column) else F.lit(x)).cast("string").alias(name) for x, name in ((column, "column"), (value, "value"), (rule, "rule"), (severity, "severity"), (detail, "detail"))])
    twice = F.col("twice")
    ragged = F.when((n != F.col("n_cols")) & (F.size(F.filter("numbers", lambda v: v.isNotNull())) >= 2), found(F.concat(n.cast("string"), F.lit("/"), F.col("n_cols").cast("string"), F.lit(" cols")), "", "ragged_row", "low", RAGGED))
    reference = F.when(F.abs(F.get("numbers", at)) >= LARGE, found("Thuyết minh", F.get("cells", at), "big_num_in_ref_col", "high", IN_REFERENCE))
    repeated = F.when(twice.isNotNull(), found(F.concat(F.lit("cols "), twice.cast("string"), F.lit(","), (twice + 1).cast("string")), grouped(F.get("numbers", twice)), "adjacent_duplicate", "high", TWICE))
    df = df.select("file", "table_idx", "row_idx", "cells", F.explode(F.filter(F.array(ragged, reference, repeated), lambda x: x.isNotNull())).alias("found"))
    given = {x: F.col(f"found.{x}") for x in ("column", "value", "rule", "severity", "detail")}
    return _finding(df, file=F.col("file"), table=F.col("table_idx"), row=F.col("row_idx"), ma_so=code_of(F.col("cells")), label=F.substring(longest(F.col("cells")), 1, 60), **given)


def has_code(code: str):
    return lambda entry: entry["ma_so"] == code


def arithmetic(rows: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Tier 2: income-statement identities, where the table has codes 01, 10 and 20 and code 01 is revenue."""
    codes = sorted({c for result, parts in IDENTITIES for c in (result, *parts)})
    df = rows.withColumn("ma_so", F.trim(code_of(F.col("cells")))).where(F.col("ma_so").isin(codes))
    df = df.withColumn("at", find_column(F.col("header"), "năm nay", "nam nay")).where("at IS NOT NULL AND at < size(cells)")
    df = df.select("file", "table_idx", "row_idx", "ma_so", F.substring(longest(F.col("cells")), 1, 50).alias("label"), parse_number(F.get("cells", F.col("at"))).alias("v")).where("v IS NOT NULL")
    # Of rows that repeat a code the last holds.  A table's coded rows are few; one list of them needs no sort by key.
    coded = F.array_sort(F.collect_list(F.struct("row_idx", "ma_so", "v", "label"))).alias("coded")
    wide = df.groupBy("file", "table_idx").agg(coded)
    last = {c: F.get(F.reverse(F.filter("coded", has_code(c))), F.lit(0)) for c in codes}
    named = ("01", *(result for result, _ in IDENTITIES))
    wide = wide.select("file", "table_idx", *[last[c]["v"].alias(f"v{c}") for c in codes], *[last[c]["label"].alias(f"l{c}") for c in named])
    wide = wide.where("v01 IS NOT NULL AND v10 IS NOT NULL AND v20 IS NOT NULL").where(label_key(F.col("l01")).contains("doanh thu"))
    out = None
    for result, parts in IDENTITIES:
        expected = sum((F.col(f"v{p}") for p in parts[1:]), F.col(f"v{parts[0]}"))
        off = wide.withColumn("expected", expected).where(F.abs(F.col("expected") - F.col(f"v{result}")) > tolerance)
        found = _finding(off, file=F.col("file"), table=F.col("table_idx"), row=-1, ma_so=result, label=F.col(f"l{result}"), column="Năm nay", value=grouped(F.col(f"v{result}")), rule="arithmetic_mismatch", severity="medium", detail=F.concat(F.lit(f"kỳ vọng {'+'.join(parts)}="), grouped(F.col("expected")), F.lit(", OCR="), grouped(F.col(f"v{result}"))))
        out = found if out is None else out.unionByName(found)
    return out


def comparatives(rows: DataFrame) -> DataFrame:
    """(file, key, current, prior) of labels that are unambiguous within a file: one distinct pair of figures, a label of 12 characters or more."""
    df = rows.withColumns({"c": find_column(F.col("header"), "năm nay", "nam nay", "số cuối", "so cuoi"), "p": find_column(F.col("header"), "năm trước", "nam truoc", "số đầu", "so dau")}).where("c IS NOT NULL AND p IS NOT NULL AND greatest(c, p) < size(cells)")
    others = F.filter("cells", lambda _, i: (i != F.col("c")) & (i != F.col("p")))
    df = df.select("file", label_key(longest(others)).alias("key"), parse_number(F.col("cells")[F.col("c")]).alias("current"), parse_number(F.col("cells")[F.col("p")]).alias("prior"))
    df = df.where(f"current IS NOT NULL AND prior IS NOT NULL AND abs(current) >= {LARGE} AND length(key) >= 12")
    return df.groupBy("file", "key").agg(F.count_distinct("current", "prior").alias("n"), F.first("current").alias("current"), F.first("prior").alias("prior")).where("n = 1").drop("n")


def cross_year(rows: DataFrame, adjacent_keys: bool = False) -> DataFrame:
    """Tier 3: a file's prior column against the current column of the year before, by label.  ``file`` is the year; with ``adjacent_keys``
    the neighbours are consecutive files in order, whatever their names."""
    pairs = comparatives(rows)
    if adjacent_keys:
        order = Window.orderBy("file")  # a row for each file
        files = rows.select("file").distinct().withColumn("before", F.lag("file").over(order))
    else:
        files = rows.select("file").distinct().withColumn("before", (F.col("file").try_cast("int") - 1).cast("string"))
    earlier = pairs.select(F.col("file").alias("before"), "key", F.col("current").alias("was"))
    off = pairs.join(files, "file").join(earlier, ["before", "key"]).where("prior <> was")
    return _finding(off, file=F.col("file"), table=-1, row=-1, ma_so="", label=F.substring("key", 1, 50), column=F.concat(F.lit("Năm trước (vs "), F.col("before"), F.lit(")")), value=grouped(F.col("prior")), rule="cross_year_mismatch", severity="high", detail=F.concat(F.col("file"), F.lit(" 'năm trước'="), grouped(F.col("prior")), F.lit(" ≠ "), F.col("before"), F.lit(" 'năm nay'="), grouped(F.col("was")), F.lit(" (có thể do trình bày lại)")))


def validate(rows: DataFrame) -> DataFrame:
    """All findings."""
    return structural(rows).unionByName(arithmetic(rows)).unionByName(cross_year(rows))


def in_order(findings: DataFrame) -> DataFrame:
    """Most severe first, then by place."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("severity"))
    return findings.orderBy(F.when(rank == 0, 10).otherwise(rank), "file", "table", "row", "rule")


def counts(findings: DataFrame) -> DataFrame:
    """Findings by rule and severity, with totals."""
    return findings.groupingSets([["rule", "severity"], ["severity"], []], "rule", "severity").agg(F.count("*").alias("n"))
