"""Line items of financial statements: facts, their series over periods, and checks across reports.

The long form ``rows`` is (report_year, table_idx, row_idx, cells).  A statement row has at least five cells, of which the last two are
figures: this period's and the one before.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.numbers import figure, grouped, is_number_cell, line_code
from quillspark.sources.writers import settled

# Line codes and labels of the national chart of accounts.
INCOME = {
    "01": "Doanh thu bán hàng và cung cấp dịch vụ",
    "02": "Các khoản giảm trừ doanh thu",
    "10": "Doanh thu thuần về bán hàng và cung cấp dịch vụ",
    "11": "Giá vốn hàng bán và dịch vụ cung cấp",
    "20": "Lợi nhuận gộp về bán hàng và cung cấp dịch vụ",
    "21": "Doanh thu hoạt động tài chính",
    "22": "Chi phí tài chính",
    "23": "Chi phí lãi vay",
    "24": "Phần lãi/lỗ trong công ty liên doanh, liên kết",
    "25": "Chi phí bán hàng",
    "26": "Chi phí quản lý doanh nghiệp",
    "30": "Lợi nhuận thuần từ hoạt động kinh doanh",
    "31": "Thu nhập khác",
    "32": "Chi phí khác",
    "40": "Lợi nhuận khác",
    "50": "Tổng lợi nhuận kế toán trước thuế",
    "51": "Chi phí thuế TNDN hiện hành",
    "52": "Chi phí thuế TNDN hoãn lại",
    "60": "Lợi nhuận sau thuế thu nhập doanh nghiệp",
    "61": "Lợi nhuận sau thuế của cổ đông công ty mẹ",
    "62": "Lợi nhuận sau thuế của cổ đông không kiểm soát",
    "70": "Lãi cơ bản trên cổ phiếu",
    "71": "Lãi suy giảm trên cổ phiếu",
}
ASSETS = {
    "100": "Tài sản ngắn hạn",
    "110": "Tiền và các khoản tương đương tiền",
    "120": "Đầu tư tài chính ngắn hạn",
    "130": "Các khoản phải thu ngắn hạn",
    "140": "Hàng tồn kho",
    "150": "Tài sản ngắn hạn khác",
    "200": "Tài sản dài hạn",
    "270": "Tổng cộng tài sản",
}
RESOURCES = {
    "300": "Nợ phải trả",
    "310": "Nợ ngắn hạn",
    "330": "Nợ dài hạn",
    "400": "Vốn chủ sở hữu",
    "410": "Vốn chủ sở hữu (mục I)",
    "411": "Vốn cổ phần đã phát hành",
    "412": "Thặng dư vốn cổ phần",
    "421": "Lợi nhuận sau thuế chưa phân phối",
    "429": "Lợi ích cổ đông không kiểm soát",
    "440": "Tổng cộng nguồn vốn",
}
CASH = {
    "20": "Lưu chuyển tiền thuần từ hoạt động kinh doanh",
    "30": "Lưu chuyển tiền thuần từ hoạt động đầu tư",
    "40": "Lưu chuyển tiền thuần từ hoạt động tài chính",
    "50": "Lưu chuyển tiền thuần trong kỳ",
    "60": "Tiền và tương đương tiền đầu kỳ",
    "70": "Tiền và tương đương tiền cuối kỳ",
}
#: Statements that tables are matched with: (name, labels, codes that must be there).
STATEMENTS = (("kqkd", INCOME, ("10", "20")), ("cdkt_ts", ASSETS, ("100",)), ("cdkt_nv", RESOURCES, ("400",)))
PER_SHARE = ("70", "71")
LEAST_CODES = 3


def labels(spark: SparkSession) -> DataFrame:
    """The dimension of (statement, code, label, unit); a fixed list."""
    rows = [(s, c, label, "VND/cổ phiếu" if s == "kqkd" and c in PER_SHARE else "triệu VND") for s, codes, _ in (*STATEMENTS, ("lctt", CASH, ())) for c, label in codes.items()]
    return spark.createDataFrame(rows, "statement string, code string, label string, unit string")


def statement_rows(rows: DataFrame) -> DataFrame:
    """Rows of tables that are recognised as a statement: report_year, table_idx, row_idx, statement, code, current_raw, prior_raw.

    A table is the statement with which it shares most codes, at least three, among those whose required codes it has; ties go to the first."""
    cells = F.col("cells")
    ok = (F.size(cells) >= 5) & is_number_cell(F.element_at(cells, -1)) & is_number_cell(F.element_at(cells, -2))
    coded = rows.where(ok).select("report_year", "table_idx", "row_idx", line_code(F.get(cells, F.lit(0))).alias("code"), F.trim(F.element_at(cells, -2)).alias("current_raw"), F.trim(F.element_at(cells, -1)).alias("prior_raw")).where("code IS NOT NULL")
    codes = coded.groupBy("report_year", "table_idx").agg(F.collect_set("code").alias("codes"))  # bounded: codes have three characters
    known = lambda items: F.array(*[F.lit(c) for c in items])
    scores = [F.struct(F.when(F.size(F.array_intersect(known(need), "codes")) == len(need), F.size(F.array_intersect(known(items), "codes"))).otherwise(0).alias("score"), F.lit(-no).alias("before"), F.lit(name).alias("statement")) for no, (name, items, need) in enumerate(STATEMENTS)]
    found = codes.select("report_year", "table_idx", F.greatest(*scores).alias("best")).where(F.col("best.score") >= LEAST_CODES)
    return coded.join(found.select("report_year", "table_idx", F.col("best.statement").alias("statement")), ["report_year", "table_idx"])


def facts(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """One fact for each (report year, statement, code), the first row that has it: statement, code, label, year, value_raw, value, unit, prior_raw."""
    found = statement_rows(rows).join(F.broadcast(labels(spark)), ["statement", "code"])
    first = F.row_number().over(Window.partitionBy("report_year", "statement", "code").orderBy("table_idx", "row_idx"))
    return found.withColumn("n", first).where("n = 1").select("statement", "code", "label", F.col("report_year").alias("year"), F.col("current_raw").alias("value_raw"), figure(F.col("current_raw")).alias("value"), "unit", "prior_raw")


def consistency(found: DataFrame) -> DataFrame:
    """(statement, code, checks, agree): a report's figure against the prior column of the next year's report, by digits alone."""
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    following = found.select("statement", "code", (F.col("year") - 1).alias("year"), F.col("prior_raw").alias("later"))
    return found.join(following, ["statement", "code", "year"]).groupBy("statement", "code").agg(F.count("*").alias("checks"), F.bool_and(digits(F.col("value_raw")) == digits(F.col("later"))).alias("agree"))


def consistent(found: DataFrame) -> DataFrame:
    """Facts of line items that no check contradicts."""
    return found.join(consistency(found).where("NOT agree"), ["statement", "code"], "left_anti")


def graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, kind, label) and edges (src, dst, rel) of the fact graph: facts point to their line item and their period."""
    item, period = F.concat_ws(":", F.lit("item"), "statement", "code"), F.concat(F.lit("period:"), F.col("year").cast("string"))
    fact = F.concat_ws(":", F.lit("fact"), "statement", "code", F.col("year").cast("string"))
    nodes = found.select(item.alias("node"), F.lit("line_item").alias("kind"), "label").distinct()
    nodes = nodes.union(found.select(period, F.lit("period"), F.col("year").cast("string")).distinct()).union(found.select(fact, F.lit("fact"), "value_raw"))
    edges = found.select(fact.alias("src"), item.alias("dst"), F.lit("OF_ITEM").alias("rel")).union(found.select(fact, period, F.lit("IN_PERIOD")))
    return nodes, edges


SERIES = ("statement", "code")


def changes(found: DataFrame) -> DataFrame:
    """Consecutive points of each series: year, value, the year and value before, delta and direction."""
    w = Window.partitionBy(*SERIES).orderBy("year")
    df = found.select(*SERIES, "label", "unit", "year", "value", "value_raw", F.lag("year").over(w).alias("year_before"), F.lag("value").over(w).alias("value_before"), F.lag("value_raw").over(w).alias("raw_before")).where("year_before IS NOT NULL")
    delta = F.col("value") - F.col("value_before")
    return df.withColumn("delta", delta).withColumn("direction", F.when(delta > 0, "tăng").when(delta < 0, "giảm").otherwise("không đổi"))


def growth(found: DataFrame, least: int = 4) -> DataFrame:
    """First and last point of series with enough points, both positive, and their multiple."""
    ends = found.groupBy(*SERIES).agg(F.count("*").alias("points"), *[f(F.struct("value", "value_raw"), "year").alias(n) for f, n in ((F.min_by, "first"), (F.max_by, "last"))], F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    df = ends.where((F.col("points") >= least) & (F.col("first.value") > 0) & (F.col("last.value") > 0))
    return df.select(*SERIES, "points", "first_year", "last_year", F.col("first.value").alias("first_value"), F.col("last.value").alias("last_value"), F.col("first.value_raw").alias("first_raw"), F.col("last.value_raw").alias("last_raw"), (F.col("last.value") / F.col("first.value")).alias("multiple"))


def peak(found: DataFrame, least: int = 4) -> DataFrame:
    """The year of the largest value of each series with enough points; the earliest of equals."""
    best = F.max_by(F.struct("year", "value", "value_raw"), F.struct(F.col("value"), -F.col("year")))
    df = found.groupBy(*SERIES).agg(F.count("*").alias("points"), best.alias("b"), F.min("year").alias("first_year"), F.max("year").alias("last_year")).where(F.col("points") >= least)
    return df.select(*SERIES, "points", "first_year", "last_year", F.col("b.year").alias("year"), F.col("b.value").alias("value"), F.col("b.value_raw").alias("value_raw"))


def ratio(found: DataFrame, over: str, under: str, statement: str = "kqkd") -> DataFrame:
    """One item as a percentage of another by year; years in which the other is 0 are left out."""
    pick = lambda code, c: F.max(F.when(F.col("code") == code, F.col(c)))
    df = found.where(F.col("statement") == statement).groupBy("year").agg(pick(over, "value").alias("over"), pick(under, "value").alias("under"), pick(over, "value_raw").alias("over_raw"), pick(under, "value_raw").alias("under_raw"))
    return df.where("over IS NOT NULL AND under <> 0").select("year", "over", "under", "over_raw", "under_raw", (F.col("over") / F.col("under") * 100).alias("percent"))


# Line items that are asked about beyond lookups and yearly changes, in order, and English names of some.
HEADLINE = (
    ("kqkd", "01"), ("kqkd", "10"), ("kqkd", "11"), ("kqkd", "20"), ("kqkd", "21"), ("kqkd", "22"), ("kqkd", "25"), ("kqkd", "26"),
    ("kqkd", "50"), ("kqkd", "60"), ("kqkd", "61"), ("cdkt_ts", "100"), ("cdkt_ts", "110"), ("cdkt_ts", "140"), ("cdkt_nv", "300"),
    ("cdkt_nv", "400"), ("cdkt_nv", "440"),
)
ENGLISH = {
    "10": "net revenue from sales of goods and services",
    "20": "gross profit",
    "50": "profit before tax",
    "60": "profit after tax",
    "440": "total resources (equals total assets)",
    "100": "current assets",
    "400": "owners' equity",
}
# Wording of questions and answers; names in braces are columns, {company} is the report's owner.
LOOKUPS = (
    "{low} của {company} {period} là bao nhiêu?",
    "Cho biết {low} của Tập đoàn {company} {period}.",
    "Giá trị {low} {period} trên báo cáo hợp nhất của {company} là bao nhiêu?",
)
LOOKUP_ANSWER = "{label} {period} là {shown}."
YEARLY = ("{label} của {company} năm {year} thay đổi thế nào so với năm {year_before}?", "{label} năm {year} là {shown}, {direction} so với {shown_before} năm {year_before}.")
TREND = ("{label} của {company} các năm {first_year}–{last_year} lần lượt là bao nhiêu?", "{label} qua các năm ({unit}) — {points}.")
GROWTH = ("{label} của {company} năm {last_year} gấp khoảng bao nhiêu lần năm {first_year}?", "{label} tăng từ {first_raw} ({first_year}) lên {last_raw} ({last_year}), tức khoảng {multiple} lần.")
PEAK = ("Trong giai đoạn {first_year}–{last_year}, năm nào {company} có {low} cao nhất?", "Cao nhất vào năm {year} với {shown}.")
MARGINS = (("Biên lợi nhuận gộp", "20", "10"), ("Biên lợi nhuận ròng", "60", "10"))
MARGIN = ("{name} của {company} năm {year} xấp xỉ bao nhiêu phần trăm?", "{name} năm {year} ≈ {percent}% ({over_label} {over_raw} / {under_label} {under_raw}).")
OPENING = ("{label} của {company} cuối năm {year} so với đầu năm {year} thay đổi thế nào?", "{label} cuối năm {year} là {shown}, so với {prior_raw} triệu VND đầu năm.")
ABROAD = ("What was {company}'s {name} in {year}?", "{title} in {year} was {value_raw} {unit}.")
DELTA = ("{label} của {company} năm {year} {way} bao nhiêu triệu VND so với năm {year_before}?", "{label} {way} khoảng {amount} triệu VND ({value_raw} năm {year} so với {raw_before} năm {year_before}).")
QUESTION = "part int, o1 int, o2 int, question string, ground_truth string, answer_type string, statement string, years array<int>, gold_numbers array<string>, difficulty string, lang string"


def filled(template: str, company: str) -> Column:
    """A template with columns in place of the names in braces."""
    parts = re.split(r"\{(\w+)\}", template.replace("{company}", company))
    return F.concat(*[F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts) if i % 2 or x])


def shown(raw: str, value: str) -> Column:
    """A figure with its unit; parentheses read as a minus in words."""
    return F.concat(F.when(F.col(value) < 0, F.concat(F.lit("âm "), bare(raw))).otherwise(F.col(raw)), F.lit(" "), F.col("unit"))


def bare(raw: str) -> Column:
    return F.regexp_replace(F.col(raw), r"^[()]+|[()]+$", "")


def questions(spark: SparkSession, found: DataFrame, company: str, carried: DataFrame | None = None) -> DataFrame:
    """Question set over facts: lookups, yearly changes, trends, growth, peaks, margins, opening against closing balances, English lookups,
    amounts of change, and questions carried over.  Items that a check contradicts are left out, except from margins.  A question asked before
    (whatever its case) is dropped, the rest are numbered.

    Columns: id, question, ground_truth, answer_type, statement, years, gold_numbers, difficulty, lang.  The windows below order line items
    and questions, which are bounded by the chart of accounts and the years."""
    found = settled(spark, found)
    kept = settled(spark, consistent(found))
    flow = ~F.col("statement").startswith("cdkt")
    items = kept.select("statement", "code").distinct().withColumn("item", F.row_number().over(Window.orderBy("statement", "code")) - 1)
    headline = spark.createDataFrame([(st, c, i, ENGLISH.get(c)) for i, (st, c) in enumerate(HEADLINE)], "statement string, code string, head int, name string")
    low = F.concat(F.lower(F.substring("label", 1, 1)), F.expr("substring(label, 2)"))
    period = F.when(flow, F.concat(F.lit("năm "), F.col("year").cast("string"))).otherwise(F.concat(F.lit("tại ngày 31/12/"), F.col("year").cast("string")))
    base = kept.join(F.broadcast(items), list(SERIES)).withColumns({"low": low, "period": period, "shown": shown("value_raw", "value"), "bare": bare("value_raw")})
    moved = changes(kept).where(flow).join(F.broadcast(items), list(SERIES)).withColumns({"shown": shown("value_raw", "value"), "shown_before": shown("raw_before", "value_before"), "bare": bare("value_raw"), "bare_before": bare("raw_before")})
    series = base.groupBy(*SERIES, "label", "low", "unit", "item").agg(F.array_sort(F.collect_list(F.struct("year", "bare"))).alias("p")).where("size(p) >= 4")
    series = series.withColumns({"years": F.transform("p", lambda x: x["year"]), "raws": F.transform("p", lambda x: x["bare"]), "points": F.array_join(F.transform("p", lambda x: F.concat(F.lit("năm "), x["year"].cast("string"), F.lit(": "), x["bare"])), ", ")})
    series = series.withColumns({"first_year": F.element_at("years", 1), "last_year": F.element_at("years", -1)})
    out = []

    def add(df: DataFrame, part: int, order, texts, kind: str, years: Column, golds: list, level, lang: str = "vi") -> None:
        question, truth = (t if isinstance(t, Column) else filled(t, company) for t in texts)
        question = F.concat(F.upper(F.substring(question, 1, 1)), F.substr(question, F.lit(2)))
        golds = golds if isinstance(golds, Column) else F.array(*golds)
        columns = [F.lit(part), *(F.col(o) if isinstance(o, str) else F.lit(o) for o in order), question, truth, F.lit(kind), F.col("statement"), years, golds, level if isinstance(level, Column) else F.lit(level), F.lit(lang)]
        out.append(df.select(*[c.cast(f.split(" ")[1]).alias(f.split(" ")[0]) for c, f in zip(columns, QUESTION.split(", "), strict=True)]))

    turn = F.pmod(F.col("item") + F.col("year"), F.lit(len(LOOKUPS)))
    form = F.coalesce(*[F.when(turn == i, filled(t, company)) for i, t in enumerate(LOOKUPS)])
    add(base, 1, ("item", "year"), (form, LOOKUP_ANSWER), "numeric_single", F.array("year"), ["bare"], F.when(F.col("code").isin("01", "10", "440"), "easy").otherwise("medium"))
    add(moved, 2, ("item", "year"), YEARLY, "numeric_compare", F.array("year_before", "year"), ["bare", "bare_before"], "medium")
    add(series, 3, ("item", 0), TREND, "multi_year", F.col("years"), F.col("raws"), "hard")
    named = series.select(*SERIES, "label", "low", "unit", "years").join(F.broadcast(headline), list(SERIES))
    grown = growth(kept).join(F.broadcast(named), list(SERIES)).withColumn("multiple", F.format_string("%.1f", "multiple"))
    add(grown, 4, ("head", 0), GROWTH, "reasoning", F.array("first_year", "last_year"), [bare("first_raw"), bare("last_raw")], "hard")
    top = peak(kept).join(F.broadcast(named), list(SERIES)).withColumn("shown", shown("value_raw", "value"))
    add(top, 4, ("head", 1), PEAK, "reasoning", F.col("years"), [bare("value_raw")], "hard")
    for no, (name, over, under) in enumerate(MARGINS):
        df = ratio(found, over, under).withColumns({"statement": F.lit("kqkd"), "name": F.lit(name), "percent": F.format_string("%.1f", "percent"), "over_label": F.lit(INCOME[over].lower()), "under_label": F.lit(INCOME[under].lower())})
        add(df, 5, (no, "year"), MARGIN, "reasoning", F.array("year"), [bare("over_raw"), bare("under_raw")], "hard")
    add(base.where(~flow), 6, ("item", "year"), OPENING, "numeric_compare", F.array("year"), ["bare", bare("prior_raw")], "medium")
    abroad = base.join(F.broadcast(headline.where("name IS NOT NULL")), list(SERIES)).withColumn("title", F.concat(F.upper(F.substring("name", 1, 1)), F.expr("substring(name, 2)")))
    add(abroad, 7, ("head", "year"), ABROAD, "numeric_single", F.array("year"), ["bare"], "medium", "en")
    amounts = moved.join(F.broadcast(headline), list(SERIES)).withColumns({"way": F.when(F.col("delta") > 0, "tăng").otherwise("giảm"), "amount": grouped(F.floor(F.abs("delta")))})
    add(amounts, 8, ("head", "year"), DELTA, "reasoning", F.array("year_before", "year"), ["bare", "bare_before"], "hard")
    every = out[0]
    for df in out[1:]:
        every = every.unionByName(df)
    if carried is not None:
        every = every.unionByName(carried)
    once = every.withColumn("n", F.row_number().over(Window.partitionBy(F.lower(F.trim("question"))).orderBy("part", "o1", "o2"))).where("n = 1")
    number = F.row_number().over(Window.orderBy("part", "o1", "o2"))
    return once.withColumn("id", F.concat(F.lit("q-"), F.lpad(number.cast("string"), 4, "0"))).drop("part", "o1", "o2", "n")


def carry(items: DataFrame) -> DataFrame:
    """Text questions of an earlier set (as ``readers.questions`` gives them) in the form that ``questions`` adds to its own."""
    kept = items.where(F.col("answer_type").isin("factual", "policy", "reasoning", "unanswerable"))
    order = F.row_number().over(Window.orderBy("id"))
    years = F.when(F.col("year").isNotNull(), F.array("year")).otherwise(F.array().cast("array<int>"))
    return kept.select(F.lit(9).alias("part"), order.alias("o1"), F.lit(0).alias("o2"), "question", "ground_truth", "answer_type", F.col("statement_type").alias("statement"), years.alias("years"), "gold_numbers", "difficulty", "lang")
