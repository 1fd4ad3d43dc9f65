from pyspark.sql import functions as F

from quillspark.operators import facts, validation
from quillspark.sources import writers

HEADER = ["Mã số", "CHỈ TIÊU", "Thuyết minh", "Năm nay", "Năm trước"]
ROWS = [
    ["01", "Doanh thu bán hàng và cung cấp dịch vụ", "30.1", "125.780.761", "110.755.497"],
    ["02", "Các khoản giảm trừ doanh thu", "30.1", "(92.891)", "(265.464)"],
    ["10", "Doanh thu thuần về bán hàng", "30.1", "125.687.870", "110.490.033"],
    ["20", "Lợi nhuận gộp về bán hàng và cung cấp", "34.064.705", "34.064.705", "17.312.806"],
    ["70", "Lãi cơ bản trên cổ phiếu", "", "500", "400"],
    ["01", "lặp lại", "", "1", "2"],
    ["", "Chi tiết"],
]


def rows(spark, year=2021, cells=ROWS):
    return spark.createDataFrame([(year, 0, i, c) for i, c in enumerate(cells)], "report_year int, table_idx int, row_idx int, cells array<string>")


def tables(spark, year="2021", cells=ROWS):
    return spark.createDataFrame([(year, 0, 5, HEADER, i, c) for i, c in enumerate(cells)], "file string, table_idx int, n_cols int, header array<string>, row_idx int, cells array<string>")


def test_facts_take_the_first_row_of_a_known_code(spark):
    got = {r["code"]: r for r in facts.facts(spark, rows(spark)).collect()}
    assert set(got) == {"01", "02", "10", "20", "70"} and got["01"]["value"] == 125780761.0 and got["02"]["value"] == -92891.0
    assert got["70"]["unit"] == "VND/cổ phiếu" and got["10"]["label"] == facts.INCOME["10"]
    assert facts.facts(spark, rows(spark, cells=ROWS[:2])).count() == 0


def test_consistency_and_graph(spark):
    later = [[*r[:3], "9", r[3]] if len(r) == 5 else r for r in ROWS]
    later[2] = [*later[2][:4], "1"]
    found = facts.facts(spark, rows(spark).unionByName(rows(spark, 2022, later)))
    agree = {r["code"]: r["agree"] for r in facts.consistency(found).collect()}
    assert agree == {"01": True, "02": True, "10": False, "20": True, "70": True}
    assert {r["code"] for r in facts.consistent(found).collect()} == set(agree) - {"10"}
    nodes, edges = facts.graph(found)
    assert nodes.where("kind = 'fact'").count() == 10 and edges.count() == 20 and nodes.where("kind = 'line_item'").count() == 5


def test_tier_one_flags_the_misfilled_row(spark):
    got = {(r["rule"], r["row"]) for r in validation.structural(tables(spark)).collect()}
    assert ("big_num_in_ref_col", 3) in got and ("adjacent_duplicate", 3) in got
    ragged = [["01", "x", "1.000", "2.000"], ["", "heading"]]
    assert {(r["rule"], r["row"]) for r in validation.structural(tables(spark, cells=ragged)).collect()} >= {("ragged_row", 0)}
    assert validation.structural(tables(spark, cells=[[], ["x"]])).count() == 0


def test_tier_two_identities(spark):
    assert validation.arithmetic(tables(spark)).count() == 0  # the repeated 01 counts last, and is no revenue
    assert validation.arithmetic(tables(spark, cells=ROWS[:5])).count() == 0
    wrong = [*ROWS[:2], ["10", "Doanh thu thuần", "", "125.687.999", "1"], *ROWS[3:5]]
    found = validation.arithmetic(tables(spark, cells=wrong)).collect()
    assert [(r["ma_so"], r["value"], r["severity"]) for r in found] == [("10", "125.687.999", "medium")]


def test_tier_three_needs_the_year_before(spark):
    later = [[*r[:3], "9.999", r[3]] for r in ROWS[:2]]
    later[1][4] = "(1)"
    both = tables(spark, cells=ROWS[:3]).unionByName(tables(spark, "2022", later))
    got = validation.cross_year(both).collect()
    assert [(r["file"], r["label"], r["value"]) for r in got] == [("2022", "các khoản giảm trừ doanh thu", "-1")]
    apart = tables(spark, cells=ROWS[:3]).unionByName(tables(spark, "2023", later))
    assert validation.cross_year(apart).count() == 0 and validation.cross_year(apart, adjacent_keys=True).count() == 1
    report = writers.findings_report(validation.validate(both))
    assert report.startswith("# Table validation") and "| cross_year_mismatch | high | 1 |" in report


def test_questions_are_numbered_once(spark):
    from quillspark.plans.statement_queries import found

    known = found(spark, "/root/testdata/sf0.001")
    carried = spark.createDataFrame([("a", "Chính sách nào?", "x", "policy", "thuyet_minh", None, [], "easy", "vi"), ("b", "?", "x", "numeric_single", "kqkd", 2021, [], "easy", "vi")], "id string, question string, ground_truth string, answer_type string, statement_type string, year int, gold_numbers array<string>, difficulty string, lang string")
    got = facts.questions(spark, known, "Orders", facts.carry(carried)).orderBy("id").collect()
    assert len({r["question"].lower() for r in got}) == len(got) and got[0]["id"] == "q-0001" and got[-1]["question"] == "Chính sách nào?"
    assert {r["answer_type"] for r in got} == {"numeric_single", "numeric_compare", "multi_year", "reasoning", "policy"}
    assert all(r["question"][0].isupper() for r in got) and {r["lang"] for r in got} == {"vi", "en"}


def test_questions_on_balances(spark):
    cells = [["100", "x", "", "10", "8"], ["110", "x", "", "(4)", "3"], ["200", "x", "", "5", "5"], ["270", "x", "", "15", "13"]]
    got = {r["question"]: r for r in facts.questions(spark, facts.facts(spark, rows(spark, 2022, cells)), "ABC").collect()}
    change = got["Tiền và các khoản tương đương tiền của ABC cuối năm 2022 so với đầu năm 2022 thay đổi thế nào?"]
    assert change["ground_truth"] == "Tiền và các khoản tương đương tiền cuối năm 2022 là âm 4 triệu VND, so với 3 triệu VND đầu năm." and change["gold_numbers"] == ["4", "3"]
    assert got["What was ABC's current assets in 2022?"]["ground_truth"] == "Current assets in 2022 was 10 triệu VND."
    assert len(got) == 4 + 4 + 1


def cut_lines(tmp_path, data):
    """Line items in two files, one line of each order in the first and two in the second, whose prices add up to half a unit; and the other tables."""
    import os
    import random

    import duckdb

    rng, first, second = random.Random(4), [], []
    for key in range(600):
        a, b = rng.randint(90_000, 10_499_999), rng.randint(90_000, 10_499_999)
        c = 9_000_050 + rng.randint(0, 9_999) * 100 - (a + b) % 100
        first.append((key, a / 100, rng.randint(0, 10) / 100))
        second += [(key, x / 100, rng.randint(0, 10) / 100) for x in (b, c)]
    con = duckdb.connect()
    con.execute("SET threads = 1")
    os.mkdir(tmp_path / "lineitem.parquet")
    con.execute(f"CREATE TABLE t AS SELECT * FROM '{data}/lineitem.parquet' LIMIT 0")
    for no, lines in enumerate((first, second)):
        con.execute("DELETE FROM t")
        con.executemany("INSERT INTO t (l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_linestatus) VALUES (?, 1, 1, 1, 1, ?, ?, 'O')", lines)
        con.execute(f"COPY t TO '{tmp_path}/lineitem.parquet/part-{no}.parquet' (FORMAT parquet)")
    os.symlink(f"{data}/orders.parquet", tmp_path / "orders.parquet")
    for name, path in (("lineitem", "lineitem.parquet/*.parquet"), ("orders", "orders.parquet")):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{path}'")
    return con


def test_identities_add_doubles_in_row_order(spark, data, tmp_path):
    """However the table is cut into files: the SQL on one thread has the same rows."""
    from quillspark.plans.statement_queries import QUERIES, SQL

    want = cut_lines(tmp_path, data).sql(SQL["arith_identity"]).fetchall()
    assert len(want) > 100 and sorted(map(tuple, QUERIES["arith_identity"](spark, str(tmp_path)).collect())) == sorted(want)


def test_report_counts_sums_in_row_order(spark, data, tmp_path):
    from quillspark.plans.statement_queries import QUERIES, SQL

    want = cut_lines(tmp_path, data).sql(SQL["findings_report"]).fetchall()
    got = [tuple(r) for r in QUERIES["findings_report"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[0] == "arithmetic_mismatch" for r in got)
