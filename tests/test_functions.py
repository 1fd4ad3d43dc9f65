import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.functions import metrics, numbers, text
from quillspark.operators import evaluation, retrieval, sessions, tables
from quillspark.sources import readers, writers


def one(spark, column, **values):
    kinds = {str: "string", int: "long", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("cell, value", [("125.780.761", 125780761.0), ("(92.891)", -92891.0), ("30.1", 301.0), ("-5", -5.0), ("4,5", 4.5), ("", None), ("n/a", None), (None, None), ("(-3)", 3.0)])
def test_parse_number(spark, cell, value):
    assert one(spark, numbers.parse_number(F.col("c")), c=cell) == value


@pytest.mark.parametrize("cell, is_number, value", [("(5", True, 5.0), ("(1.234)", True, -1234.0), ("-7", True, 7.0), ("1,5", False, 15.0), ("...", False, 0.0)])
def test_statement_figures(spark, cell, is_number, value):
    assert one(spark, numbers.is_number_cell(F.col("c")), c=cell) == is_number
    assert one(spark, numbers.figure(F.col("c")), c=cell) == value


@pytest.mark.parametrize("token, form", [("125.780.761", "125780761"), ("4,5", "4.5"), ("4,50", "4.5"), ("1.234,00", "1234"), ("(007)", "7"), ("30%", "30"), ("1,234,567", "1234567"), ("abc", None), ("", None), ("0", "0"), ("1,234", "1234")])
def test_canonical(spark, token, form):
    assert one(spark, numbers.canonical(F.col("c")), c=token) == form


def test_numbers_in_texts(spark):
    t = "Doanh thu 125.780.761, giảm trừ (92.891) năm 2021"
    assert one(spark, numbers.numbers_in(F.col("t")), t=t) == ["125780761", "2021", "92891"]
    assert one(spark, numbers.signed_numbers_in(F.col("t")), t=t) == ["125780761", "-92891", "2021"]
    assert one(spark, metrics.number_recall(F.col("t"), F.col("g")), t=t, g=["92.891", "3"]) == 0.5
    assert one(spark, metrics.number_recall(F.col("t"), F.col("g")), t=t, g=["x"]) is None


def test_plain_text_and_nfc(spark):
    rows = ["<td>Doanh thu</td> <td>125.780.761</td>", "| Doanh thu | 125.780.761 |\n|---|---|"]
    assert {one(spark, text.plain_text(F.col("t")), t=r) for r in rows} == {"Doanh thu 125.780.761"}
    assert one(spark, text.nfc(F.col("t")), t="é") == "é"


def test_lexical_metrics_against_plain_python(spark):
    rng = random.Random(5)
    pairs = [(i, " ".join(rng.choices("abcdef", k=rng.randint(0, 12))), " ".join(rng.choices("abcdef", k=rng.randint(0, 12)))) for i in range(60)]
    df = spark.createDataFrame(pairs, "k long, a string, b string")
    f1 = {r["k"]: r["f1"] for r in metrics.overlap_f1(df, ["k"], "a", "b", "f1").collect()}
    got = {r["k"]: r for r in df.select("k", metrics.rouge_l(F.split("a", " "), F.split("b", " ")).alias("rouge"), metrics.token_distance(text.tokens(F.col("a")), text.tokens(F.col("b"))).alias("d"), F.size(F.array_intersect(metrics.bag(text.tokens(F.col("a"))), metrics.bag(text.tokens(F.col("b"))))).alias("shared")).collect()}

    def lcs(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if p == q else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            row, old = [i], row
            for j, q in enumerate(y, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (p != q)))
        return row[-1]

    for k, a, b in pairs:
        x, y = a.split(), b.split()
        shared = sum((Counter(x) & Counter(y)).values())
        assert got[k]["shared"] == shared
        assert math.isclose(f1[k], 2 * shared / (len(x) + len(y)) if shared else 0.0)
        x1, y1 = a.split(" "), b.split(" ")
        assert math.isclose(got[k]["rouge"], 2 * lcs(x1, y1) / (len(x1) + len(y1)))
        assert got[k]["d"] == distance(x, y)


def test_ranking_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 20, 1)], "qid long, id long, rank int")
    relevant = spark.createDataFrame([(1, 11), (1, 12), (1, 99), (2, 21), (3, 1)], "qid long, id long")
    got = {r["qid"]: r for r in metrics.ranking_metrics(ranked, relevant, (1, 3)).collect()}
    assert (got[1]["recall_3"], got[1]["precision_1"], got[1]["hit_1"], got[1]["mrr"]) == (2 / 3, 0.0, 0, 0.5)
    assert math.isclose(got[1]["ap"], (1 / 2 + 2 / 3) / 3)
    ideal = 1 + 1 / math.log2(3) + 1 / 2
    assert math.isclose(got[1]["ndcg_3"], (1 / math.log2(3) + 1 / 2) / ideal)
    assert got[2]["mrr"] == got[3]["recall_3"] == got[3]["precision_3"] == 0.0


def test_mmr(spark):
    rows = [(1, 1, 1, 1.0, [1.0, 0.0]), (1, 2, 2, 0.99, [0.99, 0.01]), (1, 3, 3, 0.6, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "qid long, id long, rank long, score double, vector array<double>")
    assert {r["id"] for r in retrieval.mmr(df, 2, 0.5).collect()} == {1, 3}
    assert [r["id"] for r in retrieval.mmr(df, 5, 0.6).orderBy("place").collect()] == [1, 2, 3]
    assert [r["id"] for r in retrieval.mmr(df, 2, 1.0).orderBy("place").collect()] == [1, 2]


def test_fusion_is_symmetric_and_collapse_idempotent(spark):
    a = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "qid long, id long, rank int")
    b = spark.createDataFrame([(1, 6, 1), (1, 7, 2)], "qid long, id long, rank int")
    one_way, other = (sorted(map(tuple, retrieval.rrf(x, 5).collect())) for x in ([a, b], [b, a]))
    assert one_way == other and one_way[1][:2] == (1, 6)
    hits = spark.createDataFrame([(1, 1, 0.9, "d:t1", "FULL", "A"), (1, 2, 0.8, "d:t1", "FULL", "B"), (1, 3, 0.5, "", "", "prose")], "qid long, id long, score double, parent_id string, parent_text string, text string")
    once = retrieval.collapse_parents(hits)
    assert sorted((r["id"], r["text"]) for r in once.collect()) == [(1, "FULL"), (3, "prose")]
    assert sorted(map(tuple, retrieval.collapse_parents(once).collect())) == sorted(map(tuple, once.collect()))


def test_html_tables(spark):
    page = 'x<table border=1><tr><th>Mã số</th><th>Năm nay</th></tr><tr><td>01</td><td>125.780.761</td></tr><tr><td>02</td><td>a|b</td></tr></table>\n\n\n\n<div><img src="seal.png"/></div>y'
    df = spark.createDataFrame([(1, page)], "page int, markdown string")
    record = tables.table_records(df).first()
    assert (record["header"], record["n_rows"], record["n_cols"], record["rows"][0]) == (["Mã số", "Năm nay"], 2, 2, ["01", "125.780.761"])
    clean, kept = df.select(tables.clean_markdown(F.col("markdown")).alias("a"), tables.clean_markdown(F.col("markdown"), False).alias("b")).first()
    assert "| Mã số | Năm nay |\n|---|---|\n| 01 | 125.780.761 |\n| 02 | a\\|b |" in clean and "<" not in clean and "\n\n\n" not in clean and "<img" in kept


def test_grids_of_untidy_tables():
    assert tables.grid_of("<table><tr class='r'><td>a &amp; b<br/>c</td><th> d </th></tr><!-- x --><TR><TD>1 &lt; 2<!-- gone --></TD ></TR></table>") == [["a & bc", "d"], ["1 < 2"]]
    assert tables.grid_of("<table><tr><td>open<td>closed</td><tr><td>second</td></tr><td>no row</td></table>") == [["second"]]
    assert tables.grid_of("<table><tr><td>open<td>closed</td></tr><tr></tr></table>") == [["closed"], []]
    assert tables.grid_of("") == [] and tables.grid_of("<tr><td>5 > 3 &eacute;</td></tr>") == [["5 > 3 é"]]


def test_files(spark, tmp_path):
    (tmp_path / "2021_tables.json").write_text(json.dumps({"tables": [{"index": 3, "n_rows": 1, "n_cols": 2, "header": ["a", "b"], "rows": [["1"]]}]}))
    (tmp_path / "list.json").write_text(json.dumps([{"header": [], "rows": [["x", "y"]]}]))
    (tmp_path / "any.json").write_text(json.dumps({"k": [{"p": 1, "q": None}, {"p": True}], "n": {"z": [1, "two"]}}))
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "doc.md").write_text("# Hi")
    got = {r["name"]: r["text"] for r in readers.json_documents(spark, str(tmp_path)).collect()}
    assert got["2021_tables"] == "# 2021_tables\n\n## Table 3\n| a | b |\n| --- | --- |\n| 1 |  |\n"
    assert got["list"] == "# list\n\n## Table 0\n| x | y |\n"
    assert got["any"] == "# any\n\n- **k**:\n  | p | q |\n  | --- | --- |\n  | 1 |  |\n  | true |  |\n\n- **n**:\n  - **z**:\n    - 1\n    - two\n"
    assert got["bad"] == "{not json"
    assert [tuple(r) for r in readers.markdown(spark, str(tmp_path)).collect()] == [("doc.md", "# Hi")]
    rows = readers.statement_tables(spark, str(tmp_path)).collect()
    assert [(r["file"], r["table_idx"], r["n_cols"], r["row_idx"], r["cells"]) for r in rows] == [("2021", 0, 2, 0, ["1"])]
    found = {r["name"]: r["kind"] for r in readers.discover(spark, str(tmp_path)).collect()}
    assert found["doc.md"] == "md" and found["bad.json"] == "json"


def test_files_that_are_not_taken_carry_an_error(spark, tmp_path, monkeypatch):
    for name, text in (("a.md", "# A"), ("b.markdown", "B"), ("c.JSON", '{"k": 1}'), ("d.json", '{"k": 1}'), ("e.exe", "x"), ("noext", "x"), ("f.tar.gz", "x"), ("long.md", "y" * 50)):
        (tmp_path / name).write_text(text)
    monkeypatch.setattr(readers, "MOST_BYTES", 20)
    got = {r["name"]: (r["kind"], r["error"]) for r in readers.discover(spark, str(tmp_path)).collect()}
    assert got["a.md"] == ("md", None) and got["b.markdown"] == ("md", None) and got["c.JSON"] == ("json", None)
    assert got["e.exe"] == (None, "Unsupported file type: .exe") and got["noext"] == (None, "Unsupported file type: (none)") and got["f.tar.gz"][1] == "Unsupported file type: .gz"
    assert got["long.md"] == ("md", "File too large: 50 of 20 bytes")
    texts = {r["name"]: (r["text"], r["error"] is None) for r in readers.documents(spark, str(tmp_path)).collect()}
    assert len(texts) == 8 and texts["a.md"] == ("# A", True) and texts["b.markdown"] == ("B", True) and texts["d.json"][0].startswith("# d") and texts["e.exe"] == (None, False) and texts["long.md"] == (None, False)


def test_page_report(spark, tmp_path):
    pairs = spark.createDataFrame([("p1", "Tổng 1.234 và 5", "Tổng 1.234 và 6"), ("p2", "same text 7", "same text 7"), ("p3", "", "lost 8")], "page string, pred string, gold string")
    scored = evaluation.pages(pairs)
    rows = {r["page"]: r for r in scored.collect()}
    got = writers.write_page_report(scored, str(tmp_path / "out"), "Trial", skipped=2)
    shared, predicted, gold = (sum(r[c] for r in rows.values()) for c in ("numbers_shared", "n_numbers", "n_gold_numbers"))
    assert (got["numbers_matched"], got["numbers_gold"], got["pages_scored"], got["pages_skipped"]) == (shared, gold, 3, 2)
    assert got["micro_number_precision"] == round(shared / predicted, 4) and got["micro_number_recall"] == round(shared / gold, 4)
    assert got["macro_cer"] == round(sum(r["cer"] for r in rows.values()) / 3, 4)
    head = spark.read.text(f"{tmp_path}/out/report/0_head", wholetext=True).first()["value"]
    assert head.startswith("# Trial\nPages scored: 3 | skipped: 2") and f"({shared}/{gold}) |" in head
    lines = sorted(r["value"] for r in spark.read.text(f"{tmp_path}/out/report/1_pages").collect())
    assert len(lines) == 3 and lines[1] == "| p2 | 100.00% | 0.00% | 0.00% | 100.00% | 100.00% | 1/1 |"
    assert spark.read.json(f"{tmp_path}/out/per_page").count() == 3
    none = writers.write_page_report(scored.limit(0), str(tmp_path / "none"))
    assert none["pages_scored"] == 0 and none["micro_word_f1"] == 0.0


def test_pages_isolate_failures_and_merge(spark):
    df = spark.createDataFrame([("a", b"one|two"), ("b", b"bad"), ("c", b" |x")], "path string, content binary")

    def extract(content):
        if content == b"bad":
            raise ValueError("broken")
        return content.decode().split("|")

    got = sorted(readers.pages(df, extract).collect(), key=lambda r: (r["path"], r["page_no"] or 0))
    assert [(r["path"], r["page_no"], r["text"], r["error"]) for r in got] == [("a", 1, "one", None), ("a", 2, "two", None), ("b", None, None, "broken"), ("c", 2, "x", None)]
    merged = writers.merge_pages(spark.createDataFrame([("d", 2, "B"), ("d", 1, "A")], "doc_id string, page_no int, text string")).first()["text"]
    assert merged == "<!-- ===== page 1 ===== -->\n\nA\n\n<!-- ===== page 2 ===== -->\n\nB"


def test_sessions(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 else "system", f"t{i}") for i in range(9)], "c long, turn long, role string, text string")
    assert [r["turn"] for r in sessions.last_turns(turns, "c", "turn", 3).orderBy("place").collect()] == [6, 7, 8]
    assert one(spark, text.doc_year(F.col("n"), F.col("t")), n="2021_bctc.md", t="năm 2022") == 2021
    assert one(spark, text.doc_year(F.col("n"), F.col("t")), n="bctc.md", t="mã 20221, năm 2022") == 2022
    assert one(spark, text.progress(F.col("d"), F.col("n")), d=5, n=5) == 95


def test_bag_is_linear_in_its_words(spark):
    """A pass over the words, not a table of all of them for each one: 200,000 words would take minutes."""
    import time

    long = spark.range(2).select(F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: F.concat(F.lit("w"), (i % 50_000).cast("string"))).alias("w"))
    began = time.time()
    assert [r["n"] for r in long.select(F.size(F.array_intersect(metrics.bag("w"), metrics.bag("w"))).alias("n")).collect()] == [200_000] * 2
    assert time.time() - began < 60
