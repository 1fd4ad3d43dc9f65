"""Every query against its SQL on the smallest tables; those without SQL must give rows."""

import math

import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()
EMPTY = {"heading_breadcrumb_none", "ref_col_big", "score_gate_none"}


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 5)
    return x


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in SQL))
def test_query_equals_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    want = rows(columns, found.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, (float, int)) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5)) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL and not n.startswith("op") and n != "pipeline"))
def test_query_gives_rows(spark, data, name):
    assert len(QUERIES[name](spark, data).take(3)) > 0


def test_entry(spark):
    assert len(entry.entry(spark).columns) == 4


def test_document_year_reads_texts(spark):
    import re

    sf = "/root/testdata/sf0.1"
    found = {r["doc_id"]: re.search(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])", (r["text"] or "")[:2000]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want = {i: int(m[0]) for i, m in found.items() if m}
    got = {r["doc_id"]: r["year"] for r in QUERIES["document_year"](spark, sf).where("year IS NOT NULL").collect()}
    assert len(want) == 3 and got == want
