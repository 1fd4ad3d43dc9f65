"""Tables inside documents: HTML grids, records, and JSON of unknown shape."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillspark.functions.text import pipe_table, strip, strip_html

TABLE = re.compile(r"<table.*?</table>", re.S | re.I)


#: Where rows and cells begin and end; whatever else stands in angle brackets goes.
ROW, ROW_END = re.compile(r"<tr\b[^>]*>", re.I), re.compile(r"</tr\s*>", re.I)
CELL, CELL_END = re.compile(r"<t[dh]\b[^>]*>", re.I), re.compile(r"</t[dh]\s*>", re.I)
TAG = re.compile(r"<!--.*?-->|</?[a-z!][^>]*>", re.I | re.S)


def between(text: str, begin: re.Pattern, end: re.Pattern) -> list[str]:
    """What lies between a begin and the next end; a begin that meets another one first holds nothing."""
    parts = (end.split(part, maxsplit=1) for part in begin.split(text)[1:])
    return [part[0] for part in parts if len(part) == 2]


def grid_of(table: str) -> list[list[str]]:
    """Texts of the cells, row by row; spans are not expanded."""
    return [[unescape(TAG.sub("", cell)).strip() for cell in between(row, CELL, CELL_END)] for row in between(table, ROW, ROW_END)]


@F.pandas_udf(ArrayType(ArrayType(ArrayType(StringType()))))
def html_grids(text: pd.Series) -> pd.Series:
    """The grid of every table in a text."""
    return text.map(lambda t: [grid_of(m.group(0)) for m in TABLE.finditer(t)] if t else [])


def table_records(pages: DataFrame, text: str = "markdown") -> DataFrame:
    """A row for each table that has rows: the columns of pages but the text, index, n_rows, n_cols, header, rows (without the header)."""
    keep = [c for c in pages.columns if c != text]
    found = pages.select(*keep, F.posexplode(html_grids(F.coalesce(F.col(text), F.lit("")))).alias("index", "grid")).where(F.size("grid") > 0)
    return found.select(*keep, "index", (F.size("grid") - 1).alias("n_rows"), F.array_max(F.transform("grid", lambda r: F.size(r))).alias("n_cols"), F.col("grid")[0].alias("header"), F.slice("grid", F.lit(2), F.size("grid")).alias("rows"))


def clean_markdown(text: Column, strip_tags: bool = True) -> Column:
    """Text with its HTML tables as pipe tables, other tags gone if ``strip_tags``, and one newline at the end."""
    pieces = F.split(text, r"(?is)<table.*?</table>", -1)
    tables = F.transform(html_grids(text), lambda g: pipe_table(g))
    joined = F.array_join(F.flatten(F.zip_with(pieces, tables, lambda p, t: F.array(p, F.coalesce(F.concat(F.lit("\n"), t, F.lit("\n")), F.lit(""))))), "")
    body = strip_html(joined) if strip_tags else F.regexp_replace(joined, "\n{3,}", "\n\n")
    return F.concat(strip(body), F.lit("\n"))


def table_export(tables: DataFrame) -> DataFrame:
    """(name, index, header, rows) of exported tables to one Markdown document a name: a header line only if some header cell is not
    blank; short rows are padded to the header's width."""
    blank = ~F.exists("header", lambda h: F.trim(h) != "")
    width = F.when(F.size("header") > 0, F.size("header")).otherwise(F.coalesce(F.size(F.get("rows", F.lit(0))), F.lit(0)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size(r)))), " | "), F.lit(" |"))
    head = F.when(blank, F.array().cast("array<string>")).otherwise(F.array(line(F.col("header")), line(F.transform("header", lambda _: F.lit("---")))))
    part = F.array_join(F.concat(F.array(F.concat(F.lit("## Table "), F.col("index").cast("string"))), head, F.transform("rows", line)), "\n")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", part.alias("part")))), lambda s: s["part"]), "\n\n")
    return tables.groupBy("name").agg(F.concat(F.lit("# "), F.first("name"), F.lit("\n\n"), body, F.lit("\n")).alias("markdown"))


def plain(value) -> str:
    """A scalar on one line."""
    match value:
        case None:
            return ""
        case bool():
            return "true" if value else "false"
        case _:
            return " ".join(str(value).split("\n")).strip()


def pipe_rows(records: list[dict]) -> Iterator[list[str]]:
    """Header, rule and a row for each record; columns in order of first sight."""
    names = list({name: None for record in records for name in record})
    yield names
    yield ["---" for _ in names]
    yield from ([plain(record.get(name)) for name in names] for record in records)


def outline(node, indent: str = "") -> Iterator[str]:
    """Lines of Markdown: members and items as bullets, a list of flat objects as a table that a blank line ends."""
    held = lambda x: isinstance(x, (dict, list))
    match node:
        case dict():
            for name, value in node.items():
                yield f"{indent}- **{name}**:" + ("" if held(value) else f" {plain(value)}")
                if held(value):
                    yield from outline(value, indent + "  ")
        case [_, *_] if all(isinstance(x, dict) and not any(map(held, x.values())) for x in node):
            yield from (f"{indent}| {' | '.join(row)} |" for row in pipe_rows(node))
            yield ""
        case list():
            for item in node:
                yield from outline(item, indent) if held(item) else [f"{indent}- {plain(item)}"]
        case _:
            yield indent + plain(node)


@F.pandas_udf(StringType())
def json_markdown(name: pd.Series, raw: pd.Series) -> pd.Series:
    """JSON of any shape as nested bullets, lists of flat objects as tables; text that is not JSON stays as it is."""

    def render(title: str, text: str | None) -> str | None:
        if text is None:
            return None
        try:
            node = json.loads(text)
        except ValueError:
            return text
        return "\n".join([f"# {title}", "", *outline(node)]).strip() + "\n"

    return pd.Series([render(t, x) for t, x in zip(name, raw, strict=True)], dtype=object)
