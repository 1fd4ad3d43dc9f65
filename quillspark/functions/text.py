"""Text predicates and normal forms."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN = r"[\p{L}\p{N}_]+"

# Phrases that mark a refusal.
REFUSALS = (
    "không tìm thấy",
    "không thể trả lời",
    "không có thông tin",
    "không được trình bày",
    "không nêu",
    "không cung cấp",
    "không có trong",
    "không đủ thông tin",
    "tài liệu không",
    "couldn't find",
    "could not find",
    "cannot be answered",
    "not provided",
    "does not disclose",
    "no information",
    "not contain",
    "not found in",
)


def strip(text: Column) -> Column:
    """Text without white space at its ends; Spark's trim takes blanks alone."""
    return F.btrim(text, F.lit(" \t\n\r\f\x0b"))


def lead_stripped(text: Column) -> Column:
    """Text without white space at its beginning, which is cheaper to find than that at the end of a long one."""
    return F.ltrim(text, F.lit(" \t\n\r\f\x0b"))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Composed Unicode form; Spark has no such function."""
    return text.str.normalize("NFC")


def is_table_line(line: Column) -> Column:
    return lead_stripped(line).startswith("|") & (F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= 2)


def is_refusal(answer: Column) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    return reduce(lambda a, b: a | b, [low.contains(m) for m in REFUSALS])


def label_key(label: Column) -> Column:
    """A label without leading numbering, lower-cased, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"^\s*\d+[.)]\s*", ""), r"\s+", " "))


def strip_html(text: Column) -> Column:
    """Text without tags; runs of three or more newlines become two."""
    return F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), "\n{3,}", "\n\n")


def plain_text(text: Column) -> Column:
    """Markdown or HTML as comparable plain text: comments, tags, table rules, pipes and marks go, white space collapses."""
    t = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    t = F.regexp_replace(t, r"(?m)^\s*\|?[\s:|-]*-{2,}[\s:|-]*$", " ")
    t = F.regexp_replace(t, r"[|#*`>]", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def markdown_cell(value: Column) -> Column:
    """A value that is safe inside a pipe table."""
    return F.trim(F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def pipe_table(rows: Column) -> Column:
    """array<array<string>> as a Markdown table: the first row is the header, short rows are padded to the widest."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), markdown_cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), width), "|"), F.lit("|"))
    body = F.transform(F.slice(rows, F.lit(2), F.size(rows)), line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(rows[0]), rule), body), "\n")).otherwise("")


def doc_year(name: Column, text: Column) -> Column:
    """First year in a file name, else among the first 2000 characters of the text; digits must not adjoin."""
    year = r"(?<!\d)((?:19|20)\d{2})(?!\d)"
    found = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), year, 1), F.lit(""))
    return F.coalesce(found(name), found(F.substring(text, 1, 2000))).cast("int")


def file_kind(name: Column) -> Column:
    """pdf, md or json by extension, else null."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext == "pdf", "pdf").when(ext.isin("md", "markdown"), "md").when(ext == "json", "json")


def progress(done: Column, total: Column) -> Column:
    """Indexing progress in percent: from 5, at most 99 until the end is recorded."""
    return F.least(F.lit(99), 5 + F.floor(done / F.greatest(total, F.lit(1)) * 90).cast("int"))


def short_id(*keys: Column) -> Column:
    """Twelve hexadecimal digits that follow from the keys, so that a rerun names rows alike."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *keys).cast("binary"), 256), 1, 12)


def iso_utc(at: Column) -> Column:
    """A timestamp as ISO 8601 text in UTC, whatever the session's time zone; null stays null."""
    seconds = F.date_format(F.to_utc_timestamp(at, F.expr("current_timezone()")), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(seconds, F.lit("+00:00"))
