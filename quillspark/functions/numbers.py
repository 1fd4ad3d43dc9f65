"""Printed numbers in Vietnamese notation: dots group thousands, a comma marks decimals, parentheses negate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number in text, and in a table cell.
IN_TEXT = r"\d[\d.,]*\d|\d"
BODY = r"^-?\d[\d.]*(?:,\d+)?$"
CELL = r"^\(?-?[\d.]+\)?$"


def parse_number(cell: Column) -> Column:
    """Value of a cell, null if it is no number; every dot is dropped, so 30.1 reads 301."""
    s = F.trim(F.coalesce(cell, F.lit("")))
    negative = s.startswith("(") & s.endswith(")")
    bare = F.trim(F.regexp_replace(s, r"^[()]+|[()]+$", ""))
    value = F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(bare.rlike(BODY), F.when(negative, -value).otherwise(value))


def is_number_cell(cell: Column) -> Column:
    """Whether a statement cell holds a figure; a lone parenthesis on either side is accepted."""
    s = F.trim(F.coalesce(cell, F.lit("")))
    return s.rlike(CELL) & s.rlike(r"\d")


def figure(cell: Column) -> Column:
    """Value of a statement cell from its digits alone: only surrounding parentheses negate, no digits give 0."""
    s = F.trim(F.coalesce(cell, F.lit("")))
    value = F.coalesce(F.regexp_replace(s, "[^0-9]", "").try_cast("double"), F.lit(0.0))
    return F.when(s.startswith("(") & s.endswith(")"), -value).otherwise(value)


def line_code(cell: Column) -> Column:
    """The line code in a cell (two or three digits, maybe a letter), else null."""
    s = F.trim(cell)
    return F.when(s.rlike(r"^\d{2,3}[a-z]?$"), s)


def canonical(token: Column) -> Column:
    """One form for a printed number: one comma with at most two digits after it is a decimal comma, other separators go, leading
    zeros go; null if digits are missing."""
    t = F.replace(F.regexp_replace(F.trim(token), r"^[().%]+|[().%]+$", ""), F.lit(" "), F.lit(""))
    whole = F.regexp_replace(F.regexp_replace(F.split(t, ",")[0], r"\.", ""), "^0+(?=.)", "")
    tail = F.regexp_replace(F.split(t, ",")[1], "0+$", "")
    decimal = t.rlike(r"^[\d.]*\d[\d.]*,\d{0,2}$")
    digits = F.regexp_replace(t, "[.,]", "")
    return F.when(decimal, F.when(tail != "", F.concat(whole, F.lit("."), tail)).otherwise(whole)).when(digits.rlike(r"^\d+$"), F.regexp_replace(digits, "^0+(?=.)", ""))


def numbers_in(text: Column) -> Column:
    """Distinct canonical numbers of a text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IN_TEXT), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, canonical), lambda x: x.isNotNull())))


def signed_numbers_in(text: Column) -> Column:
    """All numbers of a text in order, as digits with a minus for figures in parentheses."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\(?\d[\d.,]*\d\)?|\d"), F.lit(0))
    return F.transform(found, lambda m: F.concat(F.when(m.startswith("(") & m.endswith(")"), "-").otherwise(""), F.regexp_replace(m, "[^0-9]", "")))


def grouped(value: Column) -> Column:
    """Whole numbers with dots between thousands, others as they print."""
    return F.when(value == F.floor(value), F.replace(F.format_number(value, 0), F.lit(","), F.lit("."))).otherwise(value.cast("string"))
