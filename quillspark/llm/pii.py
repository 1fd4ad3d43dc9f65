"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checksums (Luhn, mod 97) or digit counts confirm them, and context words just before a span raise
its score.  A span is kept from a score of ``THRESHOLD``; those of the four base kinds reach it without context.

Places come from cutting the text at the matches: the lengths of gaps and matches, summed by a doubling prefix sum over
the array, are the spans' code points.  Nothing is quadratic in the number of matches or the length of a text, and no row
is moved.

Null and empty texts have no spans, and ``redact`` leaves them as they are; very long texts are read whole.  Repeated rows are
handled alike, and an empty table gives no rows.  Columns of the input are kept whatever they are called; ``with_spans`` replaces one that
has the name asked for, ``redact`` replaces none but the text and its length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import quoted, unpacked, whole_row

THRESHOLD = 0.5
#: Code points before a span in which context words count.
CONTEXT_CHARS = 40
CONTEXT_WEIGHT = 0.3


@dataclass(frozen=True)
class Kind:
    name: str
    #: Possessive quantifiers where giving characters back cannot help, so that long runs cost no recursion and no second try.
    pattern: str
    #: A cheap test that a text may hold the kind.
    hint: str
    #: Score before context.
    prior: float
    context: str
    base: bool = True


# Lengths of account numbers and the countries that have them.
IBAN = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}


def iban_pattern() -> str:
    """Account numbers of exactly their country's length, with single blanks anywhere; of countries not listed, those without blanks or
    in fours.  None goes on into the next word."""
    codes = {n: "|".join(c.split()) for n, c in IBAN.items()}
    whole = "(?![A-Za-z0-9])"
    listed = "|".join(f"(?:{c})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}{whole}" for n, c in codes.items())
    other = f"(?!{'|'.join(codes.values())})[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?:\\x20[A-Z0-9]{{4}}{whole}){{2,7}}(?:\\x20[A-Z0-9]{{1,3}})?){whole}"
    return f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{listed}|{other})"


# The kinds, their patterns and context words.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.7, "mail|contact|write|address"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", ".", 0.6, "ip|host|server|address|client"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.7, "card|visa|credit|payment|account"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|tel|call|mobile|fax"),
    Kind("iban", iban_pattern(), "", 0.6, "iban|account|konto|bank", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, "ssn|social|security", False),
    Kind("secret", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])", "", 0.3, "token|secret|password|key", False),
)
BASE = sum(k.base for k in KINDS)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    places = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, F.coalesce(d.try_cast("int"), F.lit(0))).otherwise(F.coalesce(d.try_cast("int"), F.lit(0)) * 2))
    return F.aggregate(places, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number passes the mod 97 test: its first four characters move to the end, letters count from 10."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    letters = F.transform(F.split(F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4)), ""), lambda c: F.when(c == "", F.lit("")).when(c.between("0", "9"), c).otherwise((F.ascii(c) - 55).cast("string")))
    return F.aggregate(F.split(F.array_join(letters, ""), ""), F.lit(0), lambda a, d: F.when(d == "", a).otherwise((a * 10 + d.try_cast("int")) % 97)) == 1


def valid(kind: Kind, value: Column, number: Column) -> Column:
    if kind.name == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$")
    if kind.name == "card":
        return F.length(number).between(14, 19) & luhn(number)
    if kind.name == "phone":
        return F.length(number).between(10, 15)
    if kind.name == "iban":
        return mod97(value)
    return F.lit(True)


def prefix_sums(lengths: Column) -> Column:
    """Running sums of an array of integers, in as many passes as doublings reach its size."""

    def widen(sums: Column, step: Column) -> Column:
        shift = F.array_repeat(F.lit(0), F.pow(F.lit(2), step).cast("int"))
        return F.zip_with(sums, F.slice(F.concat(shift, sums), F.lit(1), F.size(sums)), lambda a, b: a + b)

    steps = F.when(F.size(lengths) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(lengths).cast("double"))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, lengths, widen)


def scored(no: int, kind: Kind):
    """From a piece and its end to a span with its score; 0 if a checksum or count fails."""

    def span(piece: Column, end: Column) -> Column:
        value = piece["value"]
        near = F.lower(F.substring(piece["gap"], -CONTEXT_CHARS, CONTEXT_CHARS)).rlike(kind.context)
        score = F.least(F.lit(1.0), F.lit(kind.prior) + F.when(near, CONTEXT_WEIGHT).otherwise(0.0))
        return F.struct((end - F.length(value)).alias("start"), F.lit(no).alias("kind_no"), end.alias("end"), F.lit(kind.name).alias("kind"), F.when(valid(kind, value, piece["number"]), score).otherwise(0.0).alias("score"))

    return span


SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string,score:double>>"


def found_in(df: DataFrame) -> DataFrame:
    """(row, text), text not null, to (row, spans)."""
    # Each step is a projection of its own, so that no lambda recomputes a match.
    empty = F.array().cast("array<string>")
    cut = []
    for k in KINDS:
        may = F.col("text").contains(k.hint) if k.hint else F.lit(True)
        cut += [F.when(may, F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))).otherwise(empty).alias(f"found_{k.name}")]
    df = df.select("row", "text", *cut)
    gaps = [F.when(F.size(f"found_{k.name}") > 0, F.split("text", k.pattern, -1)).otherwise(empty).alias(f"gaps_{k.name}") for k in KINDS]
    df = df.select("row", *(f"found_{k.name}" for k in KINDS), *gaps)
    pieces = [F.arrays_zip(F.slice(f"gaps_{k.name}", F.lit(1), F.size(f"found_{k.name}")).alias("gap"), F.col(f"found_{k.name}").alias("value")).alias(f"pieces_{k.name}") for k in KINDS]
    df = df.select("row", *pieces)
    known = [F.transform(F.col(f"pieces_{k.name}"), lambda p: F.struct(p["gap"].alias("gap"), p["value"].alias("value"), digits(p["value"]).alias("number"), (F.length(p["gap"]) + F.length(p["value"])).alias("n"))).alias(f"known_{k.name}") for k in KINDS]
    df = df.select("row", *known)
    df = df.select("row", *(f"known_{k.name}" for k in KINDS), *(prefix_sums(F.transform(f"known_{k.name}", lambda p: p["n"])).alias(f"ends_{k.name}") for k in KINDS))
    named = []
    for no, k in enumerate(KINDS):
        spans = F.zip_with(f"known_{k.name}", f"ends_{k.name}", scored(no, k))
        named.append(F.filter(spans, lambda s: s["score"] >= THRESHOLD).cast(SPAN))
    return df.select("row", F.array_sort(F.concat(*named)).alias("spans"))


def with_spans(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """docs and ``name``: array of (start, kind_no, end, kind, score), sorted; code points, end exclusive."""
    df = found_in(docs.select(whole_row(docs), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text")))
    return df.select(*unpacked([c for c in docs.columns if c != name]), F.col("spans").alias(name))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first.  ``length``,
    where there is such a column, follows the new text."""
    df = found_in(docs.select(whole_row(docs), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text")))
    df = df.select("row", F.col("row").getField(text).alias("text"), "spans")
    before = F.transform("spans", lambda s: s["end"])
    # Largest end among earlier spans: a doubling prefix maximum.
    steps = F.when(F.size(before) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(before).cast("double"))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    most = F.aggregate(steps, before, lambda m, step: F.zip_with(m, F.slice(F.concat(F.array_repeat(F.lit(0), F.pow(F.lit(2), step).cast("int")), m), F.lit(1), F.size(m)), lambda a, b: F.greatest(a, b)))
    df = df.select("row", "text", "spans", most.alias("most"))
    df = df.select("row", "text", "most", F.zip_with("spans", F.slice(F.concat(F.array(F.lit(0)), "most"), F.lit(1), F.size("spans")), lambda s, m: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), m.alias("covered"))).alias("cuts"))
    parts = F.transform("cuts", lambda c: F.when((c["start"] >= c["covered"]), F.concat(F.substring(F.col("text"), c["covered"] + 1, c["start"] - c["covered"]), F.lit("<"), F.upper(c["kind"]), F.lit(">"))).otherwise(F.lit("")))
    rest = F.substring(F.col("text"), F.element_at("most", -1) + 1, F.length("text"))
    df = df.select("row", F.when(F.size("cuts") > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(F.col("text")).alias("text"), (F.size("cuts") > 0).alias("changed"))
    given = dict(zip(docs.columns, unpacked(docs.columns), strict=True))
    given[text] = F.col("text").alias(text)
    if length in given and length != text:
        given[length] = F.when(F.col("changed"), F.length("text").cast(docs.schema[length].dataType)).otherwise(F.col("row").getField(length)).alias(length)
    return df.select(*given.values())
