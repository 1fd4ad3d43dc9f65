"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Each source gets a target by water filling: the share of the total its weight gives it, at most ``most`` times its size, the
excess shared again by weight among the others.  Every document of a source is expected target / size times.  Within a
source, documents lie in order of size class, salt, size and the hash of their id; their expected copies are summed up
along that order, one random offset is added to each source, and a document is emitted once for each integer boundary its
own stretch crosses.  The order by size keeps the words taken near the target.

The running sum needs no task to see a whole source: (source, size class, salt) is ranked on its own, and starts where
the counts of the earlier classes end.  The salt splits a class that holds a third of all rows.

Null and empty texts have size 0; sizes of 0 are sampled like others and take nothing.  Very long texts are one document like any
other, counted whole; a source that holds nothing else can miss its target by half of one.  Null sources form one source, last in order.  Ties
are broken by id and then by the text, and rows that are repeated exactly are interchangeable.  Empty tables give no rows.
Columns of the input may have any names; ``mix`` replaces those that are named like what it adds, ``mixture`` replaces none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, quoted, unpacked, whole_row

# Weights of the sources in order, repeating; the mix is this share of all sizes; no source exceeds this many times its size.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
SALTS = 64


def number(key: Column, salt: str) -> Column:
    """A number in [0, 2^32) from the md5 of a key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key).cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, source_size), a row a source, to (source, source_size, target).  The windows hold a row for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    df = sizes.select("source", "source_size", weight.alias("weight")).withColumn("cap", F.col("source_size") * most)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    df = df.withColumn("level", left / F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    # The first source whose cap is not below the level ends the filling.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap") * (1 + 1e-12), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(whole)["level"]
    return df.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * level).alias("target"))


def drawn(docs: DataFrame, columns: list[str], text: str = "text", seed: str = "mix", salts: int = SALTS) -> DataFrame:
    """(row, size, source_size, target, copies) of each row of docs; ``row`` holds ``columns`` of it.  What is not among them is not moved."""
    source, id_text = F.col("source"), F.col("doc_id").cast("string")
    key = F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source.cast("string")))
    size = F.coalesce(F.regexp_count(quoted(text), F.lit(WORD)), F.lit(0)).cast("long")
    # Size class: number of binary digits, then the leading three.
    binary = F.bin("size")
    df = docs.select(whole_row(docs.select(*map(quoted, columns))), source.alias("source"), key.alias("key"), size.alias("size"), id_text.alias("id"), F.xxhash64(quoted(text)).alias("content"))
    df = df.select("row", "source", "key", "size", "content", F.coalesce("id", F.lit("")).alias("id"), F.concat(F.lpad(F.length(binary).cast("string"), 2, "0"), F.substring(binary, 1, 3)).alias("class"), number(F.coalesce("id", F.lit("")), seed).alias("order"), F.col("id").isNull().alias("nameless"))
    # Rows without an id would all have one salt.
    df = df.withColumn("salt", F.when(F.col("nameless"), F.pmod("content", F.lit(salts))).otherwise(F.col("order") % salts))
    classes = df.groupBy("key", "class", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.first("source").alias("source"))
    sized = classes.groupBy("key").agg(F.sum("words").alias("source_size"), F.first("source").alias("source"))
    goal = targets(sized.select("source", "source_size")).withColumnRenamed("source", "of")
    goal = goal.select(F.when(F.col("of").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("of").cast("string"))).alias("key"), F.col("source_size").alias("words"), "target")
    before = F.sum("n").over(Window.partitionBy("key").orderBy("class", "salt")) - F.col("n")
    starts = classes.select("key", "class", "salt", before.alias("before")).join(goal, "key")
    rank = F.row_number().over(Window.partitionBy("key", "class", "salt").orderBy("size", "order", "id", "content"))
    df = df.withColumn("rank", rank).join(starts, ["key", "class", "salt"])
    rate = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0)
    at, offset = F.col("before") + F.col("rank"), number(F.col("key"), seed) / F.lit(2.0**32)
    copies = F.floor(at * rate + offset) - F.floor((at - 1) * rate + offset)
    return df.select("row", "size", F.col("words").alias("source_size"), "target", F.least(copies, F.ceil(rate)).cast("long").alias("copies"))


def mix(docs: DataFrame, text: str = "text", seed: str = "mix", salts: int = SALTS, columns: list[str] | None = None) -> DataFrame:
    """docs (or ``columns`` of it) and: size, source_size, target, copies and taken (copies times size)."""
    own = [c for c in (docs.columns if columns is None else columns) if c not in {"size", "source_size", "target", "copies", "taken"}]
    df = drawn(docs, own, text, seed, salts)
    return df.select(*unpacked(own), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, text: str = "text", seed: str = "mix", salts: int = SALTS) -> DataFrame:
    """The mix itself: each row of docs, with its own columns, as many times as it is taken."""
    df = drawn(docs, docs.columns, text, seed, salts).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return df.select(*unpacked(docs.columns))


def expand(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The same from what ``mix`` gives."""
    return mixed.where("copies > 0").select(whole_row(mixed), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(*unpacked(columns))
