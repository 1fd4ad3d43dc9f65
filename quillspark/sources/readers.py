"""Sources: files and tables as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import file_kind
from quillspark.operators.tables import json_markdown, table_export

TABLES = "tables array<struct<index:int,n_rows:int,n_cols:int,header:array<string>,rows:array<array<string>>>>"
MOST_BYTES = 50 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discover(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, kind, size, error) of every file, without reading it.  ``error`` says why a file is not taken: a kind that is not known, or a size
    beyond the limit; null for those that are."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select("path", name.alias("name"), file_kind(name).alias("kind"), F.col("length").alias("size"))
    ending = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    unknown = F.concat(F.lit("Unsupported file type: "), F.coalesce(F.nullif(ending, F.lit("")), F.lit("(none)")))
    large = F.concat(F.lit("File too large: "), F.col("size").cast("string"), F.lit(f" of {MOST_BYTES} bytes"))
    return found.withColumn("error", F.when(F.col("kind").isNull(), unknown).when(F.col("size") > MOST_BYTES, large))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind, text, error) of every file under a path: Markdown and JSON as text, PDF without one until its pages are read, others with the error that
    ``discover`` has for them."""
    found = discover(spark, path)
    texts = markdown(spark, path).select("name", F.lit("md").alias("kind"), "text").unionByName(json_documents(spark, path).select(F.concat("name", F.lit(".json")).alias("name"), F.lit("json").alias("kind"), "text"))
    return found.join(texts, ["name", "kind"], "left").select("name", "kind", F.when(F.col("error").isNull(), F.col("text")).alias("text"), "error")


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(name, text), a row for each Markdown file."""
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.{md,markdown}").select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of JSON files as Markdown: table exports as tables, other shapes as bullets, what is not JSON as it is."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("name"), F.col("value").alias("raw"))
    bare = F.when(F.trim("raw").startswith("["), F.concat(F.lit('{"tables":'), F.col("raw"), F.lit("}"))).otherwise(F.col("raw"))
    parsed = raw.withColumn("tables", F.from_json(bare, TABLES)["tables"])
    exported = (F.coalesce(F.size("tables"), F.lit(0)) > 0) & F.coalesce(F.forall("tables", lambda t: t["rows"].isNotNull()), F.lit(False))
    flat = parsed.where(exported).select("name", F.posexplode("tables").alias("at", "t")).select("name", F.coalesce("t.index", "at").alias("index"), F.coalesce("t.header", F.array().cast("array<string>")).alias("header"), "t.rows")
    others = parsed.where(~exported | F.col("tables").isNull()).select("name", json_markdown(F.col("name"), F.col("raw")).alias("text"))
    return table_export(flat).withColumnRenamed("markdown", "text").unionByName(others)


def statement_tables(spark: SparkSession, path: str) -> DataFrame:
    """Rows of exported statement tables: file (the year at the start of the name, or its stem), table_idx, n_cols, header, row_idx, cells."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*_tables.json").select(F.col("_metadata.file_name").alias("name"), F.from_json("value", TABLES)["tables"].alias("tables"))
    year = F.regexp_extract("name", r"^(\d{4})", 1)
    df = raw.select(F.when(year != "", year).otherwise(F.regexp_replace("name", r"\.json$", "")).alias("file"), F.posexplode("tables").alias("table_idx", "t"))
    return df.select("file", "table_idx", F.coalesce("t.n_cols", F.size("t.header")).alias("n_cols"), F.col("t.header").alias("header"), F.posexplode("t.rows").alias("row_idx", "cells"))


QUESTION = "id string, question string, ground_truth string, answer_type string, statement_type string, note_no int, year int, relevant_years array<int>, relevant_pages array<int>, gold_numbers array<string>, difficulty string, lang string"


def questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Question sets as JSON lines; the first ``limit`` by id."""
    df = spark.read.schema(QUESTION).json(path)
    return df.orderBy("id").limit(limit) if limit else df


def page_pairs(predicted: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, skipped): pages that both sides have, and those that only one has."""
    pairs = predicted.select("page", F.col("text").alias("pred")).join(gold.select("page", F.col("text").alias("gold")), "page")
    skipped = predicted.select("page").join(gold.select("page"), "page", "left_anti").unionByName(gold.select("page").join(predicted.select("page"), "page", "left_anti"))
    return pairs, skipped


#: Ways to get the texts of a file's pages, by name: functions of its bytes.  ``register`` adds to them.
ENGINES: dict[str, Callable[[bytes], list[str]]] = {}
#: Characters that a text layer must hold to be used instead of recognition.
LEAST_CHARS = 40


def register(name: str, extract: Callable[[bytes], list[str]]) -> None:
    ENGINES[name] = extract


def engine(name: str) -> Callable[[bytes], list[str]]:
    if name not in ENGINES:
        raise KeyError(f"no engine {name!r}; there are {sorted(ENGINES)}")
    return ENGINES[name]


def usable(texts: list[str]) -> bool:
    """Whether a text layer holds more than ``LEAST_CHARS`` characters that are not blank."""
    return sum(len("".join((t or "").split())) for t in texts) > LEAST_CHARS


def with_fallback(layer: Callable[[bytes], list[str]], recognise: Callable[[bytes], list[str]] | None = None) -> Callable[[bytes], list[str]]:
    """The text layer where it is usable, else recognition, else nothing."""

    def extract(content: bytes) -> list[str]:
        texts = layer(content)
        return texts if usable(texts) else recognise(content) if recognise else []

    return extract


def pages(binary: DataFrame, extract, first: int = 1, last: int | None = None) -> DataFrame:
    """(path, page_no, text) of documents: ``extract(bytes)``, or the engine of that name, gives the texts of the pages.  Pages are counted from 1,
    and only those from ``first`` to ``last`` are kept.  A file that fails gives one row with ``error``, and blank pages are left out;
    the extractor is injected, so no PDF library is required here."""
    run_one = engine(extract) if isinstance(extract, str) else extract

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, i, text, None) for i, text in enumerate(run_one(bytes(content)), 1) if text and text.strip()]
                except Exception as error:  # one bad file must not end the batch
                    rows.append((path, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["path", "page_no", "text", "error"]).astype({"page_no": "Int32"})

    found = binary.select("path", "content").mapInPandas(run, "path string, page_no int, text string, error string")
    within = F.col("page_no") >= first if last is None else F.col("page_no").between(first, last)
    return found.where(F.col("error").isNotNull() | within)


def unprocessed(inputs: DataFrame, outputs: DataFrame, key: str = "name") -> DataFrame:
    """Inputs without an output yet: a rerun resumes where the last one stopped."""
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")
