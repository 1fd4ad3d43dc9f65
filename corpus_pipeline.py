"""A training-corpus pipeline over ``documents``: five stages, each written as Parquet and read back as the next one's input.

Toxic documents go, one document of each near-duplicate group stays, personal data gives way to placeholders, sources are
mixed to their targets, and what is left is encoded.  Counts as part of the llm subpackage.

Null and empty texts pass the first stage, are one group in the second, and go on as empty texts.  Very long texts are read whole.
Repeated rows are one group.  Empty tables stay empty.  All stages but the last keep the columns of their input, whatever their
names; the last returns doc_id, n_tokens and the two digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, mixing, pii, simhash, toxicity
from quillspark.llm.common import crc_mod, fresh, quoted, table, whole_row, written
from quillspark.llm.queries import BPE_RANKS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labelled ones among them, does not reject."""
    texts, stands_for = toxicity.sample(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    columns = docs.columns
    name = fresh("toxicity", columns)
    scored = toxicity.with_score(spark, docs, toxicity.fit(spark, texts, stands_for), columns, name)
    return scored.where(F.col(name) < toxicity.THRESHOLD).select(*map(quoted, columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group; of rows of the group that repeat its id, one.  Groups may have ids
    in common, null among them.  Rows are told apart by the SHA-256 of their whole content as JSON."""
    columns = docs.columns
    key = fresh("row_key", columns)
    keyed = docs.withColumn(key, F.sha2(F.to_json(whole_row(docs)).cast("binary"), 256))
    found = simhash.near_duplicates(spark, keyed, ["doc_id", key])
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(key).alias(key))
    return keyed.join(first.select(key), key, "left_semi").dropDuplicates([key]).select(*map(quoted, columns))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data replaced by placeholders."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    return bpe.encode(spark, docs, bpe.load_ranks(BPE_RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The stages learn, iterate and tokenise: SQL cannot express them; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
