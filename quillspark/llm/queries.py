"""The thin ``opN_<name>`` queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, collocations, covertree, digest, langid, lattice, licenses, merkle, mixing, pii, positional, simhash, toxicity
from quillspark.llm.common import crc_mod, table

#: Paths of vocabulary files that are installed beside the library; none is copied into the repository.
BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = pii.listed(F.filter("spans", lambda s: s["kind_no"] < pii.BASE))
    return df.select("doc_id", *(count(k.name) for k in pii.KINDS if k.base), F.sha2(base.cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op2_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(spark, table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    texts, stands_for = toxicity.sample(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    scored = toxicity.with_score(spark, docs, toxicity.fit(spark, texts, stands_for), ["doc_id"])
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("training", crc_mod("doc_id", 7) != 2)
    return lattice.score(spark, docs, lattice.load_pieces(PIECES))


def op5_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprints(spark, table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(*licenses.scan(spark, table(spark, sf_dir, "documents")))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(spark, langid.sample(docs.where(crc_mod("doc_id", 4) != 2)))
    found = langid.with_language(spark, docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(spark, table(spark, sf_dir, "documents"), bpe.load_ranks(BPE_RANKS), public_tokenizers.PATTERN)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), columns=["doc_id", "source"])
    return mixed.select("doc_id", "source", "size", "source_size", F.round("target", 4).alias("target"), "copies", "taken")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark, table(spark, sf_dir, "documents"))


def op12_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positional.contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = merkle.manifest(spark, merkle.tampered(table(spark, sf_dir, "documents")))
    return merkle.proofs(made).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_covertree": op2_covertree,
    "op3_toxicity": op3_toxicity,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_digest": op5_digest,
    "op6_licenses": op6_licenses,
    "op7_langid": op7_langid,
    "op8_bpe": op8_bpe,
    "op9_simhash": op9_simhash,
    "op10_mixing": op10_mixing,
    "op11_collocations": op11_collocations,
    "op12_positional": op12_positional,
    "op13_merkle": op13_merkle,
}
