"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Pre-tokens of every text are dealt by hash; each distinct one is encoded once, its ids are joined back to the places where
it stands, and texts are reassembled by position.  Decoding looks ids up in the token-byte table, whose size is fixed
by the vocabulary.

The shuffle moves each distinct pre-token of a block once with its places packed, not one row for each pre-token: a row for
each of them would move several times the input (README).  The token-byte table has a fixed size and is joined in the task that
holds the ids, since a shuffle by id would put a third of all tokens into the task of the commonest one.

Null texts count as empty; empty texts have no ids.  Texts of any length are read whole.  Repeated rows and ids that are null are
kept as they are.  Empty tables give no rows.  Other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import blocks as B
from quillspark.llm.common import tidy


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids, from a file with a base64 token and a rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def splitter(pattern: str):
    def make():
        import regex

        return regex.compile(pattern).findall

    return make


def encode(spark: SparkSession, docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep_ids: bool = False, block_chars: int = B.BLOCK_CHARS) -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if ``keep_ids``, ids and the decoded bytes."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.lit(0).alias("flag"))
    blocks, words, parts = B.cut_and_write(spark, docs, splitter(pattern), "bpe", counted=False, block_chars=block_chars)
    vocabulary = spark.sparkContext.broadcast(ranks)  # fixed size: the vocabulary's

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocabulary.value, special_tokens={})
        for rows in B.by_part(batches):
            known: dict[str, bytes] = {}
            for row in rows:
                own = B.unpack_words(row["data"])
                for word in own:
                    if word not in known:
                        known[word] = np.array(coder.encode_ordinary(word), "<u4").tobytes()
                ids = [known[w] for w in own]
                sizes = np.array([len(x) // 4 for x in ids], "<u4")
                yield B.answer(row, B.pack_array(np.concatenate([np.array([len(own)], "<u4"), sizes, np.frombuffer(b"".join(ids), "<u4")])))

    answers = B.dealt(words, parts).mapInArrow(tidy(encode_parts), B.ANSWER)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + ([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())] if keep_ids else [])

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = {i: b for b, i in vocabulary.value.items()}
        schema = pa.schema(fields)
        for row in B.rows_of(batches):
            n, answers = B.answers_of(row)
            printed, decoded, sizes = [b""] * n, [b""] * n, np.zeros(n, np.int64)
            for at, data in answers:
                flat = B.unpack_array(data, "<u4")
                m = int(flat[0])
                ends = np.cumsum(flat[1 : m + 1])
                tokens, begin = flat[m + 1 :].tolist(), 0
                for i, end in zip(at[:m].tolist(), ends.tolist(), strict=True):
                    own = tokens[begin:end]
                    printed[i], decoded[i], sizes[i] = " ".join(map(str, own)).encode(), b"".join([spelled[t] for t in own]), end - begin
                    begin = end
            flat, begin, out = B.unsqueeze(row["data"]), 0, {name: [] for name, _ in fields}
            for doc_id, length in zip(row["ids"], row["lens"], strict=True):
                at = flat[begin : begin + length]
                begin += length
                places = at.tolist()
                ids, data = b" ".join([printed[i] for i in places]), b"".join([decoded[i] for i in places])
                out["doc_id"].append(doc_id)
                out["n_tokens"].append(int(sizes[at].sum()))
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(data).hexdigest())
                if keep_ids:
                    out["ids"].append([int(t) for t in ids.split()])
                    out["decoded"].append(data)
            yield pa.RecordBatch.from_pydict(out, schema)

    kept = ", ids array<int>, decoded binary" if keep_ids else ""
    return B.rejoin(blocks, answers).mapInArrow(tidy(reassemble), f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{kept}")
