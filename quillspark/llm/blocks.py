"""Corpus-wide work on distinct tokens without moving every token.

Texts are cut into tokens where they are scanned.  A *block* is what one task reads up to ``BLOCK_CHARS`` code points: it keeps
the position list of each document as indexes into the block's distinct tokens.  Only distinct tokens travel, dealt into
parts by hash, so that one task sees every occurrence of a token once per block; what it computes for a token travels
back to the blocks, where documents are reassembled by position.  The position lists are written once, bucketed by
block, and do not move again.

Very frequent tokens cost one entry a block, never one a document.  The number of parts follows from the code points of the table, at most
``PART_CHARS`` for each part on average, and a task handles its parts one after another: memory is bounded by ``PART_CHARS``
and ``BLOCK_CHARS``, or by the longest single text, whatever the size of the corpus and the number of shuffle partitions.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import partitions, tidy, written_by

#: Code points of text after which a block ends.
BLOCK_CHARS = 24_000_000
#: Code points of the table for each part of the distinct tokens.
PART_CHARS = 64_000_000

SCHEMA = "block long, part int, start int, ids array<long>, flags array<int>, lens array<int>, places binary, counts binary, data binary"
ARROW = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("start", pa.int32()), ("ids", pa.list_(pa.int64())), ("flags", pa.list_(pa.int32())), ("lens", pa.list_(pa.int32())), ("places", pa.binary()), ("counts", pa.binary()), ("data", pa.binary())])


def squeeze(indexes: np.ndarray) -> bytes:
    """Token indexes as compressed byte planes."""
    planes = np.ascontiguousarray(indexes.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_words(words: list[str]) -> bytes:
    sizes = np.array([len(words), *map(len, words)], "<u4")
    return zstandard.ZstdCompressor(level=3).compress(sizes.tobytes() + "".join(words).encode())


def unpack_words(data: bytes) -> list[str]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:4], "little")
    sizes, text = np.frombuffer(raw, "<u4", n, 4).tolist(), raw[4 * n + 4 :].decode()
    return [text[e - k : e] for e, k in zip(accumulate(sizes), sizes, strict=True)]


def pack_array(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def unpack_array(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def cut(docs: DataFrame, tokenise: Callable[[], Callable[[str], list[str]]], parts: int, counted: bool, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs (doc_id, text, flag int) to rows of SCHEMA: one with the documents of a block (part -1) and one for each of
    its parts, holding distinct tokens and, if ``counted``, how often documents with flag 1 use each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial, split = TaskContext.get().partitionId(), count(), tokenise()

        def fresh():
            return defaultdict(count().__next__), [], [], [], []

        def block(index, ids, flags, lens, found) -> pa.RecordBatch:
            number = (task << 32) | next(serial)
            flat = np.concatenate(found) if found else np.zeros(0, np.uint32)
            times = np.bincount(flat[np.repeat(np.array(flags, bool), lens)], minlength=len(index)) if counted else None
            dealt, rows, places = defaultdict(list), [], []
            for word, i in index.items():
                dealt[zlib.crc32(word.encode()) % parts].append((i, word))
            for part, own in dealt.items():
                at = [i for i, _ in own]
                rows.append({"block": number, "part": part, "start": len(places), "counts": pack_array(times[at].astype("<i8")) if counted else None, "data": pack_words([w for _, w in own])})
                places += at
            rows.append({"block": number, "part": -1, "ids": ids, "flags": flags, "lens": lens, "places": squeeze(np.array(places, np.uint32)), "data": squeeze(flat)})
            return pa.RecordBatch.from_pylist(rows, ARROW)

        held, (index, ids, flags, lens, found) = 0, fresh()
        for batch in batches:
            for doc_id, text, flag in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "flag")), strict=True):
                tokens = split(text) if text else []
                found.append(np.fromiter(map(index.__getitem__, tokens), np.uint32, len(tokens)))
                ids.append(doc_id)
                flags.append(flag)
                lens.append(len(tokens))
                held += len(text or "")
                if held >= block_chars:
                    yield block(index, ids, flags, lens, found)
                    held, (index, ids, flags, lens, found) = 0, fresh()
        if ids:
            yield block(index, ids, flags, lens, found)

    return docs.mapInArrow(tidy(run), SCHEMA)


def cut_and_write(spark: SparkSession, docs: DataFrame, tokenise, label: str, counted: bool, block_chars: int = BLOCK_CHARS, part_chars: int = PART_CHARS) -> tuple[DataFrame, DataFrame, int]:
    """The table of blocks, that of their distinct tokens, and the number of tasks to deal these to."""
    tasks = partitions(spark)
    chars = docs.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    parts = tasks * max(1, -(-chars // (tasks * part_chars)))
    whole = written_by(spark, cut(docs, tokenise, parts, counted, block_chars), label, "block", tasks)
    return whole.where("part < 0").select("block", "ids", "flags", "lens", "places", "data"), whole.where("part >= 0").select("block", "part", "start", "counts", "data"), tasks


def dealt(words: DataFrame, tasks: int) -> DataFrame:
    """The tokens of each part together, several parts a task, one after another."""
    return words.repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int")).sortWithinPartitions("part", "block")


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one part after another."""
    held: list[dict] = []
    for batch in batches:
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            if held and held[0]["part"] != row["part"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


ANSWER = "block long, start int, answer binary"


def answer(row: dict, data: bytes) -> pa.RecordBatch:
    """What was computed for the tokens of a row, for ``rejoin``."""
    return pa.RecordBatch.from_pydict({"block": [row["block"]], "start": [row["start"]], "answer": [data]}, pa.schema([("block", pa.int64()), ("start", pa.int32()), ("answer", pa.binary())]))


def rejoin(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks with what was computed for their tokens: answers become one list a block, at most one entry for each part."""
    return blocks.join(answers.groupBy("block").agg(F.collect_list(F.struct("start", "answer")).alias("answers")), "block", "left")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Blocks one at a time: each is large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def answers_of(row: dict) -> tuple[int, Iterator[tuple[np.ndarray, bytes]]]:
    """Number of distinct tokens of a block, and for each answer the indexes of its tokens (those from ``start`` on) with its data."""
    places = unsqueeze(row["places"])
    return len(places), ((places[a["start"] :], a["answer"]) for a in row["answers"] or [])
