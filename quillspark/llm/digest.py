"""Document fingerprints: a digest of quartiles of hashed byte triplets.

All byte triplets of a text are hashed into 256 buckets.  The digest states for each bucket in which quartile of all bucket counts it
lies (2 bits), besides a checksum, the length on a log scale and the ratios of the quartiles.  Two digests differ by the
sum of their bucket differences plus capped penalties for length and ratios; the difference is bounded by ``CAP`` and
likeness is 1 less its share of the bound.

``with_next`` finds each document's successor by id without putting the table into one task: rows are dealt into ranges of ids,
and the first document of a range is also sent to the end of the range before it.  An id that many rows share, null among them, is cut
into ranges of the text's hash as well, so that only rows equal in id and text stay together.

Null texts count as empty, and all empty texts have the same digest.  Texts of any length are read whole.  Documents with a null id
come last; ties in id are ordered by the text's hash.  A lone document is its own successor.  Empty tables give no rows.  Columns of
the input other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import partitions

BUCKETS = 256
#: Difference from which digests count as wholly unlike: what independent quartiles give on average.
CAP = BUCKETS * 1.25
LAST = 2**63 - 1
LEAST = -(2**63)


def digest(data: bytes) -> str:
    """136 hexadecimal digits: checksum, length, two ratios, 256 quartiles."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) >= 3:
        wide = raw.astype(np.uint32)
        triplets = wide[:-2] | (wide[1:-1] << np.uint32(8)) | (wide[2:] << np.uint32(16))
        counts = np.bincount((triplets * np.uint32(2654435761)) >> np.uint32(24), minlength=BUCKETS)
    else:
        counts = np.zeros(BUCKETS, np.int64)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    quartile = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = quartile[0::4] | (quartile[1::4] << 2) | (quartile[2::4] << 4) | (quartile[3::4] << 6)
    check = int((np.arange(1, len(raw) + 1, dtype=np.uint64) * (raw.astype(np.uint64) + np.uint64(1))).sum() % 251)
    length = min(255, round(8 * math.log2(len(raw) + 1)))
    ratios = (int(q1 * 15 // q3) << 4 | int(q2 * 15 // q3)) if q3 else 0
    return bytes([check, length, ratios]).hex() + packed.astype(np.uint8).tobytes().hex()


#: Number of bucket differences of two packed bytes: four quartiles each.
_BYTE = np.arange(256)
_STEPS = sum(np.abs(((_BYTE[:, None] >> s) & 3) - ((_BYTE[None, :] >> s) & 3)) for s in (0, 2, 4, 6))


def difference(a: str, b: str) -> float:
    """0 for equal digests; grows with unlike buckets, lengths and ratios."""
    if a == b:
        return 0.0
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    buckets = float(_STEPS[x[3:], y[3:]].sum())
    length = min(24.0, abs(int(x[1]) - int(y[1])))
    ratios = sum(min(8, abs((int(x[2]) >> s & 15) - (int(y[2]) >> s & 15))) for s in (0, 4))
    return buckets + length + ratios + (x[0] != y[0])


def likeness(a: str, b: str) -> float:
    return 1.0 - min(difference(a, b), CAP) / CAP


def with_next(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as rows (doc_id, text, bucket, tail), dealt and sorted so that the row after a document in its bucket is its
    successor; rows with tail 1 only follow."""
    n = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("k"))
    # As many ids as there are partitions come to the driver.
    found = rows.agg(F.min("k").alias("least"), F.percentile_approx("k", [i / n for i in range(1, n)], 10 * n).alias("cuts")).first()
    repeats = Counter(c for c in (found["least"], *(found["cuts"] or [])) if c is not None)
    hot = [c for c, m in repeats.items() if m > 1]
    rows = rows.withColumn("at", F.struct("k", (F.when(F.col("k").isin(hot), F.xxhash64("text")).otherwise(F.lit(LEAST)) if hot else F.lit(LEAST)).alias("h")))
    cuts = sorted((c, LEAST + i * (2**64 // m)) for c, m in repeats.items() for i in range(m))
    if hot:
        # A range begins with its least row, and an empty range is none.
        found = rows.groupBy(F.shiftright(placed(cuts), 1).alias("own")).agg(F.min("at").alias("at"))
        cuts = sorted(tuple(r["at"]) for r in found.collect())
    rows = rows.withColumn("found", placed(cuts)).withColumns({"own": F.shiftright("found", 1), "begins": F.col("found") % 2 == 1})
    own, before = F.struct(F.col("own").alias("bucket"), F.lit(0).alias("tail")), F.struct(F.pmod(F.col("own") - 1, F.lit(max(1, len(cuts)))).alias("bucket"), F.lit(1).alias("tail"))
    rows = rows.select("doc_id", "text", "k", F.explode(F.when(F.col("begins"), F.array(own, before)).otherwise(F.array(own))).alias("place")).select("doc_id", "text", "k", "place.bucket", "place.tail")
    return rows.repartitionById(max(1, len(cuts)), F.col("bucket").cast("int")).sortWithinPartitions("bucket", "tail", "k", F.xxhash64("text"))


def places(cuts: np.ndarray, hashes: np.ndarray, k: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Twice the number of the range that (k, h) lies in, and 1 more if the range begins with it.  Ranges begin at (cuts, hashes), sorted: a search by halving,
    so a row's work hardly grows with their number."""
    low, high = np.searchsorted(cuts, k, "left"), np.searchsorted(cuts, k, "right")
    at = high.copy()
    shared = np.flatnonzero(high > low)  # rows whose id some range begins with
    for i in np.unique(low[shared]):
        own = shared[low[shared] == i]
        at[own] = i + np.searchsorted(hashes[i : high[own[0]]], h[own], "right")
    at = np.maximum(at - 1, 0)
    return at * 2 + ((cuts[at] == k) & (hashes[at] == h))


def placed(cuts: list[tuple[int, int]]) -> Column:
    """``places`` of a row's ``at``."""
    if not cuts:
        return F.lit(0).cast("long")
    first, second = (np.array(c, np.int64) for c in zip(*cuts, strict=True))

    @F.pandas_udf("long")
    def find(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(places(first, second, k.to_numpy(), h.to_numpy()))

    return find(F.col("at.k"), F.col("at.h"))


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the start of the following text, or all of it."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next."""
    import hashlib

    fields = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, doc_id, text, digest) that waits for its successor
        for batch in batches:
            out = {name: [] for name in fields.names}
            for bucket, tail, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text")), strict=True):
                own = None
                if held and held[0] == bucket:
                    own = digest(text.encode())
                    new = edited(held[2], text).encode()
                    other = digest(new)
                    values = (held[1], len(held[2]), hashlib.sha256(new).hexdigest(), held[3], other, likeness(held[3], other), likeness(held[3], own))
                    for name, value in zip(fields.names, values, strict=True):
                        out[name].append(value)
                held = None if tail else (bucket, doc_id, text, own or digest(text.encode()))
            yield pa.RecordBatch.from_pydict(out, fields)

    return with_next(spark, docs).select("bucket", "tail", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
