"""An inverted-file index of vectors: cells around centres, of which a query probes the nearest few.

Building it fits the centres on a bounded sample, assigns every row to the cell of its most similar centre, and writes the rows partitioned by cell:
a probe reads the files of its cell and no others.  A search sends each query to its ``probes`` nearest cells, meets batches of a cell's rows with
blocks of the cell's queries in one matrix product each, and keeps the k best of a query in each task before anything is
shuffled.  Scores are exact; what a search can miss lies in cells that it did not probe.  As many probes as cells give the
exact result, as does ``retrieval.dense_top_k``.

How many probes a recall takes depends on the data: clusters need few, noise in many dimensions needs most of the cells.  The index measures it when it is built, on
the sample: for ``JUDGES`` of its rows it finds the ``NEIGHBOURS`` nearest in the sample by brute force, and how far down the row's list of cells theirs stand.
A search that names a recall gets the probes that reached it.

Bounds: the sample is ``SAMPLE`` rows, chosen by the hash of their ids, and there are at most ``CELLS`` centres, about the square root of the
rows; both come to the driver.  A cell that holds many rows is many files and many tasks.

Vectors that are missing, empty, zero, or hold null or non-finite components are kept in the cell -1, which no query probes; queries like that find nothing, nor do
vectors of another dimension than the index.  Ties go to the smaller id.  Columns beside id and vector are kept for filters; their names must not be
those of ``RESERVED``.  An index of no rows answers nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.retrieval import BLOCK, DIGITS, top_k, unit_rows

#: Rows the centres are fitted on, and the most centres.
SAMPLE, CELLS = 65_536, 4096
#: Rounds of the fit.
ROUNDS = 12
#: Rows of the sample that the recall is measured with, and neighbours of each.
JUDGES, NEIGHBOURS = 512, 20
RESERVED = ("cell",)


def recall_curve(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The recall of 1, 2, ... probes among rows ``x`` of unit length."""
    if not len(centres):
        return np.zeros(0)
    own = (x @ centres.T).argmax(axis=1)
    found = np.zeros(len(centres))
    for row in x[: min(JUDGES, len(x))]:
        near = np.argsort(-(x @ row), kind="stable")[:NEIGHBOURS]
        place = np.empty(len(centres), np.int64)
        place[np.argsort(-(centres @ row), kind="stable")] = np.arange(len(centres))
        found += np.bincount(place[own[near]], minlength=len(centres)) / len(near)
    return found.cumsum() / max(1, min(JUDGES, len(x)))


def fit_centres(x: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centres of unit length by spherical k-means; an empty cell starts anew at the row that is worst served."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        alike = x @ centres.T
        own, best = alike.argmax(axis=1), alike.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[empty] = x[np.argsort(best)[: len(empty)]]
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1.0), centres)
    return centres


def cells_for(rows: int) -> int:
    return max(1, min(CELLS, round(rows**0.5)))


class VectorIndex:
    """``centres``, the recall of 1, 2, ... probes, and the folder of rows: id, vector, the columns for filters, and ``cell``."""

    def __init__(self, spark: SparkSession, path: str, centres: np.ndarray, recall: np.ndarray):
        self.spark, self.path, self.centres, self.recall = spark, path, centres, recall

    @staticmethod
    def build(spark: SparkSession, vectors: DataFrame, path: str, cells: int | None = None) -> VectorIndex:
        """Index vectors (id, vector, ...) under a folder that driver and executors share."""
        taken = [c for c in vectors.columns if c.lower() in RESERVED]
        if taken:
            raise ValueError(f"columns with reserved names: {taken}")
        sized = vectors.select("id", "vector").where(F.size("vector") > 0)
        dimension = sized.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "d").first()
        rows = dimension["n"] if dimension else 0
        sample = sized.where(F.size("vector") == (dimension["d"] if dimension else 0)).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
        x = unit_rows(sample.column("vector").combine_chunks()) if sample.num_rows else np.zeros((0, 1))
        x = x[np.abs(x).sum(axis=1) > 0]
        centres = fit_centres(x, cells or cells_for(rows)) if len(x) else np.zeros((0, dimension["d"] if dimension else 0))
        index = VectorIndex(spark, path, centres, recall_curve(x, centres))
        # What a cell holds is gathered, and parted again where it is large.
        index.assigned(vectors).hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        spark.createDataFrame([(no, c.tolist(), float(r)) for no, (c, r) in enumerate(zip(centres, index.recall, strict=True))], "cell int, centre array<double>, recall double").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        return index

    @staticmethod
    def open(spark: SparkSession, path: str) -> VectorIndex:
        rows = sorted(spark.read.parquet(f"{path}/centres").collect(), key=lambda r: r["cell"])
        return VectorIndex(spark, path, np.array([r["centre"] for r in rows], np.float64).reshape(len(rows), -1), np.array([r["recall"] for r in rows], np.float64))

    def probes_for(self, recall: float) -> int:
        """The fewest probes that reached a recall on the sample."""
        return int(np.argmax(self.recall >= recall - 1e-12)) + 1 if (self.recall >= recall - 1e-12).any() else len(self.centres)

    def add(self, vectors: DataFrame) -> None:
        """Index more rows with the centres there are."""
        self.assigned(vectors).hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")

    def assigned(self, vectors: DataFrame) -> DataFrame:
        """vectors with the cell of each."""
        centres = self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.append_column("cell", pa.array(nearest(batch.column("vector"), centres, 1)[:, 0], pa.int32()))

        return vectors.mapInArrow(run, T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType())]))

    def probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """(cell, qids, left): the queries that probe each cell, packed into blocks."""
        centres = self.centres

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = nearest(batch.column("vector"), centres, probes)
                at, which = np.nonzero(cells >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(cells[at, which], pa.int32()), batch.column("qid").take(pa.array(at)), batch.column("vector").take(pa.array(at))], names=["cell", "qid", "vector"])

        def pack(table: pa.Table) -> pa.Table:
            parts = []
            for begin in range(0, table.num_rows, BLOCK):
                own = table.slice(begin, BLOCK)
                parts.append((own.column("cell")[0].as_py(), own.column("qid").to_pylist(), unit_rows(own.column("vector").combine_chunks()).tobytes()))
            return pa.table({"cell": pa.array([p[0] for p in parts], pa.int32()), "qids": pa.array([p[1] for p in parts], pa.list_(pa.int64())), "left": pa.array([p[2] for p in parts], pa.binary())})

        sent = queries.select("qid", "vector").mapInArrow(choose, f"cell int, qid long, vector {queries.schema['vector'].dataType.simpleString()}")
        # A salt bounds the queries that are packed together.
        return sent.withColumn("salt", F.pmod(F.xxhash64("qid"), F.lit(64))).groupBy("cell", "salt").applyInArrow(lambda t: pack(t.select(["cell", "qid", "vector"])), "cell int, qids array<long>, left binary")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, recall: float = 0.95, where: Column | str | None = None) -> DataFrame:
        """queries (qid, vector) to (qid, id, score, rank): the k most similar of the rows that pass ``where`` and lie in a probed cell: one of
        ``probes``, or of as many as ``recall`` takes."""
        probes = self.probes_for(recall) if probes is None else probes
        rows = self.spark.read.parquet(f"{self.path}/rows") if len(self.centres) else None
        if rows is None:
            return self.spark.createDataFrame([], "qid long, id long, score double, rank int")
        rows = rows.where("cell >= 0")
        if where is not None:
            rows = rows.where(where)
        dimension = self.centres.shape[1]

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = batch.column("cell").to_numpy()
                for cell in np.unique(cells):
                    own = batch.filter(pa.array(cells == cell))
                    for begin in range(0, own.num_rows, BLOCK):
                        part = own.slice(begin, BLOCK)
                        yield pa.RecordBatch.from_pydict({"cell": pa.array([cell], pa.int32()), "keys": [part.column("id").to_pylist()], "right": [unit_rows(part.column("vector")).tobytes()]}, pa.schema([("cell", pa.int32()), ("keys", pa.list_(pa.int64())), ("right", pa.binary())]))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in (row for batch in batches for row in batch.to_pylist()):
                x, y = np.frombuffer(r["left"]).reshape(-1, dimension), np.frombuffer(r["right"]).reshape(-1, dimension)
                alike, keys = np.round(x @ y.T, DIGITS) + 0.0, np.array(r["keys"])
                order = np.lexsort((np.broadcast_to(keys, alike.shape), -alike), axis=1)[:, :k]
                yield pa.RecordBatch.from_pydict({"qid": np.repeat(r["qids"], order.shape[1]), "id": keys[order].ravel(), "score": np.take_along_axis(alike, order, 1).ravel()}, pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]))

        asked = self.probed(queries, probes)
        # Files of cells that no query probes are not read.
        rows = rows.join(asked.select("cell").distinct(), "cell", "left_semi") if probes < len(self.centres) else rows
        lists = rows.select("cell", "id", "vector").mapInArrow(pack, "cell int, keys array<long>, right binary")
        return top_k(lists.join(asked, "cell").select("qids", "left", "keys", "right").mapInArrow(meet, "qid long, id long, score double"), k)


def nearest(column: pa.Array, centres: np.ndarray, probes: int) -> np.ndarray:
    """The cells of the most similar centres of each row, best first; -1 for rows that have none."""
    sizes = np.array(pa.compute.fill_null(pa.compute.list_value_length(column), 0))
    found = np.full((len(column), max(1, min(probes, len(centres)))), -1, np.int64)
    at = np.flatnonzero(sizes == centres.shape[1]) if len(centres) else []
    if len(at):
        x = unit_rows(column.take(pa.array(at)))
        order = np.argsort(-np.round(x @ centres.T, 12), axis=1, kind="stable")[:, : found.shape[1]]
        found[at] = np.where(np.abs(x).sum(axis=1, keepdims=True) > 0, order, -1)
    return found
