"""An inverted index for BM25 that is kept up to date and searched without scoring every document that shares a word with a question.

A row of the index is a *bundle* of up to ``BUNDLE`` documents with all their postings.  Its documents lie by length in *ranges* of ``RANGE``; for each term of a
range the bundle holds the largest frequency and the least length, from which the most that the term can give a document of the range
follows, whatever the parameters and however the mean length drifts.  A search brings every bundle together with blocks of questions, and in a task

1. adds these bounds up for each question and range;
2. scores the ``SEEDS`` ranges of a bundle with the highest bounds first: the k-th best score the task has found is the question's threshold;
3. drops ranges whose bound is below the threshold, and scores the rest exactly.

What is shuffled is the text, once, while the index is built (rows of one id meet), and k candidates of each question and task; no posting is.  The result is
that of ``retrieval.bm25`` with ``retrieval.top_k``.

Updates come in numbered batches.  A batch writes its own folders and, for ids it holds that are indexed already, tombstones of the
older versions; ``delete`` writes tombstones only.  Repeating the latest batch replaces what it wrote, so a stream that is restarted indexes each batch exactly
once.  Document counts, frequencies and the mean length are sums over what lives, less what is dead.  ``compact`` rewrites what lives as a new generation;
readers see it when its marker is written, the old one stays until it is removed.

Null and empty texts count as documents without words.  Rows without an id are left out; rows that repeat an id within a batch are each indexed, and their scores add
up.  Questions without known words find nothing.  Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.functions.text import tokens
from quillspark.operators.retrieval import B, DIGITS, K1, top_k

#: Documents of a range and of a bundle.
RANGE, BUNDLE = 16, 256
#: Ranges of a bundle that are scored to find a threshold.
SEEDS = 12
#: Questions of a block, and blocks that a task holds.
BLOCK, HELD = 256, 16
#: What rounding may add to a score.
SLACK = 2 * 10.0**-DIGITS

#: A bundle, named by its first id: a row of ids, lens and parts (its range) for each document; postings (rows, codes, tf) by range and term; for each term of a range where its
#: postings begin, its largest frequency and its least length.
PACK = "range long, ids array<long>, lens array<int>, parts binary, terms array<string>, rows binary, codes binary, tf binary, starts binary, most binary, least binary"
POSTS = f"gen int, batch long, {PACK}"
DEAD = "gen int, by long, batch long, range long, id long, len int"


def _keys(*names: str) -> list[str]:
    return ["batch", "range", *names]


class LexicalIndex:
    """An index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # Tables.

    def _read(self, name: str, schema: str) -> DataFrame:
        """A table of the current generation; an empty one before anything is written."""
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}/gen={self.generation()}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def generation(self) -> int:
        try:
            return self.spark.read.schema("gen int").parquet(f"{self.path}/current").agg(F.max("gen").alias("gen")).first()["gen"] or 0
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return 0

    def _write(self, df: DataFrame, name: str, gen: int, **key: int) -> None:
        (part, value), = key.items()
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/gen={gen}/{part}={value}")

    # Updates.

    def add(self, batch: int, chunks: DataFrame) -> None:
        """Index chunks (id, text) as batch number ``batch``, which replaces older versions of their ids."""
        gen = self.generation()
        chunks = chunks.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), "text")
        self._bury(batch, chunks.select("id"), gen)
        self._write(_bundled(chunks, tokens(F.col("text"))), "posts", gen, batch=batch)

    def delete(self, batch: int, ids: DataFrame) -> None:
        """Forget the ids (id) as of batch number ``batch``."""
        self._bury(batch, ids.select("id"), self.generation())

    def _bury(self, batch: int, ids: DataFrame, gen: int) -> None:
        old = self._rows().where(F.col("batch") < batch).join(ids.distinct(), "id", "left_semi")
        buried = self._read("dead", DEAD).where(F.col("by") < batch).select("batch", "id").distinct()
        self._write(old.join(buried, ["batch", "id"], "left_anti").select("batch", "range", "id", "len"), "dead", gen, by=batch)

    def compact(self) -> None:
        """What lives as a new generation of one batch, in fresh bundles."""
        gen, batch = self.generation() + 1, self.docs().agg(F.max("batch").alias("b")).first()["b"] or 0
        self._write(_bundled(self.bundles().mapInArrow(_words, "id long, words array<string>"), F.col("words")), "posts", gen, batch=batch)
        self.spark.createDataFrame([(gen,)], "gen int").coalesce(1).write.mode("append").parquet(f"{self.path}/current")

    # What lives.

    def dead(self) -> DataFrame:
        return self._read("dead", DEAD).select(*_keys("id"), "len").distinct()

    def _rows(self) -> DataFrame:
        """(batch, range, id, len) of all documents, those that are dead too."""
        return self._read("posts", POSTS).select(*_keys(), F.explode(F.arrays_zip("ids", "lens")).alias("doc")).select(*_keys(), F.col("doc.ids").alias("id"), F.col("doc.lens").alias("len"))

    def docs(self) -> DataFrame:
        """(batch, range, id, len) of the living documents."""
        return self._rows().join(self.dead().select("batch", "id"), ["batch", "id"], "left_anti")

    def bundles(self) -> DataFrame:
        """The bundles, with the ids of each that are ``gone``."""
        gone = self.dead().groupBy("batch", "range").agg(F.collect_set("id").alias("gone"))  # at most the documents of a bundle
        return self._read("posts", POSTS).drop("gen").join(gone, ["batch", "range"], "left")

    # Searching.

    def search(self, questions: DataFrame, k: int, k1: float = K1, b: float = B, seeds: int = SEEDS) -> DataFrame:
        """questions (qid, question) to (qid, id, score, rank)."""
        kind = questions.schema["qid"].dataType
        return top_k(self._met(questions).mapInArrow(_searcher(to_arrow_type(kind), k, k1, b, seeds), f"qid {kind.simpleString()}, id long, score double"), k)

    def postings_read(self, questions: DataFrame, k: int, seeds: int = SEEDS) -> tuple[int, int]:
        """How many postings a search scores, those of the seeds included, and how many plain BM25 would."""
        kind = to_arrow_type(questions.schema["qid"].dataType)
        sums = self._met(questions).mapInArrow(_searcher(kind, k, K1, B, seeds, tally=True), "read long, whole long")
        return tuple(sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("read", "whole")]).first())

    def _met(self, questions: DataFrame) -> DataFrame:
        """Every bundle with every block of questions: a row on either side stands for many."""
        wanted = questions.select("qid", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))
        weighted = self._weighted(wanted)
        terms = weighted.groupBy("qid").agg(F.collect_list(F.struct("term", "idf")).alias("terms"), F.first("mean").alias("mean"))
        size = questions.agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.lit(1)).alias("blocks"))
        dealt = terms.crossJoin(size).withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")))  # size is one row
        blocks = dealt.groupBy("block").agg(F.collect_list(F.struct("qid", "terms")).alias("asked"), F.first("mean").alias("mean"))
        return self.bundles().crossJoin(blocks)

    def _weighted(self, wanted: DataFrame) -> DataFrame:
        """(qid, term, idf, mean) of each word of a question that is indexed."""
        corpus = self.docs().agg(F.count("*").alias("N"), F.avg("len").alias("mean"))
        used = self.bundles().mapInArrow(_frequencies, "term string, n long").join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi")  # a vocabulary
        idf = used.groupBy("term").agg(F.sum("n").alias("df")).crossJoin(corpus)  # corpus is one row
        idf = idf.where("df > 0").select("term", F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "mean")
        return wanted.join(idf, "term")


def _bundled(docs: DataFrame, words: Column) -> DataFrame:
    """Documents (id, ...) with their ``words`` as bundles.  Rows of one id follow one another and share a bundle and a range."""
    fields = pa.schema([("range", pa.int64()), ("ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int32())), ("parts", pa.binary()), ("terms", pa.list_(pa.string())), *[(c, pa.binary()) for c in ("rows", "codes", "tf", "starts", "most", "least")]])

    def bundle(own: pa.Table) -> pa.RecordBatch:
        ids, at = np.unique(own.column("id").to_numpy(), return_inverse=True)
        lens = np.array(pa.compute.list_value_length(own.column("words")))
        place = np.argsort(np.argsort(np.bincount(at, lens), kind="stable"))[at]
        order = np.argsort(place, kind="stable")
        own, lens, parts = own.take(pa.array(order)).combine_chunks(), lens[order].astype(np.int32), (place[order] // RANGE).astype(np.int32)
        coded = pa.compute.list_flatten(own.column("words")).combine_chunks().dictionary_encode()
        size = max(len(coded.dictionary), 1)
        keys, tf = np.unique(np.repeat(np.arange(len(lens), dtype=np.int64), lens) * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        rows, codes = np.divmod(keys, size)
        order = np.lexsort((rows, codes, parts[rows]))
        rows, codes, tf = rows[order].astype(np.int32), codes[order].astype(np.int32), tf[order].astype(np.int32)
        changes = (np.diff(parts[rows], prepend=-1) != 0) | (np.diff(codes, prepend=-1) != 0)
        starts = np.flatnonzero(changes).astype(np.int32)
        most, least = (np.maximum.reduceat(tf, starts), np.minimum.reduceat(lens[rows], starts)) if len(rows) else (tf, tf)
        blobs = {c: [x.tobytes()] for c, x in (("rows", rows), ("codes", codes), ("tf", tf), ("starts", starts), ("most", most), ("least", least))}
        return pa.RecordBatch.from_pydict({"range": [ids[0]], "ids": [own.column("id").to_numpy()], "lens": [lens], "parts": [parts.tobytes()], "terms": [coded.dictionary], **blobs}, fields)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            ids = held.column("id").to_numpy()
            begins = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))[::BUNDLE] if len(ids) else []
            for begin, end in zip(begins[:-1], begins[1:], strict=True):
                yield bundle(held.slice(begin, end - begin))
            held = held.slice(begins[-1]) if len(begins) else None  # its last id may go on
        if held is not None:
            yield bundle(held)

    return docs.repartition("id").sortWithinPartitions("id").select("id", words.alias("words")).mapInArrow(pack, PACK)


class _Bundle:
    """One row of the index as arrays."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.ids, self.lens = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "lens"))
        self.terms = batch.column("terms")[i].values
        self.parts, self.rows, self.codes, self.tf, self.starts, self.most, self.least = (np.frombuffer(batch.column(c)[i].as_py(), np.int32) for c in ("parts", "rows", "codes", "tf", "starts", "most", "least"))
        gone = batch.column("gone")[i].values
        self.alive = np.ones(len(self.ids), bool) if gone is None else ~np.isin(self.ids, gone.to_numpy(zero_copy_only=False))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[_Bundle]:
    return (_Bundle(batch, i) for batch in batches for i in range(batch.num_rows))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bundles to living documents, the words of each in some order."""
    for own in _each(batches):
        order = np.argsort(own.rows, kind="stable")
        words = own.terms.take(pa.array(np.repeat(own.codes[order], own.tf[order])))
        ends = np.cumsum(own.lens, dtype=np.int32)
        docs = pa.RecordBatch.from_arrays([pa.array(own.ids), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), words)], ["id", "words"])
        yield docs.filter(pa.array(own.alive))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bundles to the number of living documents that use each term."""
    for own in _each(batches):
        n = np.bincount(own.codes[own.alive[own.rows]], minlength=len(own.terms))
        yield pa.RecordBatch.from_arrays([own.terms, pa.array(n.astype(np.int64))], ["term", "n"])


class _Questions:
    """One block: its terms by number, a matrix of their weights by question, and the best scores so far."""

    def __init__(self, asked: list[dict], mean: float, k: int, k1: float, b: float, seeds: int):
        self.mean, self.k, self.k1, self.b, self.seeds, self.qids = mean, k, k1, b, seeds, [a["qid"] for a in asked]
        vocabulary: dict[str, int] = {}
        places = [(vocabulary.setdefault(t["term"], len(vocabulary)), q, t["idf"]) for q, a in enumerate(asked) for t in a["terms"]]
        self.terms = pa.array(list(vocabulary), pa.string())
        self.weights = np.zeros((len(vocabulary), len(asked)))
        for t, q, w in places:
            self.weights[t, q] = w
        self.best = np.full((len(asked), k), -np.inf)

    def gain(self, tf: np.ndarray, lens: np.ndarray) -> np.ndarray:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * lens / self.mean))

    def score(self, own: _Bundle) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
        """(question, id, score) of the bundle's documents that may be among the k best, and how many postings were scored, of how many."""
        known = pa.compute.fill_null(pa.compute.index_in(own.terms, self.terms), -1).to_numpy(zero_copy_only=False)
        heads = np.flatnonzero(known[own.codes[own.starts]] >= 0)
        if not len(heads):
            return np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0), 0, 0
        met, at = np.unique(known[own.codes[own.starts[heads]]], return_inverse=True)
        weights, part = self.weights[met], own.parts[own.rows[own.starts[heads]]]
        ids, slots = np.unique(own.ids, return_inverse=True)
        repeats = np.zeros(own.parts[-1] + 1)
        np.maximum.at(repeats, own.parts, np.bincount(slots)[slots])  # rows of one id add up
        bounds = np.zeros((len(repeats), len(met)))
        bounds[part, at] = self.gain(own.most[heads], own.least[heads]) * repeats[part]
        bounds = bounds @ weights

        # Postings of known terms of living documents, by range.
        ends = np.append(own.starts[1:], len(own.rows))[heads]
        lengths = ends - own.starts[heads]
        posts = np.arange(lengths.sum()) + np.repeat(own.starts[heads] - np.cumsum(lengths) + lengths, lengths)
        terms = np.repeat(at, lengths)
        living = own.alive[own.rows[posts]]
        posts, terms = posts[living], terms[living]
        rows = own.rows[posts]
        gains, edges = self.gain(own.tf[posts], own.lens[rows]), np.searchsorted(own.parts[rows], np.arange(len(repeats) + 1))

        scores, done = np.full((len(ids), len(self.qids)), -np.inf), np.zeros(bounds.shape, bool)
        seeded, before = np.zeros(bounds.shape, bool), self.best
        np.put_along_axis(seeded, np.argsort(-bounds, axis=0, kind="stable")[: self.seeds], True, axis=0)
        for some in (seeded, ~seeded):
            todo = some & (bounds > 0) & (bounds + SLACK >= self.best[:, 0])
            for r in np.flatnonzero(todo.any(axis=1)):
                here, asked = slice(edges[r], edges[r + 1]), np.flatnonzero(todo[r])
                docs, doc = np.unique(slots[rows[here]], return_inverse=True)
                own_terms, term = np.unique(terms[here], return_inverse=True)
                uses = np.bincount(doc * len(own_terms) + term, gains[here], len(docs) * len(own_terms)).reshape(len(docs), -1)
                raw = uses @ weights[np.ix_(own_terms, asked)]
                scores[np.ix_(docs, asked)] = np.where(raw > 0, np.round(raw, DIGITS) + 0.0, -np.inf)  # every word that both have gives more than nothing
            done |= todo
            self.best = np.partition(np.concatenate([before, scores.T], axis=1), len(ids), axis=1)[:, len(ids) :]  # the k-th best comes first
        counts = np.zeros(bounds.shape[:1] + met.shape)
        np.add.at(counts, (own.parts[rows], terms), 1)
        counts = counts @ (weights > 0)
        doc, q = np.nonzero(np.isfinite(scores) & (scores >= self.best[:, 0]))
        return q, ids[doc], scores[doc, q], int(counts[done].sum()), int(counts.sum())


def _searcher(kind: pa.DataType, k: int, k1: float, b: float, seeds: int, tally: bool = False):
    """Bundles that meet blocks of questions to (qid, id, score), or to (read, whole): postings that were scored, and all of them."""
    fields = pa.schema([("read", pa.int64()), ("whole", pa.int64())] if tally else [("qid", kind), ("id", pa.int64()), ("score", pa.float64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Questions] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column("block")[i].as_py()
                if number not in held:
                    if len(held) == HELD:
                        held.pop(next(iter(held)))
                    held[number] = _Questions(batch.column("asked")[i].as_py(), batch.column("mean")[i].as_py(), k, k1, b, seeds)
                block = held[number]
                q, ids, scores, read, whole = block.score(_Bundle(batch, i))
                columns = [pa.array([read]), pa.array([whole])] if tally else [pa.array([block.qids[j] for j in q], kind), pa.array(ids, pa.int64()), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, schema=fields)

    return search
