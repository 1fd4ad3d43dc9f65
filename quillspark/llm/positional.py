"""Benchmark decontamination with a distributed positional inverted index.

The index holds a posting list for each term of each *block* of documents (``BLOCK_CHARS`` bytes of text): the places of the term, counted over all
words of the block, with one place left free between documents.  Blocks are written by the tasks that read the documents; nothing is shuffled to
build the index, and a term that every document uses costs a row a block.  All words are indexed, so one index serves any test set.

A test item is a phrase, or all windows of ``size`` consecutive words of it.  Its windows are looked up by their rarest term in the whole index:
blocks without it are not touched.  Where it occurs, a task meets the lists of the items' terms in one block, and intersects them window by
window from the rarest on, each shifted by the term's offset in the window: what is left are the places where the window begins.  A
proximity match needs all distinct terms of a window, in any order, within ``slop`` places more than the window has.

The items are the stated query set; a task holds those that a block may match, and one block's lists of their terms.  Joins are left to Spark,
which broadcasts a side only if its measured size is small.

Null and empty texts have no words; items without words match nothing.  Texts of any length are indexed whole; a block ends after the text
that fills it.  Repeated documents are found each; items that repeat an id are one item with the windows of all, and so are items
without an id, which are listed as the empty text.  Empty tables give no rows, or documents without hits.  Of the input only the ids and texts are read, so
names of other columns are free.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.llm.common import quoted, tidy, written
from quillspark.llm.words import Words, classes, column_bytes

#: Bytes of text in a block of the index.
BLOCK_CHARS = 16_000_000
#: Words of a window.
SIZE = 10
# The bytes that are not part of words, all ASCII but digits and letters.
SPACES = bytes(b for b in range(128) if not chr(b).isalnum())


def index(spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(block, term, places): the posting lists.  A row without a term has the documents of a block: ``ids``, and the place of the first
    word of each; the places end with one past the block."""
    chosen = docs.select(F.col(quoted(id_column)).alias("id"), F.col(quoted(text)).alias("text"))
    kind = chosen.schema["id"].dataType
    schema = pa.schema([("block", pa.int64()), ("term", pa.string()), ("places", pa.list_(pa.int32())), ("ids", pa.list_(to_arrow_type(kind)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), count()

        def block(ids: list, texts: list[bytes | None]) -> Iterator[pa.RecordBatch]:
            number = (task << 32) | next(serial)
            words, n = Words(texts, classes(SPACES)), len(texts)
            first = np.zeros(n + 1, np.int32)
            np.cumsum(words.lengths + 1, out=first[1:])
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, pa.string()), pa.array([first], pa.list_(pa.int32())), pa.array([ids], schema.field("ids").type)], schema=schema)
            # The free places are one for each document before.
            keys = words.ids.astype(np.int64) << 32
            keys |= np.arange(len(words)) + words.text
            keys.sort()
            places, ends = (keys & 0xFFFFFFFF).astype(np.int32), np.zeros(len(words.distinct) + 1, np.int32)
            np.cumsum(np.bincount(words.ids, minlength=len(words.distinct)), out=ends[1:])
            del keys
            for a in range(0, len(words.distinct), 4096):
                b = min(a + 4096, len(words.distinct))
                lists = pa.ListArray.from_arrays(pa.array(ends[a : b + 1] - ends[a]), pa.array(places[ends[a] : ends[b]]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, number)), words.distinct.slice(a, b - a), lists, pa.nulls(b - a, schema.field("ids").type)], schema=schema)

        ids, texts, held = [], [], 0
        for batch in batches:
            for doc_id, data in zip(batch.column("id").to_pylist(), column_bytes(batch.column("text")), strict=True):
                ids.append(doc_id)
                texts.append(data)
                held += len(data or b"") + 64
                if held >= block_chars:
                    yield from block(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield from block(ids, texts)

    return written(spark, chosen.mapInArrow(tidy(run), f"block long, term string, places array<int>, ids array<{kind.simpleString()}>"), "positional")


def documents_of(postings: DataFrame) -> DataFrame:
    """(block, doc, id, n_words): the documents of an index, numbered within their block."""
    df = postings.where("term IS NULL").select("block", "places", F.posexplode("ids").alias("doc", "id"))
    return df.select("block", "doc", "id", (F.get("places", F.col("doc") + 1) - F.get("places", F.col("doc")) - 1).cast("long").alias("n_words"))


def cut_items(items: DataFrame, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words): the words of each item that has any; the item is its id as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(column_bytes(batch.column("text")), classes(SPACES))
            flat, ends = words.distinct.take(pa.array(words.ids)), np.concatenate([[0], np.cumsum(words.lengths)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("item"), lists], names=["item", "words"])

    chosen = items.select(F.coalesce(F.col(quoted(id_column)).cast("string"), F.lit("")).alias("item"), F.col(quoted(text)).alias("text"))
    return chosen.mapInArrow(run, "item string, words array<string>").where(F.size("words") > 0)


def window_starts(words: list, size: int) -> range:
    """Where windows begin: one window if there are fewer words than it takes."""
    return range(max(1, len(words) - size + 1))


def intersected(window: list[str], lists: dict[str, np.ndarray]) -> np.ndarray:
    """Where the window begins: lists met from the shortest on, each moved by the term's offset."""
    found = None
    for at in sorted(range(len(window)), key=lambda i: len(lists.get(window[i], ()))):
        own = lists.get(window[at])
        if own is None:
            return np.zeros(0, np.int64)
        if found is None:
            found = own - at
        else:
            wanted = found + at
            places = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
            found = found[own[places] == wanted]
        if not len(found):
            break
    return found


def together(window: list[str], lists: dict[str, np.ndarray], first: np.ndarray, slop: int) -> np.ndarray:
    """Documents in which all distinct terms of the window stand within its length and ``slop`` places more, in any order."""
    terms = sorted(set(window), key=lambda t: len(lists.get(t, ())))
    if any(t not in lists for t in terms):
        return np.zeros(0, np.int64)
    reach = len(window) + slop
    anchors = lists[terms[0]]
    for own in (lists[t] for t in terms[1:]):
        # Some place of the term is near enough.
        near = np.searchsorted(own, anchors + reach) > np.searchsorted(own, anchors - reach, side="right")
        anchors = anchors[near]
    docs = np.searchsorted(first, anchors, side="right") - 1
    found = []
    for anchor, doc in zip(anchors.tolist(), docs.tolist(), strict=True):
        # Spans that hold the anchor: from each place that may begin one, all terms must come soon enough.
        low, high = max(anchor - reach + 1, int(first[doc])), min(anchor + reach - 1, int(first[doc + 1]) - 2)
        begins = np.arange(low, anchor + 1)
        last = np.full(len(begins), anchor)
        for t in terms[1:]:
            own = lists[t]
            at = np.searchsorted(own, begins)
            nearest = np.where(at < len(own), own[np.minimum(at, len(own) - 1)], high + reach)
            last = np.maximum(last, nearest)
        if (last <= np.minimum(begins + reach - 1, high)).any():
            found.append(doc)
    return np.unique(np.array(found, np.int64))


def search(spark: SparkSession, postings: DataFrame, items: DataFrame, size: int = SIZE, slop: int | None = None) -> DataFrame:
    """items (item, words) against an index: (block, doc, n_hit, items, near) of the documents with matches: the words inside any occurrence of a
    window, the items with occurring windows, and those with proximity matches (null without ``slop``)."""
    items = written(spark, items, "positional-items")
    terms = items.select(F.explode("words").alias("term")).distinct()
    used = postings.where("term IS NOT NULL").join(terms, "term", "left_semi")
    known = used.groupBy("term").agg(F.sum(F.size("places")).alias("f"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    windows = items.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("words"), i + 1, F.lit(size)))).alias("window")).distinct()
    placed = windows.select("item", "window", F.explode(F.array_distinct("window")).alias("term")).join(known, "term", "left")
    # The rarest term of a window; one that occurs nowhere drops the window.
    rarest = placed.groupBy("item", "window").agg(F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "term")).alias("least")).where("least.f > 0")
    anchors = rarest.select("item", F.col("least.term").alias("term")).distinct()
    where = used.select("term", "block").join(anchors, "term").select("block", "item").distinct()
    asked = where.join(items, "item").withColumnRenamed("block", "within")
    lists = used.join(where.select("block").distinct(), "block", "left_semi").select("block", "term", "places")
    lists = lists.unionByName(postings.where("term IS NULL").select("block", "term", "places"))
    schema = pa.schema([("block", pa.int64()), ("doc", pa.int32()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return schema.empty_table()
        here: dict[str | None, np.ndarray] = {}
        for batch in left.to_batches():
            column = batch.column("places")
            flat, ends = column.flatten().to_numpy(), np.array(column.offsets) - column.offsets[0].as_py()
            for i, term in enumerate(batch.column("term").to_pylist()):
                here[term] = flat[ends[i] : ends[i + 1]].astype(np.int64)
        first, block = here.pop(None), right.column("within")[0].as_py()
        hits, by_doc, near, done = [], defaultdict(set), defaultdict(set), {}
        for item, words in zip(right.column("item").to_pylist(), right.column("words").to_pylist(), strict=True):
            for i in window_starts(words, size):
                window = tuple(words[i : i + size])
                if window not in done:
                    found = intersected(window, here)
                    done[window] = np.unique(np.searchsorted(first, found, side="right") - 1).tolist()
                    hits.append((found[:, None] + np.arange(len(window))).ravel())
                for doc in done[window]:
                    by_doc[doc].add(item)
                if slop is not None:
                    for doc in together(window, here, first, slop).tolist():
                        near[doc].add(item)
        places = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        n_hit = np.bincount(np.searchsorted(first, places, side="right") - 1, minlength=len(first))
        docs = sorted({*by_doc, *near})
        return pa.table([pa.array([block] * len(docs)), pa.array(docs, pa.int32()), pa.array([int(n_hit[d]) for d in docs]), pa.array([sorted(by_doc[d]) for d in docs], pa.list_(pa.string())), pa.array([sorted(near[d]) if slop is not None else None for d in docs], pa.list_(pa.string()))], schema=schema)

    return lists.groupBy("block").cogroup(asked.groupBy("within")).applyInArrow(match, "block long, doc int, n_hit long, items array<string>, near array<string>")


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, size: int = SIZE, slop: int | None = None, id_column: str = "doc_id", item_column: str = "item_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, n_words, n_hit, items, near) of every document."""
    postings = index(spark, docs, id_column, text, block_chars)
    found = search(spark, postings, cut_items(items, item_column, text), size, slop)
    none = F.array().cast("array<string>")
    df = documents_of(postings).join(found, ["block", "doc"], "left")
    return df.select("id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"), F.when(F.lit(slop is not None), F.coalesce("near", none)).alias("near"))
