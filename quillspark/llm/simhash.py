"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: XXH64 of all word 4-grams, a bit is set where more than half of the hashes have it.  Fingerprints that differ in at
most ``radius`` bits are linked; documents are grouped by reachability over these links.

Index: the 64 bits are cut into ``radius + m`` runs; two fingerprints within the radius agree on at least m of them.  For each choice of m
runs a copy of the distinct fingerprints is rearranged so that these runs lead, which makes them the top node of a hierarchy,
and sorted by the rank of its Gray code.  Under a top node, consecutive fingerprints share a masked bit pattern: the bits all of
them have alike.  The pattern is stored in the upper node, halves of the node refine it, and two nodes are compared by the
differences that their patterns already show: a pair of nodes with more than ``radius`` is dropped whole.  Leaves are
compared bit by bit.

m grows with the number of distinct fingerprints, so that an even top node never outgrows a tile and the copies of a fingerprint are 5 up to
33 million, 15 up to 8 thousand million, and 35 beyond: work grows with the input, not with its square.  A top node that is crowded
all the same is dealt by hash into tiles of about ``TILE``; each pair of its tiles is a task of its own and builds its own
hierarchies.  Copies collapse into one fingerprint before anything is compared.  A task returns a spanning forest of the links
it finds, at most one edge for each fingerprint, never all pairs.

Null and empty texts have fingerprint zero and are linked like any other.  Texts of any length are read whole; a task holds the hashes
of one text at a time.  Repeated rows stay.  Null ids take part, but never name a component unless all of its ids are null.  Empty
tables give no rows.  Of the input's columns only those asked for and the text are read; fp, root and component_id, which are
added, must not be among them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import HOT, ascii_lower, fresh, join_hot, partitions, tidy, written
from quillspark.llm.components import components

#: Fingerprints of one top node that one task holds.
TILE = 4096
#: Fingerprints in a leaf of the hierarchy.
LEAF = 32
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 16


def bits_of(hashes: list[int]) -> int:
    """The fingerprint of a list of unsigned 64-bit hashes."""
    if not hashes:
        return 0
    total = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), CHUNK):
        own = np.array(hashes[begin : begin + CHUNK], "<u8").view(np.uint8)
        total += np.unpackbits(own.reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = 4) -> int:
    import re

    import xxhash

    words = re.findall("[^\\x20\\x09-\\x0D]+", text)
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    return bits_of([h(" ".join(words[i : i + shingle]).encode(), 42) for i in range(n)])


def fingerprints(docs: DataFrame, columns: list[str], shingle: int = 4) -> DataFrame:
    """``columns`` of docs and fp, the fingerprint as a signed long."""
    fields, own = docs.select(*columns).schema, fresh("text", columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(ascii_lower(t), shingle) for t in batch.column(own).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found, pa.int64())], names=[*columns, "fp"])

    return docs.select(*columns, F.col("text").alias(own)).mapInArrow(tidy(run), fields.add("fp", "long"))


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray code."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def runs(n: int) -> list[tuple[int, int]]:
    """(first bit from the top, length) of n runs that cover the 64 bits."""
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def trees(radius: int, m: int) -> list[list[tuple[int, int]]]:
    """For each choice of m of radius + m runs: all runs, the chosen ones first."""
    cuts = runs(radius + m)
    return [[*chosen, *(c for c in cuts if c not in chosen)] for chosen in combinations(cuts, m)]


def leading(radius: int, distinct: int, tile: int) -> int:
    """How many runs lead: the fewest whose top nodes hold no more than a tile if fingerprints are spread evenly."""
    return next((m for m in (1, 2, 3) if distinct <= tile << (64 * m // (radius + m))), 3)


def arrange(values: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """The runs of each value in another order, the first one leading."""
    out = np.zeros_like(values)
    for at, n in order:
        out = (out << np.uint64(n)) | ((values >> np.uint64(64 - at - n)) & np.uint64((1 << n) - 1))
    return out


class Forest:
    """Union-find; ``join`` tells whether two sets became one."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.top(i), self.top(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def levels_of(sorted_values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Nodes over Gray-sorted values, from leaves of LEAF values up to one root: (pattern, mask) of the bits all values of a node share."""
    starts = np.arange(0, len(sorted_values), LEAF)
    ones, zeros = np.bitwise_and.reduceat(sorted_values, starts), np.bitwise_and.reduceat(~sorted_values, starts)
    found = [(ones, ones | zeros)]
    while len(ones) > 1:
        starts = np.arange(0, len(ones), 2)
        ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts)
        found.append((ones, ones | zeros))
    return found[::-1]


def within(a: np.ndarray, b: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of Gray-sorted values, a with b or with itself, that differ in at most ``radius`` bits.  Descends both
    hierarchies together and drops pairs of nodes by the differences of their shared patterns."""
    left, right = levels_of(a), levels_of(a if b is None else b)
    depth = max(len(left), len(right))
    left, right = left[:1] * (depth - len(left)) + left, right[:1] * (depth - len(right)) + right
    repeat_l, repeat_r = depth - len(levels_of(a)), depth - len(levels_of(a if b is None else b))
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(depth):
        (pattern_l, mask_l), (pattern_r, mask_r) = left[level], right[level]
        if level:
            i_next = [i] if level <= repeat_l else [2 * i, 2 * i + 1]
            j_next = [j] if level <= repeat_r else [2 * j, 2 * j + 1]
            pairs = [(x, y) for x in i_next for y in j_next]
            i, j = np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])
            keep = (i < len(pattern_l)) & (j < len(pattern_r))
            if b is None:
                keep &= i <= j
            i, j = i[keep], j[keep]
        near = np.bitwise_count((pattern_l[i] ^ pattern_r[j]) & mask_l[i] & mask_r[j]) <= radius
        i, j = i[near], j[near]
    other = a if b is None else b
    for begin in range(0, len(i), 512):  # leaf pairs
        x = (i[begin : begin + 512, None] * LEAF + np.arange(LEAF))[:, :, None]
        y = (j[begin : begin + 512, None] * LEAF + np.arange(LEAF))[:, None, :]
        there = (x < len(a)) & (y < len(other))
        if b is None:
            there = there & (x < y)
        near = there & (np.bitwise_count(a[np.minimum(x, len(a) - 1)] ^ other[np.minimum(y, len(other) - 1)]) <= radius)
        k, p, q = np.nonzero(near)
        yield x[k, p, 0], y[k, 0, q]


def links(spark: SparkSession, distinct: DataFrame, radius: int = 4, tile: int = TILE, lead: int = 1) -> DataFrame:
    """distinct (fp) to a spanning forest of links for every task: (u, v) with fingerprints that differ in at most ``radius`` bits."""
    orders = trees(radius, lead)

    def top(order: list[tuple[int, int]]):
        value = F.lit(0).cast("long")
        for a, n in order[:lead]:
            value = F.shiftleft(value, n).bitwiseOR(F.shiftrightunsigned(F.shiftleft(F.col("fp"), a), 64 - n))
        return value

    # The top node of each hierarchy: (hierarchy, leading runs).
    tops = F.explode(F.array(*[F.struct(F.lit(k).alias("tree"), top(order).alias("top")) for k, order in enumerate(orders)]))
    spread = distinct.select("fp", tops.alias("t")).select("fp", "t.tree", "t.top")
    sizes = spread.groupBy("tree", "top").agg(F.count("*").alias("n")).where("n > 1")
    # One tile for all but crowded nodes.
    tiles = spread.join(sizes, ["tree", "top"]).withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    cut = tiles.where("tiles > 1").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, F.col("tile")).alias("a"), F.greatest(o, F.col("tile")).alias("b"))))
    dealt = tiles.where("tiles = 1").select("fp", "tree", "top", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("tile"))
    dealt = dealt.union(cut.select("fp", "tree", "top", "tile", pairs.alias("p")).select("fp", "tree", "top", "p.a", "p.b", "tile"))
    keys = ["tree", "top", "a", "b"]
    n = partitions(spark)

    def search(group: list[np.ndarray], tree: int, same: bool) -> Iterator[tuple[int, int]]:
        values = [x[np.argsort(gray_rank(arrange(x, orders[tree])))] for x in group]
        rotated = [arrange(x, orders[tree]) for x in values]
        nodes = values[0] if same else np.concatenate(values)
        forest, shift = Forest(len(nodes)), 0 if same else len(values[0])
        for i, j in within(rotated[0], None if same else rotated[1], radius):
            for x, y in zip(i.tolist(), (j + shift).tolist(), strict=True):
                if forest.join(x, y):
                    yield int(nodes[x]), int(nodes[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(key, held):
            fps, tile_of = np.concatenate([h[0] for h in held]).view(np.uint64), np.concatenate([h[1] for h in held])
            same = key[2] == key[3]
            group = [fps] if same else [fps[tile_of == key[2]], fps[tile_of == key[3]]]
            if len(fps) < 2 or min(map(len, group)) == 0:
                return None
            found = np.array(list(search(group, key[0], same)), np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"]) if len(found) else None

        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in keys]
            fps, tile_of = batch.column("fp").to_numpy(), batch.column("tile").to_numpy()
            new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            cut_at = [0, *(np.nonzero(new)[0] + 1).tolist(), batch.num_rows]
            for begin, end in zip(cut_at, cut_at[1:]):
                here = tuple(int(c[begin]) for c in columns)
                if key is not None and here != key:
                    if (out := close(key, held)) is not None:
                        yield out
                    held = []
                key = here
                held.append((fps[begin:end], tile_of[begin:end]))
        if key is not None and (out := close(key, held)) is not None:
            yield out

    return dealt.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), "u long, v long")


def near_duplicates(spark: SparkSession, docs: DataFrame, columns: list[str], radius: int = 4, shingle: int = 4, tile: int = TILE, lead: int | None = None) -> DataFrame:
    """``columns`` (doc_id among them), fp, root and component_id.  root is the smallest fingerprint that is reachable over links and tells
    components apart; component_id is the smallest doc_id of the component, which components may have in common."""
    prints = written(spark, fingerprints(docs, columns, shingle), "simhash")
    classes = written(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-classes")
    size = classes.agg(F.count("*").alias("distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    found = links(spark, classes.select("fp"), radius, tile, lead or leading(radius, size["distinct"], tile))
    roots = components(spark, found, "simhash")
    grouped = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    grouped = written(spark, grouped, "simhash-roots")
    # Partly aggregated where they lie: a large component is no single task.
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("prints"))
    large = named.where(F.col("prints") > size["distinct"] / HOT).select("root")  # fewer than HOT
    answer = join_hot(grouped.select("fp", "root"), named.select("root", "component_id"), "root", large)
    return join_hot(prints, answer, "fp", classes.where(F.col("n") > size["rows"] / HOT).select("fp"))
