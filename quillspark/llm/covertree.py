"""Vectors within a cosine threshold, by dual traversal of cover trees.

For unit vectors a cosine of at least ``t`` is a distance of at most eps = sqrt(2 - 2 t).  A cover tree nests levels whose radii
halve: the children of a node are centres more than half its radius apart that cover its members.  Two trees are
traversed together: a pair of nodes further apart than the sum of their covering radii and eps is dropped, a pair that lies within eps
whole is linked whole, and other pairs go down a level.  Where halving the radius no longer groups vectors, as
in high dimension, a node stays a leaf and leaf pairs are compared by one matrix product in double precision.

Over the cluster, the top level is a set of centres, one for ``TILE`` vectors, taken from a bounded sample (``SAMPLE`` vectors, at most
``CELLS`` centres, which dimensions share by their numbers of vectors); every vector is indexed under its nearest centre, its home.  A vector visits another cell only if the cell's covering radius
and the distances to both centres leave room for a link, and each pair of cells meets once.  Cells with more than ``TILE`` vectors are
dealt into tiles; each task holds the tree of one tile and takes visitors in batches.  All pairs are found exactly; a task returns
counts and a spanning forest of its links, at most one edge for each vector, never the pairs themselves.

Equal vectors collapse before anything is compared.  Vectors that are null, zero, or hold null or non-finite components link with
nothing: no links, a component of their own.  Vectors link only with those of the same dimension.  Repeated rows count as
vectors of their own; a null vec_id takes part but names no component unless it is alone.  Empty tables give no rows.  Other columns
of the input, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import HOT, join_hot, partitions, written
from quillspark.llm.components import components

SAMPLE, CELLS, TILE = 16384, 4096, 4096
LEAF = 64
#: Rows of one side of a matrix product.
BATCH = 2048
#: Slack for rounding when whole nodes are dropped or linked.
SLACK = 1e-7


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # very large or small components stay finite
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


class Node:
    """Rows ``members`` of a matrix, all within ``radius`` of the row ``centre``; children, or none for a leaf."""

    __slots__ = ("centre", "children", "members", "radius")

    def __init__(self, x: np.ndarray, centre: int, members: np.ndarray, reach: float):
        self.centre, self.members = centre, members
        away = distances(x[members], x[centre : centre + 1])[:, 0]
        self.radius, self.children = float(away.max()), []
        if len(members) <= LEAF or self.radius == 0.0:
            return
        while reach >= self.radius:
            reach /= 2
        nets, left = [], members
        while len(left):
            own = distances(x[left], x[left[:1]])[:, 0] <= reach
            nets.append((int(left[0]), left[own]))
            left = left[~own]
            if len(nets) * 2 > len(members) - len(left) and len(nets) >= 32:
                return  # most centres cover next to nothing: a leaf
        if len(nets) > 1:
            self.children = [Node(x, c, m, reach / 2) for c, m in nets]


class Links:
    """Link counts, weighted by the other side, and a spanning forest over rows of two matrices (or one twice)."""

    def __init__(self, weight_a: np.ndarray, weight_b: np.ndarray | None):
        self.same = weight_b is None
        self.weight = weight_a if self.same else np.concatenate([weight_a, weight_b])
        self.shift = 0 if self.same else len(weight_a)
        self.count = np.zeros(len(self.weight), np.int64)
        self.label = np.arange(len(self.weight))
        self.edges: list[tuple[int, int]] = []

    def merge(self, i: int, others: np.ndarray) -> None:
        found = np.unique(np.append(self.label[others], self.label[i]))
        if len(found) > 1:
            least = found[0]
            self.edges += [(int(least), int(x)) for x in found[1:]]
            self.label[np.isin(self.label, found)] = least

    def add(self, a: np.ndarray, b: np.ndarray, near: np.ndarray | None, once: bool) -> None:
        """Rows a and b are linked where ``near`` holds, or all of them.  ``once``: a and b are one set."""
        b = b + self.shift
        if near is None:
            self.count[a] += self.weight[b].sum()
            self.count[b] += 0 if once else self.weight[a].sum()
            if once:
                self.count[a] -= self.weight[a]
            self.merge(int(a[0]), np.concatenate([a, b]))
            return
        if once:
            np.fill_diagonal(near, False)
        if not near.any():
            return
        self.count[a] += near @ self.weight[b]
        if not once:
            self.count[b] += self.weight[a] @ near
        for i in np.nonzero(near.any(axis=1))[0]:
            self.merge(int(a[i]), b[near[i]])


def traverse(x: np.ndarray, y: np.ndarray, p: Node, q: Node, threshold: float, links: Links) -> None:
    """Find all links between members of two nodes."""
    eps = math.sqrt(2.0 - 2.0 * threshold)
    todo = [(p, q)]
    while todo:
        p, q = todo.pop()
        once = links.same and p is q
        apart = float(distances(x[p.centre : p.centre + 1], y[q.centre : q.centre + 1])[0, 0])
        if not once and apart > p.radius + q.radius + eps + SLACK:
            continue
        if (2 * p.radius if once else apart + p.radius + q.radius) <= eps - SLACK:
            links.add(p.members, q.members, None, once)
            continue
        if not p.children and not q.children:
            for i in range(0, len(p.members), BATCH):
                for j in range(i if once else 0, len(q.members), BATCH):
                    a, b = p.members[i : i + BATCH], q.members[j : j + BATCH]
                    links.add(a, b, x[a] @ y[b].T >= threshold, once and i == j)
        elif once:
            todo += [(c, d) for k, c in enumerate(p.children) for d in p.children[k:]]
        elif not q.children or (p.children and p.radius >= q.radius):
            todo += [(c, q) for c in near_children(x, p, y[q.centre], q.radius + eps)]
        else:
            todo += [(p, d) for d in near_children(y, q, x[p.centre], p.radius + eps)]


def near_children(x: np.ndarray, node: Node, point: np.ndarray, reach: float) -> list[Node]:
    away = distances(x[[c.centre for c in node.children]], point[None])[:, 0]
    return [c for c, d in zip(node.children, away, strict=True) if d <= c.radius + reach + SLACK]


def tree(x: np.ndarray) -> Node:
    return Node(x, 0, np.arange(len(x)), 2.0)


def top_level(vectors: np.ndarray, cells: int) -> np.ndarray:
    """Centres of the deepest level with at most ``cells`` of them; if the next level has too many, as many of its centres as fit."""
    x, reach, kept = unit(vectors), 1.0, np.zeros(1, np.int64)
    while len(kept) < cells and reach > 1e-3:
        net, left = [], np.arange(len(x))
        while len(left) and len(net) < cells:
            net.append(int(left[0]))
            left = left[distances(x[left], x[left[:1]])[:, 0] > reach]
        if len(net) >= len(kept):
            kept = np.array(net)
        if len(left):
            break
        reach /= 2
    return x[kept]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def classes_of(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Distinct usable vectors: cid, embedding, n (rows), least (smallest vec_id)."""
    found = rows.where("usable").groupBy("key", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    return written(spark, found.select(F.monotonically_increasing_id().alias("cid"), "key", "embedding", "n", "least", F.size("embedding").alias("dim")), "cover-classes")


def search(spark: SparkSession, classes: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """(u, v, n): for v null, n rows are linked to class u; else an edge of a spanning forest."""
    eps, n = math.sqrt(2.0 - 2.0 * threshold), partitions(spark)
    everything = classes.count()
    share = F.least(F.ceil(F.col("n") / tile), F.floor(F.col("n") * CELLS / max(1, everything)))
    # A dimension whose share is one cell needs no centre; at most CELLS / 2 others come to the driver.
    total = classes.groupBy("dim").agg(F.count("*").alias("n")).select("dim", share.cast("int").alias("cells")).where("cells > 1").collect()
    centres = {}
    for r in total:
        near = classes.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE * r["cells"] // CELLS + 64).select("embedding").toPandas()
        centres[r["dim"]] = top_level(np.array(near["embedding"].tolist()), r["cells"])
    shipped = spark.sparkContext.broadcast(centres)  # at most CELLS vectors

    def by_dim(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int]]:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            yield batch.filter(pa.array(dims == dim)), dim

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, dim in by_dim(batch):
                if dim in shipped.value:
                    d = distances(unit(matrix(own.column("embedding"), dim)), shipped.value[dim])
                    cell, away = d.argmin(axis=1), d.min(axis=1)
                else:
                    cell, away = np.zeros(len(own), np.int64), np.full(len(own), 2.0)
                yield pa.RecordBatch.from_arrays([own.column("dim"), pa.array(cell, pa.int32()), pa.array(away)], names=["dim", "cell", "away"])

    cells = {(r["dim"], r["cell"]): (r["n"], r["radius"]) for r in classes.select("dim", "embedding").mapInArrow(homes, "dim int, cell int, away double").groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).where("dim >= 0").collect()}
    # At most CELLS rows a dimension.
    plan = spark.sparkContext.broadcast({k: (math.ceil(m / tile), radius) for k, (m, radius) in cells.items()})
    names = ["dim", "cell", "tile", "visitor", "cid", "n", "embedding"]

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, dim in by_dim(batch):
                cid = own.column("cid").to_numpy()
                if dim in shipped.value:
                    d = distances(unit(matrix(own.column("embedding"), dim)), shipped.value[dim])
                else:
                    d = np.zeros((len(own), 1))
                home = d.argmin(axis=1)
                near = d[np.arange(len(own)), home]
                mixed = (cid * 2654435761 % 2**32) >> 7
                places = []
                for cell in range(d.shape[1]):
                    tiles, radius = plan.value.get((dim, cell), (0, 0.0))
                    for t in range(tiles):
                        at_home, mine = home == cell, mixed % tiles
                        places.append((cell, t, 0, np.nonzero(at_home & (mine == t))[0]))
                        guest = (home < cell) & (d[:, cell] <= radius + eps + SLACK) & (d[:, cell] - near <= 2 * eps + SLACK)
                        places.append((cell, t, 1, np.nonzero(guest | (at_home & (mine > t)))[0]))
                for cell, t, visitor, at in places:
                    if len(at):
                        some = own.take(pa.array(at))
                        same = lambda v, k=len(at): pa.array(np.full(k, v), pa.int32())
                        yield pa.RecordBatch.from_arrays([same(dim), same(cell), same(t), same(visitor), some.column("cid"), some.column("n"), some.column("embedding")], names=names)

    kind = classes.schema["embedding"].dataType.simpleString()
    placed = classes.select("dim", "cid", "n", "embedding").mapInArrow(visits, f"dim int, cell int, tile int, visitor int, cid long, n long, embedding {kind}")
    dealt = placed.repartition(n, "dim", "cell", "tile").sortWithinPartitions("dim", "cell", "tile", "visitor", "cid")
    fields = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])

    def result(links: Links, ids: np.ndarray) -> pa.RecordBatch:
        some = np.nonzero(links.count)[0]
        edges = np.array(links.edges, np.int64).reshape(-1, 2)
        u = np.concatenate([ids[some], ids[edges[:, 0]]])
        v = pa.array(np.concatenate([np.zeros(len(some), np.int64), ids[edges[:, 1]]]), mask=np.arange(len(u)) < len(some))
        counts = pa.array(np.concatenate([links.count[some], np.zeros(len(edges), np.int64)]), mask=np.arange(len(u)) >= len(some))
        return pa.RecordBatch.from_arrays([pa.array(u), v, counts], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, residents, held = None, [], None  # held: (matrix, tree, ids, weights) once the residents are complete

        def settle():
            x, ids, w = unit(np.concatenate([r[0] for r in residents])), np.concatenate([r[1] for r in residents]), np.concatenate([r[2] for r in residents])
            return x, tree(x), ids, w

        def alone(held):
            x, top, ids, w = held
            links = Links(w, None)
            traverse(x, x, top, top, threshold, links)
            return result(links, ids)

        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [batch.column(c).to_numpy() for c in ("dim", "cell", "tile", "visitor")]
            cuts = [0, *(np.nonzero(np.any([c[1:] != c[:-1] for c in parts], axis=0))[0] + 1).tolist(), batch.num_rows]
            for begin, end in zip(cuts, cuts[1:]):
                here, visitor = tuple(int(c[begin]) for c in parts[:3]), int(parts[3][begin])
                own = batch.slice(begin, end - begin)
                x, ids, w = matrix(own.column("embedding"), here[0]), own.column("cid").to_numpy(), own.column("n").to_numpy()
                if here != key:
                    if residents and held is None:
                        yield alone(settle())
                    key, residents, held = here, [], None
                if not visitor:
                    residents.append((x, ids, w))
                    continue
                if not residents:
                    continue
                if held is None:
                    held = settle()
                    yield alone(held)
                y = unit(x)
                links = Links(held[3], w)
                traverse(held[0], y, held[1], tree(y), threshold, links)
                yield result(links, np.concatenate([held[2], ids]))
        if residents and held is None:
            yield alone(settle())

    return dealt.mapInArrow(run, "u long, v long, n long")


def near_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = 0.95, tile: int = TILE) -> DataFrame:
    """vectors (vec_id, embedding) to vec_id, n_links, component_id, kept."""
    e = F.col("embedding")
    whole = F.coalesce(F.size(e) > 0, F.lit(False)) & F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    usable = whole & F.coalesce(F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e, usable.alias("usable"), F.xxhash64("embedding").alias("key"))
    classes = classes_of(spark, rows)
    found = written(spark, search(spark, classes, threshold, tile), "cover-links")
    counts = found.where("v IS NULL").groupBy(F.col("u").alias("cid")).agg(F.sum("n").alias("linked"))
    roots = components(spark, found.where("v IS NOT NULL").select("u", "v"), "cover")
    grouped = classes.select("cid", "key", "embedding", "n", "least").join(counts, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    grouped = written(spark, grouped, "cover-roots")
    size = grouped.agg(F.count("*").alias("distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    named = grouped.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("vectors"))
    large = named.where(F.col("vectors") > size["distinct"] / HOT).select("root")  # fewer than HOT
    answer = join_hot(grouped, named.select("root", "component"), "root", large)
    # Vectors whose hashes agree, if there are any, are told apart by comparing them; a hash is hot if its rows are many.
    answer = answer.groupBy("key").agg(F.collect_list(F.struct("embedding", "component", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("links"))).alias("same"), F.sum("n").alias("rows"))
    answer = written(spark, answer, "cover-answers")
    usable_rows = join_hot(rows.where("usable"), answer.select("key", "same"), "key", answer.where(F.col("rows") > size["rows"] / HOT).select("key"))
    own = F.filter("same", lambda x: x["embedding"] == F.col("embedding"))[0]
    linked = usable_rows.select("vec_id", own["links"].cast("long").alias("n_links"), F.coalesce(own["component"], "vec_id").alias("component_id"))
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
