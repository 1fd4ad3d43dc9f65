"""Merkle manifest of a dataset: which rows it held, provable row by row.

Each row is a leaf, the SHA-256 of its fields.  The leaves of a tree (a language) lie in order of their ids; every ``arity`` consecutive nodes
get a parent, the SHA-256 of their concatenated digests, its *preimage*, until one node remains; the roots of the trees are the
leaves of one more tree.  Preimages are stored ``DEPTH`` levels at a time: a row of the table holds those of a subtree.  A leaf is joined with the
preimages of all its ancestors: each names the node's siblings, which are what is left when its own slot of 64 characters is cut out,
and gives the parent of a changed node when the slot is replaced.

No task sees a whole tree.  Leaves are range-partitioned by tree, id, digest and row, counted for each (part, tree), and
numbered from the running sums of those few counts, so a tree with a third of all rows is no single task, nor is an id that many rows
share.  A subtree is at most ``arity ** DEPTH`` nodes.  A table of the leaves and one for each ``DEPTH`` levels are written to
the shared folder, so executors may be lost.  Only counts and the root come to the driver.

Nulls in a field are written ``-``; a null id comes first and is never tampered with; a null tree comes before all others.  Empty texts
count as zero bytes; texts of any length are hashed whole.  Rows with one id are in order of their digests; rows that are the same
in all fields are interchangeable.  A tree of one leaf is that leaf.  Empty tables give no rows.  Of the input only the columns named are
read: the names of others are free, and so are theirs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import quoted, written

#: Levels of a tree that one row of preimages spans.
DEPTH = 8
#: Characters of a digest.
SLOT = 64
#: The fields of a leaf, the column that names its tree, and the one that orders it.
FIELDS, TREE, ORDER = ("doc_id", "source", "lang", "n_chars", "text"), "lang", "doc_id"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """SHA-256 of the fields: each ``-`` if null, else its number of UTF-8 bytes, a colon and the value."""
    as_text = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in as_text]))


def leaves(docs: DataFrame, fields=FIELDS, tree: str = TREE, order: str = ORDER, changes: dict[str, Column] | None = None) -> DataFrame:
    """(id, tree, leaf, other) of each row; ``other`` is the leaf that the row would have with the given columns changed.  The name of a tree sorts as
    the values do, null first."""
    named = F.col(quoted(tree)).cast("string")
    changes = changes or {}
    values = [F.col(quoted(f)) for f in fields]
    return docs.select(F.col(quoted(order)).alias("id"), F.coalesce(F.concat(F.lit("+"), named), F.lit("")).alias("tree"), leaf(values).alias("leaf"), leaf([changes.get(f, v) for f, v in zip(fields, values, strict=True)]).alias("other"))


def numbered(spark: SparkSession, nodes: DataFrame, order: list[str], label: str) -> DataFrame:
    """nodes with ``pos``, their place from 0 among those of their tree in the given order, and ``n``, the number of them."""
    own = nodes.columns
    keys = ["tree", *order]
    # A number of the row before it moves: equal rows can be parted, too.
    dealt = nodes.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*keys, "__row").sortWithinPartitions(*keys, "__row")
    dealt = written(spark, dealt.select(*own, F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")), label)
    counts = dealt.groupBy("__part", "tree").agg(F.count("*").alias("here"), F.min("__at").alias("first"))
    whole = Window.partitionBy("tree")
    counts = counts.select("__part", "tree", "first", (F.sum("here").over(whole.orderBy("__part")) - F.col("here")).alias("before"), F.sum("here").over(whole).alias("n"))
    return dealt.join(counts, ["__part", "tree"]).select(*own, (F.col("before") + F.col("__at") - F.col("first")).alias("pos"), "n")


def subtrees(nodes: DataFrame, arity: int = 2, depth: int = DEPTH) -> DataFrame:
    """nodes (tree, pos, n, hash) to (tree, part, n, width, levels, top): for each run of ``arity ** depth`` nodes their number, the preimages of the
    levels above them, nearest first, and the topmost digest.  A tree ends where one node is left; levels beyond that are empty."""
    span = arity**depth
    part = F.floor(F.col("pos") / span).cast("long")
    df = nodes.groupBy("tree", part.alias("part"), "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]).alias("at0"))
    df = df.withColumns({"width": F.size("at0"), "left0": F.col("n")})
    for i in range(1, depth + 1):
        below, left = f"at{i - 1}", F.col(f"left{i - 1}")
        parents = F.sequence(F.lit(0), F.ceil(F.size(below) / arity).cast("int") - 1)
        own = F.transform(parents, lambda k: F.array_join(F.slice(F.col(below), k * arity + 1, F.lit(arity)), ""))  # noqa: B023
        df = df.withColumn(f"pre{i}", F.when(left > 1, own).otherwise(F.array().cast("array<string>")))
        df = df.withColumn(f"at{i}", F.when(left > 1, F.transform(f"pre{i}", digest)).otherwise(F.col(below)))
        df = df.withColumn(f"left{i}", F.ceil(left / arity))
    return df.select("tree", "part", "n", "width", F.array(*[f"pre{i}" for i in range(1, depth + 1)]).alias("levels"), F.element_at(f"at{depth}", 1).alias("top"))


def grown(spark: SparkSession, nodes: DataFrame, arity: int, depth: int, label: str) -> list[DataFrame]:
    """The tables of subtrees over nodes (tree, pos, n, hash), lowest first; the last one has a row for each tree, whose ``top`` is the root."""
    tiers: list[DataFrame] = []
    most = nodes.agg(F.max("n").alias("n")).first()["n"] or 0
    while not tiers or most > 1:
        tiers.append(written(spark, subtrees(nodes, arity, depth), f"{label}-{len(tiers)}"))
        most = -(-most // arity**depth)
        nodes = tiers[-1].select("tree", F.col("part").alias("pos"), F.ceil(F.col("n") / arity**depth).alias("n"), F.col("top").alias("hash"))
    return tiers


def ancestors(levels: Column, pos: Column, arity: int = 2, depth: int = DEPTH) -> Column:
    """The preimages above one node of a subtree, with the node's slot in each, nearest first."""
    steps = [F.struct(F.get(F.get(levels, F.lit(i)), F.floor(pos / arity ** (i + 1)).cast("int")).alias("preimage"), F.pmod(F.floor(pos / arity**i), F.lit(arity)).cast("int").alias("slot")) for i in range(depth)]
    return F.filter(F.array(*steps), lambda s: s["preimage"].isNotNull())


def excised(step: Column) -> Column:
    """The siblings of a node: the preimage of its parent without the node's own slot."""
    return F.concat(before(step), after(step))


def before(step: Column) -> Column:
    return F.substring(step["preimage"], F.lit(1), step["slot"] * SLOT)


def after(step: Column) -> Column:
    return F.substring(step["preimage"], (step["slot"] + 1) * SLOT + 1, F.length(step["preimage"]))


def siblings(path: Column) -> Column:
    """All siblings on the way up, one after another."""
    return F.array_join(F.transform(path, excised), "")


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf leads to: its digest takes its slot in each preimage in turn."""
    return F.aggregate(path, node, lambda digest_, step: digest(F.concat(before(step), digest_, after(step))))


@dataclass
class Manifest:
    """``leaves`` (id, tree, leaf, other, pos, n); ``tiers``, preimages of the trees; ``upper``, those of the tree of roots; its ``root``, None if there
    are no rows."""

    leaves: DataFrame
    tiers: list[DataFrame]
    roots: DataFrame
    upper: list[DataFrame]
    root: str | None
    arity: int
    depth: int

    def _below(self, tiers: list[DataFrame], above: DataFrame) -> DataFrame:
        """The lowest of some tiers with ``path``, the ancestors of each subtree's top.  ``above`` (tree, subroot, over) has those of the trees."""
        df = tiers[-1].join(above, "tree")
        span = self.arity**self.depth
        for tier in reversed(tiers[:-1]):
            local = F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("at")
            known = df.select("tree", "part", "levels", "subroot", "over", local)
            known = known.select("tree", (F.col("part") * span + F.col("at")).alias("part"), "subroot", F.concat(ancestors(F.col("levels"), F.col("at"), self.arity, self.depth), "over").alias("over"))
            df = tier.join(known, ["tree", "part"])
        return df

    def _paths(self, nodes: DataFrame, tiers: list[DataFrame], above: DataFrame) -> DataFrame:
        """nodes (tree, pos, ...) with ``subroot`` and ``path``, all their ancestors."""
        span = self.arity**self.depth
        low = self._below(tiers, above).select("tree", "part", "levels", "subroot", "over")
        df = nodes.withColumn("part", F.floor(F.col("pos") / span).cast("long")).join(low, ["tree", "part"])
        path = F.concat(ancestors(F.col("levels"), F.pmod("pos", F.lit(span)), self.arity, self.depth), "over")
        return df.select(*nodes.columns, "subroot", path.alias("path"))

    def paths(self) -> DataFrame:
        """The leaves with ``subroot`` and ``path``: (preimage, slot) of every ancestor from the parent to the root of roots."""
        none = F.array().cast("array<struct<preimage:string,slot:int>>")
        top = self.upper[-1].select("tree", F.lit("").alias("subroot"), none.alias("over"))
        trees = self._paths(self.roots, self.upper, top).select(F.col("name").alias("tree"), F.col("hash").alias("subroot"), F.col("path").alias("over"))
        return self._paths(self.leaves, self.tiers, trees)


def manifest(spark: SparkSession, rows: DataFrame, arity: int = 2, depth: int = DEPTH) -> Manifest:
    """The manifest of what ``leaves`` gives."""
    placed = numbered(spark, written(spark, rows, "merkle-leaves"), ["id", "leaf"], "merkle-order")
    tiers = grown(spark, placed.select("tree", "pos", "n", F.col("leaf").alias("hash")), arity, depth, "merkle")
    names = tiers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("hash"))
    roots = numbered(spark, names, ["name"], "merkle-roots")
    upper = grown(spark, roots.select("tree", "pos", "n", "hash"), arity, depth, "merkle-upper")
    first = upper[-1].first()
    return Manifest(placed, tiers, roots, upper, first["top"] if first else None, arity, depth)


def proofs(made: Manifest) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified): the digest of each leaf's siblings, and the root that its ``other`` leaf leads to."""
    found = made.paths().select("id", "leaf", "other", "subroot", F.lit(made.root).cast("string").alias("root"), "path")
    found = found.select("id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), folded(F.col("other"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(docs: DataFrame) -> DataFrame:
    """Leaves of documents, with those of a copy in which every seventh document or so claims one character more."""
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    return leaves(docs, changes={"n_chars": F.col("n_chars") + F.when(chosen, 1).otherwise(0)})
