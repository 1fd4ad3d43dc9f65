"""Collocations, the positional index and the Merkle manifest against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quillspark.llm import collocations, merkle, positional, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FIELDS = "doc_id long, text string, lang string"


# Collocations.


def plain_collocations(docs, max_n=3, least=10, inside=50, top=2000):
    counts, words = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for n in range(1, max_n + 1):
                counts[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    rows = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            score, k = min((Fraction(1_000_000 * a * a, f[p[:k]] * f[p[k:]]).__floor__(), k) for k in range(1, len(p)))
            held = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= inside * a for b in held):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(rows)


def got_collocations(spark, docs, **how):
    df = collocations.collocations(spark, docs, **how)
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


def test_collocations_of_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = plain_collocations(docs.select("lang", "text").collect())
    assert len(want) > 100
    assert got_collocations(spark, docs) == want
    assert sorted(map(tuple, queries.op11_collocations(spark, data).collect())) == want


def test_collocations_blocks_longer_phrases_and_ties(spark):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("aAbÉ") + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\r", ""]) for _ in range(rng.randint(0, 60)))
    rows = [(i, text(), rng.choice(["en", "en", None, "und", "x\ny"])) for i in range(80)]
    rows += [(90, None, "en"), (91, "", "en"), (92, "\x00 \x00 " * 30, "nul")] + [(93, "a b c d e", "en")] * 12
    docs = spark.createDataFrame(rows, FIELDS).withColumn("key", F.lit(1)).withColumn("phrase", F.lit("clash")).repartition(3)
    for how in ({}, {"max_n": 5, "least": 4, "inside": 30}, {"least": 2, "top": 7}):
        want = plain_collocations([(r[2], r[1]) for r in rows], **how)
        assert got_collocations(spark, docs, block_chars=200, **how) == want


def test_collocations_of_hot_words_and_large_counts(spark, none):
    docs = spark.range(3000).select(F.lit("the word the word. rare").alias("text"), F.lit("en").alias("lang"))
    assert got_collocations(spark, docs) == plain_collocations([("en", "the word the word. rare")] * 3000)
    assert got_collocations(spark, none) == []
    exact = spark.sql("SELECT 4000000000000000L AS a, 4000000000000001L AS l, 4000000000000003L AS r")
    score = exact.selectExpr("(CAST(a AS decimal(16,0)) * CAST(a AS decimal(16,0)) * CAST(1000000 AS decimal(7,0))) div (CAST(l AS decimal(19,0)) * CAST(r AS decimal(19,0))) AS s").first()["s"]
    assert score == 1_000_000 * 4000000000000000**2 // (4000000000000001 * 4000000000000003) == 999999


# Positional index.


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def plain_hits(docs, items, size=10, slop=None):
    windows = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows["" if item is None else str(item)].add(tuple(w[i : i + size]))
    rows = []
    for doc_id, text in docs:
        w = words_of(text)
        hit, found, near = set(), set(), set()
        for item, own in windows.items():
            for win in own:
                for s in range(len(w) - len(win) + 1):
                    if tuple(w[s : s + len(win)]) == win:
                        hit.update(range(s, s + len(win)))
                        found.add(item)
                if slop is not None and any(set(win) <= set(w[s : s + len(win) + slop]) for s in range(len(w))):
                    near.add(item)
        rows.append((doc_id, len(w), len(hit), sorted(found), sorted(near) if slop is not None else None))
    return sorted(rows, key=repr)


def got_hits(spark, docs, items, **how):
    return sorted(((r["id"], r["n_words"], r["n_hit"], r["items"], r["near"]) for r in positional.contamination(spark, docs, items, **how).collect()), key=repr)


def test_positional_phrases_and_proximity(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdÉ") + rng.choice([" ", "-", "_", "é "]) for _ in range(n))
    docs = [(i if i % 7 else None, text(rng.randint(0, 40))) for i in range(60)] + [(1, None), (2, ""), (3, "x y"), (3, "x y"), (4, "y. X"), (5, "the end")]
    items = [(i, text(rng.randint(1, 6))) for i in range(12)] + [(3, "x Y"), (3, "end of"), (None, "b c"), (20, None), (21, ""), (22, "--"), (23, "nowhere a"), (24, "a a a a")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("block", F.lit("clash")).withColumn("id", F.lit(0)).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit("clash"))
    for how in ({"size": 3, "slop": 2}, {"size": 2, "slop": 0}, {"size": 10}, {"size": 1, "slop": 5}):
        want = plain_hits(docs, items, **how)
        assert got_hits(spark, table, asked, **how) == want
        assert got_hits(spark, table, asked, block_chars=150, **how) == want
    assert any(r[3] for r in want)


def test_positional_of_documents_and_a_passage_in_many(spark, data, none):
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    rows, asked = docs.select("doc_id", "text").collect(), [tuple(r) for r in items.select("item_id", "text").collect()]
    passage = asked[0][1]
    more = [(10_000 + i, f"so {passage} it is {passage}") for i in range(300)] + [(20_000, "word " * 60_000 + passage)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r[0]: r for r in got_hits(spark, docs, items)}
    n = len(words_of(passage))
    assert all(got[i][2] == 2 * n and "0" in got[i][3] for i, _ in more[:-1])
    assert got[20_000][1] == 60_000 + n and got[20_000][2] == n
    few = [tuple(r) for r in rows if len(r["text"] or "") < 3000][:60]
    assert sorted((got[r[0]] for r in few), key=repr) == plain_hits(few, asked)
    assert got_hits(spark, none, items) == []
    assert all(r[2] == 0 and r[3] == [] for r in got_hits(spark, docs, items.limit(0)))


# Merkle manifest.


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_merkle(rows, arity=2):
    """rows (doc_id, source, lang, n_chars, text) to sorted (doc_id, leaf, subroot, root, proof, folded root)."""
    encode = lambda *v: h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in v))

    def parent_levels(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][i : i + arity])) for i in range(0, len(levels[-1]), arity)])
        return levels

    def path(levels, at):
        for level in levels[:-1]:
            begin = at // arity * arity
            yield level[begin:at], level[at + 1 : begin + arity]
            at //= arity

    trees = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        changed = n_chars + 1 if n_chars is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 else n_chars
        trees[lang].append((doc_id is not None, doc_id, encode(doc_id, source, lang, n_chars, text), encode(doc_id, source, lang, changed, text)))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for own in trees.values():
        own.sort(key=lambda x: (x[0], x[1] or 0, x[2]))
    levels = {name: parent_levels([x[2] for x in trees[name]]) for name in names}
    upper = parent_levels([levels[name][-1][0] for name in names])
    out = []
    for no, name in enumerate(names):
        for at, (_, doc_id, own, other) in enumerate(trees[name]):
            steps, node = [*path(levels[name], at), *path(upper, no)], other
            for before, after in steps:
                node = h("".join([*before, node, *after]))
            out.append((doc_id, own, levels[name][-1][0], upper[-1][0], h("".join("".join(b + a) for b, a in steps)), node))
    return sorted(out, key=repr)


def got_merkle(spark, docs, **how):
    df = merkle.proofs(merkle.manifest(spark, merkle.tampered(docs), **how))
    rows = df.collect()
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in rows)
    return sorted(((r["id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in rows), key=repr)


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


@pytest.mark.parametrize("arity, depth", [(2, 8), (2, 1), (3, 2), (5, 3)])
def test_merkle_of_odd_rows(spark, odd, rows, arity, depth):
    plain = [(r[0], r[3], r[2], r[4], r[1]) for r in rows]
    docs = odd.withColumn("tree", F.lit("clash")).withColumn("leaf", F.lit("clash"))
    assert got_merkle(spark, docs, arity=arity, depth=depth) == plain_merkle(plain, arity)


def test_merkle_of_documents(spark, data, none):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    want = plain_merkle(rows)
    assert got_merkle(spark, docs) == want == got_merkle(spark, docs, depth=3)
    assert got_merkle(spark, none) == []
    one = docs.where("doc_id = 5")
    assert got_merkle(spark, one) == plain_merkle([r for r in rows if r[0] == 5])


def test_merkle_finds_what_changed(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    changed = merkle.leaves(docs, changes={"text": F.when(F.col("doc_id") % 50 == 3, F.concat("text", F.lit(" "))).otherwise(F.col("text"))})
    found = {r["id"] for r in merkle.proofs(merkle.manifest(spark, changed)).where("NOT verified").collect()}
    assert found == {r["doc_id"] for r in docs.where("doc_id % 50 = 3").select("doc_id").collect()}


def test_merkle_of_an_id_on_many_rows(spark):
    docs = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(4).cast("long").alias("n_chars"))
    assert got_merkle(spark, docs, depth=4) == plain_merkle([tuple(r) for r in docs.select(*COLUMNS).collect()])
