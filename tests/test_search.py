"""The lexical index, the vector index and the retrieval path against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import pathway, retrieval
from quillspark.operators.lexical_index import LexicalIndex
from quillspark.operators.vector_index import VectorIndex
from quillspark.plans import retrieval_queries, search_queries
from quillspark.streaming import jobs


def rows_of(df):
    return sorted((r["qid"], r["rank"], r["id"], r["score"]) for r in df.collect())


# Lexical index.

WORDS = [f"w{i}" for i in range(60)]


def texts(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, weights=[1 / (i + 1) for i in range(60)], k=rng.randint(0, 40))) for _ in range(n)]


def asked(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.sample(WORDS, 4))) for i in range(12)] + [(20, "W0 w0"), (21, "nowhere"), (22, None), (23, "")]
    return spark.createDataFrame(rows, "qid long, question string")


def plain_top(spark, questions, docs, k):
    return rows_of(retrieval.top_k(retrieval.bm25(questions, spark.createDataFrame(docs, "id long, text string")), k))


def test_lexical_index_equals_bm25(spark, tmp_path):
    docs = list(enumerate(texts(1, 700))) + [(900, None), (901, ""), (902, "w59 " * 500)]
    index = LexicalIndex(spark, f"file://{tmp_path}/a")
    index.add(0, spark.createDataFrame(docs, "id long, text string").withColumn("range", F.lit("clash")))
    questions = asked(spark)
    for k, seeds in ((1, 1), (5, 2), (1000, 3)):
        assert rows_of(index.search(questions, k, seeds=seeds)) == plain_top(spark, questions, docs, k)
    read, all_of_them = index.postings_read(questions, 1, seeds=1)
    assert 0 < read < all_of_them


def test_lexical_index_updates_deletes_and_compacts(spark, tmp_path):
    questions, path = asked(spark), f"file://{tmp_path}/a"
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    index, alive = LexicalIndex(spark, path), {}
    assert rows_of(index.search(questions, 5)) == []
    for batch, (seed, ids) in enumerate(((1, range(0, 90)), (2, range(60, 150)), (3, range(30, 75)))):
        rows = list(zip(ids, texts(seed, len(ids))))
        index.add(batch, frame(rows))
        index.add(batch, frame(rows))  # repeated by a restart
        alive.update(rows)
        assert rows_of(index.search(questions, 7)) == plain_top(spark, questions, list(alive.items()), 7)
    gone = [3, 64, 149, 149, 5000]
    index.delete(3, frame([(i, "") for i in gone]))
    left = [r for r in alive.items() if r[0] not in gone]
    assert rows_of(index.search(questions, 7)) == plain_top(spark, questions, left, 7)
    assert index.docs().count() == len(left)
    index.compact()
    assert index.generation() == 1 and index.dead().count() == 0
    assert rows_of(LexicalIndex(spark, path).search(questions, 7)) == plain_top(spark, questions, left, 7)
    index.add(4, frame([(3, "w1 w2 back"), (10, "w1")]))
    left = [r for r in left if r[0] != 10] + [(3, "w1 w2 back"), (10, "w1")]
    assert rows_of(index.search(questions, 7)) == plain_top(spark, questions, left, 7)


def test_lexical_index_from_a_stream_that_is_restarted(spark, tmp_path):
    questions, docs = asked(spark), list(enumerate(texts(4, 60)))
    index = LexicalIndex(spark, f"file://{tmp_path}/index")
    for no in range(2):
        spark.createDataFrame(docs[no * 30 : no * 30 + 30], "id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.maintain(spark.readStream.schema("id long, text string").parquet(f"{tmp_path}/in"), index, f"{tmp_path}/state").awaitTermination()
    assert sorted(r["batch"] for r in index.docs().select("batch").distinct().collect()) == [0, 1]
    assert rows_of(index.search(questions, 5)) == plain_top(spark, questions, docs, 5)


def test_lexical_index_shuffles_no_posting(spark, tmp_path, monkeypatch):
    """Texts are dealt by id while the index is built; a search shuffles neither ranges nor terms of them."""
    plans, write = [], LexicalIndex._write
    monkeypatch.setattr(LexicalIndex, "_write", lambda self, df, *a, **b: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(self, df, *a, **b))[1])
    index = LexicalIndex(spark, f"file://{tmp_path}/a")
    index.add(0, spark.createDataFrame(list(enumerate(texts(5, 90))), "id long, text string"))
    plans = [p for p in plans if "words" in p] + [index.search(asked(spark), 5)._jdf.queryExecution().executedPlan().toString()]
    assert len(plans) > 1 and not any("hashpartitioning(range" in p or "hashpartitioning(batch#" in p and "term" in p.split("hashpartitioning(batch#")[1].split(")")[0] for p in plans)


def test_lexical_index_of_repeated_ids_and_large_bundles(spark, tmp_path):
    """Rows of one id add up, whatever bundle or batch of Arrow they come in; documents past one bundle are found."""
    rng = random.Random(3)
    docs = [(i // 2 if i < 900 else i, t) for i, t in enumerate(texts(6, 1300))] + [(7, "w1 w2 " * n) for n in range(1, 400)]
    rng.shuffle(docs)
    index = LexicalIndex(spark, f"file://{tmp_path}/a")
    index.add(0, spark.createDataFrame(docs, "id long, text string").coalesce(1))
    words = [(i, re.findall(r"\w+", t)) for i, t in docs]
    mean, df = sum(len(w) for _, w in words) / len(words), Counter(t for _, w in words for t in set(w))
    want = {}
    for q, question in ((0, "w1 w40"), (1, "w0 w5 w59")):
        scores = Counter()
        for i, w in words:
            for t in question.split():
                if tf := w.count(t):
                    scores[i] += math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        want[q] = sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:20]
    got = index.search(spark.createDataFrame([(0, "w1 w40"), (1, "w0 w5 w59")], "qid long, question string"), 20, seeds=1)
    found = {q: [(i, s) for x, _, i, s in rows_of(got) if x == q] for q in want}
    for q in want:
        assert [i for i, _ in found[q]] == [i for i, _ in want[q]]
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in want[q]], abs=2e-6)


# Vector index.


def blobs(n, d=16, groups=12, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    return centres[rng.integers(groups, size=n)] + 0.5 * rng.normal(size=(n, d))


def frame_of(spark, x, name="id"):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], f"{name} long, vector array<double>")


def test_vector_index_recall_exactness_and_filters(spark, tmp_path):
    x = blobs(1500)
    vectors = frame_of(spark, x).withColumn("part", F.col("id") % 4).repartition(5)
    queries = vectors.where("id % 50 = 0").select(F.col("id").alias("qid"), "vector")
    index = VectorIndex.build(spark, vectors, f"file://{tmp_path}/v")
    want = rows_of(retrieval.dense_top_k(queries, vectors, 20))
    got = rows_of(index.search(queries, 20, probes=8))
    hits = len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want})
    assert hits / len(want) >= 0.9
    assert rows_of(index.search(queries, 20, probes=len(index.centres))) == want
    opened = VectorIndex.open(spark, f"file://{tmp_path}/v")
    only = rows_of(opened.search(queries, 5, probes=len(index.centres), where="part = 1"))
    assert only == rows_of(retrieval.dense_top_k(queries, vectors.where("part = 1"), 5))
    more = spark.createDataFrame([(5000, [float(v) for v in x[0]], 1)], "id long, vector array<double>, part long")
    opened.add(more.select(*vectors.columns))
    assert (0, 2, 5000) in {r[:3] for r in rows_of(opened.search(queries, 3, probes=2))}
    # Clusters need a smaller share of the cells than noise does.
    noise = VectorIndex.build(spark, frame_of(spark, np.random.default_rng(1).normal(size=(600, 32))), f"file://{tmp_path}/n")
    assert opened.probes_for(0.95) / len(index.centres) < 0.5 < noise.probes_for(0.95) / len(noise.centres)
    assert opened.recall[-1] == pytest.approx(1.0) and opened.probes_for(1.1) == len(index.centres)


def test_vector_index_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    want = {(q, i) for q, _, i, _ in rows_of(retrieval_queries.dense_topk(spark, sf))}
    got = {(q, i) for q, _, i, _ in rows_of(search_queries.ann_topk(spark, sf))}
    assert len(got & want) / len(want) >= 0.9


def test_vector_index_odd_vectors(spark, tmp_path):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [nan, 1.0]), (8, [1.0, 0.0, 0.0]), (9, [1e300, 1e299]), (1, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    index = VectorIndex.build(spark, vectors, f"file://{tmp_path}/v", cells=3)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.0, 0.0]), (4, [0.0, 0.0])], "qid long, vector array<double>")
    got = rows_of(index.search(queries, 9, probes=9))
    assert [r[2] for r in got] == [1, 1, 9, 2] and {r[0] for r in got} == {1}
    empty = VectorIndex.build(spark, vectors.limit(0), f"file://{tmp_path}/e")
    assert rows_of(empty.search(queries, 3, probes=2)) == []
    with pytest.raises(ValueError):
        VectorIndex.build(spark, vectors.withColumn("cell", F.lit(1)), f"file://{tmp_path}/x")


# The retrieval path.


def tokens(text):
    return re.findall(r"[\w]+", (text or "").lower())


def plain_route(q):
    any_of = lambda *ps: any(re.search(p, q, re.I) for p in ps)
    note = re.search(r"thuyết\s*minh\s*(?:số\s*)?(\d{1,3})", q, re.I)
    flags = [c for c, ps in (("cdkt", ("tài sản",)), ("kqkd", ("doanh thu", "lợi nhuận")), ("lctt", ("dòng tiền",))) if any_of(*ps)]
    year = re.search(r"(?<!\d)((?:19|20)\d{2})(?!\d)", q)
    kind = "thuyet_minh" if note else flags[0] if len(flags) == 1 else ""
    return kind, int(note[1]) if note else None, int(year[1]) if year else None


def plain_periods(q, known):
    years = sorted({int(y) for y in re.findall(r"(?<!\d)((?:19|20)\d{2})(?!\d)", q)})
    span = re.search(r"(20\d{2})\s*(?:-|đến)\s*(20\d{2})", q)
    if span and int(span[1]) <= int(span[2]):
        return list(range(int(span[1]), int(span[2]) + 1))
    if len(years) >= 2:
        return years
    return [y for y in known if y >= min(years + known[:1])] if "qua các năm" in q and known else []


class Plain:
    """The path one question at a time, with loops."""

    def __init__(self, chunks, known, candidates, k):
        self.chunks, self.known, self.n, self.k = chunks, known, candidates, k
        words = {c["id"]: tokens(c["text"]) for c in chunks}
        self.tf = {i: Counter(w) for i, w in words.items()}
        self.len = {i: len(w) for i, w in words.items()}
        self.mean = sum(self.len.values()) / len(words)
        df = Counter(t for w in self.tf.values() for t in w)
        self.idf = {t: math.log(1 + (len(words) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
        self.unit = {c["id"]: self.norm(c["vector"]) for c in chunks}

    @staticmethod
    def norm(v):
        return None if v is None else np.array(v, float) / np.linalg.norm(v)

    def search(self, q, limit, kind="", note=None, year=None):
        mine = [c["id"] for c in self.chunks if c["session"] == q["session"] and kind in ("", c["statement_type"]) and note in (None, c["note_no"]) and year in (None, c["year"])]
        v, terms, branch = self.norm(q["vector"]), set(tokens(q["question"])), max(2 * limit, limit + 10)
        dense = sorted((-(round(float(v @ self.unit[i]), 6) + 0.0) if self.unit[i] is not None else 0.0, i) for i in mine)[:branch]
        weight = lambda i: round(sum(self.idf[t] * self.tf[i][t] * 2.2 / (self.tf[i][t] + 1.2 * (0.25 + 0.75 * self.len[i] / self.mean)) for t in terms if t in self.tf[i]), 6)
        sparse = sorted((-weight(i), i) for i in mine if terms & set(self.tf[i]))[:branch]
        votes = Counter()
        for found in (dense, sparse):
            for rank, (_, i) in enumerate(found):
                votes[i] += 1 / (2 + rank)
        return sorted(((i, round(s, 6)) for i, s in votes.items()), key=lambda x: (-x[1], x[0]))[:limit]

    def routed(self, q):
        kind, note, year = plain_route(q["question"])
        periods = plain_periods(q["question"], self.known)
        by_id = {c["id"]: c for c in self.chunks}
        if periods:
            per, buckets = max(2, self.n // len(periods) + 1), []
            for y in periods:
                hits = self.search(q, per, kind, note, y)
                if not hits and (kind or note is not None):
                    hits = self.search(q, per, "", None, y)
                if hits:
                    buckets.append(hits)
            buckets = buckets or [self.search(q, self.n, kind, note)]
            out, seen = [], set()
            for rank in range(max(map(len, buckets))):
                for b in buckets:
                    if rank < len(b):
                        c = by_id[b[rank][0]]
                        key = (c["doc_id"], c["page"], c["text"][:60])
                        if key not in seen:
                            seen.add(key)
                            out.append(b[rank])
            return out[: self.n], len(periods)
        tries = [(kind, note, year)] + ([(kind, note, None)] if year is not None and (kind or note is not None) else []) + [("", None, None)]
        return next((h for h in (self.search(q, self.n, *t) for t in tries) if h), []), 0

    def note(self, session, doc_id, note_no):
        parts, seen, total = [], set(), 0
        for c in sorted((c for c in self.chunks if (c["session"], c["doc_id"], c["note_no"]) == (session, doc_id, note_no)), key=lambda c: (c["ordinal"], c["id"])):
            text = c["parent_text"] or c["text"]
            key = c["parent_id"] or text[:80]
            if not text or key in seen:
                continue
            seen.add(key)
            parts.append(text)
            total += len(text)
            if total >= 12_000:
                break
        return "\n\n".join(parts)[:12_000]

    def retrieve(self, q):
        hits, periods = self.routed(q)
        by_id, kept, seen = {c["id"]: c for c in self.chunks}, [], set()
        for i, score in hits:
            c = by_id[i]
            if c["parent_id"]:
                if c["parent_id"] in seen:
                    continue
                seen.add(c["parent_id"])
                kept.append((i, score, (c["parent_text"] or c["text"])[:4000]))
            else:
                kept.append((i, score, c["text"]))
        if periods > 1:
            return [(i, t, False) for i, _, t in kept[: min(max(self.k, 2 * periods), self.n)]]
        if len(kept) > self.k:
            scores = [s for _, s, _ in kept]
            span, zero, chosen = max(scores) - min(scores) or 1.0, np.zeros(len(next(v for v in self.unit.values() if v is not None))), []
            unit = [self.unit[i] if self.unit[i] is not None else zero for i, _, _ in kept]
            while len(chosen) < self.k:
                value = lambda j: 0.6 * (scores[j] - min(scores)) / span - 0.4 * max([float(unit[j] @ unit[c]) for c in chosen], default=0.0)
                chosen.append(max((j for j in range(len(kept)) if j not in chosen), key=lambda j: (value(j), -j)))
            kept = [kept[j] for j in chosen]
        groups = [(by_id[i]["doc_id"], by_id[i]["note_no"]) for i, _, _ in kept]
        noted = [g for g in groups if g[1] is not None and g[0]]
        if noted:
            best = max(dict.fromkeys(noted), key=noted.count)
            whole = self.note(q["session"], *best)
            if len(whole) > 4000:
                lead = kept[groups.index(best)]
                return [(lead[0], whole, True)] + [(i, t, False) for (i, _, t), g in zip(kept, groups) if g != best]
        return [(i, t, False) for i, _, t in kept]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_retrieve_question_by_question(spark, sf):
    data = f"/root/testdata/{sf}"
    parts, questions = search_queries.filed_chunks(spark, data), search_queries.filed_questions(spark, data)
    chunks = [r.asDict() for r in parts.collect()]
    plain = Plain(chunks, sorted({c["year"] for c in chunks if c["year"] is not None}), 30, 8)
    got = {}
    for r in sorted(search_queries.retrieve(spark, data).collect(), key=lambda r: (r["qid"], r["rank"])):
        got.setdefault(r["qid"], []).append((r["id"], r["text"], r["whole_note"]))
    want = {q["qid"]: plain.retrieve(q) for q in questions.collect()}
    assert got == {q: found for q, found in want.items() if found}
    assert any(x[2] for found in got.values() for x in found)


def test_retrieve_gate_empty_tables_and_odd_rows(spark):
    fields = "id long, session string, text string, vector array<double>, doc_id string, doc_name string, page long, heading string, year int, statement_type string, note_no int, parent_id string, parent_text string, ordinal long"
    rows = [(1, "s", "doanh thu lớn", [1.0, 0.0], "f", "f", 1, "", 2020, "kqkd", None, None, None, 1), (2, "s", None, None, "f", "f", 1, "", None, None, None, "", "", 2), (3, "t", "doanh thu", [1.0, 0.0], "g", "g", 1, "", 2020, "", 7, "p", "x" * 5000, None)]
    chunks = spark.createDataFrame(rows, fields)
    asked = spark.createDataFrame([(1, "s", "doanh thu 2020", [1.0, 0.0]), (2, "s", " ", [1.0, 0.0]), (3, "s", None, None), (4, "u", "doanh thu", [1.0, 0.0]), (5, "t", "thuyết minh 7", None), (6, "s", "tài sản 2021", None)], "qid long, session string, question string, vector array<double>")
    known = F.array(F.lit(2020))
    got = {(r["qid"], r["rank"]): (r["id"], len(r["text"] or ""), r["whole_note"]) for r in pathway.retrieve(asked, chunks, known).collect()}
    # The second and third ask nothing, and the session of the fourth has no chunks. The sixth names what no chunk has: all of its session.
    assert got == {(1, 1): (1, 13, False), (5, 1): (3, 5000, True), (6, 1): (1, 13, False), (6, 2): (2, 0, False)}
    assert pathway.retrieve(asked, chunks, known, threshold=10.0).count() == 0
    assert pathway.retrieve(asked.limit(0), chunks, known).count() == 0 == pathway.retrieve(asked, chunks.limit(0), known).count()


def test_wider_for_more_periods(spark):
    got = spark.range(0, 20, 3).select("id", pathway.width(8, F.col("id"), 30).alias("k"), pathway.width(8, F.col("id"), 6).alias("few")).collect()
    assert [(r["k"], r["few"]) for r in got] == [(min(max(8, 2 * i), 30), min(max(8, 2 * i), 6)) for i in range(0, 20, 3)]


def test_best_of_bm25_without_all_pairs(spark):
    """Filters and groups within the packed search give what all pairs give; no pair is shuffled before it is among the best of its batch."""
    rng = random.Random(5)
    word = lambda: f"w{min(int(rng.expovariate(0.2)), 60)}"
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randint(0, 40))), rng.choice(["en", "fr", None]), f"s{i % 5}") for i in range(700)], "id long, text string, lang string, source string").repartition(3)
    asked = spark.createDataFrame([(q, " ".join(word() for _ in range(6)), rng.choice(["en", None]), rng.choice([None, "s1", "none"])) for q in range(30)] + [(99, None, None, None)], "qid long, question string, lang string, source string")
    pairs = retrieval.bm25(asked, docs).join(docs.select("id", F.col("lang").alias("c_lang"), "source"), "id")
    own = asked.select("qid", F.col("lang").alias("q_lang"), F.col("source").alias("q_source"))
    kept = pairs.join(own, "qid").where("coalesce(q_lang = c_lang, q_lang IS NULL) AND coalesce(q_source = source, q_source IS NULL)")
    rows = lambda df, *more: sorted((r["qid"], r["rank"], r["id"], round(r["score"], 5), *(str(r[c]) for c in more)) for r in df.collect())
    assert rows(retrieval.bm25_top_k(asked, docs, 4, ("lang", "source"))) == rows(retrieval.top_k(kept, 4))
    assert rows(retrieval.bm25_top_k(asked, docs, 3, bucket="lang"), "lang") == rows(retrieval.top_k(pairs.withColumnRenamed("c_lang", "lang"), 3, ["qid", "lang"]), "lang")
    plan = retrieval.bm25_top_k(asked, docs, 4)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qid" in plan and "hashpartitioning(id" not in plan and "hashpartitioning(term" not in plan.split("MapInArrow")[-1].split("pack(")[0]
    assert retrieval.bm25_top_k(asked.limit(0), docs, 4).count() == 0 == retrieval.bm25_top_k(asked, docs.limit(0), 4).count()


def test_maintained_input_is_not_one_task(spark, data, tmp_path, monkeypatch):
    """What a table of several files gives to the stream is written by several tasks."""
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{data}/{name}.parquet").repartition(4).write.parquet(str(tmp_path / f"{name}.parquet"))
    monkeypatch.setattr(search_queries, "folder", lambda spark, kind: f"file://{tmp_path}/{kind}")
    search_queries.maintained_topk(spark, str(tmp_path))
    for no in range(3):
        assert len(list((tmp_path / "maintained" / "in" / str(no)).glob("part-*"))) > 1
