import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import covertree, queries, simhash
from quillspark.llm.components import components


def brute_components(near: np.ndarray) -> np.ndarray:
    label = np.arange(len(near))
    while True:
        new = np.array([label[near[i]].min() if near[i].any() else label[i] for i in range(len(near))])
        new = np.minimum(new, label)
        if (new == label).all():
            return label
        label = new


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({65 + i: 97 + i for i in range(26)}))
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_leading_runs_hold_what_agrees():
    rng = np.random.default_rng(4)
    for m, n in ((1, 5), (2, 15), (3, 35)):
        orders = simhash.trees(4, m)
        assert len(orders) == n and all(sum(k for _, k in o) == 64 for o in orders)
        bits = [sum(k for _, k in o[:m]) for o in orders]
        for _ in range(50):
            x = rng.integers(0, 2**63, 1, dtype=np.uint64)
            y = x ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 4, replace=False).astype(np.uint64))
            assert any(simhash.arrange(x, o)[0] >> np.uint64(64 - b) == simhash.arrange(y, o)[0] >> np.uint64(64 - b) for o, b in zip(orders, bits))
    assert [simhash.leading(4, n, 4096) for n in (0, 10**7, 4 * 10**7, 8 * 10**9, 10**11, 10**15)] == [1, 1, 2, 2, 3, 3]


@pytest.mark.parametrize("tile, lead", [(3, None), (4096, None), (4096, 2), (4096, 3)])
def test_simhash_equals_brute_force(spark, data, odd, none, tile, lead):
    for docs in (odd, spark.read.parquet(f"{data}/documents.parquet")):
        rows = docs.select("doc_id", "text").collect()
        fps = np.array([brute_fingerprint(r["text"]) for r in rows], np.uint64)
        label = brute_components(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
        least = {}
        for r, k in zip(rows, label):
            least[k] = min([x for x in (least.get(k), r["doc_id"]) if x is not None], default=None)
        want = Counter((r["doc_id"], int(f), least[k]) for r, f, k in zip(rows, fps, label))
        got = simhash.near_duplicates(spark, docs, ["doc_id"], tile=tile, lead=lead).collect()
        assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(spark, none, ["doc_id"]).count() == 0


def test_simhash_index_finds_every_pair():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = [np.bitwise_xor.reduce(np.uint64(1) << rng.choice(64, rng.integers(0, 5), replace=False).astype(np.uint64)) if i % 7 else np.uint64(0) for i in range(600)]
    values = np.unique(rng.choice(centres, 600) ^ np.array(flips, np.uint64))
    for order in [*simhash.trees(4, 1), *simhash.trees(4, 2)[::4], *simhash.trees(4, 3)[::9]]:
        x = values[np.argsort(simhash.gray_rank(simhash.arrange(values, order)))]
        r = simhash.arrange(x, order)
        found = {(int(i), int(j)) for a, b in simhash.within(r, None, 4) for i, j in zip(a, b)}
        assert found == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if int(x[i] ^ x[j]).bit_count() <= 4}
        half = len(r) // 3
        crossed = {(int(i), int(j)) for a, b in simhash.within(r[:half], r[half:], 4) for i, j in zip(a, b)}
        assert crossed == {(i, j - half) for i, j in found if i < half <= j}


def test_gray_rank_orders_by_single_bit_steps():
    codes = np.arange(64, dtype=np.uint64) ^ (np.arange(64, dtype=np.uint64) >> np.uint64(1))
    assert (simhash.gray_rank(codes) == np.arange(64)).all()


def test_components_long_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(0, 300)]
    hub = [(1000, 1000 + i) for i in range(1, 400)]
    edges = spark.createDataFrame([*chain[::-1], *hub, (7, 7), (5, 4)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(spark, edges, "t").collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(400)}}
    assert components(spark, edges.limit(0), "t").count() == 0


def brute_vectors(rows, threshold=0.95):
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = np.zeros((len(rows), len(rows)), bool)
    for i in good:
        for j in good:
            if len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                near[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold
    links = near.sum(axis=1) - np.diag(near)
    label = brute_components(near)
    least = {k: min(rows[i][0] for i in range(len(rows)) if label[i] == k) for k in set(label)}
    return Counter((rows[i][0], int(links[i]), least[label[i]], rows[i][0] == least[label[i]]) for i in range(len(rows)))


@pytest.mark.parametrize("tile", [40, 4096])
def test_covertree_equals_brute_force(spark, data, tile):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] * (1 + i % 3) + rng.normal(scale=[0.02, 0.2, 0.5][i % 3], size=8)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(500 + i, rows[3][1]) for i in range(20)] + [(530 + i, [2 * x for x in rows[3][1]]) for i in range(3)]
    rows += [(600, None), (601, [0.0] * 8), (602, [float("nan")] + [1.0] * 7), (603, [None] + [1.0] * 7), (604, []), (605, [1.0, 2.0]), (606, [2.0, 4.0]), (607, [float("inf")] * 8), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    got = covertree.near_vectors(spark, df, tile=tile).collect()
    assert Counter(map(tuple, got)) == brute_vectors(rows)
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    assert Counter(map(tuple, covertree.near_vectors(spark, table, tile=tile * 3).collect())) == brute_vectors(rows)
    assert covertree.near_vectors(spark, df.limit(0)).count() == 0


def test_pipeline_equals_stages_by_hand(spark, data):
    import corpus_pipeline
    import tiktoken
    from quillspark.llm import bpe, mixing
    import hashlib
    import public_tokenizers

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.drop_toxic(spark, docs, data)
    assert kept.columns == columns
    kept = kept.cache()
    rows = kept.collect()
    fps = np.array([brute_fingerprint(r["text"]) for r in rows], np.uint64)
    ids = np.array([r["doc_id"] for r in rows])
    label = brute_components(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    first = {min(ids[label == k]) for k in set(label)}
    single = corpus_pipeline.drop_near_duplicates(spark, kept, data)
    assert single.columns == columns and {r["doc_id"] for r in single.collect()} == first
    redacted = corpus_pipeline.redact_personal_data(spark, single, data)
    mixed = mixing.mix(redacted).collect()
    ranks = bpe.load_ranks(queries.BPE_RANKS)
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in mixed:
        found = coder.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(found), hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest()] += r["copies"]
    got = corpus_pipeline.run(spark, data)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in got.collect()) == +want


def test_pipeline_stages_on_odd_rows(spark, odd, none, data):
    import corpus_pipeline
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, data)
        assert docs.count() >= 0
    once = corpus_pipeline.drop_near_duplicates(spark, odd, data).collect()
    assert sorted(r["doc_id"] for r in once if r["doc_id"] is not None) == [1, 2, 4, 5, 6, 7, 9, 12] and len(once) in (8, 9)


def test_pipeline_keeps_unlike_rows_that_share_an_id(spark):
    import corpus_pipeline
    texts = {k: " ".join(f"{k}{i * i}" for i in range(40)) for k in "abcdef"}
    rows = [(None, texts["a"]), (None, texts["b"]), (None, texts["b"]), (7, texts["c"]), (7, texts["d"]), (7, texts["d"]), (8, texts["d"]), (None, texts["e"]), (9, texts["e"]), (9, texts["f"])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, None).collect())
    assert got == Counter([(None, texts["a"]), (None, texts["b"]), (7, texts["c"]), (7, texts["d"]), (9, texts["e"]), (9, texts["f"])])
