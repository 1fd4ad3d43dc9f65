import hashlib
import math
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, digest, langid, lattice, licenses, mixing, pii, queries, toxicity
from quillspark.llm.common import crc_mod

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(number):
    total = 0
    for i, d in enumerate(reversed(number)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    found = []
    for no, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            found.append((m.start(), no, m.end(), kind))
    return sorted(found)


def check_pii(docs):
    got = pii.with_spans(docs.select("doc_id", "text")).collect()
    for r in got:
        text = r["text"] or ""
        if len(text) > 10_000 and "@" in text:
            text = text.replace("x" * 20_000, "x")  # Python's pattern is quadratic there
            shift = 19_999
        else:
            shift = 0
        want = [(s + shift * (s > 0), n, e + shift, k) for s, n, e, k in base_spans(text)]
        assert [(s.start, s.kind_no, s.end, s.kind) for s in r["spans"] if s.kind_no < pii.BASE] == want
    return len(got)


def test_pii_finds_what_plain_patterns_find(spark, data, odd):
    assert check_pii(odd) == 13
    assert check_pii(spark.read.parquet(f"{data}/documents.parquet")) == 200


def test_pii_added_kinds_and_checksums(spark):
    texts = ["iban GB82 WEST 1234 5698 7654 32 ok", "iban GB83 WEST 1234 5698 7654 32 no", "ssn 123-45-6789", "code 123-45-6789", 'token = "' + "0a" * 20 + '"', "0a" * 20]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kinds = {r["doc_id"]: {s.kind for s in r["spans"]} for r in pii.with_spans(df).collect()}
    assert [("iban" in kinds[0]), ("iban" in kinds[1]), kinds[2], kinds[3], kinds[4], kinds[5]] == [True, False, {"ssn"}, set(), {"secret"}, set()]


def test_pii_account_numbers_end_where_they_end(spark):
    de, gb, be = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "BE68 5390 0754 7034"
    texts = {
        f"IBAN {de} Please pay": [de], f"{gb} The rest": [gb], f"{gb} OK": [gb], f"{de} 2 copies": [de], "DE89 3704 0044 0532 0130 00 17 days": ["DE89 3704 0044 0532 0130 00"],
        f"{be} PLEASE": [be], f"{be} 2019": [be], f"{de} {gb} {be} NOW": [de, gb, be], f"{gb} {de}": [gb, de], f"{de}x": [], f"{de}0": [], "DE88370400440532013000 Please": [],
        # A country that is not listed: without blanks or in fours.
        "XX89 1234 5678 9012 Please": ["XX89 1234 5678 9012"], "XX89123456789012 A": ["XX89123456789012"], "XX891234567890123 A": [],
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: [r["text"][s.start : s.end] for s in r["spans"] if s.kind == "iban"] for r in pii.with_spans(df).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
    assert pii.redact(df.withColumn("n_chars", F.length("text"))).where("doc_id = 7").first()["text"] == "<IBAN> <IBAN> <IBAN> NOW"


def test_pii_secrets_in_capitals(spark):
    df = spark.createDataFrame([(1, 'TOKEN = "' + "9A8ECF7C" * 5 + '" end'), (2, "9A8ECF7C" * 5)], "doc_id long, text string")
    got = {r["doc_id"]: [(s.kind, s.end - s.start) for s in r["spans"]] for r in pii.with_spans(df).collect()}
    assert got == {1: [("secret", 40)], 2: []}


def test_pii_redacts(spark, odd, none):
    got = {r["doc_id"]: r for r in pii.redact(odd).collect()}
    assert got[1]["text"].endswith("Write to <EMAIL> or <PHONE> now") and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] is None and got[3]["text"] == "" and got[9]["n_chars"] == 48
    assert "<CARD> and <IP>, not 10.0.0.256" in got[4]["text"]
    assert pii.redact(odd).columns == odd.columns
    assert pii.with_spans(none).count() == 0 == pii.redact(none).count()
    many = " ".join(f"u{i}@h.io" for i in range(3000))
    out = pii.redact(spark.createDataFrame([(1, many)], "doc_id long, text string")).first()["text"]
    assert out == " ".join(["<EMAIL>"] * 3000)


def tiktoken_rows(texts, ranks):
    import tiktoken

    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return {t: coder.encode_ordinary(t or "") for t in texts}


@pytest.mark.parametrize("block", [50, 10_000, 24_000_000])
def test_bpe_equals_the_library_and_round_trips(spark, data, odd, none, rows, block):
    ranks = bpe.load_ranks(queries.BPE_RANKS)
    docs = odd if block != 10_000 else spark.read.parquet(f"{data}/documents.parquet")
    texts = {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
    want = tiktoken_rows({t for _, t in texts}, ranks)
    got = bpe.encode(spark, docs, ranks, public_tokenizers.PATTERN, keep_ids=True, block_chars=block).collect()
    assert len(got) == docs.count()
    expected = Counter((i, tuple(want[t]), (t or "").encode()) for i, t in docs.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got) == expected
    for r in got:
        assert r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(r["decoded"]).hexdigest()
    assert bpe.encode(spark, none, ranks, public_tokenizers.PATTERN).count() == 0


def lower(text):
    return (text or "").translate({65 + i: 97 + i for i in range(26)})


@pytest.mark.parametrize("block", [500, 24_000_000])
def test_lattice_base_counts_and_proper_model(spark, data, odd, none, block):
    pieces = lattice.load_pieces(queries.PIECES)
    for docs in (odd, spark.read.parquet(f"{data}/documents.parquet")):
        docs = docs.withColumn("training", crc_mod("doc_id", 7) != 2)
        rows = docs.select("doc_id", "text", "training").collect()
        tokens = {id(r): [*re.findall(r"[^\x20\x09-\x0D]+", lower(r["text"])), None] for r in rows}
        c = Counter(t for r in rows if r["training"] for t in tokens[id(r)])
        n, v = sum(c.values()), len(c)
        want = sorted((r["doc_id"] or -1, not r["training"], len(tokens[id(r)]), sum(c[t] > 0 for t in tokens[id(r)]), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens[id(r)]), 6)) for r in rows)
        got = lattice.score(spark, docs, pieces, block).collect()
        assert sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
        assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)
    assert lattice.score(spark, none.withColumn("training", F.lit(True)), pieces).count() == 0


def test_lattice_sums_over_all_segmentations():
    v = lattice.from_scores([("▁", -9.0), ("▁a", -1.0), ("a", -2.0), ("b", -3.0), ("ab", -4.0), ("▁ab", -5.0)])

    def brute(word):
        if not word:
            return 1.0
        return sum(math.exp(v.pieces[word[:k]]) * brute(word[k:]) for k in range(1, len(word) + 1) if word[:k] in v.pieces)

    for word in ("ab", "aab", "abab", "b"):
        assert math.isclose(lattice.log_probability(word, v), math.log(brute("▁" + word)), rel_tol=1e-12)
    assert math.isclose(sum(map(math.exp, v.pieces.values())) + sum(map(math.exp, v.byte)), 1.0)
    found, byte = {}, Counter()
    lattice.expect("aab", 2.0, v, found, byte)
    ways = {("▁a", "ab"), ("▁a", "a", "b"), ("▁", "a", "ab"), ("▁", "a", "a", "b")}
    weight = {w: math.exp(sum(v.pieces[p] for p in w)) for w in ways}
    for piece in v.pieces:
        assert math.isclose(found.get(piece, 0.0), 2 * sum(x * w.count(piece) for w, x in weight.items()) / sum(weight.values()), abs_tol=1e-9)


def brute_lattice(rows, v, pieces):
    """Score of each (text, training): every cut of every word enumerated, the fit of the weights and the spanning edges by hand."""
    def cuts(word):
        if not word:
            return [()]
        return [(word[:k], *rest) for k in range(1, min(len(word), v.longest) + 1) if word[:k] in v.pieces or k == 1 for rest in cuts(word[k:])]

    def weight(cut, piece, byte):
        return math.prod(piece[p] if p in piece else math.prod(byte[b] for b in p.encode()) for p in cut)

    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for t, _ in rows]
    seen = Counter(t for own, (_, training) in zip(tokens, rows) if training for t in own)
    n, distinct, once, twice = sum(seen.values()), len(seen), sum(c == 1 for w, c in seen.items() if w), sum(c == 2 for w, c in seen.items() if w)
    discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once and twice else 0.5
    piece, byte = {p: math.exp(w) for p, w in v.pieces.items()}, [math.exp(w) for w in v.byte]
    expected, expected_byte = Counter(), Counter()
    for word in filter(None, seen):
        ways = {c: weight(c, piece, byte) for c in cuts("\u2581" + word)}
        for c, x in ways.items():
            for p in c:
                if p in piece:
                    expected[p] += x / sum(ways.values())
                else:
                    for b in p.encode():
                        expected_byte[b] += x / sum(ways.values())
    total = sum(expected.values()) + sum(expected_byte.values()) + lattice.PRIOR_WEIGHT
    piece = {p: (expected[p] + lattice.PRIOR_WEIGHT * x) / total for p, x in piece.items()}
    byte = [(expected_byte[i] + lattice.PRIOR_WEIGHT * x) / total for i, x in enumerate(byte)]

    def chance(token):
        if token is None:
            return (seen[None] - discount) / n
        return max(0.0, seen[token] - discount) / n + discount * distinct / n * sum(weight(c, piece, byte) for c in cuts("\u2581" + token))

    return [sum(math.log10(chance(t)) for t in own) for own in tokens]


def test_lattice_score_equals_brute_force(spark):
    pieces = [("\u2581", -1.0), ("\u2581a", -2.0), ("a", -3.0), ("b", -4.0), ("ab", -5.0), ("\u2581ab", -6.0), ("ba", -7.0), ("c", -8.0)]
    texts = ["ab aab c", "Ab ab\tbac", "", None, "abba q", "c c c", "ba ba", "é ab", "cab unseen", "aab abab zz"]
    rows = [(t, i % 4 != 3) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, training boolean").repartition(3)
    got = {r["doc_id"]: r["score"] for r in lattice.score(spark, df, pieces, 20).collect()}
    want = brute_lattice(rows, lattice.from_scores(pieces), pieces)
    assert [got[i] for i in range(len(rows))] == pytest.approx(want, rel=1e-9)


def test_lattice_takes_one_very_long_word():
    v = lattice.from_scores([("\u2581", -1.0), ("x", -2.0), ("xx", -3.0)])
    assert math.isfinite(lattice.log_probability("x" * 1_000_000, v))


def test_parts_follow_the_size_of_the_table(spark):
    from quillspark.llm import blocks

    docs = spark.createDataFrame([(i, f"w{i} x{i % 7} shared", 0) for i in range(300)], "doc_id long, text string, flag int").repartition(4)
    _, words, tasks = blocks.cut_and_write(spark, docs, lambda: str.split, "t", False, 400, 10)
    assert words.agg(F.max("part")).first()[0] >= tasks
    together = blocks.dealt(words, tasks).select("part", F.spark_partition_id().alias("task")).distinct()
    assert together.groupBy("part").count().where("count > 1").count() == 0 and together.groupBy("task").count().agg(F.max("count")).first()[0] > 1


def test_digest_edits_and_neighbours(spark, data, odd, none):
    for docs in (spark.read.parquet(f"{data}/documents.parquet"), odd.where("doc_id <> 4 OR doc_id IS NULL")):
        rows = sorted(((r["doc_id"] if r["doc_id"] is not None else digest.LAST), r["text"] or "") for r in docs.select("doc_id", "text").collect())
        got = {r["doc_id"] if r["doc_id"] is not None else digest.LAST: r for r in digest.fingerprints(spark, docs).collect()}
        assert len(got) == len(rows)
        for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
            half = len(text) // 2
            new = text[: len(text) - half] + following[:half]
            r = got[i]
            assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(text), hashlib.sha256(new.encode()).hexdigest(), digest.digest(text.encode()), digest.digest(new.encode()))
            assert r["near_edited"] == digest.likeness(r["fingerprint"], r["edited_fingerprint"]) and 0 <= r["near_next"] <= 1
    assert digest.fingerprints(spark, odd).count() == 13
    assert digest.fingerprints(spark, none).count() == 0
    lone = digest.fingerprints(spark, spark.createDataFrame([(5, "alone at home")], "doc_id long, text string")).collect()
    assert len(lone) == 1 and lone[0]["near_next"] == 1.0


def test_digest_many_rows_of_one_id(spark):
    rows = [(None if i % 3 else 7 if i % 2 else i, f"text number {i} of many") for i in range(3_000)] + [(None, "a copy")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    dealt = digest.with_next(spark, docs)
    own = [r["n"] for r in dealt.where("tail = 0").groupBy("bucket").agg(F.count("*").alias("n")).collect()]
    assert sum(own) == len(rows) and max(own) < 500
    hashes = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted((digest.LAST if i is None else i, hashes[t], t) for i, t in rows)
    want = sorted((i, digest.digest(t.encode()), hashlib.sha256(digest.edited(t, order[(n + 1) % len(order)][2]).encode()).hexdigest()) for n, (i, _, t) in enumerate(order))
    got = sorted((digest.LAST if r["doc_id"] is None else r["doc_id"], r["fingerprint"], r["edited_sha256"]) for r in digest.fingerprints(spark, docs).collect())
    assert got == want


def test_digest_halves_are_nearer_than_strangers(spark, data):
    got = digest.fingerprints(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("n_chars > 400").toPandas()
    assert (got.near_edited >= got.near_next).mean() > 0.9


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def test_licenses_base_places(spark, data, odd, none):
    for docs in (odd, spark.read.parquet(f"{data}/documents.parquet")):
        want = Counter()
        for i, text in docs.select("doc_id", "text").collect():
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
            at = [(k, label) for p, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
            want[i, len(words), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))] += 1
        got = licenses.summary(*licenses.scan(spark, docs)).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert licenses.summary(*licenses.scan(spark, none)).count() == 0


def test_licenses_merge_diagonals(spark):
    notice = "permission is hereby granted free of charge to any person obtaining a copy of this software"
    changed = notice.replace("free of", "wholly free of").replace("any person", "person")
    df = spark.createDataFrame([(1, f"head {notice} tail"), (2, changed), (3, "permission is of any software"), (4, notice[:30])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.summary(*licenses.scan(spark, df)).collect()}
    assert [got[i]["labels"] for i in (1, 2, 3, 4)] == ["mit", "mit", "", ""] and got[1]["score"] == 1.0 > got[2]["score"] > 0.7


def test_licenses_do_not_add_up_scattered_words(spark):
    notice = "permission is hereby granted free of charge to any person obtaining a copy of this software".split()
    pairs = [" ".join(notice[i : i + 2]) for i in range(0, len(notice), 2)]
    scattered = [f"{'x ' * (2 + k)}".join(pairs) for k in range(3)] + [" ".join(f"{p} {' '.join('y' * (1 + i % 3))}" for i, p in enumerate(pairs * 40))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*scattered, "a b " * 500 + " ".join(notice) + " c d" * 500 + " " + " ".join(notice)])], "doc_id long, text string")
    texts, spans = licenses.scan(spark, df)
    assert [(r["doc_id"], r["label"], r["first_word"], r["last_word"], r["cover"]) for r in spans.orderBy("first_word").collect()] == [(4, "mit", 1000, 1000 + len(notice) - 1, 1.0), (4, "mit", 2000 + len(notice), 2000 + 2 * len(notice) - 1, 1.0)]


def test_licenses_need_the_words_that_tell_notices_apart(spark):
    cc = {"Licensed under CC BY 4.0": "cc-by", "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc", "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa", "Licensed under CC BY-ND 4.0": "cc-by,cc-by-nd", "Licensed under CC BY-NC-SA 4.0": "cc-by,cc-by-nc,cc-by-nc-sa", "Licensed under CC BY-NC-ND 4.0": "cc-by,cc-by-nc,cc-by-nc-nd"}
    others = {"Licensed under the Apache License, Version 2.0": "apache-2.0", "Licensed under the Apache License 2.0": "apache-2.0", "Licensed under the Apache License, Version 1.1": "", "Licensed under the Mozilla License, Version 2.0": "", "Distributed under the MIT license": "mit"}
    others["This Source Code Form is subject to the terms of the Eclipse Public License"] = ""
    others["This program is free software: you can redistribute it and/or modify it under the terms of the MIT"] = ""
    want = list({**cc, **others}.items())
    df = spark.createDataFrame([(i, f"head {t} tail") for i, (t, _) in enumerate(want)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.summary(*licenses.scan(spark, df)).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(want)] == want


def check_mix(docs):
    rows = mixing.mix(docs).collect()
    sizes, taken, goal = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, want = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
        free -= over
    for s in order:
        assert math.isclose(goal[s], want[s], rel_tol=1e-9, abs_tol=1e-9)
    assert all(r["source_size"] == sizes[r["source"]] for r in rows)
    return rows, sizes, taken, goal


def test_mixing_targets_and_sampling(spark, odd, none):
    rows, *_ = check_mix(odd)
    assert len(rows) == 13
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first, sizes, taken, goal = check_mix(docs)
    again = mixing.mix(docs.repartition(5)).collect()
    assert {r["doc_id"]: r["copies"] for r in first} == {r["doc_id"]: r["copies"] for r in again}
    assert abs(sum(taken.values()) - sum(goal.values())) < 0.03 * sum(goal.values())
    kept = mixing.expand(mixing.mix(docs), docs.columns)
    assert kept.count() == sum(r["copies"] for r in first) and kept.columns == docs.columns
    assert mixing.mix(none).count() == 0


def test_toxicity_held_out(spark, odd, none):
    sf = "/root/testdata/sf0.1"
    got = queries.op3_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit / (got.toxic == 1).sum() > 0.9 and hit / (got.predicted == 1).sum() > 0.9
    labels = spark.createDataFrame([(1, 1), (9, 0), (9, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(spark, *toxicity.sample(odd, labels, F.lit(True)))
    out = toxicity.with_score(spark, odd, model, ["doc_id"]).collect()
    assert len(out) == 13 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.with_score(spark, none, None, ["doc_id"]).count() == 0
    assert toxicity.fit(spark, *toxicity.sample(odd, labels.limit(0), F.lit(True))) is None


def brute_toxicity(texts, text):
    """The length-normalised difference of a text, every expression counted and estimated anew, nothing pruned."""
    kept = [(set(zip(w, w[1:])), set(w), y) for w, y in ((toxicity.words_of(t), y) for t, y in texts)]
    docs = {
        "pair": lambda x: [y for pairs, _, y in kept if x in pairs],
        "word": lambda x: [y for _, words, y in kept if x in words],
        "stem": lambda x: [y for _, words, y in kept if any(w.startswith(x) for w in words)],
    }
    every = {"pair": set().union(*(p for p, _, _ in kept)), "word": set().union(*(w for _, w, _ in kept))}
    every["stem"] = {w[:n] for w in every["word"] for n in toxicity.STEMS if len(w) >= n}
    counts = {k: {x: (sum(docs[k](x)), len(docs[k](x)) - sum(docs[k](x))) for x in every[k]} for k in every}
    share = {k: sum(a for a, _ in c.values()) / sum(a + b for a, b in c.values()) for k, c in counts.items()}

    def discount(order, n):
        c, found = list(counts[order].values()), 0.5
        for m in range(1, min(n, toxicity.LEVELS) + 1):
            # Every occurrence left out in turn: the others are all of one class, the one left out may be of the other.
            met = [(lone, rest) for x in c for k in (0, 1) for lone in ([1] * x[1 - k] if x[k] == m and x[1 - k] == 1 else [0] * (x[k] if x[k] == m + 1 and not x[1 - k] else 0)) for rest in [k]]
            other = sum(lone for lone, _ in met)
            chance = sum((1 - share[order]) if rest == 0 else share[order] for _, rest in met)
            found = min(float(m), max(found, m * (other + 1.0) / (chance + 1.0)))
        return found

    def ratio(order, x, below):
        a, b = counts[order][x]
        d, prior = discount(order, a + b), share[order] / (1 - share[order])
        q = prior * math.exp(below) / (1 + prior * math.exp(below))
        spare = min(d, a) + min(d, b)
        return math.log((max(a - d, 0) + spare * q) / (max(b - d, 0) + spare * (1 - q)) / prior)

    def stem(w):
        value = 0.0
        for n in toxicity.STEMS:
            if len(w) >= n and sum(counts["stem"].get(w[:n], (0, 0))) >= toxicity.LEAST["stem"]:
                value = ratio("stem", w[:n], value)
        return value

    enough = lambda k, x: sum(counts[k].get(x, (0, 0))) >= toxicity.LEAST[k]
    word = lambda w: ratio("word", w, stem(w)) if enough("word", w) else stem(w)
    own, total = toxicity.words_of(text), 0.0
    for h, w in zip([None, *own], own):
        first = word(h) if h is not None and enough("word", h) else 0.0
        total += ratio("pair", (h, w), first + word(w)) - first if h is not None and enough("pair", (h, w)) else word(w)
    return total / len(own) if own else 0.0


def test_toxicity_model_equals_brute_force(spark):
    import random

    deal = random.Random(5)
    names = [a + b for a in ("alma", "brio", "cen", "du") for b in ("", "ra", "ras", "to", "tolin")]
    texts = [(" ".join(deal.choices(names + ["vile"] * (3 * y), k=25) + ["end", "of", "it"] * (i % 3)) + f" only{i}", y) for i, y in enumerate([1] * 12 + [0] * 30)]
    df = spark.createDataFrame([(t, y, i % 2) for i, (t, y) in enumerate(texts)], "text string, toxic int, fold int").repartition(4)
    counts = toxicity.count_expressions(df)
    counts = counts.select("h", "w", (F.col("plain") + F.col("plain_held")).alias("plain"), (F.col("toxic") + F.col("toxic_held")).alias("toxic"))
    model = toxicity.learn(counts, 0.0, 0.0)
    for text in [t for t, _ in texts[::5]] + ["", "unknown words", "vile vile almaraz of end it vilest", "It. END of it almatolinda"]:
        assert math.isclose(model.difference(toxicity.words_of(text)), brute_toxicity(texts, text), abs_tol=1e-9)


def test_toxicity_copies_are_one_witness(spark):
    rows = [("a b c d e f g h", 1, i % 2) for i in range(50)] + [("q r s t u v w x", 0, 0), (None, 0, 1), ("", 0, 1), ("a b c d e f g h", 0, 0)]
    got = toxicity.without_copies(spark.createDataFrame(rows, "text string, toxic int, fold int")).collect()
    assert Counter((r["text"] or "", r["toxic"]) for r in got) == Counter([("a b c d e f g h", 1), ("q r s t u v w x", 0), ("", 0), ("a b c d e f g h", 0)])


def test_toxicity_quality_does_not_fall_with_more_rows(spark):
    """The bound on the sample binds here: a class gives all it has, an eighth, a twenty-fourth."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    caught = []
    for bound in (6000, 300):
        texts, stands_for = toxicity.sample(docs, labels, crc_mod("doc_id", 4) != 2, bound)
        got = toxicity.with_score(spark, docs, toxicity.fit(spark, texts, stands_for), ["doc_id"]).join(labels, "doc_id").where(crc_mod("doc_id", 4) == 2).toPandas()
        hit = got[got.score >= toxicity.THRESHOLD]
        caught.append(hit.toxic.sum() / got.toxic.sum())
        assert hit.toxic.mean() > 0.9
    assert caught[0] > 0.9 and caught[1] > 0.75


def test_logistic_reaches_its_maximum():
    import numpy as np

    rng = np.random.default_rng(2)
    for scale in (0.01, 1.0, 300.0):  # from overlapping to apart
        x = np.concatenate([rng.normal(0, 1, (400, 2)), rng.normal(0.05 * scale, 1, (60, 2))])
        y, weight = np.repeat([0, 1], [400, 60]), np.repeat([11.0, 1.0], [400, 60])
        beta = np.array(toxicity.logistic(x, y, weight))
        s = np.maximum(x.std(axis=0), 1e-9)
        p = 1 / (1 + np.exp(-(beta[0] + x @ beta[1:])))
        gradient = (weight * (y - p)) @ np.column_stack([np.ones(460), x / s]) - np.array([1e-6, 0.05, 0.05]) * beta * np.array([1, *s])
        assert np.abs(gradient).max() < 1e-3


def test_langid_held_out(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_langid(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97
    model = langid.fit(spark, langid.sample(odd))
    out = Counter((r["doc_id"], r["lang_pred"]) for r in langid.with_language(spark, odd, model, ["doc_id"]).collect())
    assert out[2, "und"] == out[3, "und"] == out[8, "und"] == 1 and out[9, "en"] == 1 and sum(out.values()) == 13
    empty = langid.fit(spark, langid.sample(none))
    assert {r["lang_pred"] for r in langid.with_language(spark, odd, empty, ["doc_id"]).collect()} == {"und"}


def test_langid_backs_off_to_shorter_grams():
    model = langid.Model(["a", "b"], {"known": (-1.0, -9.0)}, {"<zzz": (-9.0, -1.0), "z": (-5.0, -4.0)}, (-20.0, -20.0))
    scorer = langid.Scorer(model)
    assert scorer.predict("known")[0] == "a" and scorer.predict("zzz")[0] == "b" and scorer.predict("12 ²") == ("und", 0.0)
    # "<zzz" whole, three single z three steps down, ">" unknown.
    want = [-9 + 3 * (-5 + 3 * langid.STEP) - 20, -1 + 3 * (-4 + 3 * langid.STEP) - 20]
    assert scorer.unseen("zzz").tolist() == pytest.approx(want)
    scorer.full = len(scorer.rows)
    assert scorer.total(["known", "zzz", "zz"]).tolist() == pytest.approx((langid.Scorer(model).total(["known", "zzz", "zz"])).tolist())


CLASHES = ("spans", "size", "__id", "taken", "component_id", "fp", "root", "row", "text2", "copies", "Target", "__toxicity", "row_key", "a.b", "source_size", "row_no")


def test_columns_with_clashing_names_are_kept(spark, odd):
    import corpus_pipeline

    docs = odd.select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHES])
    intact = lambda r: all(r[c] == f"{c}-{'none' if r['doc_id'] is None else r['doc_id']}" for c in CLASHES)
    for stage in (pii.redact, mixing.mixture, lambda d: corpus_pipeline.drop_near_duplicates(spark, d, ""), lambda d: corpus_pipeline.drop_toxic(spark, d, "/root/testdata/sf0.001")):
        got = stage(docs)
        assert got.columns == docs.columns
        rows = got.collect()
        assert len(rows) >= 8 and all(map(intact, rows))
    spans = pii.with_spans(docs).collect()
    assert len(spans) == 13 and all(isinstance(r["spans"], list) and r["size"].startswith("size-") for r in spans)
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == 13 and all(r["taken"] == r["copies"] * r["size"] and r["__id"].startswith("__id-") for r in mixed)
    assert sum(r["copies"] for r in mixed) == mixing.mixture(docs).count()
