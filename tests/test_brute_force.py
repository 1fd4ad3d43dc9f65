"""Queries that SQL does not express, every row against a plain version in Python; and the sources and sinks that no query writes."""

import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspark.functions import text as texts
from quillspark.operators import chunking, models, validation
from quillspark.plans import evaluation_queries, retrieval_queries
from quillspark.sources import readers, writers

QUERIES = entry.queries()


def words(value):
    return re.findall(r"\w+", (value or "").lower())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = 0
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], above + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def turns(spark, data):
    """Every turn with the next one: (conv_id, turn) to two texts."""
    rows = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{data}/conversations.parquet").collect()}
    return {k: (t, rows[k[0], k[1] + 1]) for k, t in rows.items() if (k[0], k[1] + 1) in rows}


def test_rouge_l(spark, data, turns):
    want = {}
    for key, (a, b) in turns.items():
        n, x, y = lcs(words(a), words(b)), words(a), words(b)
        want[key] = 2 * n / (len(x) + len(y)) if n else 0.0
    got = {(r["conv_id"], r["turn"]): r["rouge_l"] for r in QUERIES["rouge_l"](spark, data).collect()}
    assert got == pytest.approx(want, abs=1e-6) and len(got) > 50


def test_word_error_rate(spark, data, turns):
    want = {k: distance(words(a), words(b)) for k, (a, b) in turns.items()}
    rows = QUERIES["word_error_rate"](spark, data).collect()
    assert {(r["conv_id"], r["turn"]): r["distance"] for r in rows} == want
    assert all(math.isclose(r["wer"], r["distance"] / max(1, len(words(turns[r["conv_id"], r["turn"]][1]))), abs_tol=1e-6) for r in rows)


def test_hash_embeddings(spark, data):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r["doc_id"]: r["vector"] for r in QUERIES["hash_embeddings"](spark, data).collect()}
    assert set(got) == set(docs)
    for doc_id, value in docs.items():
        want = Counter()
        for w, n in Counter(words(value)).items():
            h = zlib.crc32(w.encode())
            want[h % 64] += n * (1 if h >> 16 & 1 else -1)
        norm = math.sqrt(sum(x * x for x in want.values())) or 1.0
        assert got[doc_id] == pytest.approx([want[i] / norm for i in range(64)], abs=1e-6)


def plain_windows(value, size, overlap):
    found, at = [], 0
    while at < len(value):
        if len(value) - at <= size:
            found.append(value[at:])
            break
        piece, ends = value[at : at + size], []
        for mark in (". ", "\n", " "):
            places = [m.start() for m in re.finditer(f"(?={re.escape(mark)})", piece) if m.start() + len(mark) <= size]
            if places and places[-1] > size / 2:
                ends.append(places[-1] + len(mark))
        end = at + (ends[0] if ends else size)
        found.append(value[at:end])
        at = max(at + 1, end - overlap)
    return [f.strip() for f in found if f.strip()]


def test_window_chunks(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    want = Counter((r["doc_id"], i, p) for r in docs for i, p in enumerate(plain_windows(r["text"] or "", 1800, 250)))
    assert Counter(map(tuple, QUERIES["window_chunks"](spark, data).collect())) == want


def plain_prose(value, room, overlap=250):
    pieces, open_ = [], []
    for p in [p.strip() for p in re.split(r"\n{2,}", value) if p.strip()]:
        if len(p) <= room and open_ and len("\n\n".join([*open_, p])) <= room:
            open_.append(p)
            continue
        pieces += ["\n\n".join(open_)] if open_ else []
        open_ = [p] if len(p) <= room else []
        pieces += plain_windows(p, room, overlap) if len(p) > room else []
    return pieces + (["\n\n".join(open_)] if open_ else [])


def plain_blocks(text):
    """(kind, page, heading, caption, unit, lines) of each block, line after line."""
    lines, found, page, unit, caption, crumbs = re.sub("\r\n?", "\n", text).split("\n"), [], None, None, None, {}
    for line in lines:
        mark, head, bare = re.search(r"(?i)<!--\s*=+\s*page\s+(\d+)\s*=+\s*-->", line), re.match(r"(#{1,6})\s+(.*)$", line), line.strip(" \t\n\r\f\x0b")
        if mark:
            page, kind = int(mark[1]), "page"
        elif head:
            kind, caption = "heading", head[2].strip(" \t\n\r\f\x0b")
            crumbs = {**{n: t for n, t in crumbs.items() if n < len(head[1])}, len(head[1]): caption}
        elif bare.startswith("|") and line.count("|") >= 2:
            kind = "table"
        else:
            kind, named = "text", re.search(r"(?i)(?:đơn\s*vị\s*tính|unit)\s*[:.]?\s*.+", line)
            unit, caption = named[0].strip() if named else unit, bare or caption
        found.append([kind, page, " > ".join(crumbs[n] for n in sorted(crumbs)), caption, unit, line])
    for i, own in enumerate(found):
        if own[0] == "table" and not any(0 <= j < len(found) and found[j][0] in ("table", "was") for j in (i - 1, i + 1)):
            own[0] = "lone"
    blocks = []
    before = None
    for kind, *rest, line in found:
        kind = "text" if kind == "lone" else kind
        if kind in ("table", "text"):
            if kind == before:
                blocks[-1][-1].append(line)
            else:
                blocks.append([kind, *rest, [line]])
        before = kind
    return [b for b in blocks if b[0] == "table" or any(x.strip() for x in b[-1])]


def plain_chunks(doc_id, text, context, year, size=1800, overlap=250):
    from quillspark.operators import sections

    blocks, known, rows = plain_blocks(text), {}, []

    def register(crumb):
        if crumb not in known:
            above, inside, leaf = crumb.rpartition(" > ")
            parent = register(above) if inside else ("", "", None)
            kind = next((code for code, patterns in sections.HEADINGS if any(re.search(p, crumb, re.I) for p in patterns)), "")
            note = re.search(sections.NOTE_HEADING, leaf, re.I) if kind == "thuyet_minh" else None
            known[crumb] = (f"{doc_id}:s{len(known) + 1}", parent[0], kind, int(note[1]) if note else None)
        return known[crumb]

    prose = {}
    for kind, _, heading, *_, lines in blocks:
        register(heading)
        if kind == "text":
            prose.setdefault(heading, []).append("\n".join(lines).strip())
    whole = {h: "\n\n".join(p) for h, p in prose.items()}
    tables = 0
    for kind, page, heading, caption, unit, lines in blocks:
        section_id, parent_section, statement, note = known[heading]
        prefix = "\n".join(p for p in ((context or "").strip(), heading) if p)
        room = max(size - len(prefix), 200)
        value_kind, parent_id, parent_text = "", "", ""
        if kind == "text":
            pieces = plain_prose("\n".join(lines), room, overlap)
            if len(whole[heading]) <= 4000:
                parent_id, parent_text = section_id, whole[heading]
        else:
            tables += 1
            all_of_it = "\n".join(lines)
            has = lambda p: re.search(p, all_of_it, re.I)
            flow, balance = has(r"năm\s*nay") and has(r"năm\s*trước"), has(r"số\s*cuối\s*(năm|kỳ)") and has(r"số\s*đầu\s*(năm|kỳ)")
            value_kind = "flow" if flow else "balance" if balance else ""
            if year is not None and flow:
                lines = [re.sub(r"(?i)năm\s*trước", f"Năm trước ({year - 1})", re.sub(r"(?i)năm\s*nay", f"Năm nay ({year})", x)) for x in lines]
            if year is not None and balance:
                lines = [re.sub(r"(?i)số\s*đầu\s*(năm|kỳ)", rf"Số đầu \1 ({year - 1})", re.sub(r"(?i)số\s*cuối\s*(năm|kỳ)", rf"Số cuối \1 ({year})", x)) for x in lines]
            notes = {"flow": chunking.FLOW_NOTE, "balance": chunking.BALANCE_NOTE}
            said, top = [], "\n".join(lines[:2])
            for part in (caption, unit, notes[value_kind].format(year, year - 1) if value_kind and year is not None else ""):
                if part and part not in top and part not in heading and not any(part in s or s in part for s in said):
                    said.append(part)
            above = [" — ".join(said)] if said else []
            n = 2 if len(lines) > 1 and re.match(r"\s*\|?\s*:?-{2,}", lines[1]) else 1
            head, groups = "\n".join(above + lines[:n]), []
            for row in lines[n:]:
                if groups and len("\n".join([*groups[-1], row])) <= max(room - len(head), 200) - 1:
                    groups[-1].append(row)
                else:
                    groups.append([row])
            pieces = ["\n".join([head, *g]) for g in groups] or [head]
            parent_id, parent_text = f"{doc_id}:t{tables}", "\n".join(above + lines)
        rows += [(str(doc_id), len(rows) + i, page, heading, f"{prefix}\n\n{p}" if prefix else p, parent_id, parent_text, statement, note, section_id, parent_section, year, value_kind) for i, p in enumerate(pieces)]
    return rows


def chunk_rows(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["doc_id"], r["ordinal"])):
        got.setdefault(r["doc_id"], []).append(tuple(r))
    return got


def same_chunks(got, want):
    assert set(got) == set(want)
    for doc_id, rows in want.items():
        assert len(got[doc_id]) == len(rows), doc_id
        for a, b in zip(got[doc_id], rows):
            assert a == b


def test_chunk_statements_column_by_column(spark, data):
    made = retrieval_queries.statements(spark, data).collect()
    want = {str(r["doc_id"]): plain_chunks(*r) for r in made}
    assert {x[12] for rows in want.values() for x in rows} == {"", "flow", "balance"} and {x[7] for rows in want.values() for x in rows} >= {"kqkd", "cdkt", "thuyet_minh", ""}
    same_chunks(chunk_rows(QUERIES["chunk_statements"](spark, data)), want)


def test_chunks_of_random_structures(spark):
    rng = random.Random(11)
    lines = ["# Thuyết minh báo cáo", "## 5. Tiền", "### V.7 Hàng", "###### tiny", "#no heading", "# ", "| a | b |", "|---|---|", "| 1 | 2 |", "  | x | y |", "|lone", "", "", "  ", "Đơn vị tính: VND", "unit. USD ", "prose. And more " * 9, "năm nay", "| Năm  nay | năm trước |", "| Số cuối kỳ | SỐ ĐẦU NĂM |", "<!-- === page 3 === -->", "<!--=PAGE 12=-->x", "## Lưu chuyển tiền tệ", "w" * 450, "long words " * 60, "\tindent\r", "Balance sheet"]
    docs = [(f"d{i}", "\n".join(rng.choices(lines, k=rng.randint(0, 45))), rng.choice(["", "ctx", None, " two words "]), rng.choice([None, 2022])) for i in range(120)]
    docs += [("none", None, None, None), ("blank", "\n \n", "c", 2020)]
    df = spark.createDataFrame(docs, "doc_id string, text string, doc_context string, year int").repartition(4)
    for size in (1800, 300):
        want = {d: rows for d, text, context, year in docs if (rows := plain_chunks(d, text or "", context, year, size))}
        same_chunks(chunk_rows(chunking.chunk(df, size)), want)


def test_chunk_markdown_of_plain_prose(spark, data):
    """Documents without headings, tables or page marks: paragraphs in order, packed or windowed under the source."""
    docs = [r for r in spark.read.parquet(f"{data}/documents.parquet").collect() if not re.search(r"(?m)^#{1,6}\s|^\s*\||<!--", r["text"] or "")]
    want = Counter()
    for r in docs:
        room, pieces, open_ = max(200, 1800 - len(r["source"])), [], []
        for p in [p.strip() for p in re.split(r"\n{2,}", re.sub("\r\n?", "\n", r["text"] or "")) if p.strip()]:
            if len(p) <= room and open_ and len("\n\n".join([*open_, p])) <= room:
                open_.append(p)
                continue
            pieces += ["\n\n".join(open_)] if open_ else []
            open_ = [p] if len(p) <= room else []
            pieces += plain_windows(p, room, 250) if len(p) > room else []
        pieces += ["\n\n".join(open_)] if open_ else []
        want.update((str(r["doc_id"]), i, f"{r['source']}\n\n{p}") for i, p in enumerate(pieces))
    kept = {str(r["doc_id"]) for r in docs}
    got = Counter((r["doc_id"], r["ordinal"], r["text"]) for r in QUERIES["chunk_markdown"](spark, data).collect() if r["doc_id"] in kept)
    assert len(kept) > 100 and got == want


def plain_mmr(ranked, vectors, k, weight=0.6):
    """ranked: ids by rank with scores."""
    if len(ranked) <= k:
        return [i for i, _ in ranked]
    scores = [s for _, s in ranked]
    span = max(scores) - min(scores) or 1.0
    unit = {i: np.array(vectors[i], float) / (np.linalg.norm(np.array(vectors[i], float)) or 1.0) for i, _ in ranked}
    chosen = []
    while len(chosen) < k:
        left = [(weight * (s - min(scores)) / span - (1 - weight) * max([float(unit[i] @ unit[c]) for c in chosen], default=0.0), -n, i) for n, (i, s) in enumerate(ranked) if i not in chosen]
        chosen.append(max(left)[2])
    return chosen


def by_question(rows, *columns):
    out = {}
    for r in sorted(rows, key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append(tuple(r[c] for c in columns))
    return out


def test_mmr_select(spark, data):
    vectors = {r["id"]: r["vector"] for r in retrieval_queries.vectors(spark, data).collect()}
    ranked = by_question(QUERIES["dense_topk"](spark, data).collect(), "id", "score")
    want = {q: plain_mmr(found, vectors, 8) for q, found in ranked.items()}
    got = {}
    for r in sorted(QUERIES["mmr_select"](spark, data).collect(), key=lambda r: (r["qid"], r["place"])):
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == want


def test_hybrid_context(spark, data):
    vectors = {r["id"]: r["vector"] for r in retrieval_queries.vectors(spark, data).collect()}
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    want = {}
    for q, found in by_question(retrieval_queries.hybrid(spark, data, 30).collect(), "id", "score").items():
        first = {}
        for i, s in found:
            if i in docs:
                first.setdefault((docs[i]["source"], docs[i]["lang"]), (i, s))
        best = sorted(first.values(), key=lambda x: (-x[1], x[0]))[:20]
        chosen = plain_mmr([(i, s) for i, s in best if i in vectors], vectors, 8)
        want[q] = "\n\n".join(f"[{n}] (source: {docs[i]['source']})\n{(docs[i]['text'] or '')[:4000]}" for n, i in enumerate(chosen, 1))
    assert {r["qid"]: r["context"] for r in QUERIES["hybrid_context"](spark, data).collect()} == want


def canon(token):
    t = token.strip("().%+ ").replace(" ", "")
    if re.fullmatch(r"[\d.]*\d[\d.]*,\d{0,2}", t):
        whole, tail = t.split(",")
        whole, tail = re.sub("^0+(?=.)", "", whole.replace(".", "")), tail.rstrip("0")
        return f"{whole}.{tail}" if tail else whole
    digits = t.replace(".", "").replace(",", "")
    return re.sub("^0+(?=.)", "", digits) if re.fullmatch(r"\d+", digits) else None


def numbers(value):
    return {c for c in map(canon, re.findall(r"\d[\d.,]*\d|\d", value or "")) if c}


def test_evaluate_answers_and_rollup(spark, data):
    refusals = [m for m in texts.REFUSALS]
    want = {}
    for r in evaluation_queries.items(spark, data).collect():
        plain, low = r["answer_type"] != "unanswerable", (r["answer"] or "").lower()
        gold = {c for c in map(canon, r["gold_numbers"]) if c}
        a, b = words(r["answer"]), words(r["ground_truth"])
        shared, refused, years = sum((Counter(a) & Counter(b)).values()), float(any(m in low for m in refusals)), set(r["relevant_years"])
        n = lcs(a, b) if plain else 0
        want[r["id"]] = {
            "answer_type": r["answer_type"],
            "numeric_recall": len(gold & numbers(r["answer"])) / len(gold) if plain and gold else None,
            "context_recall": len(gold & numbers(r["context"])) / len(gold) if plain and gold else None,
            "token_f1": (2 * shared / (len(a) + len(b)) if shared else 0.0) if plain else None,
            "rouge_l": (2 * n / (len(a) + len(b)) if n else 0.0) if plain else None,
            "year_coverage": len(years & set(r["found_years"])) / len(years) if plain and years else None,
            "abstention": None if plain else refused,
            "false_abstention": refused if plain else None,
        }
    got = {r["id"]: r.asDict() for r in QUERIES["evaluate_answers"](spark, data).collect()}
    assert set(got) == set(want) and len(want) > 50
    for i, row in want.items():
        for name, value in row.items():
            assert got[i][name] == (pytest.approx(value) if isinstance(value, float) else value), (i, name)
    for r in QUERIES["evaluate_rollup"](spark, data).collect():
        own = [w for w in want.values() if r["answer_type"] in (None, w["answer_type"])]
        assert r["n"] == len(own)
        for name in ("numeric_recall", "context_recall", "token_f1", "rouge_l", "year_coverage", "abstention", "false_abstention"):
            known = [w[name] for w in own if w[name] is not None]
            assert r[name] == (pytest.approx(sum(known) / len(known), abs=6e-5) if known else None)


def test_page_totals(spark, data):
    plain = lambda t: re.sub(r"\s+", " ", re.sub(r"[|#*`>]", " ", t)).strip()
    signed = lambda t: [("-" if m[0] == "(" and m[-1] == ")" else "") + re.sub("[^0-9]", "", m) for m in re.findall(r"\(?\d[\d.,]*\d\)?|\d", t)]
    rows = [(plain(r["pred"]), plain(r["gold"])) for r in evaluation_queries.recognised(spark, data).collect()]
    both = lambda a, b: sum((Counter(a) & Counter(b)).values())
    f1 = lambda s, a, b: 2 * s / (a + b) if a + b else 1.0
    cer, wer, word, number = [], [], [], []
    for p, g in rows:
        cer.append(distance(p, g) / max(1, len(g)))
        wer.append(distance(p.split(), g.split()) / max(1, len(g.split())))
        word.append((both(p.split(), g.split()), len(p.split()), len(g.split())))
        number.append((both(signed(p), signed(g)), len(signed(p)), len(signed(g))))
    mean = lambda xs: sum(xs) / len(xs)
    want = {"pages": len(rows), "cer": mean(cer), "wer": mean(wer), "char_accuracy": mean([max(0, 1 - c) for c in cer]), "word_f1": mean([f1(*w) for w in word]), "number_f1": mean([f1(*n) for n in number]), "micro_word_f1": f1(*map(sum, zip(*word))), "micro_number_f1": f1(*map(sum, zip(*number)))}
    got = QUERIES["page_totals"](spark, data).first().asDict()
    assert got == pytest.approx(want, abs=6e-5)


def plain_questions(found, company):
    """The question set of facts, branch by branch, in order: (question, answer, type, statement, years, golds, level, language)."""
    from decimal import ROUND_HALF_UP, Decimal

    from quillspark.operators import facts as f

    digits = lambda raw: re.sub("[^0-9]", "", raw)
    bare = lambda raw: re.sub(r"^[()]+|[()]+$", "", raw)
    shown = lambda r: (f"âm {bare(r['value_raw'])}" if r["value"] < 0 else r["value_raw"]) + f" {r['unit']}"
    tenth = lambda x: str(Decimal(repr(x)).quantize(Decimal("0.1"), ROUND_HALF_UP))
    by_key = {(r["statement"], r["code"], r["year"]): r for r in found}
    wrong = {k[:2] for k, r in by_key.items() if (k[0], k[1], k[2] + 1) in by_key and digits(r["value_raw"]) != digits(by_key[k[0], k[1], k[2] + 1]["prior_raw"])}
    series = {}
    for (statement, code, _), r in sorted(by_key.items()):
        if (statement, code) not in wrong:
            series.setdefault((statement, code), []).append(r)
    item = {k: i for i, k in enumerate(sorted(series))}
    head = {k: i for i, k in enumerate(f.HEADLINE)}
    rows = []

    def add(order, question, answer, kind, statement, years, golds, level, lang="vi", **names):
        question = question.format(company=company, **names)
        rows.append((order, question[:1].upper() + question[1:], answer.format(company=company, **names), kind, statement, years, golds, level, lang))

    for key, points in series.items():
        statement, code = key
        first, last = points[0], points[-1]
        flow, label, unit = not statement.startswith("cdkt"), first["label"], first["unit"]
        low = label[:1].lower() + label[1:]
        for r in points:
            y, own = r["year"], bare(r["value_raw"])
            period = f"năm {y}" if flow else f"tại ngày 31/12/{y}"
            add((1, item[key], y), f.LOOKUPS[(item[key] + y) % 3], f.LOOKUP_ANSWER, "numeric_single", statement, [y], [own], "easy" if code in ("01", "10", "440") else "medium", low=low, label=label, period=period, shown=shown(r))
            if not flow:
                add((6, item[key], y), *f.OPENING, "numeric_compare", statement, [y], [own, bare(r["prior_raw"])], "medium", label=label, year=y, shown=shown(r), prior_raw=r["prior_raw"])
            if key in head and code in f.ENGLISH:
                name = f.ENGLISH[code]
                add((7, head[key], y), *f.ABROAD, "numeric_single", statement, [y], [own], "medium", "en", name=name, title=name[0].upper() + name[1:], year=y, value_raw=r["value_raw"], unit=r["unit"])
        for before, r in zip(points, points[1:]):
            if not flow:
                continue
            delta, y, z = r["value"] - before["value"], r["year"], before["year"]
            golds = [bare(r["value_raw"]), bare(before["value_raw"])]
            names = {"label": label, "year": y, "year_before": z, "value_raw": r["value_raw"], "raw_before": before["value_raw"]}
            add((2, item[key], y), *f.YEARLY, "numeric_compare", statement, [z, y], golds, "medium", shown=shown(r), shown_before=shown(before), direction="tăng" if delta > 0 else "giảm" if delta < 0 else "không đổi", **names)
            if key in head:
                add((8, head[key], y), *f.DELTA, "reasoning", statement, [z, y], golds, "hard", way="tăng" if delta > 0 else "giảm", amount=f"{math.floor(abs(delta)):,}".replace(",", "."), **names)
        if len(points) < 4:
            continue
        years = [r["year"] for r in points]
        add((3, item[key], 0), *f.TREND, "multi_year", statement, years, [bare(r["value_raw"]) for r in points], "hard", label=label, unit=unit, first_year=years[0], last_year=years[-1], points=", ".join(f"năm {r['year']}: {bare(r['value_raw'])}" for r in points))
        if key in head:
            span = {"first_year": years[0], "last_year": years[-1]}
            if first["value"] > 0 and last["value"] > 0:
                add((4, head[key], 0), *f.GROWTH, "reasoning", statement, [years[0], years[-1]], [bare(first["value_raw"]), bare(last["value_raw"])], "hard", label=label, first_raw=first["value_raw"], last_raw=last["value_raw"], multiple=tenth(last["value"] / first["value"]), **span)
            top = max(points, key=lambda r: (r["value"], -r["year"]))
            add((4, head[key], 1), *f.PEAK, "reasoning", statement, years, [bare(top["value_raw"])], "hard", low=low, year=top["year"], shown=shown(top), **span)
    for no, (name, over, under) in enumerate(f.MARGINS):
        for y in sorted({k[2] for k in by_key}):
            o, u = by_key.get(("kqkd", over, y)), by_key.get(("kqkd", under, y))
            if o and u and u["value"]:
                add((5, no, y), *f.MARGIN, "reasoning", "kqkd", [y], [bare(o["value_raw"]), bare(u["value_raw"])], "hard", name=name, year=y, percent=tenth(o["value"] / u["value"] * 100), over_label=f.INCOME[over].lower(), under_label=f.INCOME[under].lower(), over_raw=o["value_raw"], under_raw=u["value_raw"])
    seen, out = set(), []
    for row in sorted(rows, key=lambda r: r[0]):
        if row[1].strip().lower() not in seen:
            seen.add(row[1].strip().lower())
            out.append(row[1:])
    return [(f"q-{i:04d}", *row) for i, row in enumerate(out, 1)]


ASKED = ("id", "question", "ground_truth", "answer_type", "statement", "years", "gold_numbers", "difficulty", "lang")


def question_rows(df):
    return sorted(tuple(list(r[c]) if isinstance(r[c], list) else r[c] for c in ASKED) for r in df.collect())


def test_qa_generate(spark, data):
    """Every branch over the facts of the tables: all columns of all questions, in order."""
    from quillspark.plans import statement_queries

    found = [r.asDict() for r in statement_queries.found(spark, data).collect()]
    assert question_rows(QUERIES["qa_generate"](spark, data)) == plain_questions(found, "Orders")


def test_questions_of_all_branches(spark):
    """Three statements over five years, with losses, gaps, equal figures, a contradicted item, zero to divide by and a question asked twice."""
    from quillspark.operators import facts

    rng, rows = random.Random(5), []
    dotted = lambda v: f"({abs(v):,})".replace(",", ".") if v < 0 else f"{v:,}".replace(",", ".")
    items = [("kqkd", c) for c in ("01", "10", "20", "22", "50", "60", "70")] + [("cdkt_ts", c) for c in ("100", "110", "123")] + [("cdkt_nv", c) for c in ("400", "440")]
    for statement, code in items:
        before = None
        for y in range(2019, 2024):
            if (code, y) in {("22", 2021), ("110", 2022), ("110", 2023)}:
                before = None
                continue
            value = 0 if (code, y) == ("10", 2020) else before if (code, y) == ("50", 2021) and before is not None else rng.randint(-(10**6), 10**8) if code in ("60", "20") else rng.randint(1000, 10**9)
            prior = dotted(before if before is not None else rng.randint(1000, 10**6))
            label = f"Chỉ tiêu {code}" if code != "123" else "chỉ tiêu 100"
            rows.append((statement, code, label, y, dotted(value), float(value), "VND/cổ phiếu" if code == "70" else "triệu VND", "7" if (code, y) == ("01", 2022) else prior))
            before = value
    found = spark.createDataFrame(rows, "statement string, code string, label string, year int, value_raw string, value double, unit string, prior_raw string")
    want = plain_questions([r.asDict() for r in found.collect()], "Trial")
    assert {r[3] for r in want} == {"numeric_single", "numeric_compare", "multi_year", "reasoning"} and {r[8] for r in want} == {"vi", "en"}
    assert not any("Chỉ tiêu 01 " in r[1] for r in want) and any(" lần năm " in r[1] for r in want) and any("xấp xỉ" in r[1] for r in want) and any("cuối năm" in r[1] for r in want)
    assert question_rows(facts.questions(spark, found, "Trial")) == want


def test_questions_pairs_and_resumption(spark, tmp_path):
    items = [{"id": f"q{i}", "question": f"Q{i}?", "ground_truth": "x", "answer_type": "factual", "gold_numbers": ["1"], "relevant_years": [2021], "lang": "vi"} for i in (3, 1, 2)]
    (tmp_path / "set.jsonl").write_text("\n".join(map(json.dumps, items)))
    assert [r["id"] for r in readers.questions(spark, str(tmp_path / "set.jsonl"), 2).orderBy("id").collect()] == ["q1", "q2"]
    assert readers.questions(spark, str(tmp_path / "set.jsonl")).count() == 3
    left, right = (spark.createDataFrame(rows, "page string, text string") for rows in ([("a", "1"), ("b", "2")], [("b", "3"), ("c", "4")]))
    pairs, skipped = readers.page_pairs(left, right)
    assert [tuple(r) for r in pairs.collect()] == [("b", "2", "3")] and {r["page"] for r in skipped.collect()} == {"a", "c"}
    assert [r["page"] for r in readers.unprocessed(left, right, "page").collect()] == ["a"]


def test_page_ranges_engines_and_text_layers(spark):
    df = spark.createDataFrame([("x.pdf", bytearray(b"one|two||four")), ("bad.pdf", bytearray(b"!"))], "path string, content binary")

    def extract(content):
        if content == b"!":
            raise ValueError("broken")
        return content.decode().split("|")

    got = readers.pages(df, extract, 2, 3).collect()
    assert [(r["page_no"], r["text"]) for r in got if r["error"] is None] == [(2, "two")] and [r["path"] for r in got if r["error"]] == ["bad.pdf"]
    assert [r["page_no"] for r in readers.pages(df, extract, 2).where("error IS NULL").orderBy("page_no").collect()] == [2, 4]
    readers.register("split", extract)
    assert readers.pages(df, "split").where("error IS NULL").count() == 3
    with pytest.raises(KeyError):
        readers.engine("none")
    read = readers.with_fallback(lambda c: [c.decode()], lambda c: ["recognised"])
    assert read(b"x" * 41) == ["x" * 41] and read(b" x " * 40) == ["recognised"] and readers.with_fallback(lambda c: [""])(b"") == []


def test_writers(spark, tmp_path):
    at = str(tmp_path)
    writers.write_csv(spark.createDataFrame([(1, "a")], "n int, s string"), f"{at}/csv")
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{at}/csv").collect()] == [("1", "a")]
    writers.write_json(spark.createDataFrame([(1, ["a"])], "n int, s array<string>"), f"{at}/json")
    assert spark.read.json(f"{at}/json").first()["s"] == ["a"]
    writers.write_texts(spark.createDataFrame([("d1", "one\ntwo"), ("d2", "three")], "name string, text string"), f"{at}/texts")
    assert spark.read.text(f"{at}/texts/name=d1", wholetext=True).first()["value"].strip() == "one\ntwo"
    items = spark.createDataFrame([("a", "x", 0.5), ("b", "y", 1.0)], "id string, answer_type string, f1 double")
    totals = items.groupingSets([["answer_type"], []], "answer_type").agg(F.count("*").alias("n"), F.avg("f1").alias("f1"))
    markdown = writers.write_evaluation(items, totals, f"{at}/eval", "Answers")
    assert markdown == "# Answers\n\n| answer_type | n | f1 |\n| --- | --- | --- |\n| all | 2 | 0.7500 |\n| x | 1 | 0.5000 |\n| y | 1 | 1.0000 |\n"
    assert spark.read.json(f"{at}/eval/items").count() == 2 and spark.read.text(f"{at}/eval/latest", wholetext=True).first()["value"].strip() == markdown.strip()
    assert json.loads(spark.read.text(f"{at}/eval/report/kind=json").first()["value"])["rows"][0] == {"answer_type": None, "n": 2, "f1": 0.75}
    results = spark.createDataFrame([("a", 1, "xx", 0.5, None), ("a", 2, None, 0.25, "boom"), ("b", 1, "y", 1.0, None)], "name string, page_no int, text string, seconds double, error string")
    writers.write_batch_report(results, f"{at}/batch")
    assert {tuple(r) for r in spark.read.option("header", True).csv(f"{at}/batch").collect()} == {("a", "2", "2", "0.75", "1", "partial"), ("b", "1", "1", "1.0", "0", "ok")}


def test_all_findings_are_written_in_order(spark, tmp_path):
    rows = [(f"{2000 + i % 9}", 0, 3, ["Mã số", "Thuyết minh", "Năm nay"], i, [str(i), "5.000", "7.000" if i % 2 else "5.000"]) for i in range(60)]
    findings = validation.structural(spark.createDataFrame(rows, "file string, table_idx int, n_cols int, header array<string>, row_idx int, cells array<string>"))
    assert findings.count() == 90
    writers.write_findings(findings, str(tmp_path / "report"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "report" / "findings")).collect()]
    assert len(lines) == 90 and all(line.startswith("| high | 20") for line in lines)
    assert "Flagged cells: 90" in spark.read.text(str(tmp_path / "report" / "summary"), wholetext=True).first()["value"]
    assert writers.findings_report(findings, 5).count("| high |") == 2 + 5


def test_five_judges(spark):
    seen = {"faithfulness": "1.7", "answer_relevancy": "0.25", "context_precision": "-3", "context_recall": "oops", "answer_correctness": "0.5"}

    def reply(prompt):
        name = next(n for n, (what, _) in models.JUDGES.items() if what in prompt)
        if name == "answer_correctness" and "Reference:\nnone" in prompt:
            raise RuntimeError("busy")
        return f'So: {{"score": {seen[name]}, "why": "x"}}'

    df = spark.createDataFrame([("q", "c", "a", "r"), ("q", "c", "a", "none")], "question string, context string, answer string, reference string")
    scores = models.judges(reply)(**{c: F.col(c) for c in df.columns})
    got = df.select(*[s.alias(n) for n, s in scores.items()]).collect()
    assert tuple(got[0]) == (1.0, 0.25, 0.0, None, 0.5) and got[1]["answer_correctness"] is None
    errors = df.select(models.replies(reply)(models.judge_prompt("answer_correctness", **{c: F.col(c) for c in df.columns}))["error"].alias("e")).collect()
    assert [r["e"] for r in errors] == [None, "RuntimeError: busy"]


def test_ids_and_dates(spark):
    df = spark.createDataFrame([("a", "b")], "x string, y string")
    r = df.select(texts.short_id(F.col("x"), F.col("y")).alias("i"), texts.short_id(F.col("x")).alias("j"), texts.iso_utc(F.timestamp_seconds(F.lit(0))).alias("t"), texts.iso_utc(F.lit(None).cast("timestamp")).alias("n")).first()
    assert re.fullmatch("[0-9a-f]{12}", r["i"]) and r["i"] != r["j"] and r["t"] == "1970-01-01T00:00:00+00:00" and r["n"] is None


def test_dense_search_takes_any_vector(spark):
    from quillspark.operators import retrieval

    nan = float("nan")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 3.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None]), (7, [1.0, 0.0, 0.0]), (8, []), (9, [1e200, 1e200])], "id long, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 1.0]), (2, [2.0, 0.0, 0.0]), (3, None)], "qid long, vector array<double>")
    got = {(r["qid"], r["id"]): r["score"] for r in retrieval.dense_top_k(asked, vectors, 9).collect()}
    half = round(math.sqrt(0.5), 6)
    want = {(q, i): 0.0 for q in (1, 2, 3) for i in range(1, 10)} | {(1, 1): half, (1, 2): half, (1, 9): 1.0, (2, 7): 1.0}
    assert got == want
