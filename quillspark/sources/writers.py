"""Sinks."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def merge_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) to one text a document, each page after its marker."""
    piece = F.concat(F.lit("<!-- ===== page "), F.col("page_no").cast("string"), F.lit(" ===== -->\n\n"), F.col("text"))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", piece.alias("piece")))), lambda p: p["piece"]), "\n\n").alias("text"))


def write_index(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Chunks partitioned by session, so that a filter on the session prunes folders."""
    chunks.repartition("session_id").write.mode(mode).partitionBy("session_id").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_texts(docs: DataFrame, path: str) -> None:
    """A folder of texts for each name."""
    docs.select("name", F.col("text").alias("value")).write.mode("overwrite").partitionBy("name").text(path)


_own: dict[str, str] = {}


def settled(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` written once to the folder that driver and executors share and read back: what follows neither computes it again nor loses it with
    an executor.  The folder is spark.checkpoint.dir, a temporary one only where that is unset; what is written goes when the driver ends."""
    base, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not base:
        if app not in _own:
            _own[app] = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        base = _own[app]
    path = f"{base.rstrip('/')}/quillspark-settled/{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def pipe_lines(header: list[str], rows: list[list]) -> list[str]:
    shown = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    return [f"| {' | '.join(map(shown, r))} |" for r in (header, ["---"] * len(header), *rows)]


FINDING = ("severity", "file", "table", "row", "column", "value", "rule", "detail")


def _summary(findings: DataFrame) -> list[str]:
    """The head of a report: how many findings of each rule, a row for each of a fixed list."""
    from quillspark.operators.validation import counts

    total = counts(findings).orderBy(F.col("n").desc(), "rule").collect()
    every = next((r["n"] for r in total if r["rule"] is None and r["severity"] is None), 0)
    return ["# Table validation", "", f"Flagged cells: {every}", "", *pipe_lines(["Rule", "Severity", "Count"], [[r["rule"], r["severity"], r["n"]] for r in total if r["rule"] is not None])]


def findings_report(findings: DataFrame, top: int = 10_000) -> str:
    """A report to read: counts of all findings and the ``top`` first of them in order.  ``write_findings`` lists all."""
    from quillspark.operators.validation import in_order

    rows = [[r["ma_so"] or r["row"] if c == "row" else r[c] for c in FINDING] for r in in_order(findings).limit(top).collect()]
    return "\n".join([*_summary(findings), "", *pipe_lines([c.capitalize() for c in FINDING], rows)]) + "\n"


def write_findings(findings: DataFrame, path: str) -> None:
    """``path``/summary, one file of counts, and ``path``/findings, every finding in order as lines of a pipe table, spread over files."""
    from quillspark.operators.validation import in_order

    spark = findings.sparkSession
    spark.createDataFrame([("\n".join(_summary(findings)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary")
    cells = [F.coalesce(F.nullif("ma_so", F.lit("")), F.col("row").cast("string")) if c == "row" else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FINDING]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    in_order(findings).select(line.alias("value")).write.mode("overwrite").text(f"{path}/findings")


def write_evaluation(items: DataFrame, totals: DataFrame, path: str, title: str = "Evaluation") -> str:
    """An evaluation as ``path``/items (JSON lines, a row for each), ``path``/report (JSON and Markdown of the means) and ``path``/latest (the
    Markdown again).  totals has a row for each answer type and one for all; the Markdown is also returned."""
    spark, columns = items.sparkSession, totals.columns
    items.write.mode("overwrite").json(f"{path}/items")
    rows = sorted(totals.collect(), key=lambda r: (r[columns[0]] is not None, str(r[columns[0]])))
    markdown = "\n".join([f"# {title}", "", *pipe_lines(columns, [["all" if x is None and i == 0 else x for i, x in enumerate(r)] for r in rows])]) + "\n"
    report = json.dumps({"title": title, "rows": [r.asDict(True) for r in rows]}, ensure_ascii=False)
    spark.createDataFrame([("json", report), ("md", markdown)], "kind string, value string").coalesce(1).write.mode("overwrite").partitionBy("kind").text(f"{path}/report")
    spark.createDataFrame([(markdown,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/latest")
    return markdown


#: What the report of a page comparison shows: rows of the head, and columns of a page.
PAGE_HEAD = (("Char accuracy (1-CER)", "char_accuracy"), ("CER", "cer"), ("WER", "wer"), ("Word F1", "word_f1"), ("Number F1 (macro)", "number_f1"))
PAGE_COLUMNS = ("char_accuracy", "cer", "wer", "word_f1", "number_f1")


def write_page_report(scored: DataFrame, path: str, title: str = "Pages", skipped: int = 0) -> dict:
    """What ``evaluation.pages`` gives as ``path``/aggregate (JSON: macro means, micro precision, recall and F1 of words and numbers), ``path``/per_page
    (JSON lines) and ``path``/report: Markdown files in order, the head first, then a line for each page, all of them.  The aggregate is also returned."""
    spark = scored.sparkSession
    total = lambda c: F.sum(c).cast("double")
    micro = [F.round(F.coalesce(total(f"{k}_shared") / F.nullif(total(n), F.lit(0.0)), F.lit(0.0)), 4).alias(f"micro_{k[:-1]}_{what}") for k in ("words", "numbers") for what, n in (("precision", f"n_{k}"), ("recall", f"n_gold_{k}"))]
    counts = [F.sum("numbers_shared").alias("numbers_matched"), F.sum("n_gold_numbers").alias("numbers_gold")]
    found = scored.agg(F.count("*").alias("pages_scored"), *[F.round(F.avg(c), 4).alias(f"macro_{c}") for _, c in PAGE_HEAD], *micro, *counts).first().asDict()
    found = {"title": title, "pages_skipped": skipped, **{k: 0 if v is None else v for k, v in found.items()}}
    for k in ("word", "number"):
        p, r = found[f"micro_{k}_precision"], found[f"micro_{k}_recall"]
        found[f"micro_{k}_f1"] = round(2 * p * r / (p + r), 4) if p + r else 0.0
    share = lambda x: f"{x:.2%}"
    head = [f"# {title}", f"Pages scored: {found['pages_scored']} | skipped: {skipped}", "", "## Aggregate", *pipe_lines(["Metric", "Value"], [[label, share(found[f"macro_{c}"])] for label, c in PAGE_HEAD])]
    head += [f"| Number P/R (micro) | {share(found['micro_number_precision'])} / {share(found['micro_number_recall'])} ({found['numbers_matched']}/{found['numbers_gold']}) |", "", "## Per page", *pipe_lines(["Page", "CharAcc", "CER", "WER", "WordF1", "NumF1", "Num matched"], [])]
    spark.createDataFrame([(json.dumps(found, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/aggregate")
    scored.orderBy("page").write.mode("overwrite").json(f"{path}/per_page")
    spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report/0_head")
    cells = [F.col("page").cast("string"), *[F.format_string("%.2f%%", F.col(c).cast("double") * 100) for c in PAGE_COLUMNS], F.concat_ws("/", F.col("numbers_shared").cast("string"), F.col("n_gold_numbers").cast("string"))]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in cells]), F.lit(" |"))
    scored.orderBy("page").select(line.alias("value")).write.mode("overwrite").text(f"{path}/report/1_pages")
    return found


def batch_report(results: DataFrame) -> DataFrame:
    """results (name, page_no, text, seconds, error), a row for each page, to a row for each document: name, pages, characters, seconds,
    failed pages and status."""
    failed = F.count_if(F.col("error").isNotNull())
    return results.groupBy("name").agg(F.count("*").alias("pages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.round(F.sum("seconds"), 3).alias("seconds"), failed.alias("failed"), F.when(failed == 0, "ok").when(failed == F.count("*"), "failed").otherwise("partial").alias("status"))


def write_batch_report(results: DataFrame, path: str) -> None:
    write_csv(batch_report(results).orderBy("name"), path)
