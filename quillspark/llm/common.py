"""Helpers that the operators share: table access, the shared folder, and rows that cut the lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the five ASCII controls from tab to carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; always through Spark's reader, since the folder may be one that only Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        found = _own[app]
    return found.rstrip("/")


def _gone_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver delete a folder when it ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def written(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and safe from lost executors.  It goes when the driver ends."""
    path = f"{shared_dir(spark)}/quillspark/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _gone_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(spark: SparkSession, df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """As ``written``, bucketed on ``key``: a later join on the key moves only its other side."""
    name = f"quillspark_{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/quillspark/{name}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    _gone_at_exit(spark, path)
    return spark.table(name)


def partitions(spark: SparkSession, least: int = 48) -> int:
    """Number of parts for work that is dealt by hash; follows spark.sql.shuffle.partitions, which grows with the input."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def release() -> None:
    """Give memory that a Python worker no longer uses back to the machine: workers outlive their tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """A function over Arrow batches that releases memory when its task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def whole_row(docs: DataFrame, name: str = "row"):
    """All columns of ``docs`` as one struct, so that no name of theirs can meet one used inside."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias(name)


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underlines before it until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def unpacked(columns: list[str], row: str = "row") -> list:
    """Columns of such a struct under their own names."""
    return [F.col(row).getField(c).alias(c) for c in columns]


def join_hot(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """left joined with right, which has a row for each key.  The keys in ``hot`` (one column named as ``key``; the caller sees to it that
    they are few) are joined by broadcast, so that a key with a third of all rows is no single task; all others by shuffle."""
    hot = F.broadcast(hot)
    return left.join(F.broadcast(right.join(hot, key, "left_semi")), key).unionByName(left.join(hot, key, "left_anti").join(right, key))


#: A key is hot if it holds more than one in so many rows: there can be no more hot keys than that.
HOT = 1000


def crc_mod(column, n: int):
    """crc32 of the id written as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def ascii_lower(text: str | None) -> str:
    """Lower-case A-Z only; null becomes the empty text."""
    return text.encode().lower().decode() if text else ""
