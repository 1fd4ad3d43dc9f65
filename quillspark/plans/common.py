"""What plans share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.sources.readers import table  # noqa: F401


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as longs, so that results do not depend on how narrow a type a function returns."""
    narrow = (T.IntegerType, T.ShortType, T.ByteType)
    return df.select(*[F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, narrow) else F.col(f.name) for f in df.schema])
