"""Tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame, key: str = "doc_id", name: str = "result") -> DataFrame:
    """One JSON string per row, all columns in it."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias(name))


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    df.write.mode(mode).format(fmt).save(path)


def write_by_status(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Good rows under ``status=ok``, rows with an ``error`` under ``status=error``.

    One pass. Columns that may hold unmasked values are emptied in error rows.
    """
    failed = F.col("error").isNotNull()
    hidden = [c for c in ("text", "redacted_text", "edits", "items", "spans") if c in df.columns]
    for name in hidden:
        df = df.withColumn(name, F.when(~failed, F.col(name)))
    status = F.when(failed, F.lit("error")).otherwise(F.lit("ok"))
    df.withColumn("status", status).write.mode(mode).format(fmt).partitionBy("status").save(path)
