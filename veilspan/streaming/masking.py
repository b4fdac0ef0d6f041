"""Mask a stream of texts. The plan is row by row, so there is no state to keep."""

from __future__ import annotations

import posixpath
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.redact import Policy
from ..plans.text import process

DOCUMENT_SCHEMA = "doc_id long, text string"


def document_stream(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: str = DOCUMENT_SCHEMA,
    files_per_batch: int | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def mask_stream(documents: DataFrame, policy: Iterable[Policy] = (), **options) -> DataFrame:
    return process(documents, policy, **options).select(
        "doc_id", "redacted_text", "total_entities", "error"
    )


def start_masking(
    masked: DataFrame, output: str, name: str, checkpoint: str | None = None, fmt: str = "parquet",
    available_now: bool = True,
) -> StreamingQuery:
    """Write a masked stream to files.

    The checkpoint goes to ``checkpoint`` or, without one, to a folder called
    ``name`` in the shared folder that the session names in ``spark.checkpoint.dir``.
    """
    if checkpoint is None:
        shared = masked.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared:
            raise ValueError("no checkpoint given and spark.checkpoint.dir is not set")
        checkpoint = posixpath.join(shared, name)
    writer = (
        masked.writeStream.queryName(name)
        .outputMode("append")
        .format(fmt)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(output)
