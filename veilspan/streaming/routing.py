"""A masked stream into two tables, one for good rows and one for errors, each row once."""

from __future__ import annotations

import posixpath

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch_id"


def route_batch(batch: DataFrame, batch_id: int, good: str, bad: str, fmt: str = "parquet") -> None:
    """Write one batch: rows without an error below ``good``, the others, less their text, below ``bad``.

    Each batch has a folder of its own in both, which is replaced as a whole: a batch that is
    written again, after a stop at any point, leaves what a single run leaves.
    """
    rows = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        hidden = [c for c in ("text", "redacted_text", "edits", "items", "spans") if c in rows.columns]
        folder = f"{BATCH}={batch_id}"
        failed = F.col("error").isNotNull()
        rows.filter(~failed).drop("error").write.mode("overwrite").format(fmt).save(posixpath.join(good, folder))
        rows.filter(failed).drop(*hidden).write.mode("overwrite").format(fmt).save(posixpath.join(bad, folder))
    finally:
        rows.unpersist()


def start_routing(
    masked: DataFrame,
    good: str,
    bad: str,
    name: str,
    checkpoint: str | None = None,
    fmt: str = "parquet",
    available_now: bool = True,
) -> StreamingQuery:
    """Write a masked stream to two tables, each row exactly once; read them with ``spark.read.load``.

    The batch is its folder's name, and a column ``batch_id`` of either table. The checkpoint goes to
    ``checkpoint`` or to a folder called ``name`` in the session's ``spark.checkpoint.dir``.
    """
    if checkpoint is None:
        shared = masked.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared:
            raise ValueError("no checkpoint given and spark.checkpoint.dir is not set")
        checkpoint = posixpath.join(shared, name)
    writer = (
        masked.writeStream.queryName(name)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: route_batch(batch, batch_id, good, bad, fmt))
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
