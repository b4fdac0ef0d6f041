"""Results of steps that later steps read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, which the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine gets a temporary folder; on a cluster, where no
    folder of one machine will do, it is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named:
            if not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="veilspan-")
        context.setCheckpointDir(named)
    return named or context.getCheckpointDir()


def computed(df: DataFrame) -> DataFrame:
    """``df`` worked out once and read again from the shared folder; survives lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that was never used before."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
