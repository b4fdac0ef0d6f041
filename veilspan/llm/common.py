"""What the operators of this package share: word splitting, shared folders, mapping batches."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.steps import checkpoint_folder

#: Words are runs of anything but these; ``bytes.split()`` cuts at the same six characters.
WORD_GAP = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the cluster names it."""
    return checkpoint_folder(spark)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, never used before."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and checkpoints of steps that nothing refers to any more.

    Its cleaner waits for the driver to collect garbage, which a driver that only plans may
    not do for long while the disks of the executors fill.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read again from the shared folder; survives lost executors."""
    shared_folder(df.sparkSession)
    release(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like ``cut``, as a compressed table that stays in the shared folder."""
    path = shared_path(df.sparkSession, name)
    release(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def removed(table: DataFrame) -> None:
    """Delete a table from ``stored`` that nothing reads any more."""
    jvm = table.sparkSession.sparkContext._jvm
    folders = {file.rsplit("/", 1)[0] for file in table.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def map_texts(
    docs: DataFrame,
    columns: list[str],
    work: Callable[[Iterator[list[list]]], Iterator[list[list]]],
    schema: str,
) -> DataFrame:
    """Run ``work`` over the named columns, a batch at a time.

    ``work`` gets batches as lists of column values (strings as UTF-8 bytes, nulls as
    None) and gives lists (or Arrow arrays) of column values that follow ``schema``. Only the named
    columns reach Python, so that others cannot clash with the results.
    """
    wanted = docs.select(*columns)
    wanted = wanted.select(
        *[
            F.col(f.name).cast("binary").alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in wanted.schema
        ]
    )
    out = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        lists = ([c.to_pylist() for c in b.columns] for b in batches)
        for result in work(lists):
            arrays = [
                v if isinstance(v, pa.Array) else pa.array(v, type=f.type) for v, f in zip(result, arrow, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return wanted.mapInArrow(run, out)


def keep_rows(docs: DataFrame, text: str, wanted: Callable[[Iterator[list]], Iterator[list[bool]]]) -> DataFrame:
    """The rows of ``docs`` whose text ``wanted`` accepts, with all their columns as they are."""
    names = docs.columns
    place = names.index(text)
    inner = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema)])
    renamed = docs.toDF(*inner.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.binary()).to_pylist()
            for verdicts in wanted(iter([texts])):
                yield batch.filter(pa.array(verdicts, type=pa.bool_()))

    return renamed.mapInArrow(run, inner).toDF(*names)
