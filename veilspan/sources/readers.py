"""Tables in: texts, transcripts, speaker turns, responses, word boxes, lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reference_values import BANK_BY_BIN, ID_AREA_PREFIXES

TRANSCRIPT_SCHEMA = (
    "segments array<struct<start:double,end:double,text:string,"
    "words:array<struct<word:string,start:double,end:double,score:double>>>>, "
    "language string"
)
RESPONSE_SCHEMA = "doc_id long, raw_response string"
OCR_SCHEMA = (
    "image_id long, words array<struct<word_no:int,text:string,left:int,top:int,"
    "width:int,height:int,conf:double>>"
)
TURN_FIELDS = 9


def spread(df: DataFrame, partitions: int | None, *keys: str) -> DataFrame:
    """``df`` dealt out to so many partitions by a hash of its keys; as it is if none are asked for.

    Pattern scans are bound by CPU, and a file with one row group is one task: small inputs on
    many cores gain from it. It is the caller's choice, as it shuffles the texts.
    """
    return df.repartition(partitions, *keys) if partitions else df


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


CORRUPT = "_corrupt_record"


def _raw_documents(spark: SparkSession, path: str, fmt: str, key: str, text: str) -> DataFrame:
    """Records of a text format with what could not be read in ``error``."""
    schema = f"`{key}` long, `{text}` string, {CORRUPT} string"
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    df = reader.json(path) if fmt == "json" else reader.option("header", True).csv(path)
    error = F.when(F.col(CORRUPT).isNotNull(), "unreadable record").when(F.col(key).isNull(), "record without key")
    return df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), CORRUPT, error.alias("error"))


def read_documents(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    key: str = "doc_id",
    text: str = "text",
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Texts as ``doc_id``, ``text``.

    Plain text files give one row per line. Lines have no key of their own: ``doc_id`` numbers
    them, and is unique and the same again for as long as the files and the split size are;
    ``file`` names the source. Unreadable JSON and CSV records are left out here and come out
    of ``read_document_errors``.
    """
    if fmt == "text":
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
        return lines.select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"), "file")
    if fmt in ("json", "csv"):
        df = _raw_documents(spark, path, fmt, key, text)
        return df.filter(F.col("error").isNull()).select("doc_id", "text")
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "orc":
        df = spark.read.orc(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), *extra)


def read_document_errors(
    spark: SparkSession, path: str, fmt: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """What ``read_documents`` leaves out of JSON and CSV: ``doc_id``, ``text``, ``record`` and ``error``."""
    df = _raw_documents(spark, path, fmt, key, text)
    return df.filter(F.col("error").isNotNull()).select("doc_id", "text", F.col(CORRUPT).alias("record"), "error")


def _raw_transcripts(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.schema(f"{TRANSCRIPT_SCHEMA}, {CORRUPT} string").option("multiLine", True)
    df = reader.option("columnNameOfCorruptRecord", CORRUPT).json(path)
    error = F.when(F.col(CORRUPT).isNotNull(), "unreadable transcript").when(
        F.col("segments").isNull(), "transcript without segments"
    )
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return df.select("segments", "language", CORRUPT, name.alias("audio_id"), error.alias("error"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Aligned transcripts, one JSON file per recording, named after the file.

    Files that cannot be read come out of ``read_transcript_errors``.
    """
    return _raw_transcripts(spark, path).filter(F.col("error").isNull()).select("segments", "language", "audio_id")


def read_transcript_errors(spark: SparkSession, path: str) -> DataFrame:
    """Recordings whose transcript cannot be used: ``audio_id``, ``record`` and ``error``."""
    df = _raw_transcripts(spark, path).filter(F.col("error").isNotNull())
    return df.select("audio_id", F.col(CORRUPT).alias("record"), "error")


def _raw_turns(spark: SparkSession, path: str) -> DataFrame:
    cells = F.split(F.trim("value"), r"\s+")
    start, length = (F.get("c", F.lit(i)).try_cast("double") for i in (3, 4))
    lines = spark.read.text(path).select("value", cells.alias("c")).filter(F.col("c")[0] == "SPEAKER")
    short = F.size("c") < TURN_FIELDS
    return lines.select(
        F.get("c", F.lit(1)).alias("audio_id"),
        F.get("c", F.lit(7)).alias("speaker_id"),
        F.when(~short, start).alias("start_time"),
        F.when(~short, start + length).alias("end_time"),
        "value",
    )


def read_speaker_turns(spark: SparkSession, path: str) -> DataFrame:
    """Speaker turns from RTTM text; lines of other kinds are left out.

    Turns whose times cannot be read come out of ``read_turn_errors``.
    """
    return _raw_turns(spark, path).filter("end_time IS NOT NULL").drop("value")


def read_turn_errors(spark: SparkSession, path: str) -> DataFrame:
    """Turns that ``read_speaker_turns`` leaves out: ``audio_id``, ``record`` and ``error``."""
    bad = _raw_turns(spark, path).filter("end_time IS NULL")
    return bad.select("audio_id", F.col("value").alias("record"), F.lit("turn without readable times").alias("error"))


def _raw_records(spark: SparkSession, path: str, fmt: str, schema: str, key: str, what: str) -> DataFrame:
    """Records of a nested table, with what could not be read in ``error``."""
    if fmt == "json":
        reader = spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE")
        df = reader.option("columnNameOfCorruptRecord", CORRUPT).json(path)
    else:
        df = spark.read.format(fmt).load(path).withColumn(CORRUPT, F.lit(None).cast("string"))
    error = (
        F.when(F.col(CORRUPT).isNotNull(), "unreadable record")
        .when(F.col(key).isNull(), "record without key")
        .when(F.col(what).isNull(), f"record without {what}")
    )
    return df.withColumn("error", error)


def _bad_records(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col("error").isNotNull()).select(key, F.col(CORRUPT).alias("record"), "error")


def read_responses(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Model responses: doc_id, raw_response. What cannot be used comes out of ``read_response_errors``."""
    df = _raw_records(spark, path, fmt, RESPONSE_SCHEMA, "doc_id", "raw_response")
    return df.filter(F.col("error").isNull()).select("doc_id", "raw_response")


def read_response_errors(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Responses that cannot be read, or have no key or no text: doc_id, ``record`` (as it stands) and ``error``."""
    return _bad_records(_raw_records(spark, path, fmt, RESPONSE_SCHEMA, "doc_id", "raw_response"), "doc_id")


def _raw_ocr(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    df = _raw_records(spark, path, fmt, OCR_SCHEMA, "image_id", "words")
    box = lambda w: (
        w.isNull() | w["text"].isNull() | w["left"].isNull() | w["top"].isNull() | w["width"].isNull() | w["height"].isNull()
    )
    short = F.coalesce(F.exists("words", box), F.lit(False))
    return df.withColumn("error", F.coalesce("error", F.when(short, "word without text or box")))


def read_ocr_words(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Word boxes of pages: image_id, words. What cannot be used comes out of ``read_ocr_errors``."""
    return _raw_ocr(spark, path, fmt).filter(F.col("error").isNull()).select("image_id", "words")


def read_ocr_errors(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Pages that cannot be read, have no key or words, or a word without text or box: image_id, ``record``, ``error``."""
    return _bad_records(_raw_ocr(spark, path, fmt), "image_id")


def area_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ID_AREA_PREFIXES.items()), "prefix string, province string")


def bin_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BANK_BY_BIN.items()), "bin string, bank string")
