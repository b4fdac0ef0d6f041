"""Token counts with a digest cache.

Texts and the tokenizer are named by digests. Counts known from a stored table are
joined in; only the distinct texts that it lacks are encoded, and their counts are
appended to it for later runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_texts

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
SLICE_CHARS = 1024 * 1024


@lru_cache(maxsize=4)
def _encoder(path: str):
    """Counts the tokens of a list of texts, as the model file's own library does."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]


def tokenizer_digest(path: str) -> str:
    """Names the tokenizer's file content and the version of the library that reads it."""
    import sentencepiece
    import tokenizers

    library = tokenizers if path.endswith(".json") else sentencepiece
    seen = hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode())
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            seen.update(block)
    return seen.hexdigest()


def read_cache(spark: SparkSession, cache: str, name: str) -> DataFrame:
    """Counts stored for a tokenizer, one row per digest; empty where the table is not yet there.

    Appends by two runs at once leave equal rows for a digest, which meet here.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    exists = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache) if exists else spark.createDataFrame([], CACHE_SCHEMA)
    return stored.filter(F.col("tokenizer") == name).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(
    spark: SparkSession,
    docs: DataFrame,
    model_path: str,
    cache: str,
    limit: int = 4096,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``key``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every text.

    ``cache`` is a table path that the cluster shares; it is made if absent. A null text
    counts as empty, with no tokens. Repeated keys give a row each and equal texts are
    encoded once; an empty table gives an empty one and leaves the cache as it is; other
    columns are not read.

    Texts are grouped by their SHA-256, with one of them kept per task before the shuffle,
    so that a text with very many copies moves once per task. The copies' rows carry the
    digest only.
    """
    name = tokenizer_digest(model_path)
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(body, 256))
    rows = docs.select(
        F.col(key).alias("key"), digest.alias("digest"), F.octet_length(body).cast("long").alias("n_bytes")
    )
    distinct = docs.select(digest.alias("digest"), body.alias("body")).groupBy("digest").agg(F.first("body").alias("body"))
    stored = read_cache(spark, cache, name)
    misses = distinct.join(stored, "digest", "left_anti")

    def work(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        count = _encoder(model_path)
        for digests, raws in batches:
            counts: list[int] = []
            part, size = [], 0
            for raw in raws:
                part.append(raw.decode("utf-8", "replace"))
                size += len(raw)
                if size > SLICE_CHARS:
                    counts += count(part)
                    part, size = [], 0
            yield [digests, counts + count(part)]

    encoded = cut(map_texts(misses, ["digest", "body"], work, "digest binary, n_tokens long"))
    encoded.select(F.lit(name).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    # a plain join of two tables, so that a digest with very many rows can be split at run time
    counts = encoded.unionByName(stored)
    return rows.join(counts, "digest").select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
