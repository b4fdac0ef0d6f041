"""One query per operator, each over its whole table, and SQL where that can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import let
from . import (
    containment,
    fuzzy_lines,
    hard_negatives,
    html_layout,
    license_rules,
    periodic_runs,
    piece_codec,
    quality_knn,
    repetition,
    simhash_dedup,
    token_cache,
    url_filter,
    vector_files,
)
from .common import WORD_GAP, shared_path

Query = Callable[[SparkSession, str], DataFrame]

PIECE_MODEL = "piece_bpe_32k.model"
#: Host and path prefix, verdict: fixed values of the query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_components(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cache = shared_path(spark, "token-counts")
    return token_cache.token_counts(spark, docs, public_tokenizers.path(PIECE_MODEL), cache)


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.deduplicated_lines(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.licences(table(spark, sf_dir, "documents"))


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


def op8_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.html_text(table(spark, sf_dir, "pages"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(spark, table(spark, sf_dir, "pages"), URL_RULES)


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the last words of every tenth text, by key digest, made periodic."""
    digest = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1))
    g = F.floor(digest / 10)

    def periodic(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        word = lambda i: F.element_at(words, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int"))
        return F.array_join(F.transform(words, lambda _, i: word(i)), " ")

    words = F.filter(F.split("text", WORD_GAP), lambda w: w != "")
    return docs.select("doc_id", F.when(digest % 10 == 0, let(words, periodic)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    order = F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"]))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("top", F.array_max(order)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.col2")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.col3")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.col3")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved), "vec_id % 100 = 0")


def op13_vector_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_files.exact_top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


#: Components as whole numbers; a DuckDB double compares a NaN as greater than infinity.
WHOLE_SQL = """
WITH whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
)"""

OP12_SQL = (
    WHOLE_SQL
    + """, rows_ AS (
  SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM whole WHERE label IS NOT NULL
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows_ a, rows_ b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM positives JOIN scores USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 10"""
)

OP13_SQL = (
    WHOLE_SQL
    + """, scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q, whole c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id, score
FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""
)

OP10_SQL = r"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), rules(h, p, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), hits AS (
  SELECT page_id, host, path, h || p AS rule, v
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
), best AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v
  FROM hits GROUP BY ALL
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict
FROM parts LEFT JOIN best USING (page_id, host, path)
"""

# Exact containment of distinct shingles; items of fewer words than a shingle do not occur in the table.
OP8_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), item_words AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM benchmark
), item_shingles AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM item_words)
), doc_shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM doc_words)
), sizes AS (SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id),
shared AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM item_shingles JOIN doc_shingles USING (s) GROUP BY ALL
)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
FROM shared JOIN sizes USING (item_id) WHERE 10 * n_shared >= 8 * n_shingles
"""



def _op7_sql() -> str:
    """Windows of every length as joined words, counted; the words inside repeated ones marked."""
    widths = (3, *repetition.GRAM_LIMITS)
    ctes = [
        r"""split AS (SELECT doc_id, coalesce(text, '') AS text,
  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)""",
        "words AS (SELECT doc_id, i, length(w[i]) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM split))",
        r"""lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k,
  length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS n
  FROM (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM split)))
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]'))""",
        "same_lines AS (SELECT doc_id, count(*) AS n_dup_lines, sum(n) AS dup_line_chars FROM lines WHERE k > 1 GROUP BY doc_id)",
        "sizes AS (SELECT doc_id, count(*) AS n_words, sum(n) AS word_chars FROM words GROUP BY doc_id)",
    ]
    for width in widths:
        ctes += [
            f"""g{width} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM (
  SELECT doc_id, i, array_to_string(w[i:i + {width - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {width - 2})) AS i FROM split)))""",
            f"""c{width} AS (SELECT doc_id, count(*) AS k, sum(n) AS n FROM words JOIN (
  SELECT DISTINCT doc_id, unnest(range(i, i + {width})) AS i FROM g{width} WHERE k > 1) USING (doc_id, i) GROUP BY doc_id)""",
        ]
    grams = ", ".join(f"coalesce(c{n}.n, 0) AS dup{n}_chars" for n in repetition.GRAM_LIMITS)
    joins = " ".join(f"LEFT JOIN c{n} ON c{n}.doc_id = s.doc_id" for n in widths)
    ctes.append(
        f"""figures AS (SELECT s.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
  length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(c3.k, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, {grams}
  FROM split s LEFT JOIN sizes ON sizes.doc_id = s.doc_id LEFT JOIN same_lines l ON l.doc_id = s.doc_id {joins})"""
    )
    whole = [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars",
        *(f"dup{n}_chars" for n in repetition.GRAM_LIMITS),
    ]
    failed = f"(n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.REPEAT_LIMIT} * n_words)"
    limits = {"dup_line_chars": repetition.LINE_LIMIT} | {f"dup{n}_chars": x for n, x in repetition.GRAM_LIMITS.items()}
    good = " AND ".join(f"100 * {c} <= {x} * word_chars" for c, x in limits.items())
    columns = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in whole)
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, {columns}, {failed} AS base_failed, "
        f"(NOT {failed} AND {good}) AS kept FROM figures"
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_quality,
        op3_token_counts,
        op4_fuzzy_lines,
        op5_licenses,
        op6_piece_codec,
        op7_repetition,
        op8_contamination,
        op9_html_layout,
        op10_url_filter,
        op11_periodic_runs,
        op12_hard_negatives,
        op13_vector_files,
    )
}
ORACLE_SQL = {
    "op5_licenses": license_rules.licences_sql("documents"),
    "op7_repetition": _op7_sql(),
    "op8_contamination": OP8_SQL,
    "op10_url_filter": OP10_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_vector_files": OP13_SQL,
}
