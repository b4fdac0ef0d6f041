"""Inputs of the queries: the given tables and what is derived from them.

Every derived table is written twice, as DataFrame and as SQL.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.checks import id_check_code
from ...operators.reference_values import ID_CHECK_CODES, ID_WEIGHTS
from ...operators.rules import Rule
from ...sources.readers import read_documents, read_table, spread

AS_OF = dt.date(1999, 1, 1)
WORD = "[^ \\n]+"


def partitions(spark: SparkSession) -> int | None:
    """What the session asks for in ``spark.veilspan.partitions``: for small tables on many cores."""
    asked = spark.conf.get("spark.veilspan.partitions", None)
    return int(asked) if asked else None


def documents(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    df = read_documents(spark, f"{sf_dir}/documents.parquet", extra=extra)
    return spread(df, partitions(spark), "doc_id")


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/pages.parquet", "page_id", "url").select(
        F.col("page_id").alias("doc_id"), F.col("url").alias("text")
    )


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence with phone, identity numbers and plate for every order."""
    orders = read_table(
        spark, f"{sf_dir}/orders.parquet", "o_orderkey", "o_custkey", "o_orderdate"
    )
    customers = read_table(spark, f"{sf_dir}/customer.parquet", "c_custkey", "c_name")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    first17 = F.concat(F.lit("110101"), day, _padded(key % 1000, 3))
    # Every fifth check character is wrong.
    code = F.when(key % 5 == 0, F.translate(id_check_code(first17), "0123456789X", "123456789X0"))
    code = code.otherwise(id_check_code(first17))
    text = F.concat(
        F.lit("customer "), F.col("c_name"),
        F.lit(" tel 1"), (cust % 7 + 3).cast("string"), _padded(key, 9),
        F.lit(" id "), first17, code,
        F.lit(" old "), F.when(key % 3 == 0, F.lit("990101")).otherwise(F.lit("320101")),
        F.substring(day, 3, 6), _padded(cust % 1000, 3),
        F.lit(" plate 京"), F.when(key % 4 == 0, F.lit("7")).otherwise(F.lit("A")),
        _padded(key % 100000, 5), F.lit(" end"),
    )
    joined = spread(orders.join(customers, orders.o_custkey == customers.c_custkey), partitions(spark), "o_orderkey")
    return joined.select(key.alias("doc_id"), text.alias("text"))


_FIRST17 = "'110101' || strftime(o_orderdate, '%Y%m%d') || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0')"
_WEIGHED = " + ".join(
    f"CAST(substring(f17, {i}, 1) AS INTEGER) * {w}" for i, w in enumerate(ID_WEIGHTS, start=1)
)

PEOPLE_SQL = f"""
people_keys AS (
  SELECT o_orderkey, o_custkey, o_orderdate, c_name, {_FIRST17} AS f17
  FROM orders JOIN customer ON o_custkey = c_custkey
),
people_code AS (
  SELECT *, substring('{ID_CHECK_CODES}', ({_WEIGHED}) % 11 + 1, 1) AS code FROM people_keys
),
people AS (
  SELECT o_orderkey AS doc_id,
    'customer ' || c_name || ' tel 1' || CAST(o_custkey % 7 + 3 AS VARCHAR)
    || lpad(CAST(o_orderkey AS VARCHAR), 9, '0')
    || ' id ' || f17
    || CASE WHEN o_orderkey % 5 = 0 THEN translate(code, '0123456789X', '123456789X0') ELSE code END
    || ' old ' || CASE WHEN o_orderkey % 3 = 0 THEN '990101' ELSE '320101' END
    || substring(strftime(o_orderdate, '%Y%m%d'), 3, 6)
    || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0')
    || ' plate 京' || CASE WHEN o_orderkey % 4 = 0 THEN '7' ELSE 'A' END
    || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') || ' end' AS text
  FROM people_code
)"""


# --- speech: every turn of a conversation is a segment with timed words ------------

TURN_SECONDS = 40.0
WORD_SECONDS = 0.4
SPOKEN_SECONDS = 0.3


def turn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per turn, with ``segments`` holding the turn as its one segment."""
    turns = read_table(
        spark, f"{sf_dir}/conversations.parquet", "conv_id", "turn", "role", "text"
    )
    offset = F.col("turn") * F.lit(TURN_SECONDS)
    words = F.transform(
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)),
        lambda w, i: F.struct(
            w.alias("word"),
            (offset + i * F.lit(WORD_SECONDS)).alias("start"),
            (offset + i * F.lit(WORD_SECONDS) + F.lit(SPOKEN_SECONDS)).alias("end"),
            ((F.length(w) % 10) / F.lit(10.0)).alias("score"),
        ),
    )
    timed = spread(turns, partitions(spark), "conv_id", "turn").withColumn("words", words)
    last = F.try_element_at("words", F.lit(-1)).getField("end")
    segment = F.struct(
        offset.alias("start"), last.alias("end"), F.col("text"), F.col("words")
    )
    return timed.filter(F.col("text").rlike("[^ \\n]")).select(
        "conv_id", "turn", "role", "text", F.array(segment).alias("segments")
    )


def speaker_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with speaker and times; needs no words, only their number."""
    turns = read_table(
        spark, f"{sf_dir}/conversations.parquet", "conv_id", "turn", "role", "text"
    )
    n = F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    offset = F.col("turn") * F.lit(TURN_SECONDS)
    return turns.filter(F.col("text").rlike("[^ \\n]")).select(
        "conv_id",
        "turn",
        F.col("role").alias("speaker_id"),
        offset.alias("start_time"),
        (offset + (n - 1) * F.lit(WORD_SECONDS) + F.lit(SPOKEN_SECONDS)).alias("end_time"),
        F.length("text").alias("n_chars"),
    )


def _double(number: float) -> str:
    return f"CAST({number} AS DOUBLE)"


SPEECH_SQL = f"""
turns AS (
  SELECT conv_id, turn, role, text, regexp_extract_all(text, '[^ \\n]+') AS vals,
    string_split_regex(text, '[^ \\n]+') AS gaps, turn * {_double(TURN_SECONDS)} AS t_turn
  FROM conversations WHERE regexp_matches(text, '[^ \\n]')
),
words0 AS (
  SELECT conv_id, turn, role, t_turn, UNNEST(range(1, len(vals) + 1)) AS i, vals, gaps FROM turns
),
words AS (
  SELECT conv_id, turn, role, CAST(i - 1 AS INTEGER) AS word_no, vals[i] AS word,
    CAST(list_sum([length(g) for g in gaps[1:i]])
      + coalesce(list_sum([length(v) for v in vals[1:i-1]]), 0) AS INTEGER) AS c0,
    t_turn + (i - 1) * {_double(WORD_SECONDS)} AS t0,
    t_turn + (i - 1) * {_double(WORD_SECONDS)} + {_double(SPOKEN_SECONDS)} AS t1
  FROM words0
),
speaker_turns AS (
  SELECT conv_id, turn, role AS speaker_id, t_turn AS start_time,
    t_turn + (len(vals) - 1) * {_double(WORD_SECONDS)} + {_double(SPOKEN_SECONDS)} AS end_time,
    length(text) AS n_chars
  FROM turns
)"""

# Conversations hold no personal data: capitals stand in for it. The first rule
# starts on the space between words, the second inside words.
SPEECH_RULES = [
    Rule("NAME", "spaced_capital", " [A-Z][a-z]+", 0.6),
    Rule("SOUND", "th_sound", "th[a-z]", 0.5),
]
