"""Segmentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators.redact import Policy, redact
from ...operators.resolve import resolve
from ...operators.scan import scan
from ...operators.segment import explode_segments, merge_segments_long, register_segmenter, segment, segment_rows, segment_with
from ...plans.text import analyze, process
from . import sqltext as q
from .detection import RAW, strict
from .inputs import documents
from .registry import query

FIELDS = ["doc_id", "seg_no", "segment_id", "start", "end", "text"]
SPACE = "[\\p{Z}\\t\\n\\v\\f\\r\\x{1c}-\\x{1f}\\x{85}]"


def finished(name: str, source: str, low: int = 1, high: int | None = None) -> str:
    """CTE ``name``: blank segments out, white space stripped, numbered again.

    ``source`` has doc_id, part (order), start, text.
    """
    return f"""
{name}_bare AS (
  SELECT doc_id, part, "start" + length(text) - length(regexp_replace(text, '^{SPACE}+', '')) AS "start",
    regexp_replace(regexp_replace(text, '^{SPACE}+', ''), '{SPACE}+$', '') AS text
  FROM {source} WHERE regexp_matches(text, '[^ \\t\\n\\v\\f\\r]')
),
{name}_numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS n FROM {name}_bare
  WHERE length(text) {f'BETWEEN {low} AND {high}' if high else f'>= {low}'}
),
{name} AS (
  SELECT doc_id, CAST(n AS INTEGER) AS seg_no, printf('seg_%04d', n) AS segment_id,
    CAST("start" AS INTEGER) AS "start", CAST("start" + length(text) AS INTEGER) AS "end", text
  FROM {name}_numbered
)"""


SELECT = 'SELECT doc_id, seg_no, segment_id, "start", "end", text FROM s'


def _cut(spark: SparkSession, sf_dir: str, strategy: str, **options) -> DataFrame:
    return explode_segments(segment(documents(spark, sf_dir), strategy, **options), "doc_id").select(
        *FIELDS
    )


SENTENCES_SQL = """
pieces AS (SELECT doc_id, regexp_extract_all(text, '[^。！？.!?]*[。！？.!?]|[^。！？.!?]+') AS ps
  FROM documents),
sentences AS (SELECT doc_id, UNNEST(range(1, len(ps) + 1)) AS part, ps FROM pieces),
placed AS (SELECT doc_id, part, ps[part] AS text,
  coalesce(list_sum([length(p) for p in ps[1:part-1]]), 0) AS "start" FROM sentences)"""


@query("seg_sentence", q.with_query([SENTENCES_SQL, finished("s", "placed")], SELECT))
def seg_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir, "sentence")


@query("seg_sentence_length", q.with_query(
    [SENTENCES_SQL, "kept AS (SELECT * FROM placed WHERE length(text) BETWEEN 5 AND 1000)",
     finished("s", "kept")], SELECT))
def seg_sentence_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir, "sentence", min_length=5, max_length=1000)


def _parts_sql(name: str, pattern: str, rank: int = 0) -> str:
    return f"""
{name}_cut AS (SELECT doc_id, string_split_regex(text, {q.quoted(pattern)}) AS ps,
  regexp_extract_all(text, {q.quoted(pattern)}) AS ms FROM documents),
{name}_each AS (SELECT doc_id, UNNEST(range(1, len(ps) + 1)) AS part, ps, ms FROM {name}_cut),
{name} AS (SELECT doc_id, {rank} * 10000000 + part AS part, ps[part] AS text,
  coalesce(list_sum([length(p) for p in ps[1:part-1]]), 0)
  + coalesce(list_sum([length(m) for m in ms[1:part-1]]), 0) AS "start" FROM {name}_each)"""


@query("seg_paragraph", q.with_query(
    [_parts_sql("lines", "\n|\r\n"), finished("s", "lines")], SELECT))
def seg_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as paragraphs: the texts have no blank lines."""
    return _cut(spark, sf_dir, "paragraph", separators=["\n", "\r\n"])


@query("seg_fixed", q.with_query(
    ["""steps AS (SELECT doc_id, text,
       UNNEST(range(0, greatest(length(text) - 51, 0) + 1, 450)) AS "start" FROM documents)""",
     'cut AS (SELECT doc_id, "start" AS part, "start", substring(text, "start" + 1, 500) AS text FROM steps)',
     finished("s", "cut")], SELECT))
def seg_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir, "fixed_length", respect_word_boundaries=False)


WORD_WINDOWS_SQL = """
walk AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS "start", text, length(text) AS n FROM documents
  WHERE regexp_matches(text, '\\S')
  UNION ALL
  SELECT doc_id, CASE WHEN room > 50 THEN "start" + room - 50 ELSE "start" + 450 END, text, n
  FROM (SELECT *, length(regexp_extract(substring(text, "start" + 1, 500), '(?s)^(.*)[\\p{Z}\\t\\n\\v\\f\\r]', 1)) AS room
    FROM walk WHERE "start" + 500 < n)
),
sized AS (SELECT *,
  length(regexp_extract(substring(text, "start" + 1, 500), '(?s)^(.*)[\\p{Z}\\t\\n\\v\\f\\r]', 1)) AS room FROM walk),
cut AS (SELECT doc_id, "start" AS part, "start", substring(text, "start" + 1,
  CASE WHEN "start" + 500 >= n THEN n - "start" WHEN room > 50 THEN room ELSE 500 END) AS text FROM sized)"""


@query("seg_fixed_words", q.with_query(
    [WORD_WINDOWS_SQL, finished("s", "cut")], SELECT, recursive=True))
def seg_fixed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir, "fixed_length")


PATTERNS: Sequence[str] = [r"\.\n", "[,;] "]


@query("seg_pattern", q.with_query(
    [_parts_sql("p0", PATTERNS[0], 0), _parts_sql("p1", PATTERNS[1], 1),
     "parts AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1)", finished("s", "parts")], SELECT))
def seg_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir, "custom", patterns=PATTERNS)


@query("seg_whole", q.with_query(
    ['whole AS (SELECT doc_id, 0 AS part, 0 AS "start", text FROM documents)',
     finished("s", "whole")], SELECT))
def seg_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir, "whole")


FUNCTION_SQL = q.with_query(
    ["""parts AS (SELECT doc_id, text, UNNEST(range(0, (length(text) + 99) // 100)) AS part FROM documents
      WHERE regexp_matches(text, '[^ \\t\\n\\v\\f\\r]'))"""],
    """SELECT doc_id, CAST(part AS INTEGER) AS seg_no, printf('seg_%04d', part) AS segment_id,
      CAST(part * 100 AS INTEGER) AS "start", CAST(least(part * 100 + 100, length(text)) AS INTEGER) AS "end",
      substring(text, part * 100 + 1, 100) AS text, CAST(NULL AS VARCHAR) AS error FROM parts""")


def hundreds(text: str) -> list[tuple[int, int, str]]:
    return [(i, min(i + 100, len(text)), text[i : i + 100]) for i in range(0, len(text), 100)]


@query("seg_function", FUNCTION_SQL)
def seg_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments by a caller's function: a hundred characters each."""
    return segment_with(documents(spark, sf_dir), hundreds)


@query("seg_function_sql", FUNCTION_SQL)
def seg_function_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same function as a table function of SQL."""
    register_segmenter(spark, "hundreds", hundreds)
    return spark.sql(
        "SELECT d.doc_id, s.seg_no, s.segment_id, s.start, s.end, s.text, s.error FROM {docs} AS d, LATERAL hundreds(d.text) AS s",
        docs=documents(spark, sf_dir),
    )


BLANKS = "\u3000 \n\t"


@query("blank_texts", f"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR NOT regexp_matches(text, '[^\\p{{Z}}\\t\\n\\v\\f\\r]') THEN 0 ELSE 1 END
  AS total_segments FROM documents""")
def blank_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third text is white space of several scripts: it has no segment and comes out as it is."""
    df = documents(spark, sf_dir).withColumn(
        "text", F.when(F.col("doc_id") % 3 == 0, F.lit(BLANKS)).otherwise(F.col("text"))
    )
    done = process(df, [], rules=strict("EMAIL_ADDRESS"))
    same = (F.col("doc_id") % 3 != 0) | (F.col("redacted_text") == BLANKS)
    return done.filter(same).select("doc_id", F.col("total_segments").cast("int").alias("total_segments"))


# Spans are looked for in one sentence at a time, then moved to the whole text.
SEGMENTED_SQL = [
    SENTENCES_SQL,
    """seg_texts AS (SELECT doc_id * 1000000 + part AS doc_id, text FROM placed
      WHERE regexp_matches(text, '\\S'))""",
    q.hits("h", "seg_texts", RAW),
    q.checked("c", "h"),
    """moved AS (SELECT c.* REPLACE (p.doc_id AS doc_id, d.text AS text,
        CAST(c."start" + p."start" AS INTEGER) AS "start", CAST(c."end" + p."start" AS INTEGER) AS "end")
      FROM c JOIN placed p ON p.doc_id = c.doc_id // 1000000 AND p.part = c.doc_id % 1000000
      JOIN documents d ON d.doc_id = p.doc_id)""",
    q.deduped("d", "moved"),
    q.covered("v", "d"),
]


@query("redact_segmented", q.with_query(
    [*SEGMENTED_SQL, q.masked("m", "v", "documents", "'[REDACTED]'")],
    "SELECT doc_id, n_entities, redacted_text FROM m"))
def redact_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analyze(documents(spark, sf_dir), strict(), threshold=None, segment_by="sentence")
    masked = redact(found, [Policy()])
    return masked.select("doc_id", F.size("spans").cast("long").alias("n_entities"), "redacted_text")


@query("merge_segments_long", q.with_query(
    [*SEGMENTED_SQL, q.masked("m", "v", "documents", "'[REDACTED]'")],
    """SELECT CASE WHEN doc_id % 5 > 0 THEN doc_id // 3 END AS doc_id, redacted_text,
      CAST(NULL AS VARCHAR) AS error FROM m"""))
def merge_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences masked as rows of their own, then put together; keys are null or stand for several texts."""
    key = F.when(F.col("doc_id") % 5 > 0, F.expr("doc_id div 3"))
    cut = segment(documents(spark, sf_dir).withColumn("doc_id", key), "sentence")
    rows = resolve(scan(segment_rows(cut, "doc_id"), strict()), "cover")
    masked = redact(rows, [Policy()]).select("text_no", "doc_id", "seg_no", "n_rows", "lead", "redacted_text")
    return merge_segments_long(masked, "doc_id").drop("text_no")
