"""Model responses, prompts and the response cache.

Responses are rendered from spans found in the documents: in four formats, with
places that are off by a few characters or far out of the text, and with some
values in capitals.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators import cache as lru
from ...operators import metrics
from ...operators import prompts as pr
from ...operators import responses as rs
from ...operators.resolve import resolve
from ...operators.rules import Rule
from ...operators.scan import scan
from ...operators.steps import new_path
from ...sources.readers import read_response_errors, read_responses, read_table
from . import sqltext as q
from .detection import GREEDY_SQL, strict
from .inputs import documents
from .registry import query

RULES = [
    *strict("BANK_CARD", "EMAIL_ADDRESS"),
    Rule("NAME", "capital_word", "[A-Z][a-z]{6,}", 0.6),
]
FAR = 5_000_000
FORMATS = ["json", "relaxed_json", "lines", "table"]


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the entities their responses report."""
    found = resolve(scan(documents(spark, sf_dir), RULES), "cover")
    key = F.col("doc_id")
    shift = F.when(key % 11 == 3, F.lit(FAR)).otherwise((key % 7).cast("int"))
    reported = F.transform(
        "spans",
        lambda s: F.struct(
            F.lower(s.getField("entity_type")).alias("entity_type"),
            F.when(key % 13 == 5, F.upper(s.getField("value")))
            .otherwise(s.getField("value"))
            .alias("value"),
            (s.getField("start") + shift).alias("start"),
            (s.getField("end") + shift).alias("end"),
        ),
    )
    return found.select("doc_id", "text", reported.alias("reported"))


def _render(kind: str) -> Column:
    def each(line, glue: str) -> Column:
        return F.array_join(F.transform("reported", line), glue)

    def get(e: Column, name: str) -> Column:
        return e.getField(name).cast("string")

    if kind == "json":
        line = lambda e: F.concat(
            F.lit('{"entity_type": "'), get(e, "entity_type"), F.lit('", "value": "'), get(e, "value"),
            F.lit('", "start": '), get(e, "start"), F.lit(', "end": "'), get(e, "end"),
            F.lit('", "confidence": 0.9}'),
        )
        return F.concat(F.lit("以下是结果\n```json\n["), each(line, ", "), F.lit("]\n```\n"))
    if kind == "relaxed_json":
        line = lambda e: F.concat(
            F.lit("{entity_type: '"), get(e, "entity_type"), F.lit("', value: '"), get(e, "value"),
            F.lit("', start: "), get(e, "start"), F.lit(", end: "), get(e, "end"),
            F.lit(", confidence: 0.9,}"),
        )
        return F.concat(F.lit("["), each(line, ",\n"), F.lit("]"))
    if kind == "lines":
        line = lambda e: F.concat(
            get(e, "entity_type"), F.lit(": "), get(e, "value"), F.lit(" (position: "),
            get(e, "start"), F.lit("-"), get(e, "end"), F.lit(")"),
        )
        return F.concat(F.lit("找到：\n"), each(line, "\n"))
    line = lambda e: F.concat(
        F.lit("| "), get(e, "entity_type"), F.lit(" | "), get(e, "value"), F.lit(" | "),
        get(e, "start"), F.lit(" | "), get(e, "end"), F.lit(" | 0.9 |"),
    )
    return F.concat(F.lit("| type | value | start | end | confidence |\n|---|---|---|---|---|\n"), each(line, "\n"))


def responses(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """All documents' responses in one format, or in four by turns."""
    rendered = _render(kind or FORMATS[-1])
    if kind is None:
        for number, each in enumerate(FORMATS[:-1]):
            rendered = F.when(F.col("doc_id") % 4 == number, _render(each)).otherwise(rendered)
    return _reported(spark, sf_dir).select("doc_id", rendered.alias("raw_response"))


REPORTED_SQL = [
    q.hits("h", "documents", RULES),
    q.checked("c", "h"),
    q.deduped("d", "c"),
    q.covered("v", "d"),
    f"""reported AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY "start") AS place,
      entity_type, CASE WHEN doc_id % 13 = 5 THEN upper(value) ELSE value END AS value,
      CAST("start" + CASE WHEN doc_id % 11 = 3 THEN {FAR} ELSE doc_id % 7 END AS INTEGER) AS "start",
      CAST("end" + CASE WHEN doc_id % 11 = 3 THEN {FAR} ELSE doc_id % 7 END AS INTEGER) AS "end"
    FROM v)""",
]


def _entities(df: DataFrame, column: str, *more: str) -> DataFrame:
    kept = F.filter(F.col(column), lambda e: e.isNotNull())
    return df.select("doc_id", *more, F.inline(kept)).select(
        "doc_id", *more, "entity_type", "value", "start", "end", "confidence"
    )


def _format_query(kind: str, confidence: float) -> None:
    sql = q.with_query(
        REPORTED_SQL,
        'SELECT doc_id, entity_type, value, "start", "end", '
        f"CAST({confidence} AS DOUBLE) AS confidence FROM reported",
    )
    name = {"relaxed_json": "resp_relaxed"}.get(kind, f"resp_{kind}")

    @query(name, sql)
    def read_one(spark: SparkSession, sf_dir: str) -> DataFrame:
        cleaned = rs.clean_response(F.col("raw_response"))
        read = responses(spark, sf_dir, kind).withColumn("read", rs.read_format(cleaned, kind))
        return _entities(read.select("doc_id", F.col("read.found").alias("found")), "found")


for _kind, _confidence in zip(FORMATS, (0.9, 0.9, 0.8, 0.9), strict=True):
    _format_query(_kind, _confidence)

METHOD_SQL = """CASE doc_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'relaxed_json' WHEN 2 THEN 'lines'
  ELSE 'table' END"""


@query("resp_cascade", q.with_query(
    REPORTED_SQL,
    f"""SELECT doc_id, {METHOD_SQL} AS parse_method, entity_type, value, "start", "end",
      CAST(CASE WHEN doc_id % 4 = 2 THEN 0.8 ELSE 0.9 END AS DOUBLE) AS confidence FROM reported"""))
def resp_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(rs.extract(responses(spark, sf_dir)), "entities", "parse_method")


@query("resp_counters", q.with_query(
    [*REPORTED_SQL, "n AS (SELECT doc_id, count(*) AS n FROM reported GROUP BY doc_id)",
     f"""each AS (SELECT d.doc_id, coalesce(n.n, 0) AS n,
       CASE WHEN n.n IS NULL THEN 'nothing' ELSE {METHOD_SQL.replace('doc_id', 'd.doc_id')} END AS parse_method,
       CASE WHEN d.doc_id % 4 = 3 OR (d.doc_id % 4 = 1 AND n.n IS NOT NULL) THEN 1 ELSE 0 END AS n_errors
       FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id)"""],
    """SELECT parse_method, count(*) AS n_responses, CAST(sum(n) AS BIGINT) AS n_entities,
      CAST(sum(n_errors) AS BIGINT) AS n_errors FROM each GROUP BY parse_method"""))
def resp_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = rs.extract(responses(spark, sf_dir))
    return read.groupBy(F.coalesce("parse_method", F.lit("nothing")).alias("parse_method")).agg(
        F.count("*").alias("n_responses"),
        F.sum(F.size("entities")).alias("n_entities"),
        F.sum(F.size("errors")).alias("n_errors"),
    )


@query("resp_clean", q.with_query(
    [*REPORTED_SQL,
     """json AS (SELECT doc_id, string_agg('{"entity_type": "' || lower(entity_type) || '", "value": "'
       || value || '", "start": ' || "start" || ', "end": "' || "end" || '", "confidence": 0.9}', ', '
       ORDER BY place) AS body FROM reported GROUP BY doc_id)"""],
    """SELECT d.doc_id, '[' || coalesce(body, '') || ']' AS cleaned
    FROM documents d LEFT JOIN json ON json.doc_id = d.doc_id"""))
def resp_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(spark, sf_dir, "json").select(
        "doc_id", rs.clean_response(F.col("raw_response")).alias("cleaned")
    )


EDGE = "[\\p{Z}\\t\\n\\v\\f\\r]+"
GROUND_SQL = [
    *REPORTED_SQL,
    """e AS (SELECT r.doc_id, r.place, r.entity_type, r.value AS v, r."start" AS s,
      least(r."end", length(d.text)) AS e, length(d.text) AS n, d.text,
      CAST(CASE WHEN r.doc_id % 4 = 2 THEN 0.8 ELSE 0.9 END AS DOUBLE) AS conf,
      strpos(d.text, r.value) - 1 AS exact, strpos(lower(d.text), lower(r.value)) - 1 AS folded,
      regexp_replace(r.value, '[^\\w\\s]', '', 'g') AS bare
      FROM reported r JOIN documents d ON d.doc_id = r.doc_id)""",
    f"""sliced AS (SELECT *, CASE WHEN s < n THEN substring(text, s + 1, e - s) END AS here,
      regexp_replace(regexp_replace(substring(text, s + 1, e - s), '^{EDGE}', ''), '{EDGE}$', '') AS there,
      greatest(s - 5, 0) AS low, substring(text, greatest(s - 5, 0) + 1, least(e + 5, n) - greatest(s - 5, 0)) AS region
      FROM e)""",
    """judged AS (SELECT *, CASE
      WHEN s >= n AND exact >= 0 THEN 'search' WHEN s >= n AND folded >= 0 THEN 'case_search'
      WHEN s >= n THEN NULL WHEN here = v THEN 'none' WHEN strpos(here, v) > 0 THEN 'narrowed'
      WHEN there = '' THEN NULL WHEN strpos(v, there) > 0 THEN 'shortened'
      WHEN exact >= 0 THEN 'moved' WHEN bare <> '' AND strpos(region, bare) > 0 THEN 'near' END AS repair
      FROM sliced)""",
    """ends AS (SELECT *, CAST(CASE repair WHEN 'search' THEN exact WHEN 'case_search' THEN folded
        WHEN 'none' THEN s WHEN 'narrowed' THEN s + strpos(here, v) - 1 WHEN 'shortened' THEN s
        WHEN 'moved' THEN exact ELSE low + strpos(region, bare) - 1 END AS INTEGER) AS "start",
      CASE repair WHEN 'search' THEN 0.9 WHEN 'case_search' THEN 0.8 WHEN 'narrowed' THEN 0.9
        WHEN 'shortened' THEN 0.8 WHEN 'near' THEN 0.7 ELSE 1.0 END AS factor
      FROM judged WHERE repair IS NOT NULL)""",
    """g_in AS (SELECT doc_id, place, entity_type, repair, "start",
      CAST(CASE repair WHEN 'shortened' THEN e WHEN 'near' THEN "start" + length(bare)
        ELSE "start" + length(v) END AS INTEGER) AS "end", conf * CAST(factor AS DOUBLE) AS score
      FROM ends)""",
    GREEDY_SQL,
]


@query("resp_ground", q.with_query(
    GROUND_SQL, 'SELECT doc_id, entity_type, "start", "end", round(score, 6) AS score, repair FROM g_out',
    recursive=True))
def resp_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = rs.extract(responses(spark, sf_dir)).select("doc_id", "entities")
    placed = rs.ground(read, documents(spark, sf_dir))
    return placed.select(
        "doc_id", F.inline(F.filter("spans", lambda s: s.isNotNull()))
    ).select(
        "doc_id", "entity_type", "start", "end", F.round("score", 6).alias("score"), "repair"
    )


# --- what has no place: every fifth response reports something that is in no text, every
# --- seventh one belongs to no text

ORPHAN = 1_000_000_000
STRAY = "¤ 0 ¤"


def _strays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses in one format that are out of place, grounded."""
    key = F.col("doc_id")
    line = F.concat(F.lit("note: "), F.when(key % 5 == 0, STRAY).otherwise(F.substring("text", 1, 1)), F.lit(" (position: 0-1)"))
    raw = documents(spark, sf_dir).filter("length(text) > 0 AND substring(text, 1, 1) rlike '[A-Za-z]'").select(
        F.when(key % 7 == 0, key + ORPHAN).otherwise(key).alias("doc_id"), line.alias("raw_response")
    )
    read = rs.extract(raw).select("doc_id", "entities")
    return rs.ground(read, documents(spark, sf_dir))


TWO_WORDS = "^[A-Za-z]+ [A-Za-z]+"


@query("resp_loose", f"""
WITH v AS (SELECT doc_id, text, replace(upper(regexp_extract(text, '{TWO_WORDS}')), ' ', '.') AS v FROM documents
  WHERE regexp_matches(text, '{TWO_WORDS}'))
SELECT doc_id, 'NOTE' AS entity_type, 0 AS "start", CAST(length(v) AS INTEGER) AS "end", 'loose_search' AS repair
FROM v WHERE strpos(lower(text), lower(v)) = 0 AND length(v) >= 4""")
def resp_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two words of a text, reported in capitals, with a dot between and out of place."""
    words = F.replace(F.upper(F.regexp_extract("text", TWO_WORDS, 0)), F.lit(" "), F.lit("."))
    raw = documents(spark, sf_dir).filter(F.col("text").rlike(TWO_WORDS)).select(
        "doc_id", F.concat(F.lit("note: "), words, F.lit(f" (position: {FAR}-{FAR + 9})")).alias("raw_response")
    )
    placed = rs.ground(rs.extract(raw).select("doc_id", "entities"), documents(spark, sf_dir))
    spans = placed.select("doc_id", F.inline(F.filter("spans", lambda s: s.isNotNull())))
    return spans.filter("repair = 'loose_search'").select("doc_id", "entity_type", "start", "end", "repair")


STRAYS_SQL = f"""
strays AS (SELECT CASE WHEN doc_id % 7 = 0 THEN doc_id + {ORPHAN} ELSE doc_id END AS doc_id,
  doc_id % 7 = 0 AS orphan, doc_id % 5 = 0 AS stray,
  CASE WHEN doc_id % 5 = 0 THEN '{STRAY}' ELSE substring(text, 1, 1) END AS value
FROM documents WHERE regexp_matches(substring(text, 1, 1), '[A-Za-z]'))"""


@query("resp_unplaced", q.with_query(
    [STRAYS_SQL], """SELECT doc_id, 'NOTE' AS entity_type, value,
      CASE WHEN orphan THEN 'no text for this response' ELSE 'not found in the text' END AS error
    FROM strays WHERE orphan OR stray"""))
def resp_unplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.unplaced_entities(_strays(spark, sf_dir), "doc_id").select("doc_id", "entity_type", "value", "error")


@query("resp_orphans", q.with_query(
    [STRAYS_SQL], "SELECT doc_id, 'no text for this response' AS error FROM strays WHERE orphan"))
def resp_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strays(spark, sf_dir).filter("error IS NOT NULL").select("doc_id", "error")


@query("error_rate", q.with_query(
    [STRAYS_SQL], """SELECT orphan, count(*) AS n,
      round(avg(CASE WHEN orphan OR stray THEN 1 ELSE 0 END), 6) AS error_rate FROM strays GROUP BY orphan"""))
def error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses that could not be placed, whole or in part."""
    tried = _strays(spark, sf_dir).select(
        (F.col("doc_id") >= ORPHAN).alias("orphan"),
        F.coalesce("error", F.when(F.size("unplaced") > 0, "an entity has no place")).alias("error"),
    )
    return metrics.error_rate(tried, "orphan").withColumn("error_rate", F.round("error_rate", 6))


# --- prompts and cache ----------------------------------------------------------------

TEMPLATE = "List {{ entities }} in the text of {{ role }}.\n{{ text }}\nAnswer for {{ client }}."
ENTITIES = ["PERSON", "PHONE_NUMBER", "ID_CARD"]
MODEL, TEMPERATURE = "small", 0.5
NOW = dt.datetime(2024, 1, 1, 12, 0, 0)
EPOCH = int(NOW.replace(tzinfo=dt.timezone.utc).timestamp())


def prompt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, f"{sf_dir}/conversations.parquet", "conv_id", "turn", "role", "text")
    prompt = pr.render_prompt(TEMPLATE, text=F.col("text"), entities=ENTITIES, role=F.col("role"))
    return turns.withColumn("prompt", prompt).withColumn(
        "key", pr.cache_key(F.col("prompt"), MODEL, TEMPERATURE)
    )


PROMPT_SQL = f"""
prompts0 AS (SELECT conv_id, turn, text, replace(replace(replace({q.quoted(TEMPLATE)},
  '{{{{ text }}}}', text), '{{{{ entities }}}}', 'PERSON, PHONE_NUMBER, ID_CARD'),
  '{{{{ role }}}}', role) AS prompt FROM conversations),
prompts AS (SELECT *, md5('{{"model":"{MODEL}","prompt":' || CAST(to_json(prompt) AS VARCHAR)
  || ',"temperature":{TEMPERATURE}}}') AS key FROM prompts0)"""


@query("prompt_table", q.with_query(
    [PROMPT_SQL], "SELECT conv_id, turn, prompt, key, 'client' AS missing FROM prompts"))
def prompt_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = pr.missing_variables(F.lit(TEMPLATE), ["text", "entities", "role"])
    return prompt_rows(spark, sf_dir).select(
        "conv_id", "turn", "prompt", "key", F.array_join(missing, ",").alias("missing")
    )


def cache_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to the prompts of even conversations, up to an hour and a half old."""
    age = (F.col("conv_id") % 8) * 900
    return prompt_rows(spark, sf_dir).filter("conv_id % 2 = 0").select(
        "key",
        F.concat(F.lit("answer "), F.col("turn").cast("string")).alias("response"),
        F.timestamp_seconds(F.lit(EPOCH) - age).alias("created_at"),
    )


CACHE_SQL = """live AS (SELECT DISTINCT key FROM prompts WHERE conv_id % 2 = 0 AND (conv_id % 8) * 900 <= 3600)"""


@query("cache_anti_join", q.with_query(
    [PROMPT_SQL, CACHE_SQL],
    "SELECT key, min(prompt) AS prompt FROM prompts WHERE key NOT IN (SELECT key FROM live) GROUP BY key"))
def cache_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = pr.live_cache(cache_rows(spark, sf_dir), NOW)
    return pr.calls_to_make(prompt_rows(spark, sf_dir), live)


@query("request_counters", q.with_query(
    [PROMPT_SQL, CACHE_SQL],
    """SELECT count(*) AS total_requests,
      count(*) FILTER (key IN (SELECT key FROM live)) AS cache_hits,
      count(DISTINCT key) FILTER (key NOT IN (SELECT key FROM live)) AS calls,
      count(*) FILTER (turn % 7 = 0) AS errors,
      count(*) FILTER (turn % 7 = 0) * 2 AS retries,
      CAST(sum(length(text) // 4) AS BIGINT) AS total_tokens FROM prompts"""))
def request_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prompt_rows(spark, sf_dir)
    answers = rows.select(
        "key",
        F.when(F.col("turn") % 7 == 0, "timed out").alias("error"),
        F.floor(F.length("text") / 4).cast("long").alias("tokens"),
        F.when(F.col("turn") % 7 == 0, 3).otherwise(1).alias("attempts"),
    )
    return pr.request_counters(rows, pr.live_cache(cache_rows(spark, sf_dir), NOW), answers)




LRU_CAPACITY, LRU_TTL = 12, 100
LRU_SQL = f"""
WITH RECURSIVE log AS (
  SELECT conv_id * 1000 + turn AS n, role || ' ' || lower(substring(coalesce(text, ''), 1, 1)) AS key,
    (conv_id * 1000 + turn) / 25.0 AS t FROM conversations
),
numbered AS (
  SELECT *, lag(n) OVER (PARTITION BY key ORDER BY n) AS before,
    row_number() OVER (PARTITION BY key ORDER BY n) AS k FROM log
),
judged AS (
  SELECT n, key, t, k, before IS NOT NULL AND (SELECT count(DISTINCT l.key) FROM log l
    WHERE l.n > r.before AND l.n < r.n) < {LRU_CAPACITY} AS resident FROM numbered r
),
walk AS (
  SELECT n, key, t, k, false AS hit, t AS put FROM judged WHERE k = 1
  UNION ALL
  SELECT j.n, j.key, j.t, j.k, j.resident AND j.t - w.put <= {LRU_TTL},
    CASE WHEN j.resident AND j.t - w.put <= {LRU_TTL} THEN w.put ELSE j.t END
  FROM walk w JOIN judged j ON j.key = w.key AND j.k = w.k + 1
)
SELECT n, hit FROM walk"""


@query("cache_lru_hits", LRU_SQL)
def cache_lru_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as requests, by role and first letter, against a small cache; short stretches of the log."""
    turns = read_table(spark, f"{sf_dir}/conversations.parquet", "conv_id", "turn", "role", "text")
    n = F.col("conv_id") * 1000 + F.col("turn")
    letter = F.lower(F.substring(F.coalesce("text", F.lit("")), 1, 1))
    log = turns.select(n.alias("n"), F.concat("role", F.lit(" "), letter).alias("key"), (n / 25.0).alias("at"))
    return lru.cache_hits(log, capacity=LRU_CAPACITY, ttl_seconds=LRU_TTL, width=4000)


@query("response_files", """
SELECT CASE WHEN doc_id % 7 > 0 AND doc_id % 11 > 0 THEN doc_id END AS doc_id,
  CASE WHEN doc_id % 7 > 0 AND doc_id % 11 > 0 AND doc_id % 13 > 0 THEN text END AS raw_response,
  CASE WHEN doc_id % 7 = 0 THEN '{"doc_id": ' || doc_id END AS record,
  CASE WHEN doc_id % 7 = 0 THEN 'unreadable record' WHEN doc_id % 11 = 0 THEN 'record without key'
    WHEN doc_id % 13 = 0 THEN 'record without raw_response' END AS error
FROM documents""")
def response_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses as lines of JSON, some cut off, without a key or without a text: read again, good and bad."""
    key = F.col("doc_id")
    own = F.struct(F.when(key % 11 > 0, key).alias("doc_id"), F.when(key % 13 > 0, F.col("text")).alias("raw_response"))
    line = F.when(key % 7 == 0, F.concat(F.lit('{"doc_id": '), key)).otherwise(F.to_json(own))
    path = new_path(spark, "responses")
    documents(spark, sf_dir).select(line.alias("value")).write.text(path)
    good = read_responses(spark, path)
    return good.unionByName(read_response_errors(spark, path), allowMissingColumns=True)
