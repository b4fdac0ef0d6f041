"""Scans, checks, de-duplication and overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.checks import card_scheme, is_bank_card
from ...operators.dictionary import scan_dictionary
from ...operators.joins import lookup_join
from ...operators.reference_values import BANK_BY_BIN, CARD_SCHEME_PREFIXES
from ...operators.resolve import resolve
from ...operators.rules import Rule, builtin_rules, ip_address_rule, select_rules, supported_entities
from ...operators.scan import (
    boost_expr, explode_spans, is_valid_span, keep_expr, scan, split_valid,
)
from ...sources.readers import bin_table, read_table
from . import sqltext as q
from .inputs import AS_OF, PEOPLE_SQL, documents, page_urls, people
from .registry import query

RAW = builtin_rules(validate=False)
PLACE = ["doc_id", "entity_type", "pattern", "start", "end", "value"]
PLACE_SQL = 'doc_id, entity_type, pattern, "start", "end", value'


def raw(*entities: str) -> list[Rule]:
    return select_rules(RAW, entities)


def strict(*entities: str) -> list[Rule]:
    return select_rules(builtin_rules(AS_OF), entities or None)


def named(name: str) -> list[Rule]:
    return [r for r in RAW if r.name == name]


def _scan_sql(rules: list[Rule], source: str = "documents") -> str:
    return q.with_query([q.hits("h", source, rules)], f"SELECT {PLACE_SQL} FROM h")


def _scan(df: DataFrame, rules: list[Rule]) -> DataFrame:
    return explode_spans(scan(df, rules), "doc_id").select(*PLACE)


@query("scan_bank_card", _scan_sql(raw("BANK_CARD")))
def scan_bank_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(documents(spark, sf_dir), raw("BANK_CARD"))


@query("scan_phone_raw", _scan_sql(raw("PHONE_NUMBER")))
def scan_phone_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(documents(spark, sf_dir), raw("PHONE_NUMBER"))


@query("scan_car_plate", _scan_sql(raw("CAR_PLATE")))
def scan_car_plate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(documents(spark, sf_dir), raw("CAR_PLATE"))


@query("scan_id_card", q.with_query([PEOPLE_SQL, q.hits("h", "people", raw("ID_CARD"))],
                                    f"SELECT {PLACE_SQL} FROM h"))
def scan_id_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(people(spark, sf_dir), raw("ID_CARD"))


@query("scan_ip", _scan_sql([ip_address_rule()]))
def scan_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(documents(spark, sf_dir), [ip_address_rule()])


@query("scan_email", _scan_sql(raw("EMAIL_ADDRESS")))
def scan_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(documents(spark, sf_dir), raw("EMAIL_ADDRESS"))


@query("scan_domain", _scan_sql(named("simple_domain")))
def scan_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(documents(spark, sf_dir), named("simple_domain"))


CHECKED = ["doc_id", "entity_type", "start", "end", "score", "pattern", "value"]
CHECKED_SQL = 'doc_id, entity_type, "start", "end", score, pattern, value'


def _check_sql(entity: str, source: str, before: list[str] | None = None) -> str:
    return q.with_query(
        [*(before or []), q.hits("h", source, raw(entity)), q.checked("c", "h"), q.deduped("d", "c")],
        f"SELECT {CHECKED_SQL} FROM d",
    )


def _check(df: DataFrame, entity: str) -> DataFrame:
    found = resolve(scan(df, strict(entity)), "none")
    return explode_spans(found, "doc_id").select(*CHECKED)


@query("validate_bank_card", _check_sql("BANK_CARD", "documents"))
def validate_bank_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check(documents(spark, sf_dir), "BANK_CARD")


@query("validate_url", _check_sql(
    "URL", "urls", ["urls AS (SELECT page_id AS doc_id, url AS text FROM pages)"]))
def validate_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check(page_urls(spark, sf_dir), "URL")


# Keys of derived texts are moved out of the way of document keys.
BOTH_SQL = [
    PEOPLE_SQL,
    "both_texts AS (SELECT doc_id, text FROM documents "
    "UNION ALL SELECT -1 - doc_id AS doc_id, text FROM people)",
]


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = people(spark, sf_dir).withColumn("doc_id", F.lit(-1) - F.col("doc_id"))
    return documents(spark, sf_dir).unionByName(derived)


@query("validate_phone", _check_sql("PHONE_NUMBER", "both_texts", BOTH_SQL))
def validate_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check(_both(spark, sf_dir), "PHONE_NUMBER")


@query("validate_car_plate", _check_sql("CAR_PLATE", "both_texts", BOTH_SQL))
def validate_car_plate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check(_both(spark, sf_dir), "CAR_PLATE")


def _id_sql(names: tuple[str, ...]) -> str:
    rules = [r for r in raw("ID_CARD") if r.name in names]
    return q.with_query(
        [PEOPLE_SQL, q.hits("h", "people", rules), q.checked("c", "h"), q.deduped("d", "c")],
        f"SELECT {CHECKED_SQL} FROM d",
    )


def _ids(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> DataFrame:
    rules = [r for r in strict("ID_CARD") if r.name in names]
    found = resolve(scan(people(spark, sf_dir), rules), "none")
    return explode_spans(found, "doc_id").select(*CHECKED)


ID_18 = ("id_card_18", "id_card_with_separator")
ID_15 = ("id_card_15", "id_card_15_with_separator")


@query("validate_id_card_18", _id_sql(ID_18))
def validate_id_card_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir, ID_18)


@query("validate_id_card_15", _id_sql(ID_15))
def validate_id_card_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir, ID_15)


TYPES = sorted({r.entity_type for r in RAW})


@query("supported_entities", q.with_query(
    [q.hits("h", "documents", RAW)],
    f"""SELECT t.entity_type, count(h.doc_id) AS n FROM (SELECT UNNEST({TYPES!r}) AS entity_type) t
    LEFT JOIN h ON h.entity_type = t.entity_type GROUP BY t.entity_type"""))
def supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each supported type is found, those that are not found included."""
    counts = explode_spans(scan(documents(spark, sf_dir), RAW), "doc_id").groupBy("entity_type").agg(F.count("*").alias("n"))
    return supported_entities(spark, RAW).join(counts, "entity_type", "left").select(
        "entity_type", F.coalesce("n", F.lit(0)).alias("n")
    )


# --- bank and network of a card: a lookup join and a prefix chain ------------------

LEADS = [*BANK_BY_BIN, "411111", "510000", "340000", "350000", "601100", "650000", "990000"]
_LEADS_SQL = "[" + ", ".join(q.quoted(x) for x in LEADS) + "]"
_BIN_SQL = " ".join(f"WHEN {q.quoted(b)} THEN {q.quoted(n)}" for b, n in BANK_BY_BIN.items())
_SCHEME_SQL = " ".join(
    f"WHEN regexp_matches(card, '^({'|'.join(p)})') THEN {q.quoted(s)}"
    for s, p in CARD_SCHEME_PREFIXES
)


@query("bank_scheme", f"""
WITH cards AS (
  SELECT c_custkey, {_LEADS_SQL}[c_custkey % {len(LEADS)} + 1]
    || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS card FROM customer
)
SELECT c_custkey, card, CASE substring(card, 1, 6) {_BIN_SQL} END AS bank,
  CASE {_SCHEME_SQL} END AS scheme, {q.valid_card('card')} AS valid
FROM cards""")
def bank_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    leads = F.array(*[F.lit(x) for x in LEADS])
    cards = read_table(spark, f"{sf_dir}/customer.parquet", "c_custkey").withColumn(
        "card",
        F.concat(
            F.element_at(leads, (key % len(LEADS)).cast("int") + 1),
            F.lpad(key.cast("string"), 10, "0"),
        ),
    )
    named_cards = lookup_join(
        cards.withColumn("bin", F.substring("card", 1, 6)), bin_table(spark), "bin", ["c_custkey"]
    )
    return named_cards.select(
        "c_custkey", "card", "bank",
        card_scheme(F.col("card")).alias("scheme"),
        is_bank_card(F.col("card")).alias("valid"),
    )


# --- context, union, filters -------------------------------------------------------

BOOST_RULES = raw("BANK_CARD", "EMAIL_ADDRESS")
BOOST_WORDS = {"BANK_CARD": ["the", "de "], "EMAIL_ADDRESS": ["and", "mit"]}
BOOST_WINDOW = 24
_NEAR_SQL = " OR ".join(
    f"(entity_type = {q.quoted(t)} AND regexp_matches(lead, {q.quoted('|'.join(ws))}))"
    for t, ws in BOOST_WORDS.items()
)


@query("context_boost", q.with_query(
    [q.hits("h", "documents", BOOST_RULES),
     f'led AS (SELECT *, substring(text, greatest("start" - {BOOST_WINDOW}, 0) + 1, '
     f'"start" - greatest("start" - {BOOST_WINDOW}, 0)) AS lead FROM h)'],
    f"""SELECT doc_id, entity_type, pattern, "start", "end", round(CASE WHEN {_NEAR_SQL}
      THEN least(1.0, score + 0.2) ELSE score END, 6) AS score FROM led"""))
def context_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir), BOOST_RULES)
    boosted = found.withColumn(
        "spans", boost_expr(F.col("spans"), F.col("text"), BOOST_WORDS, BOOST_WINDOW, 0.2)
    )
    return explode_spans(boosted, "doc_id").select(
        "doc_id", "entity_type", "pattern", "start", "end", F.round("score", 6).alias("score")
    )


def all_checked(source: str = "documents") -> list[str]:
    return [q.hits("h", source, RAW), q.checked("c", "h"), q.deduped("d", "c")]


@query("union_dedup_spans", q.with_query(all_checked(), f"SELECT {CHECKED_SQL} FROM d"))
def union_dedup_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(scan(documents(spark, sf_dir), strict()), "none")
    return explode_spans(found, "doc_id").select(*CHECKED)


ALLOWED, DENIED, THRESHOLD = ["BANK_CARD", "PHONE_NUMBER", "EMAIL_ADDRESS", "URL"], ["URL"], 0.75


@query("filter_threshold_allow_deny", q.with_query(
    [q.hits("h", "documents", RAW)],
    f"""SELECT {PLACE_SQL}, score FROM h WHERE score >= {THRESHOLD}
    AND entity_type IN ('BANK_CARD', 'PHONE_NUMBER', 'EMAIL_ADDRESS', 'URL')
    AND entity_type NOT IN ('URL')"""))
def filter_threshold_allow_deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir), select_rules(RAW, ALLOWED, DENIED))
    kept = found.withColumn("spans", keep_expr(F.col("spans"), THRESHOLD, ALLOWED, DENIED))
    return explode_spans(kept, "doc_id").select(*PLACE, "score")


@query("span_validity", q.with_query(
    [q.hits("h", "documents", raw("BANK_CARD", "EMAIL_ADDRESS")),
     'bent AS (SELECT doc_id, entity_type, pattern, CASE WHEN doc_id % 3 = 0 THEN "end" ELSE "start" END '
     'AS "start", "end", CASE WHEN doc_id % 5 = 0 THEN CAST(1.5 AS DOUBLE) ELSE score END AS score FROM h)'],
    """SELECT doc_id, entity_type, pattern, "start", "end",
      ("start" >= 0 AND "end" > "start" AND score BETWEEN 0 AND 1) AS valid FROM bent"""))
def span_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans bent out of shape for some texts, good and rejected ones told apart."""
    from ...operators.scan import with_fields

    found = scan(documents(spark, sf_dir), raw("BANK_CARD", "EMAIL_ADDRESS"))
    bent = F.transform(
        "spans",
        lambda s: with_fields(
            s,
            start=F.when(F.col("doc_id") % 3 == 0, s.getField("end")).otherwise(s.getField("start")),
            score=F.when(F.col("doc_id") % 5 == 0, F.lit(1.5)).otherwise(s.getField("score")),
        ),
    )
    parted = split_valid(found.withColumn("spans", bent))
    both = parted.withColumn("spans", F.concat("spans", "rejected"))
    rows = explode_spans(both, "doc_id")
    return rows.select(
        "doc_id", "entity_type", "pattern", "start", "end",
        is_valid_span(F.struct(*[F.col(c) for c in rows.columns if c != "doc_id"])).alias("valid"),
    )


# --- overlaps ----------------------------------------------------------------------


@query("overlap_cover", q.with_query(
    [*all_checked(), q.covered("v", "d")], f"SELECT {CHECKED_SQL} FROM v"))
def overlap_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(scan(documents(spark, sf_dir), strict()), "cover")
    return explode_spans(found, "doc_id").select(*CHECKED)


GREEDY_SQL = """
g_no AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", score DESC, place) AS i FROM g_in
),
g_walk AS (
  SELECT doc_id, i, i AS kept, "end" AS kept_end, score AS kept_score, TRUE AS apart
  FROM g_no WHERE i = 1
  UNION ALL
  SELECT n.doc_id, n.i,
    CASE WHEN n."start" >= w.kept_end OR n.score > w.kept_score THEN n.i ELSE w.kept END,
    CASE WHEN n."start" >= w.kept_end OR n.score > w.kept_score THEN n."end" ELSE w.kept_end END,
    CASE WHEN n."start" >= w.kept_end OR n.score > w.kept_score THEN n.score ELSE w.kept_score END,
    n."start" >= w.kept_end
  FROM g_walk w JOIN g_no n ON n.doc_id = w.doc_id AND n.i = w.i + 1
),
g_last AS (
  SELECT doc_id, kept, coalesce(lead(apart) OVER (PARTITION BY doc_id ORDER BY i), TRUE) AS final
  FROM g_walk
),
g_out AS (
  SELECT n.* FROM g_last l JOIN g_no n ON n.doc_id = l.doc_id AND n.i = l.kept WHERE l.final
)"""


@query("overlap_greedy", q.with_query(
    [q.hits("h", "documents", RAW), q.deduped("d", "h"),
     """g_in AS (SELECT *, row_number() OVER (PARTITION BY doc_id
       ORDER BY "start", "end", entity_type, pattern) AS place FROM d)""", GREEDY_SQL],
    f"SELECT {CHECKED_SQL} FROM g_out", recursive=True))
def overlap_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(scan(documents(spark, sf_dir), RAW), "greedy")
    return explode_spans(found, "doc_id").select(*CHECKED)


@query("scan_dictionary", q.with_query(
    [PEOPLE_SQL, """pairs AS (SELECT doc_id, text, c_name AS value, 'CUSTOMER' AS entity_type
      FROM people JOIN customer ON contains(text, 'customer ' || c_name || ' tel')
      UNION ALL SELECT doc_id, text, substring(text, strpos(text, ' plate ') + 7, 7), 'PLATE' FROM people
      WHERE doc_id % 4 > 0)"""],
    """SELECT doc_id, entity_type, CAST(strpos(text, value) - 1 AS INTEGER) AS "start",
      CAST(strpos(text, value) - 1 + length(value) AS INTEGER) AS "end", value FROM pairs"""))
def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customer names and plates as literal values, in two automata."""
    customers = read_table(spark, f"{sf_dir}/customer.parquet", "c_name")
    orders = read_table(spark, f"{sf_dir}/orders.parquet", "o_orderkey").filter("o_orderkey % 4 > 0")
    plates = orders.select(F.concat(F.lit("京A"), F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0")))
    values = customers.select(F.col("c_name").alias("value"), F.lit("CUSTOMER").alias("entity_type")).unionAll(
        plates.select("*", F.lit("PLATE"))
    )
    limit = values.distinct().count() // 2 + 1
    found = scan_dictionary(people(spark, sf_dir), values, max_values=limit)
    return explode_spans(found, "doc_id").select("doc_id", "entity_type", "start", "end", "value")
