"""Apply a masking policy to settled spans. One narrow pass, no shuffle."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masks
from ..functions.arrays import let, running_starts
from ..functions.text import slice_text
from .joins import BROADCAST_BYTES, BROADCAST_ROWS, lookup_join
from .reference_values import POLICY_TABLE

DEFAULT = "DEFAULT"
OPERATORS = ("replace", "mask", "hash", "redact", "encrypt", "custom")
#: Policies of more types are looked up in a map, not told apart one by one.
WIDEST_CASE = 64
POLICY_SCHEMA = (
    "entity_type string, operator string, new_value string, masking_char string, "
    "chars_to_mask int, from_end boolean, hash_type string"
)


@dataclass(frozen=True)
class Policy:
    """What to do with the values of one entity type (``DEFAULT``: all the others)."""

    entity_type: str = DEFAULT
    operator: str = "replace"
    new_value: str | None = "[REDACTED]"
    masking_char: str = "*"
    chars_to_mask: int = -1
    from_end: bool = True
    hash_type: str = "sha256"
    salt: str | None = None
    key: str | bytes | None = None
    function: Callable[[Column], Column] | None = None

    def __post_init__(self) -> None:
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator {self.operator!r}; one of {OPERATORS}")
        if self.operator == "encrypt" and self.key is None:
            raise ValueError("encrypt needs a key")
        if self.operator == "custom" and self.function is None:
            raise ValueError("custom needs a function")
        if self.operator == "hash" and self.hash_type not in masks.HASHES:
            raise ValueError(f"unknown hash type {self.hash_type!r}")
        if self.operator == "mask" and len(self.masking_char) != 1:
            raise ValueError("masking_char is one character")

    def replacement(self, value: Column) -> Column:
        if self.operator == "replace":
            return F.lit(self.new_value)
        if self.operator == "mask":
            return masks.mask_chars(
                value, F.lit(self.masking_char), F.lit(self.chars_to_mask), F.lit(self.from_end)
            )
        if self.operator == "hash":
            salt = None if self.salt is None else F.lit(self.salt)
            return masks.hash_value(value, self.hash_type, salt)
        if self.operator == "redact":
            return F.lit("")
        if self.operator == "encrypt":
            return masks.encrypt_value(value, self.key)
        return self.function(value)


def config_policy() -> list[Policy]:
    """The shipped policy by entity type."""
    return [Policy(**row) for row in POLICY_TABLE]


def policy_table(spark: SparkSession, policy: Iterable[Policy]) -> DataFrame:
    return spark.createDataFrame(
        [
            (p.entity_type, p.operator, p.new_value, p.masking_char, p.chars_to_mask,
             p.from_end, p.hash_type)
            for p in policy
        ],
        POLICY_SCHEMA,
    )


def operator_list() -> list[str]:
    return list(OPERATORS)


def _by_type(policy: Iterable[Policy]) -> tuple[dict[str, Policy], Policy | None]:
    policy = list(policy)
    entries = {p.entity_type: p for p in policy}
    if len(entries) < len(policy):
        raise ValueError("a policy has at most one entry for an entity type")
    default = entries.pop(DEFAULT, None)
    return entries, default


def replacement_expr(span: Column, policy: Iterable[Policy]) -> Column:
    """Replacement text of one span; types without a policy become ``<TYPE>``."""
    entries, default = _by_type(policy)
    value = span.getField("value")
    if default is not None:
        out = default.replacement(value)
    else:
        out = F.concat(F.lit("<"), span.getField("entity_type"), F.lit(">"))
    for entity_type, p in entries.items():
        out = F.when(span.getField("entity_type") == entity_type, p.replacement(value)).otherwise(
            out
        )
    return out


def operator_expr(span: Column, policy: Iterable[Policy]) -> Column:
    entries, default = _by_type(policy)
    out = F.lit(default.operator if default is not None else "replace")
    for entity_type, p in entries.items():
        out = F.when(span.getField("entity_type") == entity_type, F.lit(p.operator)).otherwise(out)
    return out


def rebuild_expr(text: Column, edits: Column) -> Column:
    """Gaps of ``text`` and replacements, put back together.

    ``edits`` are sorted and do not overlap. If a replacement is null, so is the
    result: text is never let through with a value that could not be masked.
    """

    def join(e: Column) -> Column:
        def piece(edit: Column, i: Column) -> Column:
            last_end = F.when(i == 0, F.lit(0)).otherwise(
                e[F.greatest(i - 1, F.lit(0))].getField("end")
            )
            return F.concat(
                slice_text(text, last_end, edit.getField("start")), edit.getField("replacement")
            )

        tail_from = F.element_at(e, -1).getField("end")
        whole = F.concat(
            F.array_join(F.transform(e, piece), ""), slice_text(text, tail_from, F.length(text))
        )
        return (
            F.when(F.size(e) == 0, text)
            .when(F.exists(e, lambda x: x.getField("replacement").isNull()), F.lit(None))
            .otherwise(whole)
        )

    return let(edits, join)


def items_expr(edits: Column) -> Column:
    """Log of edits with offsets in the text that comes out."""

    def log(e: Column) -> Column:
        growth = F.transform(
            e,
            lambda x: F.length(x.getField("replacement"))
            - (x.getField("end") - x.getField("start")),
        )

        def item(x: Column, i: Column, shift: Column) -> Column:
            return let(
                x.getField("start") + shift[i],
                lambda s: F.struct(
                    s.alias("start"),
                    (s + F.length(x.getField("replacement"))).alias("end"),
                    x.getField("entity_type").alias("entity_type"),
                    x.getField("replacement").alias("text"),
                    x.getField("operator").alias("operator"),
                    x.getField("score").alias("score"),
                ),
            )

        return let(
            running_starts(growth), lambda shift: F.transform(e, lambda x, i: item(x, i, shift))
        )

    return let(edits, log)


def _with_output(df: DataFrame, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return (
        df.withColumn("redacted_text", rebuild_expr(text, F.col("edits")))
        .withColumn("items", items_expr(F.col("edits")))
        .withColumn(
            "error",
            F.when(
                F.exists("edits", lambda x: x.getField("replacement").isNull()),
                F.lit("no replacement for a detected value"),
            ),
        )
    )


def _edit(span: Column, replacement: Column, operator: Column) -> Column:
    get = span.getField
    return F.struct(
        get("start").alias("start"),
        get("end").alias("end"),
        get("entity_type").alias("entity_type"),
        get("score").alias("score"),
        replacement.alias("replacement"),
        operator.alias("operator"),
    )


def redact(
    df: DataFrame,
    policy: Iterable[Policy] = (),
    text_col: str = "text",
    spans_col: str = "spans",
) -> DataFrame:
    """Add ``redacted_text``, ``items`` and ``error`` from settled, sorted spans."""
    policy = list(policy)
    edits = F.transform(
        F.col(spans_col),
        lambda s: _edit(s, replacement_expr(s, policy), operator_expr(s, policy)),
    )
    return _with_output(df.withColumn("edits", edits), text_col)


def policy_from_rows(rows: Iterable) -> list[Policy]:
    """Policies from rows of a policy table; null fields take their defaults."""
    fields = [f for f in Policy.__dataclass_fields__ if f not in ("salt", "key", "function")]
    return [
        Policy(**{f: row[f] for f in fields if f in row.__fields__ and row[f] is not None})
        for row in rows
    ]


def check_policy_rows(rows: list) -> list[Policy]:
    """Policies from all rows of a table, which has one row for a type and what ``Policy`` accepts."""
    if any(row["entity_type"] is None for row in rows):
        raise ValueError("a policy table names an entity type in every row")
    try:
        policies = policy_from_rows(rows)
        _by_type(policies)
    except ValueError as e:
        raise ValueError(f"not a policy table: {e}") from e
    return policies


def table_default(policy: DataFrame) -> Policy | None:
    """The ``DEFAULT`` row of a policy table, which is checked as a whole.

    Refused are what ``Policy`` refuses: unknown operators and hash types, masks that are
    not one character, operators that need a key or a function, and two rows for one type.
    """
    twice = policy.groupBy("entity_type").count().filter("count > 1 OR entity_type IS NULL").limit(1)
    operator = F.coalesce("operator", F.lit("replace"))
    wrong = policy.filter(
        ~operator.isin("replace", "mask", "hash", "redact")
        | ((operator == "hash") & ~F.coalesce("hash_type", F.lit("sha256")).isin(*masks.HASHES))
        | ((operator == "mask") & (F.length(F.coalesce("masking_char", F.lit("*"))) != 1))
    )
    if row := twice.first():
        raise ValueError(f"a policy table has one row for an entity type, not {row['count']} for {row['entity_type']!r}")
    if row := wrong.limit(1).first():
        raise ValueError(f"a policy table cannot hold {row}")
    rows = policy_from_rows(policy.filter(F.col("entity_type") == DEFAULT).limit(1).collect())
    return rows[0] if rows else None


def _table_fields(policy: DataFrame) -> list[Column]:
    """All fields of a policy table, with the defaults where they are null or not there."""
    other = {"entity_type": F.lit(None), "operator": F.lit("replace"), "new_value": F.lit("[REDACTED]"),
             "masking_char": F.lit("*"), "chars_to_mask": F.lit(-1), "from_end": F.lit(True),
             "hash_type": F.lit("sha256")}
    return [
        (F.coalesce(F.col(f), o) if f in policy.columns else o).alias(f) for f, o in other.items()
    ]


def _entry_replacement(value: Column, entry: Column) -> Column:
    """Replacement of a value by one entry of a policy table, all fields filled; null without an operator."""
    get = entry.getField
    return (
        F.when(get("operator") == "replace", get("new_value"))
        .when(
            get("operator") == "mask",
            masks.mask_chars(value, get("masking_char"), get("chars_to_mask"), get("from_end")),
        )
        .when(
            get("operator") == "hash",
            F.when(get("hash_type") == "sha256", masks.hash_value(value, "sha256"))
            .when(get("hash_type") == "sha512", masks.hash_value(value, "sha512"))
            .when(get("hash_type") == "md5", masks.hash_value(value, "md5")),
        )
        .when(get("operator") == "redact", F.lit(""))
    )


def span_replacements(
    spans: DataFrame, policy: DataFrame, keys: list[str], max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Long-form spans with ``replacement`` and ``operator`` from a policy table.

    Types without a row take the ``DEFAULT`` row, without one they become ``<TYPE>``, as with
    a list of policies.
    """
    default = table_default(policy)
    rows = policy.filter(F.col("entity_type") != DEFAULT).select(
        "entity_type", F.struct(*_table_fields(policy)).alias("entry")
    )
    joined = lookup_join(spans, rows, "entity_type", [*keys, "start"], max_rows=max_rows)
    other = (
        F.concat(F.lit("<"), F.col("entity_type"), F.lit(">"))
        if default is None
        else default.replacement(F.col("value"))
    )
    named = F.when(F.col("entry").isNull(), other).otherwise(_entry_replacement(F.col("value"), F.col("entry")))
    return joined.select(
        *spans.columns,
        named.alias("replacement"),
        F.coalesce("entry.operator", F.lit("replace" if default is None else default.operator)).alias("operator"),
    )


def _redact_by_entries(
    df: DataFrame, entries: list, default: Policy | None, text_col: str, spans_col: str
) -> DataFrame:
    """``redact`` with entries (rows with all fields of a policy table) as a constant map on the row."""
    kind = POLICY_SCHEMA.replace(" string", ":string").replace(" int", ":int").replace(" boolean", ":boolean")
    pairs = json.dumps([{"t": row["entity_type"], "e": row.asDict()} for row in entries])
    found = F.from_json(F.lit(pairs), f"array<struct<t:string,e:struct<{kind.replace(', ', ',')}>>>")
    by_type = F.map_from_entries(found)

    def edit(span: Column) -> Column:
        value, named = span.getField("value"), span.getField("entity_type")
        other = F.concat(F.lit("<"), named, F.lit(">")) if default is None else default.replacement(value)
        return let(
            F.try_element_at(by_type, named),
            lambda entry: _edit(
                span,
                F.when(entry.isNull(), other).otherwise(_entry_replacement(value, entry)),
                F.coalesce(entry.getField("operator"), F.lit("replace" if default is None else default.operator)),
            ),
        )

    return _with_output(df.withColumn("edits", F.transform(F.col(spans_col), edit)), text_col)


def redact_by_table(
    df: DataFrame,
    policy: DataFrame,
    text_col: str = "text",
    spans_col: str = "spans",
    max_rows: int = BROADCAST_ROWS,
    max_types: int = BROADCAST_ROWS,
) -> DataFrame:
    """``redact`` with the policy in a table.

    The edits of a text are worked out on its own row; they never travel by a key, so that texts
    with null or repeated keys are no special case and none can lose its edits on the way. A
    policy of at most ``max_rows`` rows and 8 MB becomes part of the plan. Of a larger one, only
    the rows for entity types that occur in ``df`` do; more than ``max_types`` such types are
    refused. Both give the same and refuse the same tables (see ``table_default``).
    """
    rows = policy.limit(max_rows + 1).collect()
    if len(rows) <= max_rows and sum(len(str(r)) for r in rows) <= BROADCAST_BYTES:
        policies = check_policy_rows(rows)
        if len(policies) <= WIDEST_CASE:
            return redact(df, policies, text_col, spans_col)
        default = _by_type(policies)[1]
        named = policy
    else:
        default = table_default(policy)
        types = F.transform(F.col(spans_col), lambda s: s.getField("entity_type"))
        occurring = df.select(F.explode(F.array_distinct(types)).alias("entity_type")).distinct()
        named = policy.join(occurring, "entity_type", "left_semi")
    filled = named.filter(F.col("entity_type") != DEFAULT).select(*_table_fields(policy))
    entries = filled.limit(max_types + 1).collect()
    if len(entries) > max_types:
        raise ValueError(f"more than {max_types} entity types with a policy of their own")
    return _redact_by_entries(df, entries, default, text_col, spans_col)


def restore(
    df: DataFrame,
    key: str | bytes,
    text_col: str = "redacted_text",
    items_col: str = "items",
) -> DataFrame:
    """Add ``restored_text`` and ``restore_error``: the item log applied backwards to masked texts.

    Every encrypted value is decrypted where it stands in the masked text. A text comes back whole
    or not at all: it is null, with an error, if a value cannot be decrypted (wrong key, changed
    text), if an item was not encrypted, so that its value is lost, or if items lie outside the
    text or over each other. Masked texts that are null stay null, with an error; texts without
    items are what they were. In-row: no shuffle.
    """
    text, items = F.col(text_col), F.coalesce(F.col(items_col), F.array().cast(df.schema[items_col].dataType))
    ordered = F.array_sort(items)
    edits = F.transform(
        ordered,
        lambda i: F.struct(
            i.getField("start").alias("start"),
            i.getField("end").alias("end"),
            F.when(
                i.getField("operator") == "encrypt",
                masks.decrypt_value(slice_text(text, i.getField("start"), i.getField("end")), key),
            ).alias("replacement"),
        ),
    )
    apart = F.forall(
        F.sequence(F.lit(0), F.size("__edits")),
        lambda n: F.coalesce(F.get("__edits", n).getField("start"), F.length(text))
        >= F.when(n == 0, 0).otherwise(F.get("__edits", n - 1).getField("end")),
    )
    error = (
        F.when(text.isNull(), "no masked text")
        .when(F.exists(items, lambda i: i.getField("operator") != "encrypt"), "a value was not encrypted")
        .when(~apart, "items do not fit the text")
        .when(F.exists("__edits", lambda e: e.getField("replacement").isNull()), "a value cannot be decrypted")
    )
    out = df.withColumn("__edits", edits).withColumn("restore_error", error)
    whole = F.when(F.col("restore_error").isNull(), rebuild_expr(text, F.col("__edits")))
    return out.withColumn("restored_text", whole).drop("__edits")


def explode_items(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.inline(F.filter("items", lambda i: i.isNotNull())))


def audit_log(df: DataFrame, *keys: str) -> DataFrame:
    """Type, place and operator of every edit; never the value."""
    return explode_items(df, *keys).select(*keys, "start", "end", "entity_type", "operator")
