"""Entities out of free-form model responses, placed in the text they talk about."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import empty_array, let, running_starts
from ..functions.text import slice_text, strip
from .resolve import greedy_expr
from .scan import SPAN_TYPE

DEFAULT_CONFIDENCE = 0.8
MIN_CONFIDENCE = 0.5
MAX_OFFSET = 5

# --- Fixed values: openings and marks of lines that explain rather than report. ---

EXPLAINING_STARTS = ["以下是", "根据", "识别结果"]
EXPLAINING_MARK = "如下"

# --- Fixed values: one reported entity in running text. ---

LINE_PATTERN = r"(?i)((?U:\w+)):\s*([^(]+)\s*\((?:位置:|position:)?\s*(\d+)-(\d+)\)"

RAW_TYPE = (
    "struct<entity_type:string,value:string,start:string,end:string,confidence:string,"
    "is_inferred:string,notes:string,metadata:string>"
)
FOUND_TYPE = (
    "struct<entity_type:string,value:string,start:int,end:int,confidence:double,"
    "is_inferred:boolean,notes:string,metadata:string>"
)
GROUNDED_TYPE = SPAN_TYPE[:-1] + ",is_inferred:boolean,notes:string,metadata:string,repair:string>"
METHODS = ("json", "relaxed_json", "lines", "table")


# --- cleaning and the four formats ----------------------------------------------


def clean_response(raw: Column) -> Column:
    """Code fences and explaining lines out, lines stripped."""
    bare = strip(
        F.regexp_replace(F.regexp_replace(raw, r"```json\s*", ""), r"```\s*\z", "")
    )
    explains = "^(?:" + "|".join(EXPLAINING_STARTS) + ")"
    lines = F.filter(
        F.transform(F.split(bare, "\n", -1), strip),
        lambda line: ~(line.rlike(explains) | F.contains(line, F.lit(EXPLAINING_MARK))),
    )
    return strip(F.array_join(lines, "\n"))


def _raw_json(text: Column) -> Column:
    return F.from_json(
        F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit("")),
        f"array<{RAW_TYPE}>",
        {"allowSingleQuotes": "false"},
    )


def _coerce(raw: Column) -> Column:
    """Typed fields; the confidence has a default, everything else must be there."""
    get = raw.getField
    return F.struct(
        F.upper(get("entity_type")).alias("entity_type"),
        get("value").alias("value"),
        F.trim(get("start")).try_cast("int").alias("start"),
        F.trim(get("end")).try_cast("int").alias("end"),
        F.when(get("confidence").isNull(), F.lit(DEFAULT_CONFIDENCE))
        .otherwise(F.trim(get("confidence")).try_cast("double"))
        .alias("confidence"),
        F.lower(get("is_inferred")).try_cast("boolean").alias("is_inferred"),
        get("notes").alias("notes"),
        get("metadata").alias("metadata"),
    ).cast(FOUND_TYPE)


def is_complete(entity: Column) -> Column:
    """All fields there, start not negative, end after start, confidence in 0..1."""
    get = entity.getField
    return F.coalesce(
        (F.length(get("entity_type")) > 0)
        & (F.length(get("value")) > 0)
        & (get("start") >= 0)
        & (get("end") > get("start"))
        & get("confidence").between(0.0, 1.0),
        F.lit(False),
    )


def from_json_array(text: Column) -> Column:
    """Raw entities of the outermost JSON array, or null if there is none."""
    return _raw_json(text)


def relax_json(text: Column) -> Column:
    """Quote bare names, drop trailing commas, turn single quotes to double ones."""
    quoted = F.regexp_replace(text, r"((?U:\w+)):", r'"$1":')
    no_comma = F.regexp_replace(F.regexp_replace(quoted, r",\s*\}", "}"), r",\s*\]", "]")
    return F.replace(no_comma, F.lit("'"), F.lit('"'))


def _raw(entity_type: Column, value: Column, start: Column, end: Column, conf: Column) -> Column:
    nothing = F.lit(None).cast("string")
    return F.struct(
        entity_type.alias("entity_type"), value.alias("value"), start.alias("start"),
        end.alias("end"), conf.alias("confidence"), nothing.alias("is_inferred"),
        nothing.alias("notes"), nothing.alias("metadata"),
    ).cast(RAW_TYPE)


def from_lines(text: Column) -> Column:
    """Raw entities written as ``TYPE: value (position: a-b)``."""
    group = [F.regexp_extract_all(text, F.lit(LINE_PATTERN), F.lit(i)) for i in (1, 2, 3, 4)]
    zipped = F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(group)])
    return F.transform(
        zipped,
        lambda m: _raw(
            m.getField("g0"), strip(m.getField("g1")), m.getField("g2"), m.getField("g3"),
            F.lit(str(DEFAULT_CONFIDENCE)),
        ),
    )


def from_table(text: Column) -> Column:
    """Raw entities from pipe-table rows of at least six cells; the first is empty."""
    rows = F.filter(
        F.transform(
            F.filter(
                F.transform(F.split(text, "\n", -1), strip),
                lambda line: F.contains(line, F.lit("|")),
            ),
            lambda line: F.transform(F.split(line, r"\|", -1), strip),
        ),
        lambda cells: F.size(cells) >= 6,
    )
    # A missing confidence has a default elsewhere; here an unreadable one rejects the row.
    return F.transform(rows, lambda c: _raw(c[1], c[2], c[3], c[4], c[5]))


READERS: dict[str, Callable[[Column], Column]] = {
    "json": from_json_array,
    "relaxed_json": lambda text: _raw_json(relax_json(text)),
    "lines": from_lines,
    "table": from_table,
}


def read_format(text: Column, method: str) -> Column:
    """``struct(found, rejected, failed)`` of one format.

    ``failed`` says that something that looked like the format could not be read.
    """

    def sort_out(raw: Column) -> Column:
        typed = F.coalesce(F.transform(raw, _coerce), empty_array(FOUND_TYPE))
        return let(
            typed,
            lambda t: F.struct(
                F.filter(t, is_complete).alias("found"),
                F.filter(t, lambda e: ~is_complete(e)).alias("rejected"),
                F.when(F.lit("json" in method), raw.isNull() & F.contains(text, F.lit("[")))
                .otherwise(F.exists(t, lambda e: ~is_complete(e)))
                .alias("failed"),
            ),
        )

    return let(READERS[method](text), sort_out)


def extract_expr(raw_response: Column) -> Column:
    """Try the formats in order; the first to give an entity wins.

    ``struct(parse_method, entities, rejected, errors)``.
    """

    def attempt(text: Column, left: list[str], errors: Column) -> Column:
        if not left:
            return F.struct(
                F.lit(None).cast("string").alias("parse_method"),
                empty_array(FOUND_TYPE).alias("entities"),
                empty_array(FOUND_TYPE).alias("rejected"),
                errors.alias("errors"),
            )
        method = left[0]

        def decide(r: Column) -> Column:
            grown = F.when(
                r.getField("failed"), F.concat(errors, F.array(F.lit(f"{method}: not readable")))
            ).otherwise(errors)
            return F.when(
                F.size(r.getField("found")) > 0,
                F.struct(
                    F.lit(method).alias("parse_method"),
                    r.getField("found").alias("entities"),
                    r.getField("rejected").alias("rejected"),
                    grown.alias("errors"),
                ),
            ).otherwise(let(grown, lambda e: attempt(text, left[1:], e)))

        return let(read_format(text, method), decide)

    return let(
        clean_response(raw_response), lambda text: attempt(text, list(METHODS), empty_array("string"))
    )


def extract(df: DataFrame, response_col: str = "raw_response") -> DataFrame:
    """Add ``parse_method``, ``entities``, ``rejected`` and ``errors``."""
    return (
        df.withColumn("__read", extract_expr(F.col(response_col)))
        .select("*", "__read.*")
        .drop("__read")
    )


# --- grounding ------------------------------------------------------------------


def _no_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\W", "")


def lower_in_place(text: Column) -> Column:
    """Lower case with every character where it was: one whose lower case is two stays as it is."""

    def each(t: Column) -> Column:
        lower = F.lower(t)
        apart = F.transform(F.split(t, "", -1), lambda c: F.when(F.length(F.lower(c)) == 1, F.lower(c)).otherwise(c))
        return F.when(F.length(lower) == F.length(t), lower).otherwise(F.array_join(apart, ""))

    return let(text, each)


def _loose_place(chars: Column, size: Column, bare: Column, width: Column) -> Column:
    """Where ``width`` characters in a row hold just the letters of ``bare``; null if nowhere.

    The letters of the text are laid out once, each with its place. Where ``bare`` is among
    them, the window may begin at any place that takes in its letters and no others.
    """

    def lower(c: Column) -> Column:  # one letter stays one
        return F.when(F.length(F.lower(c)) == 1, F.lower(c)).otherwise(c)

    def search(at: Column) -> Column:
        letters = F.array_join(F.transform(at, lambda i: lower(chars[i])), "")
        m = F.length(bare)

        def among(parts: Column) -> Column:
            starts = running_starts(F.transform(parts, lambda p: F.length(p) + m))

            def window(k: Column) -> Column:
                before = F.coalesce(F.get(at, k - 1), F.lit(-1))
                after = F.coalesce(F.get(at, k + m), size)
                low = F.greatest(before + 1, F.get(at, k + m - 1) + 1 - width)
                return F.when(low <= F.least(F.get(at, k), after - width), low)

            def first(s: Column) -> Column:
                numbers = F.sequence(F.lit(0), F.size(parts) - 2)
                places = F.transform(numbers, lambda j: window(s[j] + F.length(parts[j])))
                return F.try_element_at(F.array_compact(places), F.lit(1))

            return F.when(F.size(parts) > 1, let(starts, first))

        return let(F.split(letters, bare, -1), among)

    numbers = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)))
    return let(F.filter(numbers, lambda i: _no_punctuation(chars[i]) != ""), search)


def ground_entity(
    e: Column, text: Column, size: Column, min_confidence: float = MIN_CONFIDENCE,
    max_offset: int = MAX_OFFSET, partial: bool = True,
) -> Column:
    """Place one entity in ``text`` of ``size`` characters; null if it cannot be placed.

    ``repair`` names the way it was placed. The confidence floor holds for
    entities that were right as they came. Searches walk through the whole text,
    so each is made once and only when nothing before it did.
    """
    get = e.getField

    def placed(
        repair: str, start: Column, end: Column, value: Column, factor: float, searched: bool = False
    ) -> Column:
        note = F.format_string(
            f"position corrected by {repair.replace('_', ' ')} (was %d-%d)", get("start"), get("end")
        )
        return F.struct(
            get("entity_type").alias("entity_type"),
            start.alias("start"),
            end.alias("end"),
            (get("confidence") * F.lit(factor)).alias("score"),
            F.lit("model").alias("recognizer"),
            F.lit("response").alias("pattern"),
            get("confidence").alias("pattern_score"),
            value.alias("value"),
            (F.lit(True) if searched else get("is_inferred")).alias("is_inferred"),
            (note if searched else get("notes")).alias("notes"),
            get("metadata").alias("metadata"),
            F.lit(repair).alias("repair"),
        ).cast(GROUNDED_TYPE)

    def search(v: Column) -> Column:
        width = F.length(v)

        def loose(bare: Column) -> Column:
            # The first window as long as the value that equals it but for case and punctuation.
            first = let(F.split(text, "", -1), lambda cs: _loose_place(cs, size, bare, width))
            worth_it = (F.length(bare) >= 3) & (
                F.instr(_no_punctuation(F.lower(text)), bare) > 0
            )
            return F.when(
                worth_it,
                let(
                    first,
                    lambda at: F.when(
                        at.isNotNull(),
                        placed(
                            "loose_search", at, at + width, slice_text(text, at, at + width), 0.7, True
                        ),
                    ),
                ),
            )

        def any_case(at: Column) -> Column:
            found = placed(
                "case_search", at, at + width, slice_text(text, at, at + width), 0.8, True
            )
            return F.when(at >= 0, found).otherwise(let(_no_punctuation(F.lower(v)), loose))

        def exact(at: Column) -> Column:
            return F.when(at >= 0, placed("search", at, at + width, v, 0.9, True)).otherwise(
                let(F.instr(lower_in_place(text), lower_in_place(v)) - 1, any_case)
            )

        return let(F.instr(text, v) - 1, exact)

    def near(end: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(get("value"), r"(?U)[^\w\s]", ""), r"(?U)\s", "")
        low = F.greatest(get("start") - max_offset, F.lit(0))
        region = slice_text(text, low, F.least(end + max_offset, size))
        return let(
            bare,
            lambda b: F.when(
                F.length(b) > 0,
                let(
                    F.instr(region, b) - 1,
                    lambda at: F.when(
                        at >= 0, placed("near", low + at, low + at + F.length(b), b, 0.7)
                    ),
                ),
            ),
        )

    def mismatch(v: Column, here: Column, end: Column) -> Column:
        moved = let(
            F.instr(text, v) - 1,
            lambda at: F.when(at >= 0, placed("moved", at, at + F.length(v), v, 1.0)).otherwise(
                near(end)
            ),
        )
        if not partial:
            return moved

        def shortened(bare: Column) -> Column:
            return F.when(
                F.contains(v, bare),
                F.when(F.length(bare) > 0, placed("shortened", get("start"), end, bare, 0.8)),
            ).otherwise(moved)

        def narrowed(inner: Column) -> Column:
            start = get("start") + inner
            return F.when(
                inner >= 0, placed("narrowed", start, start + F.length(v), v, 0.9)
            ).otherwise(let(strip(here), shortened))

        return let(F.instr(here, v) - 1, narrowed)

    def in_text(v: Column) -> Column:
        end = F.least(get("end"), size)

        def compare(here: Column) -> Column:
            return F.when(
                here == get("value"),
                F.when(
                    get("confidence") >= min_confidence,
                    placed("none", get("start"), end, here, 1.0),
                ),
            ).otherwise(mismatch(v, here, end))

        return (
            F.when(F.length(v) == 0, F.lit(None))
            .when(get("start") >= size, search(v))
            .otherwise(let(slice_text(text, get("start"), end), compare))
        )

    return let(strip(get("value")), in_text)


def ground_expr(entities: Column, text: Column, **options) -> Column:
    """Entities placed in ``text``; of overlapping ones the better stays; by start."""
    return grounding_expr(entities, text, **options).getField("spans")


def grounding_expr(entities: Column, text: Column, **options) -> Column:
    """``spans`` as in ``ground_expr``, and the entities that have no place in ``text``, ``unplaced``."""
    tried = let(
        F.length(text),
        lambda size: F.transform(
            entities,
            lambda e: F.struct(e.alias("entity"), ground_entity(e, text, size, **options).alias("span")),
        ),
    )

    def both(pairs: Column) -> Column:
        spans = F.array_compact(F.transform(pairs, lambda p: p.getField("span")))
        left = F.filter(pairs, lambda p: p.getField("span").isNull())
        return F.struct(
            greedy_expr(spans, GROUNDED_TYPE).alias("spans"),
            F.transform(left, lambda p: p.getField("entity")).alias("unplaced"),
        )

    return let(tried, both)


def ground(
    responses: DataFrame, documents: DataFrame, key: str = "doc_id", **options
) -> DataFrame:
    """Add ``spans``, ``unplaced`` and ``error`` to extracted responses, from the text of their ``key``.

    Every response comes out. One without a text has no spans, all its entities unplaced
    and an ``error``; entities that are not found in their text are ``unplaced``. Nothing
    but key and text takes part in the shuffle; a plain join, so that a text with very
    many responses is split at run time.
    """
    texts = documents.select(key, F.col("text").alias("__text"))
    placed = responses.join(texts, key, "left").withColumn(
        "__placed", grounding_expr(F.col("entities"), F.col("__text"), **options)
    )
    known = F.col("__text").isNotNull()
    return (
        placed.withColumn("spans", F.when(known, F.col("__placed.spans")).otherwise(F.array().cast(f"array<{GROUNDED_TYPE}>")))
        .withColumn("unplaced", F.when(known, F.col("__placed.unplaced")).otherwise(F.col("entities")))
        .withColumn("error", F.when(~known, "no text for this response"))
        .drop("__text", "__placed")
    )


def unplaced_entities(grounded: DataFrame, *keys: str) -> DataFrame:
    """One row per entity without a place, with why."""
    why = F.coalesce("error", F.lit("not found in the text"))
    return grounded.select(
        *keys, why.alias("error"), F.inline(F.filter("unplaced", lambda e: e.isNotNull()))
    ).select(*keys, "entity_type", "value", "start", "end", "error")
