"""Helpers for working on arrays inside one row, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Arrays are folded in runs of this many elements, so that the appends inside
# a fold copy short runs only and the cost stays near linear in the array.
RUN_LENGTH = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``.

    Columns are expression trees: naming one in Python does not stop Spark from
    evaluating it at every use inside a lambda. A one-element array does.
    """
    return F.transform(F.array(value), body)[0]


def literal_array(values: Sequence[str | float]) -> Column:
    """A constant array; no SQL text, whose escapes depend on a setting."""
    return F.array(*[F.lit(v if isinstance(v, str) else float(v)) for v in values])


def empty_array(element_type: str) -> Column:
    return F.array().cast(f"array<{element_type}>")


def step_result(state: Column, out: Column) -> Column:
    return F.struct(state.alias("state"), out.alias("out"))


def fold_emit(
    items: Column,
    state: Column,
    step: Callable[[Column, Column], Column],
    emit_type: str,
) -> Column:
    """Run a sequential recurrence over an array and keep what it emits.

    ``step(state, item)`` gives ``struct(state, out)``: the next state and an array
    of what is emitted, of ``emit_type``. So does the whole: the last state and
    all that was emitted.
    """

    def advance(acc: Column, item: Column) -> Column:
        return let(
            step(acc.getField("state"), item),
            lambda r: F.struct(
                r.getField("state").alias("state"),
                F.when(F.size(r.getField("out")) == 0, acc.getField("out"))
                .otherwise(F.concat(acc.getField("out"), r.getField("out")))
                .alias("out"),
            ),
        )

    def one_run(acc: Column, run: Column) -> Column:
        folded = F.aggregate(
            run,
            F.struct(acc.getField("state").alias("state"), empty_array(emit_type).alias("out")),
            advance,
        )
        # Not a ``let``, which would copy all runs so far each time.
        return F.aggregate(
            F.array(folded),
            acc,
            lambda a, r: F.struct(
                r.getField("state").alias("state"),
                F.concat(a.getField("runs"), F.array(r.getField("out"))).alias("runs"),
            ),
        )

    def all_runs(xs: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(1), F.size(xs), F.lit(RUN_LENGTH)),
            lambda first: F.slice(xs, first, F.lit(RUN_LENGTH)),
        )
        folded = F.aggregate(
            runs,
            F.struct(
                state.alias("state"),
                F.array().cast(f"array<array<{emit_type}>>").alias("runs"),
            ),
            one_run,
        )
        return let(
            folded,
            lambda r: F.struct(
                r.getField("state").alias("state"),
                F.flatten(r.getField("runs")).alias("out"),
            ),
        )

    def one_short_run(xs: Column) -> Column:
        return F.aggregate(
            xs, F.struct(state.alias("state"), empty_array(emit_type).alias("out")), advance
        )

    return let(
        items,
        lambda xs: F.when(F.size(xs) <= RUN_LENGTH, one_short_run(xs)).otherwise(all_runs(xs)),
    )


def running_starts(lengths: Column) -> Column:
    """Exclusive prefix sums of an ``array<int>``: where each piece starts."""

    def one_run(total: Column, run: Column) -> Column:
        return F.aggregate(
            run,
            F.struct(total.alias("total"), empty_array("int").alias("out")),
            lambda acc, n: F.struct(
                (acc.getField("total") + n).alias("total"),
                F.concat(acc.getField("out"), F.array(acc.getField("total"))).alias("out"),
            ),
        )

    def all_runs(ns: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(1), F.size(ns), F.lit(RUN_LENGTH)),
            lambda first: F.slice(ns, first, F.lit(RUN_LENGTH)),
        )
        folded = F.aggregate(
            runs,
            F.struct(F.lit(0).alias("total"), F.array().cast("array<array<int>>").alias("runs")),
            lambda acc, run: F.aggregate(
                F.array(one_run(acc.getField("total"), run)),
                acc,
                lambda a, r: F.struct(
                    r.getField("total").alias("total"),
                    F.concat(a.getField("runs"), F.array(r.getField("out"))).alias("runs"),
                ),
            ),
        )
        return F.flatten(folded.getField("runs"))

    return let(
        lengths,
        lambda ns: F.when(F.size(ns) == 1, F.array(F.lit(0)))
        .when(F.size(ns) <= RUN_LENGTH, one_run(F.lit(0), ns).getField("out"))
        .otherwise(all_runs(ns)),
    )
