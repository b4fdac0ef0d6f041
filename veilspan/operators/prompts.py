"""Prompt tables and the question which model calls are still to be made."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CACHE_TTL_SECONDS = 3600
VARIABLE = r"\{\{\s*(\w+)\s*\}\}"


def render_prompt(template: str | Column, **variables: str | Column | list[str]) -> Column:
    """Fill ``{{ name }}`` marks in the order given; lists are joined by a comma and a space."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in variables.items():
        if isinstance(value, list):
            value = ", ".join(value)
        filled = F.lit(value) if isinstance(value, str) else value.cast("string")
        out = F.replace(out, F.lit("{{ " + name + " }}"), filled)
    return out


def template_variables(template: Column) -> Column:
    """Names of the variables of a template, each once, sorted."""
    return F.array_sort(
        F.array_distinct(F.regexp_extract_all(template, F.lit(VARIABLE), F.lit(1)))
    )


def missing_variables(template: Column, given: list[str]) -> Column:
    names = F.array(*[F.lit(n) for n in given]).cast("array<string>")
    return F.array_except(template_variables(template), names)


def cache_key(prompt: Column, model: str | None = None, temperature: float | None = None) -> Column:
    """Digest of what decides an answer; absent settings are left out."""
    fields = []
    if model is not None:
        fields.append(F.lit(model).alias("model"))
    fields.append(prompt.alias("prompt"))
    if temperature is not None:
        fields.append(F.lit(temperature).alias("temperature"))
    return F.md5(F.to_json(F.struct(*fields)))


def live_cache(
    cache: DataFrame, now: dt.datetime, ttl_seconds: int = CACHE_TTL_SECONDS
) -> DataFrame:
    """Cache entries young enough to use, the latest answer per key."""
    age = F.lit(now).cast("timestamp").cast("long") - F.col("created_at").cast("long")
    return (
        cache.filter(age <= ttl_seconds)
        .groupBy("key")
        .agg(F.max_by("response", F.struct("created_at", "response")).alias("response"))
    )


def calls_to_make(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct prompts without a usable answer.

    Copies of a prompt collapse before the join, first within each task, so that a
    prompt that makes up much of the table is no hot key.
    """
    distinct = prompts.groupBy("key").agg(F.min("prompt").alias("prompt"))
    return distinct.join(cache.select("key"), "key", "left_anti")


def request_counters(prompts: DataFrame, cache: DataFrame, responses: DataFrame) -> DataFrame:
    """One row: requests, cache hits, calls, errors, retries and tokens.

    ``responses`` has ``key``, ``error``, ``tokens`` and, if calls were made again,
    ``attempts`` (all attempts but the first are retries).
    """
    by_key = prompts.groupBy("key").agg(F.count("*").alias("n"))
    hits = by_key.join(cache.select("key", F.lit(True).alias("cached")), "key", "left")
    asked = hits.select(
        F.col("n").alias("total_requests"),
        F.when(F.col("cached"), F.col("n")).otherwise(0).alias("cache_hits"),
        F.when(F.col("cached").isNull(), 1).otherwise(0).alias("calls"),
    )
    attempts = F.col("attempts") if "attempts" in responses.columns else F.lit(1)
    answered = responses.select(
        F.when(F.col("error").isNotNull(), 1).otherwise(0).alias("errors"),
        F.greatest(F.coalesce(attempts, F.lit(1)) - 1, F.lit(0)).alias("retries"),
        F.coalesce("tokens", F.lit(0)).alias("total_tokens"),
    )
    both = asked.unionByName(answered, allowMissingColumns=True)
    names = ["total_requests", "cache_hits", "calls", "errors", "retries", "total_tokens"]
    return both.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names])
