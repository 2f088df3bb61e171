"""Model usage: attempts folded from events, summaries, prices and costs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import constants as C
from tidewire.functions.text import strip
from tidewire.functions.times import before
from tidewire.operators.skew import lookup, materialize
from tidewire.schemas import MODEL_PRICE

TOKENS = ["input_tokens", "output_tokens", "reasoning_tokens", "cached_input_tokens", "total_tokens"]


def model_prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.MODEL_PRICES, MODEL_PRICE)


def fold_attempts(events: DataFrame) -> DataFrame:
    """Started and completed events (``phase`` 0, 1) -> one row per attempt.

    The completed event wins column by column where it says something; error texts are cut to 500 characters.
    """
    names = [c for c in events.columns if c not in ("attempt_id", "phase")]
    last = [F.max_by(n, F.when(F.col(n).isNotNull(), F.col("phase"))).alias(n) for n in names]
    folded = events.groupBy("attempt_id").agg(*last)
    if "error_message" in names:
        folded = folded.withColumn("error_message", F.substring("error_message", 1, 500))
    return folded


def _key(value: Column) -> Column:
    return F.lower(strip(value))


def price_of_models(models: DataFrame, prices: DataFrame) -> DataFrame:
    """(provider, model) pairs -> price by the longest configured prefix (an exact name is the longest one).

    Prefixes are exploded so that the match is an equality join, not a theta join.
    """
    pairs = models.select("provider", "model").distinct()
    prefixes = pairs.select(
        "provider",
        "model",
        _key(F.col("provider")).alias("provider_key"),
        F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(_key(F.col("model"))), F.lit(1))),
                              lambda n: F.substring(_key(F.col("model")), F.lit(1), n))).alias("model_key"),
    )
    known = prices.select(
        F.col("provider").alias("provider_key"), F.col("model").alias("model_key"),
        F.struct("input_per_million", "output_per_million", "cached_input_per_million").alias("price"),
    )
    return (
        prefixes.join(known, ["provider_key", "model_key"])
        .groupBy("provider", "model")
        .agg(F.max_by("price", F.length("model_key")).alias("price"))
    )


def cost(price: Column, provider: Column, tokens: dict[str, Column]) -> Column:
    """USD for token counts; an unknown price costs nothing. Only one provider bills reasoning on top of output."""
    amount = {n: F.coalesce(c, F.lit(0)).cast("double") for n, c in tokens.items()}
    cached = F.greatest(F.lit(0.0), amount["cached_input_tokens"])
    fresh = F.greatest(F.lit(0.0), amount["input_tokens"] - cached)
    extra = F.when(_key(provider) == "gemini", amount["reasoning_tokens"]).otherwise(0.0)
    billed = F.greatest(F.lit(0.0), amount["output_tokens"] + extra)
    cached_rate = F.coalesce(price["cached_input_per_million"], price["input_per_million"])
    total = (
        fresh / 1_000_000 * price["input_per_million"]
        + cached / 1_000_000 * cached_rate
        + billed / 1_000_000 * price["output_per_million"]
    )
    return F.coalesce(total, F.lit(0.0))


def per_call_cost(attempts: DataFrame, prices: DataFrame) -> DataFrame:
    """Every attempt with ``cost_usd``. The attempts (folded from events, narrow) are read three times, so written once."""
    attempts = materialize(attempts)
    priced = price_of_models(attempts, prices).withColumn("pair", F.concat_ws("\x01", "provider", "model"))
    calls = attempts.withColumn("pair", F.concat_ws("\x01", "provider", "model"))
    joined = lookup(calls, priced.select("pair", "price"), "pair")
    value = cost(F.col("price"), F.col("provider"), {n: F.col(n) for n in TOKENS})
    return joined.withColumn("cost_usd", value).drop("pair", "price")


def usage_summary(
    attempts: DataFrame,
    as_of: datetime | None = None,
    days: int | None = None,
    provider: str | None = None,
    model: str | None = None,
    component: str | None = None,
) -> DataFrame:
    """Calls, outcomes, tokens, stored cost and mean latency per component, provider and model."""
    rows = attempts
    if days is not None and as_of is not None:
        rows = rows.where(F.col("called_at") >= before(as_of, days=days))
    for name, value in {"provider": provider, "model": model, "component": component}.items():
        if value:
            rows = rows.where(F.col(name) == value)
    started = F.coalesce("attempt_status", F.lit("completed")) == "started"
    return rows.groupBy("component", "provider", "model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if("success").alias("successes"),
        F.count_if(~F.col("success") & ~started).alias("failures"),
        F.count_if(started).alias("incomplete_attempts"),
        *[F.sum(n).alias(n) for n in TOKENS],
        F.sum("estimated_cost_usd").alias("stored_estimated_cost_usd"),
        F.avg("latency_seconds").alias("avg_latency_seconds"),
    )


def reestimated_cost(summary: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost on the summed tokens (cached tokens are taken off after summing), dearest first. The summary is read for its
    models and again for its sums, so it is written once: one row for each component and model."""
    summary = materialize(summary)
    priced = summary.join(price_of_models(summary, prices), ["provider", "model"], "left")
    value = cost(F.col("price"), F.col("provider"), {n: F.col(n) for n in TOKENS})
    return (
        priced.withColumn("reestimated_cost_usd", value)
        .drop("price")
        .orderBy(F.col("reestimated_cost_usd").desc(), F.col("calls").desc(), "component", "provider", "model")
    )


def usage_totals(summary: DataFrame) -> DataFrame:
    names = ["calls", "successes", "failures", "incomplete_attempts", *TOKENS, "stored_estimated_cost_usd",
             "reestimated_cost_usd"]
    return summary.agg(*[F.sum(n).alias(n) for n in names if n in summary.columns])
