"""Counts and averages over posts, reactions, logs and golden sets."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.times import EASTERN, before
from tidewire.operators.skew import newest


def _day(posts: DataFrame, day: date | None, day_tz: str) -> DataFrame:
    if day is None:
        return posts
    start = F.to_utc_timestamp(F.lit(day).cast("timestamp"), day_tz)
    end = F.to_utc_timestamp(F.date_add(F.lit(day), 1).cast("timestamp"), day_tz)
    return posts.where((F.col("created_at") >= start) & (F.col("created_at") < end))


def post_stats(posts: DataFrame, day: date | None = None, day_tz: str = EASTERN) -> DataFrame:
    processed = F.col("processed_at").isNotNull()
    return _day(posts, day, day_tz).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(processed).alias("processed"),
        F.count_if(~processed).alias("pending"),
        F.avg("score").alias("avg_score"),
        F.count_if(F.col("score") >= 7).alias("high_signal"),
        F.count_if(F.col("score") >= 5).alias("digest_worthy"),
    )


def processed_counts(posts: DataFrame, as_of: datetime) -> DataFrame:
    at = F.col("processed_at")
    spans = {"last_hour": {"hours": 1}, "last_24h": {"hours": 24}, "last_7d": {"days": 7}}
    return posts.agg(*[F.count_if(at >= before(as_of, **span)).alias(name) for name, span in spans.items()])


def category_counts(posts: DataFrame) -> DataFrame:
    """Processed posts per category; counted per distinct list first so few rows are exploded and shuffled."""
    lists = posts.where(F.col("processed_at").isNotNull()).groupBy("categories").agg(F.count(F.lit(1)).alias("n"))
    return (
        lists.select(F.explode("categories").alias("category"), "n")
        .groupBy("category")
        .agg(F.sum("n").alias("count"))
        .orderBy(F.col("count").desc(), "category")
    )


def ticker_counts(posts: DataFrame, limit: int = 50) -> DataFrame:
    tickers = posts.where(F.col("processed_at").isNotNull()).select(F.explode("tickers").alias("t"))
    return (
        tickers.groupBy(F.upper("t").alias("ticker"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), "ticker")
        .limit(limit)
    )


def bookmark_counts(posts: DataFrame) -> DataFrame:
    counted = posts.where("bookmarked").groupBy("author_handle").agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.col("count").desc(), "author_handle")


def reaction_summary(reactions: DataFrame) -> DataFrame:
    return reactions.groupBy("reaction_type").agg(F.count(F.lit(1)).alias("count"))


def alert_count(alert_log: DataFrame, as_of: datetime, minutes: int = 60) -> DataFrame:
    return alert_log.agg(F.count_if(F.col("sent_at") >= before(as_of, minutes=minutes)).alias("alerts"))


def fetch_summary(fetch_log: DataFrame) -> DataFrame:
    return fetch_log.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("fetched").alias("fetched"), F.sum("new").alias("new")
    )


def run_tier_counts(results: DataFrame, run: str, threshold: float = 7) -> DataFrame:
    score = F.col("score")
    return results.groupBy(run).agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(score >= threshold + 1).alias("high_signal"),
        F.count_if((score >= threshold - 1) & (score < threshold + 1)).alias("market_relevant"),
    )


# Canary trigger: rows that expect it are left out of precision and recall, predictions of it count as none.
_CANARY = "vol_substitution"
_GATES = {
    "band_accuracy": 0.60,
    "surprise_accuracy": 0.60,
    "stale_accuracy": 0.75,
    "trigger_precision": 0.70,
    "trigger_recall": 0.70,
    "catalyst_accuracy": 0.70,
    "direction_accuracy": 0.60,
}


def golden_eval(golden: DataFrame, results: DataFrame, order: str = "seq") -> DataFrame:
    """Expected bands and labels against scorer output: one row of accuracies and whether all gates pass.

    Of several results for an id the last by ``order`` counts; without such a column, one chosen by its content.
    """
    total, got = F.count(F.lit(1)), F.col("r").isNotNull()
    want, have = F.col("expected"), F.col("r")
    last_by = newest(results, order) if order in results.columns else F.xxhash64(*results.columns)
    last = results.groupBy("id").agg(F.max_by(F.struct(*[c for c in results.columns if c != "id"]), last_by).alias("r"))
    joined = golden.select("id", "expected").join(last, "id", "left")
    expected_trigger = F.nullif(want["playbook_trigger"], F.lit(""))
    actual_trigger = F.nullif(F.nullif(have["playbook_trigger"], F.lit(_CANARY)), F.lit(""))
    counted = F.coalesce(expected_trigger != _CANARY, F.lit(True))
    hit = F.coalesce(actual_trigger == expected_trigger, F.lit(False))

    def share(test: Column, name: str) -> Column:
        return F.coalesce(F.count_if(got & test) / F.nullif(total, F.lit(0)), F.lit(0.0)).alias(name)

    tp = F.count_if(counted & got & hit)
    fp = F.count_if(counted & got & ~hit & actual_trigger.isNotNull())
    fn = F.count_if(counted & ~hit & expected_trigger.isNotNull())
    ratio = lambda n, d: F.when(d > 0, n / d).otherwise(F.when(total == 0, 0.0).otherwise(1.0))
    report = joined.agg(
        total.alias("total"),
        share(have["score"].between(want["score_min"], want["score_max"]), "band_accuracy"),
        share(have["surprise"] == F.coalesce(want["surprise"], F.lit(0)), "surprise_accuracy"),
        share(have["is_stale_repeat"] == F.coalesce(want["is_stale_repeat"], F.lit(False)), "stale_accuracy"),
        ratio(tp, tp + fp).alias("trigger_precision"),
        ratio(tp, tp + fn).alias("trigger_recall"),
        share(have["catalyst_status"].eqNullSafe(want["catalyst"]), "catalyst_accuracy"),
        share(have["direction"] == F.coalesce(want["direction"], F.lit("na")), "direction_accuracy"),
    )
    passed = F.col("total") >= 20
    for name, gate in _GATES.items():
        passed = passed & (F.col(name) >= gate)
    return report.withColumn("passed", passed)
