"""Narratives named by enrichments."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.times import before


def narrative_mentions(analyses: DataFrame) -> DataFrame:
    """One row per post and narrative named (columns id, narratives, sentiment, at)."""
    return analyses.select("id", F.explode("narratives").alias("name"), "sentiment", "at")


def narrative_rollup(mentions: DataFrame, as_of: datetime, active_days: int = 7) -> DataFrame:
    last = F.col("last_mentioned_at")
    return (
        mentions.groupBy("name")
        .agg(
            F.count(F.lit(1)).alias("mention_count"),
            F.min("at").alias("first_seen_at"),
            F.max("at").alias("last_mentioned_at"),
            F.max_by("sentiment", F.when(F.col("sentiment").isNotNull(), F.struct("at", "id"))).alias("sentiment"),
        )
        .withColumn("active", last >= before(as_of, days=active_days))
    )


def active_narratives(rollup: DataFrame) -> DataFrame:
    return rollup.where("active").orderBy(F.col("last_mentioned_at").desc(), "name")


def narrative_links(mentions: DataFrame) -> DataFrame:
    return mentions.select("id", "name").distinct()
