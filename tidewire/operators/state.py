"""Current state of a post derived from append-only logs of results, marks and expansions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import constants as C
from tidewire.functions.times import at, before
from tidewire.operators.skew import lookup, newest


def tier_rank(tier: Column) -> Column:
    rank = F.lit(-1)
    for name, value in C.SIGNAL_TIER_RANK.items():
        rank = F.when(tier == name, value).otherwise(rank)
    return rank


def latest_scores(results: DataFrame, order: str = "processed_at") -> DataFrame:
    """Last result per post; it replaces every score column, also by null. Of results at one time the one with the
    greatest ``seq`` is the last, where they have one."""
    others = [c for c in results.columns if c != "id"]
    last = F.max_by(F.struct(*others), newest(results, order)).alias("r")
    return results.groupBy("id").agg(last).select("id", "r.*")


def _last_present(log: DataFrame, name: str, order: str) -> Column:
    return F.max_by(name, F.when(F.col(name).isNotNull(), newest(log, order))).alias(name)


def apply_enrichment(log: DataFrame, order: str = "at") -> DataFrame:
    """Per column the latest non-null value; ties as in ``latest_scores``."""
    return log.groupBy("id").agg(*[_last_present(log, c, order) for c in log.columns if c not in ("id", order, "seq")])


def apply_article(log: DataFrame, order: str = "at") -> DataFrame:
    """As enrichment; the short summary is the link summary too; a row with ``set_top_visual`` may clear it."""
    rest = [c for c in log.columns if c not in ("id", order, "seq", "top_visual", "set_top_visual")]
    visual = F.max_by(F.struct("top_visual"), F.when(F.col("set_top_visual"), newest(log, order)))
    state = log.groupBy("id").agg(
        *[_last_present(log, c, order) for c in rest], visual["top_visual"].alias("top_visual")
    )
    return state.withColumn("link_summary", F.col("short_summary"))


def stronger_tier(existing: Column, candidate: Column) -> Column:
    """The stronger tier; equal or unknown keeps the existing one."""
    existing, candidate = F.nullif(existing, F.lit("")), F.nullif(candidate, F.lit(""))
    return (
        F.when(existing.isNull(), candidate)
        .when(candidate.isNull(), existing)
        .when(tier_rank(candidate) > tier_rank(existing), candidate)
        .otherwise(existing)
    )


def merged_tickers(existing: Column, new: Column) -> Column:
    return F.when(F.size(new) > 0, F.array_sort(F.array_union(existing, new))).otherwise(existing)


def apply_analysis(posts: DataFrame, analyses: DataFrame, order: str = "at") -> DataFrame:
    """Latest analysis per post joined on: stronger tier kept, tickers united when the analysis names any."""
    fields = [c for c in analyses.columns if c != "id"]
    latest = analyses.groupBy("id").agg(F.max_by(F.struct(*fields), newest(analyses, order)).alias("analysis"))
    analysis = F.col("analysis")
    return posts.drop("analysis").join(latest, "id", "left").withColumns(
        {
            "signal_tier": stronger_tier(F.col("signal_tier"), analysis["signal_tier"]),
            "tickers": F.coalesce(merged_tickers(F.col("tickers"), analysis["tickers"]), F.col("tickers")),
        }
    )


def apply_link_expansion(posts: DataFrame, expansions: DataFrame) -> DataFrame:
    """Latest expansion (by ``seq``) replaces the links, unless a later observation added links."""
    latest = expansions.groupBy("id").agg(
        F.max_by(F.struct("seq", F.col("links").alias("expanded"), "expanded_at"), "seq").alias("x")
    )
    valid = F.col("x").isNotNull() & (F.col("x")["seq"] > F.coalesce("links_changed_seq", F.lit(-1)))
    return (
        posts.join(latest, "id", "left")
        .withColumn("links_expanded_at", F.when(valid, F.col("x")["expanded_at"]))
        .withColumn("links", F.when(valid, F.col("x")["expanded"]).otherwise(F.col("links")))
        .drop("x")
    )


def apply_bookmarks(posts: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """A bookmark sticks; the first bookmark time is kept."""
    first = bookmarks.groupBy("id").agg(F.min("at").alias("bookmarked_at"))
    return posts.join(first, "id", "left").withColumn("bookmarked", F.col("bookmarked_at").isNotNull())


def digest_marks(marks: DataFrame) -> DataFrame:
    return marks.groupBy("id").agg(F.max_by("digest_date", newest(marks, "marked_at")).alias("included_in_digest"))


def skip_stale_backlog(posts: DataFrame, older_than_days: int, as_of: datetime) -> DataFrame:
    """Score rows (to be appended) that close unprocessed posts older than the limit without scoring them."""
    days = max(0, older_than_days)
    stale = posts.where(F.col("processed_at").isNull() & (F.col("created_at") < before(as_of, days=days)))
    return stale.select(
        "id",
        F.lit(0.0).alias("score"),
        F.array(F.lit("skipped_stale")).alias("categories"),
        F.lit(f"Skipped stale backlog older than {days} days without LLM processing.").alias("summary"),
        F.lit("noise").alias("signal_tier"),
        at(as_of).alias("processed_at"),
    )


def prunable(as_of: datetime, days: int = 14) -> Column:
    """Old enough and already shown in a digest. A post without a time is never pruned."""
    old = F.coalesce(F.col("created_at") < before(as_of, days=days), F.lit(False))
    return old & F.col("included_in_digest").isNotNull()


def prune(posts: DataFrame, as_of: datetime, days: int = 14) -> DataFrame:
    return posts.where(~prunable(as_of, days))


def prune_count(posts: DataFrame, as_of: datetime, days: int = 14) -> DataFrame:
    return posts.select(F.count_if(prunable(as_of, days)).alias("pruned"))


def orphans_removed(rows: DataFrame, posts: DataFrame, post_column: str = "post_id") -> DataFrame:
    """Rows whose post still exists (after a prune)."""
    return lookup(rows, posts.select(F.col("id").alias(post_column)), post_column, "left_semi")
