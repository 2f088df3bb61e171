"""Media analysis cache: latest result per image and model, hits and misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import non_blank, or_blank, strip
from tidewire.operators.skew import lookup, newest


def cache_key(url: Column, provider: Column, model: Column) -> Column:
    """One key column; null where a part is missing."""
    parts = [strip(or_blank(url)), F.lower(strip(or_blank(provider))), F.lower(strip(or_blank(model)))]
    complete = (parts[0] != "") & (parts[1] != "") & (parts[2] != "")
    return F.when(complete, F.concat_ws("\x01", *parts))


def cache_latest(log: DataFrame) -> DataFrame:
    """Newest result and number of hits per (url, provider, model); ``is_hit`` rows carry no result. Ties as in
    ``latest_scores``."""
    rows = log.withColumn("cache_key", cache_key(F.col("media_url"), F.col("provider"), F.col("model")))
    stored = ~F.col("is_hit")
    return (
        rows.where(F.col("cache_key").isNotNull())
        .groupBy("cache_key")
        .agg(
            F.max_by(F.struct("media_url", "provider", "model", "result"), F.when(stored, newest(log, "updated_at"))).alias("r"),
            F.max(F.when(stored, F.col("updated_at"))).alias("updated_at"),
            F.count_if("is_hit").alias("hits"),
        )
        .where(F.col("updated_at").isNotNull())
        .select("cache_key", strip(F.col("r.media_url")).alias("media_url"), F.lower(strip(F.col("r.provider"))).alias("provider"),
                F.lower(strip(F.col("r.model"))).alias("model"), F.col("r.result").alias("result"), "updated_at", "hits")
    )


def pending_media(posts: DataFrame) -> DataFrame:
    """Exploded media items with a URL that nobody has analysed yet."""
    items = posts.select("id", F.posexplode("media_items").alias("pos", "item"))
    item = F.col("item")
    names = [f for f in ("kind", "prose_text", "short_description") if f in posts.schema["media_items"].dataType.elementType.names]
    open_item = non_blank(strip(item["url"])).isNotNull()
    for name in names:
        open_item = open_item & (or_blank(item[name]) == "")
    return items.where(open_item).select("id", "pos", item["url"].alias("url"))


def cache_lookup(pending: DataFrame, cache: DataFrame, provider: str, model: str) -> DataFrame:
    """Pending items with the cached result, or null where the image has to be analysed.

    One picture may be attached to a large share of the posts, hence the hot-key join.
    """
    keyed = pending.withColumn("cache_key", cache_key(F.col("url"), F.lit(provider), F.lit(model)))
    return lookup(keyed, cache.select("cache_key", F.col("result").alias("cached")), "cache_key").drop("cache_key")


def cache_misses(pending: DataFrame, cache: DataFrame, provider: str, model: str) -> DataFrame:
    """Distinct images to analyse: each once, before any costly work."""
    urls = pending.select(strip(F.col("url")).alias("url")).distinct()
    keyed = urls.withColumn("cache_key", cache_key(F.col("url"), F.lit(provider), F.lit(model)))
    return keyed.join(cache.select("cache_key"), "cache_key", "left_anti").select("url")
