"""Short links resolved from a table of known targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import non_blank, or_blank
from tidewire.functions.urls import clean_url, display_url, is_short
from tidewire.operators.skew import lookup
from tidewire.schemas import LINKS

MAX_EXPANSIONS = 2


def expand_short_urls(posts: DataFrame, url_map: DataFrame) -> DataFrame:
    """Links with short targets replaced by the target in ``url_map`` (url, target); the first two per post.

    Only posts that hold a short link are exploded and joined; the others keep their row untouched.
    """
    cleaned = F.transform(
        F.coalesce("links", F.array().cast(LINKS)),
        lambda k: F.struct(
            clean_url(k["url"]).alias("url"),
            F.coalesce(F.nullif(clean_url(k["expanded_url"]), F.lit("")), clean_url(k["url"])).alias("expanded_url"),
            or_blank(k["display_url"]).alias("display_url"),
        ),
    )
    rows = posts.withColumn("links", cleaned)
    # Positions of the links that may be resolved.
    open_at = F.slice(
        F.filter(
            F.transform("links", lambda k, i: F.when(is_short(k["expanded_url"]), i)), lambda i: i.isNotNull()
        ), 1, MAX_EXPANSIONS,
    )
    asked = rows.select("id", F.explode(open_at).alias("pos"), "links").select(
        "id", "pos", F.get("links", F.col("pos"))["expanded_url"].alias("url")
    )
    answers = (
        lookup(asked, url_map.select("url", "target"), "url", "inner")
        .groupBy("id")
        .agg(F.map_from_entries(F.collect_list(F.struct("pos", clean_url(F.col("target")).alias("target")))).alias("found"))
    )

    def resolve(k, i):
        target = F.coalesce(F.try_element_at("found", i), k["expanded_url"])
        shown = F.coalesce(non_blank(k["display_url"]), display_url(target))
        return F.struct(k["url"].alias("url"), target.alias("expanded_url"), shown.alias("display_url"))

    return rows.join(answers, "id", "left").withColumn("links", F.transform("links", resolve)).drop("found")
