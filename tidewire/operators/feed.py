"""Filtered, ranked pages over posts and the small tables hung on them."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import brief_text, fixed, non_blank, or_blank, retweet_parts, unescape_html
from tidewire.functions.times import before, in_range
from tidewire.functions.urls import display_text, link_kinds, post_url
from tidewire.operators.skew import counted_broadcast, lookup, newest
from tidewire.operators.state import tier_rank


def has_category(category: str) -> Column:
    return F.array_contains("categories", category)


def has_ticker(ticker: str, strict: bool = False) -> Column:
    """Upper-cased substring of any ticker, or equality when ``strict``."""
    wanted = ticker.upper()
    if strict:
        return F.exists("tickers", lambda t: F.upper(t) == wanted)
    return F.exists("tickers", lambda t: F.contains(F.upper(t), F.lit(wanted)))


def by_author(handle: str) -> Column:
    return F.col("author_handle") == handle.lstrip("@")


def filter_posts(
    posts: DataFrame,
    *,
    category: str | None = None,
    ticker: str | None = None,
    strict_ticker: bool = False,
    min_score: float | None = None,
    tier: str | None = None,
    author: str | None = None,
    bookmarked: bool = False,
    since: datetime | None = None,
    until: datetime | None = None,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Conjunction of the given filters; plain comparisons reach the scan."""
    tests = []
    if min_score is not None:
        tests.append(F.col("score") >= min_score)
    if tier:
        tests.append(F.col("signal_tier") == tier)
    if author:
        tests.append(by_author(author))
    if bookmarked:
        tests.append(F.col("bookmarked"))
    if since is not None or until is not None:
        tests.append(in_range(F.col("created_at"), since, until))
    if category:
        tests.append(has_category(category))
    if ticker:
        tests.append(has_ticker(ticker, strict_ticker))
    for test in tests:
        posts = posts.where(test)
    return posts if ids is None else restrict_to(posts, ids)


def restrict_to(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """Posts with an id in ``ids``; an empty set gives no rows."""
    return lookup(posts, ids, "id", "left_semi")


def _page(rows: DataFrame, keys: list[Column], limit: int, offset: int = 0) -> DataFrame:
    ordered = rows.orderBy(*keys, F.col("id"))
    return (ordered.offset(offset) if offset else ordered).limit(limit)


_ORDERS = {
    "latest": lambda: [F.col("created_at").desc_nulls_last()],
    "relevance": lambda: [F.col("score").desc_nulls_last(), F.col("created_at").desc_nulls_last()],
}


def feed(posts: DataFrame, *, order: str = "relevance", limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """One page of processed posts. Top-k runs per partition before rows move."""
    if order not in _ORDERS:
        raise ValueError(f"Invalid order: {order!r}. Must be one of {sorted(_ORDERS)}")
    rows = filter_posts(posts.where(F.col("processed_at").isNotNull()), **filters)
    return _page(rows, _ORDERS[order](), limit, offset)


def attach_reactions(page: DataFrame, reactions: DataFrame, page_rows: int) -> DataFrame:
    """Distinct reaction types for the posts of a page of at most ``page_rows`` rows, the limit it was cut with."""
    ids = page.select(F.col("id").alias("post_id"))
    types = (
        reactions.join(counted_broadcast(ids, page_rows), "post_id", "left_semi")
        .groupBy(F.col("post_id").alias("id"))
        .agg(F.array_sort(F.collect_set("reaction_type")).alias("reactions"))
    )
    empty = F.array().cast("array<string>")
    return page.join(counted_broadcast(types, page_rows), "id", "left").withColumn("reactions", F.coalesce("reactions", empty))


def page_envelope(page: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Row count of a page and whether another page may follow."""
    count = F.count(F.lit(1))
    return page.agg(
        count.alias("count"),
        F.lit(limit).alias("limit"),
        F.lit(offset).alias("offset"),
        (count == limit).alias("has_more"),
    )


def unprocessed(posts: DataFrame, limit: int = 50) -> DataFrame:
    return _page(posts.where(F.col("processed_at").isNull()), [F.col("created_at").desc_nulls_last()], limit)


def _has_quote() -> Column:
    return F.col("has_quote") & F.col("quote_id").isNotNull()


def reprocess_candidates(
    posts: DataFrame, day: date, min_score: float = 3, limit: int = 200, day_tz: str = "UTC"
) -> DataFrame:
    """Processed quotes and replies of one day that were not reprocessed yet, newest first."""
    start = F.to_utc_timestamp(F.lit(day).cast("timestamp"), day_tz)
    end = F.to_utc_timestamp(F.date_add(F.lit(day), 1).cast("timestamp"), day_tz)
    rows = posts.where(
        F.col("processed_at").isNotNull()
        & (_has_quote() | F.col("reply_id").isNotNull())
        & F.col("reprocessed_at").isNull()
        & (F.col("created_at") >= start)
        & (F.col("created_at") < end)
        & (F.col("score") >= min_score)
    )
    return _page(rows, [F.col("created_at").desc()], limit)


def enrichment_candidates(posts: DataFrame, threshold: float = 7, limit: int = 10) -> DataFrame:
    """High-scored posts without analysis, or with a quote or media but no media analysis."""
    no_media_analysis = F.col("media_analysis").isNull()
    rows = posts.where(
        (F.col("score") >= threshold)
        & F.col("signal_tier").isNotNull()
        & (F.col("analysis").isNull() | (_has_quote() & no_media_analysis) | (F.col("has_media") & no_media_analysis))
    )
    return _page(rows, [F.col("score").desc()], limit)


def posts_by_ids(posts: DataFrame, ids: DataFrame) -> DataFrame:
    return restrict_to(posts, ids)


def last_fetch(fetch_log: DataFrame) -> DataFrame:
    """The latest row of each endpoint; ties as in ``latest_scores``."""
    others = [c for c in fetch_log.columns if c != "endpoint"]
    last = F.max_by(F.struct(*others), newest(fetch_log, "executed_at")).alias("r")
    return fetch_log.groupBy("endpoint").agg(last).select(
        "endpoint", "r.*"
    )


def digest(posts: DataFrame, day: date, min_score: float = 5, day_tz: str = "UTC") -> DataFrame:
    """Posts of a day worth a digest, strongest tier first, best score first; noise is left out.

    The order is a range-partitioned sort, not a window, so a tier with most of the posts is no bottleneck.
    """
    start = F.to_utc_timestamp(F.lit(day).cast("timestamp"), day_tz)
    end = F.to_utc_timestamp(F.date_add(F.lit(day), 1).cast("timestamp"), day_tz)
    rank = tier_rank(F.col("signal_tier"))
    return (
        posts.where(
            F.col("processed_at").isNotNull()
            & (F.col("score") >= min_score)
            & (F.col("created_at") >= start)
            & (F.col("created_at") < end)
        )
        .withColumn("tier_rank", rank)
        .where(F.col("tier_rank") > 0)
        .orderBy(F.col("tier_rank").desc(), F.col("score").desc(), "id")
    )


def digest_mark_rows(selection: DataFrame, day: date, marked_at: datetime) -> DataFrame:
    """Rows to append to the digest marks."""
    return selection.select("id", F.lit(day).alias("digest_date"), F.lit(marked_at).alias("marked_at"))


_OPTIONAL = ["surprise", "themes", "playbook_trigger", "catalyst_status", "direction", "story_key"]


def search_row_json(rows: DataFrame) -> DataFrame:
    """One JSON object per row; fields that are null or empty are left out."""
    fixed = ["id", "author_handle", "author_name", "content", "summary", "created_at", "score", "categories",
             "signal_tier", "tickers", "bookmarked", "rank"]
    fields = [F.col(c) for c in fixed if c in rows.columns]
    fields.append(post_url(F.col("author_handle"), F.col("id")).alias("url"))
    for name in _OPTIONAL:
        if name in rows.columns:
            value = F.col(name)
            fields.append((F.when(F.size(value) > 0, value) if name == "themes" else value).alias(name))
    return rows.select("id", F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("json"))


def brief_lines(rows: DataFrame) -> DataFrame:
    """``[score]* @handle (time) [tickers] text`` in at most 80 characters of text."""
    score = F.when(F.coalesce("score", F.lit(0.0)) != 0, fixed(F.col("score"), 1)).otherwise("-")
    tickers = F.when(F.size("tickers") > 0, F.concat(F.lit(" ["), F.array_join("tickers", ","), F.lit("]")))
    time = F.coalesce(F.date_format("created_at", "MM/dd HH:mm"), F.lit("??/??"))
    line = F.concat(
        F.lit("["), score, F.lit("]"), F.when(F.col("bookmarked"), "*").otherwise(""),
        F.lit(" @"), F.col("author_handle"), F.lit(" ("), time, F.lit(")"), or_blank(tickers), F.lit(" "),
        or_blank(brief_text(F.col("summary"), F.col("content"))),
    )
    return rows.select("id", line.alias("line"))


def live_reactions(reactions: DataFrame, deleted: DataFrame) -> DataFrame:
    """Reactions without those named in the tombstone log."""
    return reactions.join(deleted.select("reaction_id").distinct(), "reaction_id", "left_anti")


def reactions_for_post(reactions: DataFrame, post_id: str) -> DataFrame:
    return reactions.where(F.col("post_id") == post_id).orderBy(F.col("created_at").desc(), F.col("reaction_id").desc())


def reactions_export(
    reactions: DataFrame, posts: DataFrame, reaction_type: str | None = None, limit: int = 100
) -> DataFrame:
    """Newest reactions with their posts.

    Only reactions whose post exists count towards the limit, so ids are matched first (no text moves), the page
    is cut, and just the posts of the page are read in full.
    """
    rows = reactions if reaction_type is None else reactions.where(F.col("reaction_type") == reaction_type)
    existing = posts.select(F.col("id").alias("post_id"))
    page = (
        lookup(rows, existing, "post_id", "left_semi")
        .orderBy(F.col("created_at").desc(), F.col("reaction_id").desc())
        .limit(limit)
    )
    wanted = page.select(F.col("post_id").alias("id")).distinct()
    shown = posts.join(counted_broadcast(wanted, limit), "id", "left_semi").select(
        F.col("id").alias("post_id"), "author_handle", F.substring("content", 1, 500).alias("content"), "summary",
        "score", "categories", "tickers",
    )
    return page.join(counted_broadcast(shown, limit), "post_id", "inner").orderBy(F.col("created_at").desc(), F.col("reaction_id").desc())


def export_recent(posts: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """All columns of posts of the last days, newest first."""
    return posts.where(F.col("created_at") >= before(as_of, days=days)).orderBy(F.col("created_at").desc(), "id")


def post_detail(posts: DataFrame, reactions: DataFrame, post_id: str) -> DataFrame:
    """One post with its reactions (``graph.with_quote_embeds`` adds the posts it quotes)."""
    one = posts.where(F.col("id") == post_id)
    own = reactions.where(F.col("post_id") == post_id)
    types = own.agg(F.array_sort(F.collect_set("reaction_type")).alias("reactions"))
    return one.withColumn("reactions", types.scalar())


def retweet_display(posts: DataFrame) -> DataFrame:
    """Author, id and text to show, also for old rows that only carry ``RT @x: ...`` text.

    The shown text has its links resolved and tidied and its HTML references decoded; the stored texts are decoded
    only. Posts carry ``links`` and ``has_media``.
    """
    legacy = F.when(~F.col("is_retweet"), retweet_parts(F.col("content")))
    rows = posts.withColumn("_legacy", legacy)
    found = F.col("_legacy").isNotNull()
    return (
        rows.withColumn("is_retweet", F.col("is_retweet") | found)
        .withColumn("original_author_handle", F.when(found, F.col("_legacy")["handle"]).otherwise(F.col("original_author_handle")))
        .withColumn("original_content", F.coalesce(F.when(found, F.col("_legacy")["text"]), F.col("original_content")))
        .withColumn("retweeted_by_handle", F.when(found, F.col("author_handle")).otherwise(F.col("retweeted_by_handle")))
        .withColumn("display_author_handle", _shown("original_author_handle", "author_handle"))
        .withColumn("display_author_name", _shown("original_author_name", "author_name"))
        .withColumn("display_id", _shown("original_id", "id"))
        .withColumn("_said", _shown("original_content", "content"))
        .withColumn("_kinds", link_kinds(F.col("display_id"), F.col("_said"), F.col("links"), F.col("has_media")))
        .withColumn("display_content", unescape_html(display_text(F.col("_said"), F.col("_kinds"))))
        .withColumn("content", unescape_html(F.col("content")))
        .withColumn("original_content", unescape_html(F.col("original_content")))
        .drop("_legacy", "_said", "_kinds")
    )


def _shown(original: str, own: str) -> Column:
    return F.coalesce(F.when(F.col("is_retweet"), non_blank(F.col(original))), F.col(own))
