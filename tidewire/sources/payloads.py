"""Raw feed payloads -> post observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.decode import closed_json, whole_json
from tidewire.functions.text import (
    let,
    looks_truncated,
    non_blank,
    or_blank,
    retweet_parts,
    strip,
    unescape_html,
)
from tidewire.functions.times import parse_timestamp
from tidewire.schemas import LINKS, MEDIA_ITEMS
from tidewire.sources.objects import read_objects

_ID_KEYS = ("id", "id_str", "tweetId", "rest_id")


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _first_text(v: Column, *paths: str) -> Column:
    """First path with a non-empty text."""
    return F.coalesce(*[non_blank(_get(v, p)) for p in paths])


def _object(v: Column, *paths: str) -> Column:
    """First path that holds an object with members."""
    return F.coalesce(
        *[F.when(F.schema_of_variant(_get(v, p, "variant")).startswith("OBJECT<"), _get(v, p, "variant")) for p in paths]
    )


def _items(v: Column) -> Column:
    """Members of a list payload, of a ``{"tweets": [...]}`` page, or the object itself."""
    kind = F.schema_of_variant(v)
    page = F.try_variant_get(v, "$.tweets", "array<variant>")
    return (
        F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
        .when(page.isNotNull(), page)
        .otherwise(F.array(v))
    )


def _wrapped(v: Column) -> Column:
    """Whether a value is a list or a page, not a leaf."""
    return F.schema_of_variant(v).startswith("ARRAY") | F.try_variant_get(v, "$.tweets", "array<variant>").isNotNull()


def _depth(text: Column) -> Column:
    """How many square brackets are open at once at most, those within JSON strings left out."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]++|\\(?s:.))*+"', "")
    signs = F.split(F.regexp_replace(bare, r"[^\[\]]++", ""), "")
    step = lambda s, c: F.when(c == "[", s["now"] + 1).otherwise(s["now"] - 1)
    return F.aggregate(
        F.filter(signs, lambda c: c != ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, c: let(step(s, c), lambda n: F.struct(n.alias("now"), F.greatest(s["most"], n).alias("most"))),
        lambda s: s["most"],
    )


def _opened(v: Column, text: Column) -> Column:
    """All leaves of a value whatever its wrappers: every wrapper has a square bracket, so their greatest nesting is enough.

    Few payloads have more than two wrappers: only for those the nesting is looked up and the rest opened.
    """
    def step(items: Column) -> Column:
        return F.flatten(F.transform(items, _items))

    def rest(items: Column) -> Column:
        turns = F.sequence(F.lit(1), F.greatest(_depth(text), F.lit(1)))
        return F.when(F.exists(items, _wrapped), F.aggregate(turns, items, lambda acc, _: step(acc))).otherwise(items)

    return let(step(_items(v)), rest)


def _open(rows: DataFrame, column: str) -> DataFrame:
    rows = rows.withColumn("v", F.explode(_opened(F.col("v"), F.col(column))))
    is_post = F.schema_of_variant("v").startswith("OBJECT") & _first_text(F.col("v"), *_ID_KEYS).isNotNull()
    return rows.where(is_post)


def _records(spark: SparkSession, path: str, whole_files: bool) -> DataFrame:
    """(file, value, whole): records of the files; ``whole`` is false for text that belongs to no object."""
    if whole_files:
        return read_objects(spark, path)
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.lit(True).alias("whole"))
    return text.where(strip(F.col("value")) != "")


def read_observations(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Payload objects (columns file, v) that carry an id, out of any number of wrappers.

    Files are read line by line, or with ``whole_files`` as lists or pages over several lines; either way one large file is
    read by many tasks. Records that cannot be opened are in ``read_quarantine``.
    """
    return parse_payloads(_records(spark, path, whole_files).where("whole"), "value", whole_files).select("file", "v")


def read_quarantine(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Records of the same files (columns file, value) that are no JSON."""
    # One reading of the files for both kinds.
    broken = F.when(F.col("whole"), _broken(F.col("value"), whole_files)).otherwise(True)
    return _records(spark, path, whole_files).where(broken).select("file", "value")


def _broken(text: Column, closed: bool = False) -> Column:
    return closed_json(text).isNull() if closed else (strip(or_blank(text)) != "") & whole_json(text).isNull()


def quarantined(raw: DataFrame, column: str) -> DataFrame:
    """Rows whose text is no JSON; blank and null texts are nothing at all."""
    return raw.where(_broken(F.col(column)))


def parse_payloads(raw: DataFrame, column: str, closed: bool = False) -> DataFrame:
    """Payload objects ``v`` of a text column; other columns are kept. Unparsable texts give no rows (see ``quarantined``).

    ``closed``: texts end where their first bracket closes.
    """
    value = closed_json(F.col(column)) if closed else whole_json(F.col(column))
    return _open(raw.withColumn("v", value), column)


def post_id(v: Column) -> Column:
    return _first_text(v, *_ID_KEYS)


def author(v: Column) -> tuple[Column, Column]:
    """Handle and name over all payload variants; null where none names them."""
    handle = _first_text(
        v, "author.username", "author.screen_name", "author.handle", "user.username", "user.screen_name",
        "user.handle", "legacy.screen_name", "core.user_results.result.legacy.screen_name",
        "core.user_results.result.core.screen_name", "authorHandle",
    )
    name = _first_text(
        v, "author.name", "author.display_name", "user.name", "user.display_name", "legacy.name",
        "core.user_results.result.legacy.name", "core.user_results.result.core.name", "authorName",
    )
    return handle, name


def raw_content(v: Column) -> Column:
    """Base text, or the longest note text if that is longer; still HTML-escaped."""
    base = or_blank(_first_text(v, "text", "full_text", "content", "legacy.full_text", "legacy.text"))
    note = "note_tweet.note_tweet_results.result.text"
    top, nested = or_blank(_get(v, note)), or_blank(_get(v, f"legacy.{note}"))
    longest = F.when(F.length(nested) > F.length(top), nested).otherwise(top)
    return F.when(F.length(longest) > F.length(base), longest).otherwise(base)


def retweeted(v: Column) -> Column:
    """Payload of the retweeted post, null if there is none."""
    return _object(
        v, "retweetedTweet", "retweeted_status", "retweetedStatus", "retweeted_status_result.result",
        "_raw.legacy.retweeted_status_result.result",
    )


def _article_body(v: Column) -> Column:
    result = "_raw.article.article_results.result"
    blocks = _get(v, f"{result}.content_state.blocks", "array<variant>")
    texts = F.filter(F.transform(blocks, lambda b: strip(or_blank(_get(b, "text")))), lambda t: t != "")
    return F.coalesce(non_blank(_get(v, f"{result}.plain_text")), non_blank(F.array_join(texts, "\n")))


def _media(v: Column) -> Column:
    none = F.array().cast("array<variant>")
    lists = [
        F.coalesce(_get(v, p, "array<variant>"), none)
        for p in ("extended_entities.media", "entities.media", "media", "media.items")
    ]

    def item(m: Column) -> Column:
        url = F.coalesce(
            _first_text(m, "media_url_https", "media_url", "url"), non_blank(_get(m, "video_info.variants[0].url"))
        )
        return F.struct(
            url.alias("url"),
            F.coalesce(_first_text(m, "type", "media_type"), F.lit("photo")).alias("type"),
            non_blank(_get(m, "source")).alias("source"),
            non_blank(_get(m, "media_id")).alias("media_id"),
        )

    def article_item(m: Column, source: str) -> Column:
        return F.struct(
            non_blank(_get(m, "media_info.original_img_url")).alias("url"),
            F.lit("photo").alias("type"),
            F.lit(source).alias("source"),
            non_blank(_get(m, "media_id")).alias("media_id"),
        )

    article = "_raw.article.article_results.result"
    entities = F.coalesce(_get(v, f"{article}.media_entities", "array<variant>"), none)
    cover = _get(v, f"{article}.cover_media", "variant")
    every = F.concat(
        F.transform(F.concat(*lists), item).cast(MEDIA_ITEMS),
        F.transform(entities, lambda m: article_item(m, "article")).cast(MEDIA_ITEMS),
        F.array(article_item(cover, "article_cover")).cast(MEDIA_ITEMS),
    )
    return F.aggregate(
        F.filter(every, lambda m: m["url"].isNotNull()),
        F.array().cast(MEDIA_ITEMS),
        lambda acc, m: F.when(F.exists(acc, lambda a: a["url"] == m["url"]), acc).otherwise(F.array_append(acc, m)),
    )


def _links(v: Column, content: Column) -> Column:
    none = F.array().cast("array<variant>")
    lists = [
        F.coalesce(_get(v, p, "array<variant>"), none) for p in ("urls", "entities.urls", "_raw.legacy.entities.urls")
    ]

    def link(k: Column) -> Column:
        raw = strip(or_blank(_get(k, "url")))
        expanded = strip(or_blank(_first_text(k, "expanded_url", "expandedUrl")))
        shown = strip(or_blank(_first_text(k, "display_url", "displayUrl")))
        resolved = F.when(expanded != "", expanded).otherwise(raw)
        return F.struct(
            F.when(raw != "", raw).otherwise(resolved).alias("url"),
            resolved.alias("expanded_url"),
            shown.alias("display_url"),
        )

    stored = F.aggregate(
        F.filter(F.transform(F.concat(*lists), link), lambda k: k["expanded_url"] != "").cast(LINKS),
        F.array().cast(LINKS),
        lambda acc, k: F.when(
            F.exists(acc, lambda a: (a["url"] == k["url"]) & (a["expanded_url"] == k["expanded_url"])), acc
        ).otherwise(F.array_append(acc, k)),
    )
    found = F.transform(
        F.regexp_extract_all(content, F.lit(r"https?://\S+"), F.lit(0)),
        lambda u: F.regexp_replace(u, r"[),.?!:;]+$", ""),
    )
    plain = F.transform(
        F.array_distinct(F.filter(found, lambda u: u != "")),
        lambda u: F.struct(u.alias("url"), u.alias("expanded_url"), u.alias("display_url")),
    )
    return F.when(F.size(stored) > 0, stored).otherwise(plain)


def _has_items(v: Column, *paths: str) -> Column:
    test = F.lit(False)
    for p in paths:
        listed = F.coalesce(F.size(_get(v, p, "array<variant>")) > 0, F.lit(False))
        test = test | listed | F.coalesce(F.schema_of_variant(_get(v, p, "variant")).startswith("OBJECT<"), F.lit(False))
    return test


def normalize_payloads(rows: DataFrame) -> DataFrame:
    """Payloads (variant column ``v``) -> observations; all other columns (source, seq, ...) are carried along."""
    v = F.col("v")
    carried = [c for c in rows.columns if c != "v"]
    # HTML decoding is done once for all three texts, before they are used again and again.
    rt = F.col("_rt")
    base = rows.withColumn("_rt", retweeted(v))
    base = base.withColumn("_text", unescape_html(raw_content(v))).withColumn(
        "_rt_text", unescape_html(raw_content(rt))
    )
    content, rt_text = F.col("_text"), non_blank(F.col("_rt_text"))
    handle, name = author(v)
    handle = F.coalesce(handle, F.lit("unknown"))
    quoted = _object(v, "quotedTweet", "quoted_status")

    article = "_raw.article.article_results.result"
    is_article = _object(v, "article", article).isNotNull()
    title = _first_text(v, "article.title", f"{article}.title")
    preview = _first_text(v, "article.previewText", f"{article}.preview_text")
    said = strip(content)
    rich = (F.length(said) >= 400) | (
        (strip(or_blank(preview)) != "") & (F.length(said) >= F.length(strip(or_blank(preview))) + 80)
    )
    body = F.coalesce(_article_body(v), F.when((said != "") & rich, said))

    rt_handle, rt_name = author(rt)
    rt_id = post_id(rt)
    nested = rt.isNotNull() & F.coalesce(rt_handle, rt_text, rt_id).isNotNull()
    legacy = F.when(rt.isNull(), retweet_parts(content))
    is_retweet = nested | legacy.isNotNull()
    media, links = _media(v), _links(v, content)
    id_text = lambda *paths: non_blank(strip(_first_text(v, *paths)))
    out = base.select(
        *carried,
        post_id(v).alias("id"),
        handle.alias("author_handle"),
        name.alias("author_name"),
        content.alias("content"),
        parse_timestamp(_first_text(v, "createdAt", "created_at")).alias("created_at"),
        quoted.isNotNull().alias("has_quote"),
        _first_text(quoted, "id", "id_str").alias("quote_id"),
        id_text(
            "in_reply_to_status_id_str", "in_reply_to_status_id", "inReplyToStatusId", "inReplyToStatusIdStr",
            "legacy.in_reply_to_status_id_str", "legacy.in_reply_to_status_id",
        ).alias("reply_id"),
        id_text(
            "conversation_id_str", "conversationIdStr", "conversation_id", "legacy.conversation_id_str",
            "legacy.conversation_id",
        ).alias("conversation_id"),
        media.alias("media_items"),
        _has_items(v, "media", "entities.media", "extended_entities.media").alias("_listed_media"),
        links.alias("links"),
        _has_items(v, "urls", "entities.urls", "_raw.legacy.entities.urls").alias("_listed_links"),
        is_article.alias("is_article"),
        F.when(is_article, title).alias("article_title"),
        F.when(is_article, preview).alias("article_preview"),
        F.when(is_article, body).alias("article_text"),
        F.coalesce(is_retweet, F.lit(False)).alias("is_retweet"),
        F.when(is_retweet, handle).alias("retweeted_by_handle"),
        F.when(is_retweet, name).alias("retweeted_by_name"),
        F.when(nested, rt_id).alias("original_id"),
        F.when(nested, rt_handle).otherwise(legacy["handle"]).alias("original_author_handle"),
        F.when(nested, rt_name).alias("original_author_name"),
        F.when(nested, rt_text).otherwise(legacy["text"]).alias("original_content"),
    )
    has_link = (F.size("links") > 0) | F.col("_listed_links") | F.col("content").rlike(r"https?://\S+") | F.col("is_article")
    return out.withColumns(
        {"has_media": (F.size("media_items") > 0) | F.col("_listed_media"), "has_link": has_link}
    ).drop("_listed_media", "_listed_links")


def hydration_queue(observations: DataFrame) -> DataFrame:
    """Retweets whose original has to be read again."""
    from tidewire.functions.text import needs_hydration

    test = needs_hydration(*[F.col(c) for c in ("is_retweet", "original_id", "original_content", "content")])
    return observations.where(test).select(
        F.coalesce("original_id", "id").alias("id"), looks_truncated(F.col("content")).alias("cut")
    )
