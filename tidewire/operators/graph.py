"""Walks along quote, reply and inline-link edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewire.functions.text import (
    fixed, non_blank, or_blank, squeeze, strip, triage_text, truncate_context, unescape_html,
)
from tidewire.functions.urls import inline_links, link_kinds, status_id
from tidewire.operators.skew import counted_broadcast, lookup, materialize, union_all

MAX_INLINE = 4
MAX_QUOTE_DEPTH = 3


def linked_ids(post_id: Column, links: Column, limit: int = MAX_INLINE) -> Column:
    """Distinct ids of other posts that the stored links point to, first ``limit``."""
    ids = F.transform(links, lambda k: F.coalesce(status_id(strip(or_blank(k["expanded_url"]))), status_id(k["url"])))
    return F.slice(F.array_distinct(F.filter(ids, lambda i: i.isNotNull() & (i != post_id))), 1, limit)


def _dependencies() -> Column:
    near = F.transform(F.array("quote_id", "reply_id"), strip)
    every = F.concat(near, F.coalesce(linked_ids(F.col("id"), F.col("links")), F.array().cast("array<string>")))
    return F.array_distinct(F.filter(every, lambda i: (or_blank(i) != "") & (i != F.col("id"))))


def dependency_ids(posts: DataFrame) -> DataFrame:
    """Per post the ordered distinct ids it depends on: quoted post, reply parent, inline-linked posts."""
    return posts.select("id", _dependencies().alias("deps"))


def _reached(posts: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """Distinct ids reachable from the sources in 1..depth steps.

    Each level holds distinct ids, so a much-quoted post is expanded once. A node is reachable within the depth
    by a walk exactly if it is by a shortest path, so no visited set has to be subtracted between levels.
    """
    edges = dependency_ids(posts)
    frontier, levels = sources.select("id").distinct(), []
    for _ in range(depth):
        # An id that is no post has no edges and is left out by whoever joins the result with posts.
        frontier = frontier.join(edges, "id").select(F.explode("deps").alias("id")).distinct()
        levels.append(frontier)
    return union_all(levels).distinct()


def expand_dependencies(posts: DataFrame, sources: DataFrame, depth: int = 3) -> DataFrame:
    """Source posts plus unprocessed posts they depend on, directly or through others (processed ones included)."""
    start = posts.join(sources.select("id").distinct(), "id", "left_semi")
    if depth <= 0:
        return start
    more = _reached(posts, sources, depth).join(sources.select("id"), "id", "left_anti")
    return start.unionByName(posts.where(F.col("processed_at").isNull()).join(more, "id", "left_semi"))


def missing_dependencies(posts: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Ids that posts depend on but that are not among the ``stored`` ones (all of ``posts`` by default)."""
    named = dependency_ids(posts).select(F.explode("deps").alias("id")).distinct()
    return named.join((posts if stored is None else stored).select("id"), "id", "left_anti")


def with_inline_links(posts: DataFrame) -> DataFrame:
    """Adds ``inline``: the distinct posts linked from the text, as array of struct(id, url)."""
    kinds = link_kinds(F.col("id"), F.col("content"), F.col("links"), F.col("has_media"))
    return posts.withColumn("inline", inline_links(kinds))


def quote_pointers(posts: DataFrame) -> DataFrame:
    """(id, top_quote, next_quote): the quoted post when shown as a feed row, and when shown as an embed.

    A feed row falls back to its first inline link only if it has no quote flag; an embed always may.
    """
    rows = with_inline_links(posts)
    explicit, first = non_blank(F.col("quote_id")), F.get("inline", F.lit(0))["id"]
    other = lambda c: F.when(c != F.col("id"), c)
    return rows.select(
        "id",
        other(F.coalesce(explicit, F.when(~F.col("has_quote"), first))).alias("top_quote"),
        other(F.coalesce(explicit, first)).alias("next_quote"),
    )


def quote_chain(posts: DataFrame, page: DataFrame | None = None, depth: int = MAX_QUOTE_DEPTH) -> DataFrame:
    """Per post the nested quoted posts q1..q<depth>; a chain ends at a missing post or one it already holds.

    ``page`` restricts the starting posts, as many as it likes: its ids are counted once, and since a chain has one row per
    starting post, the same count bounds what each level looks up. Few ids are broadcast, so nothing but the chosen posts
    moves; more are joined by shuffle. Each level is materialised (a few narrow columns), so the plan does not double from
    level to level, and the texts that links are found in are read once, or for a page only for the posts of the chain.
    """
    if page is None:
        start = every = materialize(quote_pointers(posts))
    else:
        ids = materialize(page.select("id").distinct())
        rows = ids.count()
        start = quote_pointers(posts.join(counted_broadcast(ids, rows), "id", "left_semi"))
    chain = start.select("id", F.col("top_quote").alias("next"), F.array().cast("array<string>").alias("path"))
    for _ in range(depth):
        chain = materialize(chain)
        if page is not None:
            ids = chain.where(F.col("next").isNotNull()).select(F.col("next").alias("id")).distinct()
            every = quote_pointers(posts.join(counted_broadcast(ids, rows), "id", "left_semi"))
        hops = every.select(F.col("id").alias("next"), F.col("next_quote").alias("after"), F.lit(True).alias("found"))
        joined = lookup(chain, hops, "next")
        path = F.when(F.col("found"), F.array_append("path", F.col("next"))).otherwise(F.col("path"))
        open_end = F.col("found") & ~F.array_contains("path", F.col("after"))
        chain = joined.select("id", "after", "found", path.alias("path")).select(
            "id", F.when(open_end, F.col("after")).alias("next"), "path"
        )
    return chain.select("id", *[F.get("path", F.lit(i)).alias(f"q{i + 1}") for i in range(depth)])


_EMBED = ("id", "author_handle", "author_name", "content", "created_at")


def with_quote_embeds(page: DataFrame, posts: DataFrame, depth: int = MAX_QUOTE_DEPTH) -> DataFrame:
    """Rows of ``page`` with ``quote_embed``: the quoted post's id, author, decoded text and time, and in it the next one.

    Null where nothing is quoted or the quoted post is not stored. Only quoted posts move with their texts; a post that
    many rows quote is spread.
    """
    chain = materialize(quote_chain(posts, page, depth))
    asked = chain.select("id", F.posexplode(F.array(*[f"q{i + 1}" for i in range(depth)])).alias("level", "quoted"))
    asked = asked.where(F.col("quoted").isNotNull())
    ids = asked.select(F.col("quoted").alias("id")).distinct()
    chosen = posts.select(*_EMBED).join(counted_broadcast(ids, asked.count()), "id", "left_semi")
    shown = chosen.withColumn("content", unescape_html(F.col("content"))).select(
        F.col("id").alias("quoted"), F.struct(*_EMBED).alias("post"))
    found = lookup(asked, shown, "quoted", "inner").groupBy("id").agg(
        *[F.first(F.when(F.col("level") == i, F.col("post")), ignorenulls=True).alias(f"e{i}") for i in range(depth)])
    embed = None
    for i in reversed(range(depth)):
        fields = [F.col(f"e{i}")[name].alias(name) for name in _EMBED]
        nested = [] if embed is None else [embed.alias("quote_embed")]
        embed = F.when(F.col(f"e{i}").isNotNull(), F.struct(*fields, *nested))
    return page.join(found.select("id", embed.alias("quote_embed")), "id", "left")


def inline_references(posts: DataFrame) -> DataFrame:
    """Inline links other than the quoted post, one row each; ``embedded`` tells whether the target is stored."""
    explicit = non_blank(F.col("quote_id"))
    rows = with_inline_links(posts).withColumn(
        "quote", F.coalesce(explicit, F.when(~F.col("has_quote"), F.get("inline", F.lit(0))["id"]))
    )
    flat = rows.select("id", "quote", F.posexplode("inline").alias("pos", "k")).where(
        F.col("quote").isNull() | (F.col("k.id") != F.col("quote"))
    ).select("id", "pos", F.col("k.id").alias("linked_id"), F.col("k.url").alias("url"))
    stored = posts.select(F.col("id").alias("linked_id"), F.lit(True).alias("stored"))
    return lookup(flat, stored, "linked_id").withColumn("embedded", F.coalesce("stored", F.lit(False))).drop("stored")


def thread_replies(posts: DataFrame, roots: DataFrame, depth: int = 2, max_nodes: int = 100) -> DataFrame:
    """Stored direct replies below the roots of each thread, level by level: (thread, depth, id, parent).

    ``roots`` has ``id`` and, for several threads at once, ``thread``; without it all roots are one thread. A thread's
    roots are never its replies, and ``max_nodes`` is one budget for all of them: at most so many posts are asked for
    their replies, at most so many replies are kept, breadth first, ids in the order of their numbers. The budget is
    part of the operator and cuts each level per partition before the shuffle; a much-answered parent is salted.
    """
    place = lambda c: F.struct(F.length(c).alias("len"), c.alias("id"))
    replies = posts.select("id", F.col("reply_id").alias("parent")).where(F.col("parent").isNotNull())
    named = roots if "thread" in roots.columns else roots.withColumn("thread", F.lit(""))
    start = named.select("thread", "id").distinct()
    level = start.withColumns({"depth": F.lit(0), "parent": F.lit(None).cast("string"), "path": F.array(place(F.col("id")))})
    level = _first_nodes(level, max_nodes)
    levels = [level]
    for step in range(1, depth + 1):
        frontier = level.select("thread", F.col("id").alias("parent"), "path")
        below = lookup(replies, frontier, "parent", "inner").join(start, ["thread", "id"], "left_anti")
        level = below.select(
            "thread", "id", F.lit(step).alias("depth"), "parent", F.array_append("path", place(F.col("id"))).alias("path")
        )
        level = _first_nodes(level, max_nodes)
        levels.append(level)
    # In breadth-first order a post's number also counts those asked before it; all of the last depth come after them.
    order = W.partitionBy("thread").orderBy("depth", "path")
    nodes = union_all(levels).withColumn("_n", F.row_number().over(order))
    asked = nodes.where(F.col("_n") <= max_nodes).select("thread", F.col("id").alias("parent"))
    answers = nodes.where(F.col("depth") > 0).join(asked, ["thread", "parent"], "left_semi")
    ranked = answers.withColumn("_n", F.row_number().over(order))
    return ranked.where(F.col("_n") <= max_nodes).select("thread", "depth", "id", "parent")


def _first_nodes(level: DataFrame, count: int) -> DataFrame:
    ranked = level.withColumn("_n", F.row_number().over(W.partitionBy("thread").orderBy("path")))
    return ranked.where(F.col("_n") <= count).drop("_n")


def _triage() -> Column:
    return triage_text(*[F.col(c) for c in ("content", "is_article", "article_title", "article_preview", "article_text")])


def context_text(
    posts: DataFrame, dep_chars: int = 900, context_chars: int = 2400, page: DataFrame | None = None,
    texts: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Text for a scorer: the post, then bounded lines for the posts it quotes, answers or links to.

    ``page`` holds the posts to be scored, with their texts (by default all); what they depend on is looked up in ``posts``.
    Where ``texts`` is given, neither has texts yet: it adds them to rows of posts, once these have moved.
    """
    page = posts if page is None else page
    told = texts or (lambda rows: rows)
    deps = told(page).select("id", "quote_id", "reply_id", F.posexplode(_dependencies()).alias("pos", "dep_id"))
    # Texts are cut before they travel.
    named = deps.select(F.col("dep_id").alias("id")).distinct()
    said = told(posts.join(named, "id", "left_semi")).select(
        F.col("id").alias("dep_id"), F.col("author_handle").alias("dep_author"),
        truncate_context(_triage(), dep_chars).alias("dep_text"),
    )
    label = (
        F.when(F.col("dep_id") == F.col("quote_id"), "Quoted tweet")
        .when(F.col("dep_id") == F.col("reply_id"), "Reply parent")
        .otherwise("Context")
    )
    line = F.concat(F.lit("- "), label, F.lit(" @"), F.col("dep_author"), F.lit(": "), F.col("dep_text"))
    lines = (
        lookup(deps, said, "dep_id", "inner")
        .where(F.col("dep_text") != "")
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
        .select("id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("_context"))
    )
    base = told(page.join(lines, "id", "left")).select("id", _triage().alias("base"), F.col("_context").alias("context"))
    full = F.concat(F.col("base"), F.lit("\n\nDirect context:\n"), truncate_context(F.col("context"), context_chars))
    return base.select("id", F.when(F.col("context").isNull(), F.col("base")).otherwise(full).alias("text"))


def author_context(posts: DataFrame, authors: DataFrame) -> DataFrame:
    """``tier-1, macro, prior 8.4`` or ``unranked`` per post."""
    known = authors.select(
        F.col("handle").alias("author_handle"),
        F.concat_ws(
            ", ",
            F.concat(F.lit("tier-"), F.col("tier")),
            non_blank(F.col("category")),
            F.when(F.col("avg_score").isNotNull(), F.concat(F.lit("prior "), fixed(F.col("avg_score"), 1))),
        ).alias("known"),
    )
    joined = lookup(posts.select("id", "author_handle"), known, "author_handle")
    return joined.select("id", F.coalesce(non_blank(F.col("known")), F.lit("unranked")).alias("author_context"))


def linked_post_previews(posts: DataFrame, page: DataFrame, limit: int = 3) -> DataFrame:
    """Digest previews of the first inline-linked posts of a page: summary, else the first 180 characters."""
    rows = with_inline_links(page).select("id", F.posexplode(F.slice("inline", 1, limit)).alias("pos", "k"))
    links = rows.select("id", "pos", F.col("k.id").alias("linked_id"), F.col("k.url").alias("url"))
    preview = F.coalesce(non_blank(F.col("summary")), strip(F.substring("content", 1, 180)))
    said = posts.select(F.col("id").alias("linked_id"), F.col("author_handle").alias("linked_author"), preview.alias("preview"))
    return lookup(links, said, "linked_id")
