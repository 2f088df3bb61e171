"""One clean record per post out of many observations (append log -> current state)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import let, looks_truncated, non_blank, or_blank, rstrip, strip
from tidewire.operators.skew import lookup, materialize, tree_fold

RICHER_BY = 120
_VERSION = "struct<seq:long,text:string,len:int,cut:boolean>"
_STEPS = f"array<struct<len:int,end:{_VERSION}>>"
_ORIGINALS = "array<struct<text:string,end:string>>"


# --- richer text -----------------------------------------------------------------------------------------------
# A kept text gives way to the next non-empty one when it is empty or cut, else to the first that is at least
# RICHER_BY characters longer. A run of observations is therefore a function of the kept text's length alone. It is
# stored as steps: (length of an observation, text finally kept once that observation is taken), lengths rising.
# The first step also tells what an open (empty or cut) text ends as. Runs compose, so they fold as a tree.


def _take(steps: Column, kept: Column) -> Column:
    """Text kept after a run, given the text kept before it."""
    richer = F.filter(steps, lambda s: s["len"] >= kept["len"] + RICHER_BY)
    return (
        F.when(F.size(steps) == 0, kept)
        .when(kept.isNull() | kept["cut"], F.get(steps, F.lit(0))["end"])
        .when(F.size(richer) > 0, F.get(richer, F.lit(0))["end"])
        .otherwise(kept)
    )


def _then(first: Column, rest: Column) -> Column:
    """Run ``first`` followed by run ``rest``."""
    head = F.transform(first, lambda s: F.struct(s["len"].alias("len"), _take(rest, s["end"]).alias("end")))
    tail = F.filter(rest, lambda s: s["len"] > F.try_element_at(first, F.lit(-1))["len"])
    both = F.concat(head, tail)
    # A step is superfluous when the next longer one ends the same way.
    slim = let(
        both,
        lambda steps: F.filter(
            steps,
            lambda s, i: (i == F.size(steps) - 1)
            | (s["end"]["seq"] != F.coalesce(F.get(steps, i + 1)["end"]["seq"], F.lit(-1))),
        ),
    )
    return F.when(F.size(first) == 0, rest).when(F.size(rest) == 0, first).otherwise(slim)


def _fold_steps(runs: Column) -> Column:
    return F.aggregate(F.reverse(runs), F.array().cast(_STEPS), lambda acc, run: _then(run, acc))


def _text_leaf(seq: Column, text: Column, counts: Column, whole: bool) -> Column:
    length = F.length(strip(text))
    version = F.struct(seq.alias("seq"), (text if whole else _mark(text)).alias("text"), length.alias("len"), looks_truncated(text).alias("cut"))
    leaf = F.array(F.struct(length.alias("len"), version.alias("end")))
    return F.when(counts, leaf).otherwise(F.array()).cast(_STEPS)


# --- media and link lists --------------------------------------------------------------------------------------
# An observation counts only if it brings a URL not seen before; then its fields overwrite earlier ones. Keeping
# just those observations bounds the state by the number of distinct URLs of the post.


def _item_leaf(seq: Column, items: Column, fields: list[str]) -> Column:
    urls = lambda acc: F.transform(acc, lambda a: a["url"])
    typed = F.transform(items, lambda m: F.struct(strip(m["url"]).alias("url"), *[m[f].alias(f) for f in fields[1:]]))
    usable = F.filter(typed, lambda m: or_blank(m["url"]) != "")
    item_type = "array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>"
    merged = F.aggregate(
        usable,
        F.array().cast(item_type),
        lambda acc, m: _upsert(acc, m, fields),
    )
    leaf = F.when(F.size(usable) > 0, F.array(F.struct(seq.alias("seq"), merged.alias("items"))))
    return F.coalesce(leaf, F.array().cast(f"array<struct<seq:long,items:{item_type}>>"))


def _upsert(acc: Column, item: Column, fields: list[str]) -> Column:
    known = F.exists(acc, lambda a: a["url"] == item["url"])
    changed = F.transform(
        acc,
        lambda a: F.when(
            a["url"] == item["url"],
            F.struct(a["url"].alias("url"), *[F.coalesce(item[f], a[f]).alias(f) for f in fields[1:]]),
        ).otherwise(a),
    )
    return F.when(known, changed).otherwise(F.array_append(acc, item))


def _fold_items(observations: Column, fields: list[str]) -> Column:
    item_type = "array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>"

    def has_url(acc: Column, url: Column) -> Column:
        return F.exists(acc, lambda o: F.exists(o["items"], lambda m: m["url"] == url))

    return F.aggregate(
        F.flatten(observations),
        F.array().cast(f"array<struct<seq:long,items:{item_type}>>"),
        lambda acc, o: F.when(
            F.exists(o["items"], lambda m: ~has_url(acc, m["url"])), F.array_append(acc, o)
        ).otherwise(acc),
    )


def _items_of(kept: Column, fields: list[str]) -> Column:
    item_type = "array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>"
    return F.aggregate(
        F.flatten(F.transform(kept, lambda o: o["items"])),
        F.array().cast(item_type),
        lambda acc, m: _upsert(acc, m, fields),
    )


# --- text of the original of a retweet -------------------------------------------------------------------------
# A complete text replaces a missing or cut one, or one it extends. A run is a list of (candidate, text finally
# kept once it is taken); a candidate that an earlier one extends can never be the first to be taken.


def _extends(longer: Column, shorter: Column) -> Column:
    return (F.length(longer) > F.length(shorter)) & longer.startswith(shorter)


def _originals_after(run: Column, kept: Column) -> Column:
    hits = F.filter(run, lambda e: _extends(e["text"], rstrip(kept)))
    return F.when(F.size(hits) > 0, F.get(hits, F.lit(0))["end"]).otherwise(kept)


def _fold_originals(runs: Column) -> Column:
    def then(first: Column, rest: Column) -> Column:
        head = F.transform(
            first, lambda e: F.struct(e["text"].alias("text"), _originals_after(rest, e["end"]).alias("end"))
        )
        tail = F.filter(rest, lambda e: ~F.exists(first, lambda f: f["text"].startswith(e["text"])))
        return F.concat(head, tail)

    return F.aggregate(F.reverse(runs), F.array().cast(_ORIGINALS), lambda acc, run: then(run, acc))


def _original_leaf(is_retweet: Column, text: Column) -> Column:
    good = F.coalesce(is_retweet, F.lit(False)) & (strip(or_blank(text)) != "") & ~looks_truncated(text)
    entry = F.array(F.struct(rstrip(text).alias("text"), text.alias("end")))
    return F.when(good, entry).otherwise(F.array()).cast(_ORIGINALS)


# --- the merge -------------------------------------------------------------------------------------------------

MEDIA_FIELDS = ["url", "type", "source", "media_id"]
LINK_FIELDS = ["url", "expanded_url", "display_url"]
_FILL_IF_NULL = ["author_name", "created_at", "quote_id", "reply_id", "conversation_id"]
_STICKY = ["has_quote", "has_media", "has_link", "is_article", "is_retweet"]
_RETWEET_FILL = [
    "retweeted_by_handle", "retweeted_by_name", "original_id", "original_author_handle", "original_author_name",
]


def _first(value: Column, when: Column, seq: Column) -> Column:
    """struct(seq, value) where ``when`` holds, for a later minimum by seq."""
    return F.when(when, F.struct(seq.alias("seq"), value.alias("value")))


def _longest(value: Column, seq: Column) -> Column:
    length = F.length(strip(or_blank(value)))
    return F.when(
        length > 0, F.struct(length.alias("len"), (-seq).alias("back"), value.alias("value"))
    )


def merge_posts(
    observations: DataFrame, level_bits: tuple[int, ...] = (12, 24), texts: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """One row per id from observations in order of ``seq`` (a unique place in the log).

    First sight fixes author and source; later sights fill gaps, raise flags, lengthen titles, replace cut texts
    by richer ones, extend media and link lists and complete retweet originals. ``links_changed_seq`` is the last
    sight that added a link (older link expansions are void from there on).

    The fold needs lengths of texts alone, so in it they are hashes; those kept in the end are read again, and only they
    move. ``texts`` reads them: rows with ``id`` and ``seq`` -> the same rows with the observations' ``content`` and
    ``article_text``. By default they are looked up in ``observations``.
    """
    state = materialize(merge_states(observations, level_bits, whole=False).withColumn("_row", F.monotonically_increasing_id()))
    posts = state
    for name, column in (("content", "content"), ("body", "article_text")):
        end = F.get(name, F.lit(0))["end"]
        kept = state.select("_row", "id", end["seq"].alias("seq"), end["text"].alias("_mark")).where("_mark IS NOT NULL")
        if texts is None:
            rows = observations.select(F.col("id").alias("_id"), F.col("seq").alias("_seq"), column)
            rows = kept.join(rows, F.col("_id").eqNullSafe(F.col("id")) & F.col("_seq").eqNullSafe(F.col("seq")))
        else:
            rows = texts(kept)
        found = rows.where(F.col("_mark") == _mark(F.col(column))).select("_row", F.col(column).alias(f"{name}_text"))
        # Equal rows of one place are one text.
        posts = posts.join(found.dropDuplicates(["_row"]), "_row", "left")
    return posts_of(posts)


def _mark(text: Column) -> Column:
    return F.xxhash64(text).cast("string")


def merge_states(observations: DataFrame, level_bits: tuple[int, ...] = (12, 24), whole: bool = True) -> DataFrame:
    """The fold's state of every id after these observations; ``posts_of`` turns it into posts.

    States of one id over disjoint stretches of the log compose (``compose_states``), so they can be stored and carried on
    without the observations they came from. Where not ``whole`` they hold hashes in place of texts that count.
    """
    seq = F.col("seq")
    said = or_blank(F.col("content")) != ""
    wrote = strip(or_blank(F.col("article_text"))) != ""
    leaf: dict[str, Column] = {
        # Texts that take part in the folds below are not carried twice: only blank ones are kept here.
        "first_row": F.struct(
            "seq",
            *["author_handle", "source", "article_title", "article_preview"],
            F.when(~said, F.col("content")).alias("content"),
            F.when(~wrote, F.col("article_text")).alias("article_text"),
            *_RETWEET_FILL,
            "original_content",
        ),
        "observations": F.lit(1).cast("long"),
        "last_seq": seq,
        "title": _longest(F.col("article_title"), seq),
        "preview": _longest(F.col("article_preview"), seq),
        "content": _text_leaf(seq, F.col("content"), said, whole),
        "body": _text_leaf(seq, F.col("article_text"), wrote, whole),
        "media": _item_leaf(seq, F.col("media_items"), MEDIA_FIELDS),
        "link_items": _item_leaf(seq, F.col("links"), LINK_FIELDS),
        "original": F.array(
            F.struct(
                seq.alias("seq"), _original_leaf(F.col("is_retweet"), F.col("original_content")).alias("run")
            )
        ),
    }
    for name in _FILL_IF_NULL:
        present = F.col(name).isNotNull() if name == "created_at" else or_blank(F.col(name)) != ""
        leaf[name] = _first(F.col(name), present, seq)
    for name in _STICKY:
        leaf[name] = F.coalesce(F.col(name), F.lit(False))
    for name in _RETWEET_FILL:
        leaf[name] = _first(F.col(name), F.coalesce("is_retweet", F.lit(False)) & F.col(name).isNotNull(), seq)
    return tree_fold(observations, "id", "seq", leaf, _COLLAPSE, _COMMUTATIVE, level_bits)


def _fold_firsts(parts: Column) -> Column:
    """Runs of originals: the first sight's follows a rule of its own and is kept apart until the end."""
    flat = F.flatten(parts)
    rest = F.transform(F.slice(flat, 2, F.greatest(F.size(flat) - 1, F.lit(1))), lambda p: p["run"])
    return F.when(
        F.size(flat) > 1,
        F.array(
            F.get(flat, F.lit(0)),
            F.struct(F.get(flat, F.lit(1))["seq"].alias("seq"), _fold_originals(rest).alias("run")),
        ),
    ).otherwise(flat)


_COLLAPSE = {
    "content": _fold_steps,
    "body": _fold_steps,
    "media": lambda rows: _fold_items(rows, MEDIA_FIELDS),
    "link_items": lambda rows: _fold_items(rows, LINK_FIELDS),
    "original": _fold_firsts,
}
_COMMUTATIVE = {
    "first_row": F.min, "observations": F.sum, "last_seq": F.max, "title": F.max, "preview": F.max,
    **{name: F.min for name in (*_FILL_IF_NULL, *_RETWEET_FILL)}, **{name: F.bool_or for name in _STICKY},
}


def compose_states(states: DataFrame) -> DataFrame:
    """One state per id out of states over disjoint stretches of the log. The caller bounds how many an id has."""
    rows = F.sort_array(F.collect_list(F.struct(F.col("first_row")["seq"].alias("_at"), *_COLLAPSE))).alias("_rows")
    grouped = states.groupBy("id").agg(rows, *[f(F.col(n)).alias(n) for n, f in _COMMUTATIVE.items()])
    parts = [f(_of_rows(n)).alias(n) for n, f in _COLLAPSE.items()]
    return grouped.select("id", *_COMMUTATIVE, *parts).select(*states.columns)


def _of_rows(name: str) -> Column:
    return F.transform("_rows", lambda row: row[name])


def posts_of(state: DataFrame) -> DataFrame:
    """Posts of the fold's states."""
    first = F.col("first_row")
    first_seq = first["seq"]
    content = F.get("content", F.lit(0))["end"]["text"]
    body = F.get("body", F.lit(0))["end"]
    wrote = body["text"]
    if "content_text" in state.columns:
        content, wrote = F.col("content_text"), F.col("body_text")

    def longest(name: str, column: str) -> Column:
        best = F.col(name)
        kept = F.when(-best["back"] == first_seq, best["value"]).otherwise(strip(best["value"]))
        return F.coalesce(kept, first[column])

    later = F.flatten(F.transform(F.filter("original", lambda p: p["seq"] > first_seq), lambda p: p["run"]))
    original = first["original_content"]
    open_original = (strip(or_blank(original)) == "") | looks_truncated(original)
    completed = F.when(open_original, F.coalesce(F.get(later, F.lit(0))["end"], original)).otherwise(
        _originals_after(later, original)
    )
    merged_media = _items_of(F.col("media"), MEDIA_FIELDS)
    return state.select(
        "id",
        first["author_handle"].alias("author_handle"),
        F.col("author_name")["value"].alias("author_name"),
        F.coalesce(F.when(F.size("content") > 0, content), first["content"]).alias("content"),
        F.col("created_at")["value"].alias("created_at"),
        first["source"].alias("source"),
        "has_quote",
        F.col("quote_id")["value"].alias("quote_id"),
        F.col("reply_id")["value"].alias("reply_id"),
        F.col("conversation_id")["value"].alias("conversation_id"),
        (F.col("has_media") | (F.size("media") > 0)).alias("has_media"),
        merged_media.alias("media_items"),
        "has_link",
        _items_of(F.col("link_items"), LINK_FIELDS).alias("links"),
        F.when(F.size("link_items") > 1, F.try_element_at("link_items", F.lit(-1))["seq"]).alias("links_changed_seq"),
        "is_article",
        longest("title", "article_title").alias("article_title"),
        longest("preview", "article_preview").alias("article_preview"),
        F.when(F.size("body") == 0, first["article_text"])
        .when(body["seq"] == first_seq, wrote)
        .otherwise(strip(wrote))
        .alias("article_text"),
        "is_retweet",
        *[F.coalesce(first[n], F.col(n)["value"]).alias(n) for n in _RETWEET_FILL],
        completed.alias("original_content"),
        "observations",
        "last_seq",
    )


def dedupe_first_seen(rows: DataFrame, order: str = "seq") -> DataFrame:
    """First row of every non-empty id in arrival order."""
    # A minimum for each column, all of the same row: columns that nobody asks for, such as texts, do not move.
    first = [F.min_by(F.col(f"`{c}`"), order).alias(c) for c in rows.columns if c != "id"]
    return rows.where(non_blank(F.col("id")).isNotNull()).groupBy("id").agg(*first)


def new_observations(observations: DataFrame, known: DataFrame) -> DataFrame:
    """Observations whose id is not among the known posts."""
    return lookup(observations, known, "id", "left_anti")
