"""Author state: a fold of commands, joined with running statistics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import or_blank
from tidewire.functions.times import before
from tidewire.operators.skew import tree_fold

DEFAULT_WEIGHT = 50.0
DEFAULT_TIER = 2
CEILING, FLOOR = 100.0, 10.0
_INF = float("inf")

# Effect of a run of commands on an existing author. Weight: min(hi, max(lo, a*w + b)), closed under composition
# for a >= 0. Tier: a fixed value if one was set, then the minimum with ``cap``. Both therefore fold as a tree.
_EFFECT = "struct<a:double,b:double,lo:double,hi:double,set_tier:int,cap:int>"


def handle_key(handle: Column) -> Column:
    return F.regexp_replace(or_blank(handle), "^@+", "")


def _effect(a, b, lo, hi, set_tier, cap) -> Column:
    return F.struct(
        F.lit(a).cast("double").alias("a"),
        F.lit(b).cast("double").alias("b"),
        F.lit(lo).cast("double").alias("lo"),
        F.lit(hi).cast("double").alias("hi"),
        F.lit(set_tier).cast("int").alias("set_tier"),
        F.lit(cap).cast("int").alias("cap"),
    )


def _neutral() -> Column:
    return _effect(1.0, 0.0, -_INF, _INF, None, None)


def _clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(hi, F.greatest(lo, x))


def _scaled(a: Column, x: Column, b: Column) -> Column:
    # 0 * infinity is not a number; a decay to nothing forgets the bound.
    return F.when(a == 0, b).otherwise(a * x + b)


def _then(f: Column, g: Column) -> Column:
    """Effect ``f`` followed by effect ``g``."""
    return F.struct(
        (f["a"] * g["a"]).alias("a"),
        (g["a"] * f["b"] + g["b"]).alias("b"),
        _clamp(_scaled(g["a"], f["lo"], g["b"]), g["lo"], g["hi"]).alias("lo"),
        _clamp(_scaled(g["a"], f["hi"], g["b"]), g["lo"], g["hi"]).alias("hi"),
        F.coalesce(g["set_tier"], f["set_tier"]).alias("set_tier"),
        F.when(g["set_tier"].isNotNull(), g["cap"]).otherwise(F.least(f["cap"], g["cap"])).alias("cap"),
    )


def _compose(effects: Column) -> Column:
    return F.aggregate(effects, _neutral(), _then)


def _command_effect() -> Column:
    command, amount = F.col("command"), F.coalesce("amount", F.lit(None).cast("double"))
    tier = F.coalesce("tier", F.lit(DEFAULT_TIER))
    rate = F.coalesce(amount, F.lit(0.05))
    return (
        F.when(command == "upsert", _effect(1.0, 0.0, -_INF, _INF, None, tier))
        .when(command == "promote", _effect(1.0, 0.0, -_INF, _INF, 1, None))
        .when(command == "demote", _effect(1.0, 0.0, -_INF, _INF, tier, None))
        .when(command == "boost", _effect(1.0, F.coalesce(amount, F.lit(5.0)), -_INF, CEILING, None, None))
        .when(command == "decay", _effect(1.0 - rate, 0.0, FLOOR, _INF, None, None))
        .otherwise(_neutral())
    )


def fold_authors(commands: DataFrame, level_bits: tuple[int, ...] = (12, 24)) -> DataFrame:
    """Commands in order of ``seq`` -> one row per author.

    Commands: upsert (keeps the lower tier, fills name and category), promote, demote, mute, boost, decay.
    Commands before an author's first upsert have no effect, as there is nothing to change yet.
    """
    seq = F.col("seq")
    known = F.col("command") == "upsert"
    rows = commands.withColumn("handle", handle_key(F.col("handle"))).where(F.col("handle") != "")
    present = lambda c: F.when(known & F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("value")))
    muted_at = F.when(F.col("command") == "mute", seq)
    run = F.struct(known.alias("created"), _command_effect().alias("all"))

    # ``live`` is what happens from the first upsert on; null while there is none.
    def collapse(parts: Column) -> Column:
        def step(acc: Column, part: Column) -> Column:
            live = F.when(acc["live"].isNotNull(), _then(acc["live"], part["all"])).otherwise(part["live"])
            return F.struct(_then(acc["all"], part["all"]).alias("all"), live.alias("live"))

        start = F.struct(_neutral().alias("all"), F.lit(None).cast(_EFFECT).alias("live"))
        return F.aggregate(parts, start, step)

    leaf = {
        "display_name": present("display_name"),
        "category": present("category"),
        "created_seq": F.when(known, seq),
        "muted_seq": muted_at,
        "effect": F.struct(run["all"].alias("all"), F.when(run["created"], run["all"]).alias("live")),
    }
    agg = {"display_name": F.max, "category": F.max, "created_seq": F.min, "muted_seq": F.max}
    state = tree_fold(rows, "handle", "seq", leaf, {"effect": collapse}, agg, level_bits)
    live = F.col("effect")["live"]
    return state.where(live.isNotNull()).select(
        "handle",
        F.col("display_name")["value"].alias("display_name"),
        F.least(live["set_tier"], live["cap"]).alias("tier"),
        F.col("category")["value"].alias("category"),
        _clamp(live["a"] * DEFAULT_WEIGHT + live["b"], live["lo"], live["hi"]).alias("weight"),
        F.coalesce(F.col("muted_seq") > F.col("created_seq"), F.lit(False)).alias("muted"),
    )


def decay_due(last_high_signal_at: Column, as_of: datetime, days: int = 7) -> Column:
    return last_high_signal_at.isNull() | (last_high_signal_at < before(as_of, days=days))


def decay(authors: DataFrame, as_of: datetime, rate: float = 0.05) -> DataFrame:
    """Weights of authors without a recent high signal shrink; a weight under the floor is raised to it."""
    lower = F.greatest(F.lit(FLOOR), F.col("weight") * (1 - rate))
    due = decay_due(F.col("last_high_signal_at"), as_of)
    return authors.withColumn("weight", F.when(due, lower).otherwise(F.col("weight")))


def decay_commands(authors: DataFrame, as_of: datetime, rate: float = 0.05) -> DataFrame:
    """The same as rows for the command log."""
    due = authors.where(decay_due(F.col("last_high_signal_at"), as_of))
    return due.select("handle", F.lit("decay").alias("command"), F.lit(rate).alias("amount"))


def author_stats(scored: DataFrame, authors: DataFrame, threshold: float = 7.0) -> DataFrame:
    """Seen, kept, mean score and last high signal of authors, over their full first-pass results."""
    score = F.col("score")
    stats = (
        scored.where(F.col("processed_at").isNotNull())
        .withColumn("handle", handle_key(F.col("author_handle")))
        .groupBy("handle")
        .agg(
            F.count(F.lit(1)).alias("posts_seen"),
            F.count_if(score >= 5).alias("posts_kept"),
            F.avg(score).alias("avg_score"),
            F.max(F.when(score >= threshold, F.col("processed_at"))).alias("last_high_signal_at"),
        )
    )
    return stats.join(authors.select("handle"), "handle", "left_semi")


def author_last_fetched(fetch_log: DataFrame) -> DataFrame:
    """Latest fetch per handle, from log rows whose endpoint names a user."""
    handle = handle_key(F.col("handle"))
    return (
        fetch_log.select(handle.alias("handle"), "executed_at")
        .where(F.col("handle") != "")
        .groupBy("handle")
        .agg(F.max("executed_at").alias("last_fetched_at"))
    )


def reaction_mutes(reactions: DataFrame) -> DataFrame:
    """``x_author`` reactions with a target mute that author; other types are only stored."""
    return reactions.where((F.col("reaction_type") == "x_author") & (handle_key(F.col("target")) != "")).select(
        handle_key(F.col("target")).alias("handle"),
        F.lit("mute").alias("command"),
        F.col("created_at").alias("at"),
    )


def reaction_rejects(reactions: DataFrame, allowed: list[str]) -> DataFrame:
    """Reactions of an unknown type, for quarantine."""
    return reactions.where(~F.coalesce(F.col("reaction_type").isin(allowed), F.lit(False)))


def list_authors(
    authors: DataFrame,
    tier: int | None = None,
    include_muted: bool = False,
    limit: int | None = None,
    least_recent_first: bool = False,
) -> DataFrame:
    rows = authors
    if tier is not None:
        rows = rows.where(F.col("tier") == tier)
    if not include_muted:
        rows = rows.where(~F.col("muted"))
    if least_recent_first:
        epoch = F.lit("1970-01-01").cast("timestamp")
        rows = rows.orderBy(F.coalesce("last_fetched_at", epoch), "handle")
    else:
        rows = rows.orderBy("tier", F.col("weight").desc(), "handle")
    return rows.limit(limit) if limit else rows


def rotation(authors: DataFrame, count: int) -> DataFrame:
    """Next tier-1 authors to fetch: those waiting longest."""
    return list_authors(authors, tier=1, limit=count, least_recent_first=True)


def authors_to_promote(posts: DataFrame, authors: DataFrame, min_bookmarks: int = 3) -> DataFrame:
    """Authors with enough bookmarks that are not tier 1 yet (unknown authors included)."""
    # Counting first leaves one row per author for the join, however hot an author is.
    counts = (
        posts.where("bookmarked").groupBy(F.col("author_handle").alias("handle"))
        .agg(F.count(F.lit(1)).alias("bookmarks")).where(F.col("bookmarks") >= min_bookmarks)
    )
    joined = counts.join(authors.select("handle", "tier"), "handle", "left")
    return joined.where(F.col("tier").isNull() | (F.col("tier") > 1)).select("handle", "bookmarks")
