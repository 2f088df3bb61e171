"""Chat formatting by quotation linking, built from column functions alone.

A message is cut into runs of lines of one quote level (the number of ``>`` before them). Quoted runs are normalised and
hashed and joined to the earliest message of the conversation that wrote the same; the least deep quote names the message
that is answered. Messages are then ordered by reply: an answer to an earlier message opens a branch behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import checkpointed

# Turns per block: neighbours are found in blocks and then between them, so no conversation is sorted in one place.
BLOCK = 1024
# A quoted line of fewer words does not link by itself.
LINE_WORDS = 3

_MARK = r"(?m)(?:^|\G)[ \t]*>"
_RUN = r"(?m)^(>*+)[^\n]*+(?:\n\1(?!>)[^\n]*+)*+"


def segments(text: Column) -> Column:
    """Array of (level, body): runs of lines of one quote level, marks and one blank after them taken off."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), _MARK, ">")
    runs = F.regexp_extract_all(marked, F.lit(_RUN), F.lit(0))
    return F.transform(runs, lambda run: F.struct(
        F.length(F.regexp_extract(run, "^(>*)", 1)).alias("level"), F.regexp_replace(run, "(?m)^>+[ \t]?", "").alias("body"),
    ))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _units(body: Column, least_words: int) -> Column:
    """Hashes of a passage and, apart, of its lines of some words: array of (whole, hash)."""
    lines = F.filter(F.transform(F.split(body, "\n", -1), normal), lambda x: F.size(F.split(x, " ")) >= least_words)
    whole = F.filter(F.array(normal(body)), lambda x: x != "")
    return F.concat(
        F.transform(whole, lambda x: F.struct(F.lit(True).alias("whole"), F.xxhash64(x).alias("h"))),
        F.transform(lines, lambda x: F.struct(F.lit(False).alias("whole"), F.xxhash64(x).alias("h"))),
    )


def _before(turns: DataFrame, value: Column, name: str, strict: bool) -> DataFrame:
    """Adds the largest ``value`` at turns before (``strict``) or up to each turn of its conversation, block by block."""
    blocked = turns.withColumn("_block", F.floor(F.col("turn") / BLOCK)).withColumn("_value", value)
    inside = Window.partitionBy("conv_id", "_block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    blocks = blocked.groupBy("conv_id", "_block").agg(F.max("_value").alias("_most"))
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("conv_id", "_block", F.max("_most").over(earlier).alias("_carried"))
    joined = blocked.withColumn("_inside", F.max("_value").over(inside)).join(carried, ["conv_id", "_block"])
    return joined.withColumn(name, F.coalesce("_inside", "_carried")).drop("_block", "_value", "_inside", "_carried")


def _paths(runs: DataFrame) -> DataFrame:
    """(conv_id, run, path): the branches that lead to each run, by doubling. A branch is (-answered turn, first turn)."""
    now = checkpointed(runs)
    while now.where(F.col("up").isNotNull()).limit(1).count():
        above = now.select("conv_id", F.col("run").alias("up"), F.col("path").alias("head"), F.col("up").alias("next"))
        joined = now.join(above, ["conv_id", "up"], "left")
        now = checkpointed(joined.select(
            "conv_id", "run", F.concat(F.coalesce("head", F.array().cast("array<struct<back:bigint,first:bigint>>")), "path").alias("path"),
            F.col("next").alias("up"),
        ))
    return now.select("conv_id", "run", "path")


def link(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, body, n_quotes, n_linked, parent_turn, path, formatted.

    ``body`` is the text without quotes; ``n_quotes`` counts quoted runs, ``n_linked`` those found in an earlier message
    of the conversation, whole or by a line of some words. ``parent_turn`` is the latest message that the least deep
    linked quote comes from, else the message before (null for the first). ``path`` orders branches: messages sorted by
    (conv_id, path, turn) stand in reply order, each behind the one it answers. ``formatted`` is the body under its
    role's header.

    Rows with equal conversation and turn are one message for links and keep a row each. A null conversation or turn
    links to nothing and has no parent; null texts and roles count as empty and ``user``. Earliest originals are
    pre-aggregated, so a passage that many messages share joins one row.
    """
    rows = messages.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("user")).alias("role"), segments(F.col(text).cast("string")).alias("parts"),
    )
    own = F.filter("parts", lambda p: p["level"] == 0)
    quoted = F.filter("parts", lambda p: (p["level"] > 0) & (normal(p["body"]) != ""))
    body = F.trim(F.array_join(F.transform(own, lambda p: p["body"]), "\n"), F.lit(" \t\r\n"))
    rows = checkpointed(rows.select("conv_id", "turn", "role", body.alias("body"), quoted.alias("quotes")))
    placed = rows.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())

    paragraphs = F.split("body", r"\n[ \t]*\n", -1)
    written = F.array_distinct(F.flatten(F.transform(F.concat(F.array("body"), paragraphs), lambda p: _units(p, 1))))
    originals = placed.select("conv_id", "turn", F.explode(written).alias("u")).groupBy("conv_id", F.col("u.h").alias("h")).agg(
        F.min("turn").alias("origin"))
    asked = placed.where(F.size("quotes") > 0).select("conv_id", "turn", F.posexplode("quotes").alias("q", "quote"))
    asked = asked.select("conv_id", "turn", "q", "quote.level", F.explode(F.array_distinct(_units(F.col("quote.body"), LINE_WORDS))).alias("u"))
    asked = asked.select("conv_id", "turn", "q", "level", "u.whole", F.col("u.h").alias("h"))
    found = asked.join(originals, ["conv_id", "h"]).where(F.col("origin") < F.col("turn"))
    linked = found.groupBy("conv_id", "turn", "q", "level").agg(F.max(F.struct("whole", "origin"))["origin"].alias("origin"))
    answered = checkpointed(linked.groupBy("conv_id", "turn").agg(
        F.max_by("origin", F.struct(-F.col("level"), F.col("origin"))).alias("answers"), F.countDistinct("q").alias("n_linked")))

    turns = placed.select("conv_id", "turn").distinct().join(answered, ["conv_id", "turn"], "left")
    turns = _before(turns, F.col("turn"), "previous", True).withColumn("parent_turn", F.coalesce("answers", "previous"))
    jump = F.when(F.col("previous").isNull() | (F.col("parent_turn") != F.col("previous")), F.col("turn"))
    turns = checkpointed(_before(turns, jump, "run", False))
    at = turns.select("conv_id", F.col("turn").alias("parent_turn"), F.col("run").alias("up"))
    none = F.array().cast("array<struct<back:bigint,first:bigint>>")
    heads = turns.where(F.col("turn") == F.col("run")).select("conv_id", "run", "parent_turn")
    branch = F.array(F.struct((-F.col("parent_turn")).alias("back"), F.col("run").alias("first")))
    runs = heads.join(at, ["conv_id", "parent_turn"], "left").select(
        "conv_id", "run", F.when(F.col("parent_turn").isNull(), none).otherwise(branch).alias("path"), "up")
    places = turns.join(_paths(runs), ["conv_id", "run"]).select("conv_id", "turn", "parent_turn", "n_linked", "path")
    joined = rows.join(places, ["conv_id", "turn"], "left")
    return joined.select(
        "conv_id", "turn", "role", "body", F.size("quotes").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "parent_turn", F.coalesce("path", none).alias("path"),
        F.concat(F.lit("<|"), "role", F.lit("|>\n"), "body", F.lit("\n")).alias("formatted"),
    )


def reply_ordered(linked: DataFrame) -> DataFrame:
    """The messages in reply order, dealt out by ranges of the order, so a huge conversation takes many tasks."""
    return linked.orderBy("conv_id", "path", "turn", "role", "body")
