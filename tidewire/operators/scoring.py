"""Tiers, work routing and the surface for a caller-supplied scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.decode import has_score, model_items, model_output, score_item
from tidewire.functions.text import or_blank
from tidewire.functions.times import vision_age_ok
from tidewire.operators.skew import lookup, materialize
from tidewire.sources.paths import exists

BATCH_SIZE = 15


def signal_tier(score: Column, threshold: float = 7) -> Column:
    return F.when(
        score.isNotNull(),
        F.when(score >= threshold + 1, "high_signal")
        .when(score >= threshold - 1, "market_relevant")
        .when(score >= threshold - 3, "news")
        .otherwise("noise"),
    )


def needs_media_analysis(items: Column) -> Column:
    """Some item has a URL and no analysis yet."""
    done = lambda m: (or_blank(m["kind"]) != "") | (or_blank(m["prose_text"]) != "") | (or_blank(m["short_description"]) != "")
    return F.coalesce(F.exists(items, lambda m: (or_blank(m["url"]) != "") & ~done(m)), F.lit(False))


def work_routing(
    scored: DataFrame,
    authors: DataFrame,
    as_of: datetime,
    *,
    summary_min: float = 5,
    analysis_min: float = 6,
    article_min: float = 5,
    media_min: float = 5,
    vision_max_age_days: int | None = None,
    force_refresh: bool = False,
) -> DataFrame:
    """Which follow-up work each scored post needs, as flags. The cheap tests run before any costly work."""
    score, fresh = F.col("score"), F.lit(force_refresh)
    blank = lambda c: or_blank(F.col(c)) == ""
    article = (
        F.col("is_article")
        & (fresh | F.col("article_processed_at").isNull())
        & (score >= article_min)
        & ~(blank("article_text") & blank("article_preview") & blank("article_title"))
    )
    vision = vision_age_ok(F.col("created_at"), vision_max_age_days, as_of)
    open_media = needs_media_analysis(F.col("media_items"))
    flags = {
        "needs_summary": (F.length("content") > 500) & (score >= summary_min) & (fresh | blank("content_summary")),
        "needs_analysis": (score >= analysis_min) & (fresh | F.col("analysis").isNull()),
        "needs_article": article,
        "media_via_article": article & vision & open_media,
        "needs_media": vision & (score >= media_min) & open_media & ~(article & vision & open_media),
    }
    # Flags first: no text crosses the shuffle of the authors.
    narrow = scored.select("id", F.lower("author_handle").alias("handle_key"), *[f.alias(n) for n, f in flags.items()])
    tier1 = authors.where(F.col("tier") == 1).select(F.lower("handle").alias("handle_key")).distinct()
    rows = lookup(narrow, tier1.withColumn("is_tier1", F.lit(True)), "handle_key")
    flags = {n: F.col(n) for n in flags} | {"needs_summary": F.col("needs_summary") & F.col("is_tier1").isNull()}
    no = F.lit(False)
    return rows.select("id", *[F.coalesce(flag, no).alias(name) for name, flag in flags.items()])


SCORED_BATCH = "ids array<string>, raw string, error string"
_LOGGED = "ids array<string>, addresses array<string>, raw string, error string"


def score_batches(
    posts: DataFrame, scorer: Callable[[list[dict]], str], batch_size: int = BATCH_SIZE
) -> DataFrame:
    """Calls ``scorer`` with lists of ``batch_size`` posts where they lie; it returns the model's raw text.

    A batch whose call fails yields its ids and the error; nothing else of the job is affected, and its posts stay
    unprocessed. Callers filter and cut the texts first: no predicate moves through a Python map. Every action on the
    result calls the scorer again; ``logged_answers`` keeps what it said.
    """
    return posts.mapInPandas(_scored(scorer, batch_size), SCORED_BATCH)


def _scored(scorer: Callable[[list[dict]], str], batch_size: int):
    """Frames of posts -> frames of (ids, raw answer, error), a row for each batch."""

    def call(rows: list[dict]) -> tuple[list[str], str | None, str | None]:
        ids = [row["id"] for row in rows]
        try:
            return ids, scorer(rows), None
        except Exception as failure:  # the scorer is foreign code
            return ids, None, f"{type(failure).__name__}: {failure}"[:500]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[dict] = []
        for frame in frames:
            waiting.extend(frame.to_dict("records"))
            whole = len(waiting) - len(waiting) % batch_size
            done = [call(waiting[i : i + batch_size]) for i in range(0, whole, batch_size)]
            waiting = waiting[whole:]
            yield pd.DataFrame(done, columns=["ids", "raw", "error"])
        if waiting:
            yield pd.DataFrame([call(waiting)], columns=["ids", "raw", "error"])

    return run


def logged_answers(
    posts: DataFrame, scorer: Callable[[list[dict]], str], log: str, batch_size: int = BATCH_SIZE
) -> DataFrame:
    """Batches as ``score_batches`` gives them for these posts, each question put to the scorer once for all time.

    A question's address is the hash of all its columns. Answers are written to ``log`` with the addresses they answer,
    and read from there: scores, failures and a later run over the same posts call nothing. Posts whose call failed are
    asked again by the next run. A task that dies asks again only what it had not written, the batches of its partition.
    """
    spark = posts.sparkSession
    named = F.sha2(F.to_json(F.struct(*sorted(posts.columns)), {"ignoreNullFields": "false"}), 256)
    asked = materialize(posts.withColumn("address", named))
    known = spark.read.schema(_LOGGED).parquet(log) if exists(spark, log) else spark.createDataFrame([], _LOGGED)
    answered = known.where(F.col("error").isNull()).select(F.explode("addresses").alias("address"))
    # Copies of a question are put once.
    fresh = lookup(asked, answered, "address", "left_anti").dropDuplicates(["address"])

    def bare(rows: list[dict]) -> str:
        return scorer([{k: v for k, v in row.items() if k != "address"} for row in rows])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        addresses: dict[str, str] = {}

        def noted(parts):
            for frame in parts:
                addresses.update(zip(frame["id"], frame["address"]))
                yield frame

        for done in _scored(bare, batch_size)(noted(frames)):
            if len(done):
                yield done.assign(addresses=[[addresses.pop(i) for i in ids] for ids in done["ids"]])[["ids", "addresses", "raw", "error"]]

    fresh.mapInPandas(run, _LOGGED).write.mode("append").parquet(log)
    told = spark.read.schema(_LOGGED).parquet(log).withColumn("batch", F.sha2(F.concat_ws(",", "addresses"), 256))
    each = told.select("batch", "error", F.explode(F.arrays_zip("ids", "addresses")).alias("q")).select(
        F.col("q.addresses").alias("address"), "batch", F.col("error").isNull().alias("good")
    )
    # The good answer where there is one, else a failed one; each batch with the ids that are asked for now.
    best = each.groupBy("address").agg(F.max(F.struct("good", "batch")).alias("b")).select("address", "b.*")
    ids = lookup(asked.select("id", "address"), best, "address", "inner").groupBy("batch", "good").agg(F.collect_set("id").alias("ids"))
    once = told.withColumn("good", F.col("error").isNull()).dropDuplicates(["batch", "good"]).select("batch", "good", "raw", "error")
    return ids.join(once, ["batch", "good"]).select("ids", "raw", "error")


def normalize_scores(batches: DataFrame) -> DataFrame:
    """Raw scorer texts -> score results, for ids of their batch with a score that is a number (or missing: 0).

    All other ids of a batch are in ``score_failures``. Both read ``batches``: take them from ``logged_answers``, or the
    scorer is called once for each.
    """
    items = F.filter(model_items(F.col("raw")), has_score)
    scored = batches.where(F.col("raw").isNotNull()).select("ids", F.explode(items).alias("v"))
    return scored.select("ids", score_item(F.col("v")).alias("s")).where(F.array_contains("ids", F.col("s.id"))).select("s.*")


def score_failures(batches: DataFrame) -> DataFrame:
    """Batches for quarantine, with the ids that got no score: the call failed, its text could not be parsed, or the
    answer leaves them out or scores them by no number."""
    items = F.filter(model_items(F.col("raw")), has_score)
    answered = F.transform(items, lambda v: F.try_variant_get(v, "$.id", "string"))
    missing = F.array_except("ids", F.coalesce(answered, F.array().cast("array<string>")))
    why = F.when(model_output(F.col("raw")).isNull(), "unparsable output").otherwise("no score in the answer")
    return batches.withColumn("ids", F.when(F.col("error").isNotNull(), F.col("ids")).otherwise(missing)).where(
        F.size("ids") > 0).withColumn("error", F.coalesce("error", why))
