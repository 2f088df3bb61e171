"""One run of the whole cycle: queue, dependencies, links, context, scores, routing, alerts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.times import at
from tidewire.operators.alerts import alert_candidates, alert_gate
from tidewire.operators.graph import author_context, context_text, expand_dependencies
from tidewire.operators.links import expand_short_urls
from tidewire.operators.scoring import logged_answers, normalize_scores, score_failures, signal_tier, work_routing
from tidewire.operators.skew import materialize


@dataclass(frozen=True)
class Cycle:
    """What a run leaves behind: rows for the score log, batches for quarantine, work flags, alert decisions."""

    scores: DataFrame
    failures: DataFrame
    routing: DataFrame
    alerts: DataFrame


# Columns of a post that its scores replace.
_REPLACED = ("score", "categories", "summary", "tickers", "surprise", "is_stale_repeat", "themes", "playbook_trigger",
             "catalyst_status", "direction", "signal_tier", "processed_at")


def process_cycle(
    posts: DataFrame, queue: DataFrame, authors: DataFrame, url_map: DataFrame, scorer: Callable[[list[dict]], str], log: str,
    as_of: datetime, *, depth: int = 3, chat: Column | None = None, alert_threshold: float = 8, routing: dict | None = None,
    gate: dict | None = None, texts: Callable[[DataFrame], DataFrame] | None = None,
) -> Cycle:
    """Process the posts of ``queue`` (ids) and the unprocessed posts they depend on, at ``as_of``.

    ``posts`` have their texts, or ``texts`` adds them to rows of posts, once these have moved. Dependencies are followed, short links of what was found are resolved by ``url_map``, and
    dependencies are followed once more, as a resolved link may point to a post. Each post is put to ``scorer`` once, with
    the posts it quotes, answers or links to and what is known of its author; answers are kept in ``log``. Scores get a
    tier; flags tell which further work a post needs, and the alert gate which of them are sent (``chat`` names a
    post's chat, one for all by default). Nothing is marked here: the caller appends ``scores`` to its log.
    """
    told = texts or (lambda rows: rows)
    first = materialize(expand_dependencies(told(posts), queue, depth).select("id"))
    resolved = expand_short_urls(told(posts.join(first, "id", "left_semi")).select("id", "links"), url_map)
    linked = materialize(resolved.select("id", F.col("links").alias("_links")))
    known = posts.join(linked, "id", "left").withColumn("links", F.coalesce("_links", "links")).drop("_links")
    chosen = materialize(expand_dependencies(told(known), queue, depth).select("id"))
    bare = known.join(chosen, "id", "left_semi")
    page = told(bare)
    asked = context_text(known, page=bare, texts=texts).join(author_context(page, authors), "id")
    answers = materialize(logged_answers(asked, scorer, log))
    scores = normalize_scores(answers).withColumn("signal_tier", signal_tier(F.col("score"))).withColumn("processed_at", at(as_of))
    scores = materialize(scores)
    fields = [c for c in scores.columns if c != "id" and c in _REPLACED]
    scored = page.drop(*fields).join(scores.select("id", *fields), "id")
    named = F.lit("main") if chat is None else chat
    due = alert_candidates(scored, alert_threshold).select("id", named.alias("chat"), F.col("processed_at").alias("ts"), "score")
    return Cycle(scores, score_failures(answers), work_routing(scored, authors, as_of, **(routing or {})), alert_gate(due, **(gate or {})))
