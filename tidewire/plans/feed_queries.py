"""Pages, counts, usage and metrics."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire import constants as C
from tidewire.functions.times import parse_timestamp, time_range
from tidewire.operators import authors, feed, media, metrics, narratives, stats, usage
from tidewire.operators.skew import shared_folder
from tidewire.plans.catalog import CATALOG, DAY, query
from tidewire.plans.feed_views import AS_OF, Feed

_PAGE = ("id", "author_handle", "created_at", "score", "signal_tier", "categories", "tickers", "bookmarked")
_PAGE_SQL = """id, author_handle, epoch_us(created_at) AS created_at, score, signal_tier,
  array_to_string(categories, ',') AS categories, array_to_string(tickers, ',') AS tickers, bookmarked"""


@query("Q1 Q2", f"""
, page AS (SELECT * FROM posts WHERE processed_at IS NOT NULL AND score >= 5
           ORDER BY score DESC NULLS LAST, created_at DESC NULLS LAST, id LIMIT 50),
  r AS (SELECT post_id, array_to_string(list_sort(list(DISTINCT reaction_type)), ',') AS types FROM reactions GROUP BY 1)
SELECT {_PAGE_SQL}, coalesce(r.types, '') AS reactions FROM page LEFT JOIN r ON r.post_id = page.id""")
def feed_page(t: Feed) -> DataFrame:
    page = feed.feed(t.posts, order="relevance", min_score=5, limit=50).select(*_PAGE)
    return feed.attach_reactions(page, t.reactions, 50)


@query("Q1 Q4 Q5 T3 T4", f"""
SELECT {_PAGE_SQL} FROM posts WHERE processed_at IS NOT NULL AND list_contains(categories, 'fed_policy')
  AND len(list_filter(tickers, lambda x: contains(upper(x), 'T'))) > 0
  AND created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-21'
ORDER BY created_at DESC, id LIMIT 40 OFFSET 20""")
def feed_filtered(t: Feed) -> DataFrame:
    since, until = time_range("2024-01-10..2024-01-20", AS_OF)
    return feed.feed(
        t.posts, order="latest", category="fed_policy", ticker="t", since=since, until=until, limit=40, offset=20
    ).select(*_PAGE)


@query("Q1 Q5 Q6", f"""
SELECT {_PAGE_SQL} FROM posts WHERE processed_at IS NOT NULL AND bookmarked AND signal_tier = 'news'
  AND list_contains(tickers, 'X') ORDER BY score DESC, created_at DESC, id LIMIT 30""")
def feed_bookmarked_tier(t: Feed) -> DataFrame:
    return feed.feed(t.posts, bookmarked=True, tier="news", ticker="x", strict_ticker=True, limit=30).select(*_PAGE)


@query("Q6", f"""
SELECT {_PAGE_SQL} FROM posts WHERE processed_at IS NOT NULL AND author_handle = 'u3'
ORDER BY score DESC, created_at DESC, id LIMIT 50""")
def feed_author(t: Feed) -> DataFrame:
    return feed.feed(t.posts, author="@u3").select(*_PAGE)


@query("Q3", """
, page AS (SELECT id FROM posts WHERE processed_at IS NOT NULL AND score >= 9.5
  ORDER BY score DESC, created_at DESC, id LIMIT 50)
SELECT count(*) AS count, CAST(50 AS BIGINT) AS "limit", CAST(0 AS BIGINT) AS "offset", count(*) = 50 AS has_more FROM page""")
def feed_envelope(t: Feed) -> DataFrame:
    return feed.page_envelope(feed.feed(t.posts, min_score=9.5, limit=50), 50)


@query("Q7 Q11", """
SELECT id, score FROM posts WHERE id IN (SELECT post_id FROM reactions)""")
def posts_by_ids(t: Feed) -> DataFrame:
    return feed.posts_by_ids(t.posts, t.reactions.select(F.col("post_id").alias("id"))).select("id", "score")


@query("Q8", """
SELECT id, epoch_us(created_at) AS created_at FROM posts WHERE processed_at IS NULL ORDER BY posts.created_at DESC, id LIMIT 50""")
def unprocessed_queue(t: Feed) -> DataFrame:
    return feed.unprocessed(t.posts).select("id", "created_at")


@query("Q9", """
SELECT id, score FROM posts WHERE processed_at IS NOT NULL AND ((has_quote AND quote_id IS NOT NULL) OR reply_id IS NOT NULL)
  AND reprocessed_at IS NULL AND CAST(created_at AS DATE) = DATE '2024-01-15' AND score >= 3
ORDER BY created_at DESC, id LIMIT 200""")
def reprocess_candidates(t: Feed) -> DataFrame:
    return feed.reprocess_candidates(t.posts, DAY).select("id", "score")


@query("Q10", """
SELECT id, score FROM posts WHERE score >= 7 AND (analysis IS NULL
  OR (has_quote AND quote_id IS NOT NULL AND media_analysis IS NULL) OR (has_media AND media_analysis IS NULL))
ORDER BY score DESC, id LIMIT 10""")
def enrichment_candidates(t: Feed) -> DataFrame:
    return feed.enrichment_candidates(t.posts).select("id", "score")


@query("Q12", """
SELECT handle, tier, weight FROM authors WHERE NOT muted ORDER BY tier, weight DESC, handle LIMIT 100""")
def authors_list(t: Feed) -> DataFrame:
    return authors.list_authors(t.authors, limit=100).select("handle", "tier", "weight")


@query("Q13", """
SELECT handle, epoch_us(last_fetched_at) AS last_fetched_at FROM authors WHERE NOT muted AND tier = 1
ORDER BY coalesce(authors.last_fetched_at, TIMESTAMP '1970-01-01'), handle LIMIT 25""")
def author_rotation(t: Feed) -> DataFrame:
    return authors.rotation(t.authors, 25).select("handle", "last_fetched_at")


@query("Q14", """
SELECT endpoint, epoch_us(max(executed_at)) AS executed_at FROM fetch_log GROUP BY 1""")
def last_fetch(t: Feed) -> DataFrame:
    return feed.last_fetch(t.fetch_log).select("endpoint", "executed_at")


@query("Q15 T2", """
SELECT id, signal_tier, score, CASE signal_tier WHEN 'high_signal' THEN 3 WHEN 'market_relevant' THEN 2 ELSE 1 END::BIGINT AS tier_rank
FROM posts WHERE processed_at IS NOT NULL AND score >= 5 AND CAST(created_at AS DATE) = DATE '2024-01-15' AND signal_tier <> 'noise'""")
def digest_selection(t: Feed) -> DataFrame:
    return feed.digest(t.posts, DAY).select("id", "signal_tier", "score", "tier_rank")


@query("Q16 X10", """
SELECT id, author_handle, 'https://x.com/' || author_handle || '/status/' || id AS url, surprise,
  CASE WHEN len(themes) > 0 THEN array_to_string(themes, ',') END AS themes, playbook_trigger, catalyst_status
FROM posts WHERE processed_at IS NOT NULL ORDER BY created_at DESC, id LIMIT 200""")
def search_row_json(t: Feed) -> DataFrame:
    rows = feed.search_row_json(feed.feed(t.posts, order="latest", limit=200))
    text = lambda p: F.get_json_object("json", f"$.{p}")
    themes = F.regexp_replace(text("themes"), r'[\[\]"]', "")
    return rows.select(
        "id", text("author_handle").alias("author_handle"), text("url").alias("url"),
        text("surprise").cast("long").alias("surprise"), themes.alias("themes"),
        text("playbook_trigger").alias("playbook_trigger"), text("catalyst_status").alias("catalyst_status"),
    )


@query("Q17", """
SELECT id, '[' || CASE WHEN coalesce(score, 0) <> 0 THEN printf('%.1f', score) ELSE '-' END || ']'
  || CASE WHEN bookmarked THEN '*' ELSE '' END || ' @' || author_handle || ' (' || strftime(created_at, '%m/%d %H:%M') || ')'
  || CASE WHEN len(tickers) > 0 THEN ' [' || array_to_string(tickers, ',') || ']' ELSE '' END || ' ' || substr(summary, 1, 80) AS line
FROM posts""")
def brief_lines(t: Feed) -> DataFrame:
    return feed.brief_lines(t.full_posts)


@query("Q18", """
, page AS (SELECT r.* FROM reactions r WHERE reaction_type = '>>' AND post_id IN (SELECT id FROM posts)
           ORDER BY created_at DESC, reaction_id DESC LIMIT 100)
SELECT reaction_id, post_id, author_handle, substr(content, 1, 500) AS content, score
FROM page JOIN posts ON posts.id = page.post_id JOIN texts USING (n)""")
def reactions_export(t: Feed) -> DataFrame:
    rows = feed.reactions_export(t.reactions, t.full_posts, ">>", 100)
    return rows.select("reaction_id", "post_id", "author_handle", "content", "score")


@query("Q18", """
SELECT reaction_id, reaction_type FROM reactions WHERE post_id = '17'""")
def reactions_of_post(t: Feed) -> DataFrame:
    return feed.reactions_for_post(t.reactions, "17").select("reaction_id", "reaction_type")


@query("Q19", """
SELECT reaction_type, count(*) AS count FROM reactions
WHERE reaction_id NOT IN (SELECT seq FROM author_commands WHERE command = 'mute') GROUP BY 1""")
def live_reactions(t: Feed) -> DataFrame:
    deleted = t.author_commands.where("command = 'mute'").select(F.col("seq").alias("reaction_id"))
    return stats.reaction_summary(feed.live_reactions(t.reactions, deleted))


@query("Q20", """
SELECT id, author_handle, score,
  coalesce((SELECT array_to_string(list_sort(list(DISTINCT reaction_type)), ',') FROM reactions WHERE post_id = '25'), '') AS reactions
FROM posts WHERE id = '25'""")
def post_detail(t: Feed) -> DataFrame:
    return feed.post_detail(t.posts, t.reactions, "25").select("id", "author_handle", "score", "reactions")


@query("S9", """
SELECT id, epoch_us(created_at) AS created_at, score FROM posts WHERE created_at >= TIMESTAMP '2024-01-22 12:00:00'""")
def export_recent(t: Feed) -> DataFrame:
    return feed.export_recent(t.posts, AS_OF, 7).select("id", "created_at", "score")


@query("A1 T2", """
SELECT count(*) AS total, count(processed_at) AS processed, count(*) - count(processed_at) AS pending,
  round(avg(score), 6) AS avg_score, count(*) FILTER (score >= 7) AS high_signal, count(*) FILTER (score >= 5) AS digest_worthy
FROM posts WHERE created_at >= TIMESTAMP '2024-01-15 05:00:00' AND created_at < TIMESTAMP '2024-01-16 05:00:00'""")
def post_stats_day(t: Feed) -> DataFrame:
    return stats.post_stats(t.posts, DAY)


@query("A1", """
SELECT count(*) AS total, count(processed_at) AS processed, count(*) - count(processed_at) AS pending,
  round(avg(score), 6) AS avg_score, count(*) FILTER (score >= 7) AS high_signal, count(*) FILTER (score >= 5) AS digest_worthy
FROM posts""")
def post_stats(t: Feed) -> DataFrame:
    return stats.post_stats(t.posts)


@query("A2", """
SELECT count(*) FILTER (processed_at >= TIMESTAMP '2024-01-29 11:00:00') AS last_hour,
  count(*) FILTER (processed_at >= TIMESTAMP '2024-01-28 12:00:00') AS last_24h,
  count(*) FILTER (processed_at >= TIMESTAMP '2024-01-22 12:00:00') AS last_7d FROM posts""")
def processed_counts(t: Feed) -> DataFrame:
    return stats.processed_counts(t.posts, AS_OF)


@query("A3", """
SELECT category, count(*) AS count FROM (SELECT unnest(categories) AS category FROM posts WHERE processed_at IS NOT NULL) GROUP BY 1""")
def category_counts(t: Feed) -> DataFrame:
    return stats.category_counts(t.posts)


@query("A4", """
SELECT upper(x) AS ticker, count(*) AS count FROM (SELECT unnest(tickers) AS x FROM posts WHERE processed_at IS NOT NULL)
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def ticker_counts(t: Feed) -> DataFrame:
    return stats.ticker_counts(t.posts)


@query("A5 M14", """
SELECT author_handle, count(*) AS count FROM posts WHERE bookmarked GROUP BY 1""")
def bookmark_counts(t: Feed) -> DataFrame:
    return stats.bookmark_counts(t.posts)


@query("A6", "SELECT reaction_type, count(*) AS count FROM reactions GROUP BY 1")
def reaction_summary(t: Feed) -> DataFrame:
    return stats.reaction_summary(t.reactions)


@query("A14", """
SELECT count(*) AS alerts FROM events WHERE ts >= TIMESTAMP '2024-01-29 11:00:00'""")
def alert_count(t: Feed) -> DataFrame:
    return stats.alert_count(t.alert_log, AS_OF)


@query("A16", """
SELECT endpoint, count(*) AS runs, CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(new) AS BIGINT) AS new FROM fetch_log GROUP BY 1""")
def fetch_summary(t: Feed) -> DataFrame:
    return stats.fetch_summary(t.fetch_log)


@query("A17", """
SELECT event_type, count(*) AS processed, count(*) FILTER (score >= 8) AS high_signal,
  count(*) FILTER (score >= 6 AND score < 8) AS market_relevant FROM posts WHERE processed_at IS NOT NULL GROUP BY 1""")
def run_tier_counts(t: Feed) -> DataFrame:
    return stats.run_tier_counts(t.posts.where("processed_at IS NOT NULL"), "event_type")


@query("A15", """
, j AS (SELECT g.*, r.id IS NOT NULL AS got, r.score, r.surprise AS s, r.stale AS st,
          CASE WHEN r.trigger = 'vol_substitution' THEN NULL ELSE r.trigger END AS act, r.catalyst AS c, r.direction AS d
        FROM golden g LEFT JOIN golden_results r USING (id)),
  k AS (SELECT count(*) AS n, count(*) FILTER (got AND score BETWEEN score_min AND score_max) AS band,
          count(*) FILTER (got AND s = surprise) AS sur, count(*) FILTER (got AND st = stale) AS sta,
          count(*) FILTER (got AND c IS NOT DISTINCT FROM catalyst) AS cat, count(*) FILTER (got AND d = direction) AS dir,
          count(*) FILTER (coalesce(trigger, '') <> 'vol_substitution' AND got AND act = trigger) AS tp,
          count(*) FILTER (coalesce(trigger, '') <> 'vol_substitution' AND got AND act IS NOT NULL AND act IS DISTINCT FROM trigger) AS fp,
          count(*) FILTER (trigger IS NOT NULL AND trigger <> 'vol_substitution' AND (NOT got OR act IS DISTINCT FROM trigger)) AS fn
        FROM j),
  m AS (SELECT n AS total, band / n AS band_accuracy, sur / n AS surprise_accuracy, sta / n AS stale_accuracy,
          CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS trigger_precision,
          CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS trigger_recall,
          cat / n AS catalyst_accuracy, dir / n AS direction_accuracy FROM k)
SELECT total, round(band_accuracy, 6) AS band_accuracy, round(surprise_accuracy, 6) AS surprise_accuracy,
  round(stale_accuracy, 6) AS stale_accuracy, round(trigger_precision, 6) AS trigger_precision,
  round(trigger_recall, 6) AS trigger_recall, round(catalyst_accuracy, 6) AS catalyst_accuracy,
  round(direction_accuracy, 6) AS direction_accuracy,
  total >= 20 AND band_accuracy >= 0.6 AND surprise_accuracy >= 0.6 AND stale_accuracy >= 0.75 AND trigger_precision >= 0.7
    AND trigger_recall >= 0.7 AND catalyst_accuracy >= 0.7 AND direction_accuracy >= 0.6 AS passed FROM m""")
def golden_eval(t: Feed) -> DataFrame:
    return stats.golden_eval(t.golden, t.golden_results)


# --- usage ------------------------------------------------------------------------------------------------------

_SUMS = """CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens, CAST(sum(cached_input_tokens) AS BIGINT) AS cached_input_tokens,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens"""
_SUMMARY = f"""component, provider, model, count(*) AS calls, count(*) FILTER (success) AS successes,
  count(*) FILTER (NOT success AND completed) AS failures, count(*) FILTER (NOT completed) AS incomplete_attempts,
  {_SUMS}, round(sum(estimated_cost_usd), 6) AS stored_estimated_cost_usd, round(avg(latency_seconds), 6) AS avg_latency_seconds"""
_PRICED = """
, pairs AS (SELECT DISTINCT provider, model FROM usage_attempts),
  priced AS (SELECT p.provider, p.model, arg_max(r.pin, length(r.model)) AS pin, arg_max(r.pout, length(r.model)) AS pout,
               arg_max(r.pcached, length(r.model)) AS pcached
             FROM pairs p JOIN prices r ON r.provider = lower(trim(p.provider)) AND starts_with(lower(trim(p.model)), r.model)
             GROUP BY 1, 2)"""
_COST = """coalesce(greatest(0, coalesce({i}, 0) - greatest(0, coalesce({c}, 0))) / 1000000 * pin
  + greatest(0, coalesce({c}, 0)) / 1000000 * pcached
  + greatest(0, coalesce({o}, 0) + CASE WHEN provider = 'gemini' THEN coalesce({r}, 0) ELSE 0 END) / 1000000 * pout, 0)"""


@query("M22", """
SELECT attempt_id, component, provider, model, success, completed, input_tokens, error_length FROM usage_attempts""")
def usage_attempts(t: Feed) -> DataFrame:
    folded = usage.fold_attempts(t.usage_events)
    return folded.select(
        "attempt_id", "component", "provider", "model", "success",
        (F.col("attempt_status") == "completed").alias("completed"), "input_tokens",
        F.length("error_message").alias("error_length"),
    )


@query("A7", f"SELECT {_SUMMARY} FROM usage_attempts WHERE called_at >= TIMESTAMP '1997-01-01' GROUP BY 1, 2, 3")
def usage_summary(t: Feed) -> DataFrame:
    as_of = datetime(1997, 1, 31, tzinfo=timezone.utc)
    return usage.usage_summary(usage.fold_attempts(t.usage_events), as_of, 30)


@query("A8 G15", f"""{_PRICED}, s AS (SELECT {_SUMMARY} FROM usage_attempts GROUP BY 1, 2, 3)
SELECT component, provider, model, calls,
  round({_COST.format(i="input_tokens", c="cached_input_tokens", o="output_tokens", r="reasoning_tokens")}, 6) AS reestimated_cost_usd
FROM s LEFT JOIN priced USING (provider, model)""")
def reestimated_cost(t: Feed) -> DataFrame:
    summary = usage.usage_summary(usage.fold_attempts(t.usage_events))
    costs = usage.reestimated_cost(summary, usage.model_prices(t.spark))
    return costs.select("component", "provider", "model", "calls", "reestimated_cost_usd")


@query("A9", f"""{_PRICED}, s AS (SELECT {_SUMMARY} FROM usage_attempts GROUP BY 1, 2, 3)
SELECT CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(successes) AS BIGINT) AS successes, CAST(sum(failures) AS BIGINT) AS failures,
  CAST(sum(incomplete_attempts) AS BIGINT) AS incomplete_attempts, {_SUMS},
  round(sum(stored_estimated_cost_usd), 4) AS stored_estimated_cost_usd,
  round(sum({_COST.format(i="input_tokens", c="cached_input_tokens", o="output_tokens", r="reasoning_tokens")}), 4)
    AS reestimated_cost_usd
FROM s LEFT JOIN priced USING (provider, model)""")
def usage_totals(t: Feed) -> DataFrame:
    summary = usage.usage_summary(usage.fold_attempts(t.usage_events))
    totals = usage.usage_totals(usage.reestimated_cost(summary, usage.model_prices(t.spark)))
    return totals.withColumns({n: F.round(n, 4) for n in ("stored_estimated_cost_usd", "reestimated_cost_usd")})


@query("A10 G15", f"""{_PRICED}
SELECT attempt_id, round(1e6 * {_COST.format(i="input_tokens", c="cached_input_tokens", o="output_tokens", r="reasoning_tokens")}, 3) AS cost_micro_usd
FROM usage_attempts LEFT JOIN priced USING (provider, model)""")
def per_call_cost(t: Feed) -> DataFrame:
    calls = usage.per_call_cost(usage.fold_attempts(t.usage_events), usage.model_prices(t.spark))
    return calls.select("attempt_id", F.round(F.col("cost_usd") * 1e6, 3).alias("cost_micro_usd"))


# --- metrics ----------------------------------------------------------------------------------------------------


@query("A11", "SELECT key, round(sum(value), 6) AS value FROM metric_events WHERE type = 'counter' GROUP BY 1")
def metric_counters(t: Feed) -> DataFrame:
    return metrics.metric_counters(t.metric_events)


@query("A11", "SELECT key, round(arg_max(value, tick), 6) AS value FROM metric_events WHERE type = 'gauge' GROUP BY 1")
def metric_gauges(t: Feed) -> DataFrame:
    return metrics.metric_gauges(t.metric_events)


@query("A12", """
, g AS (SELECT key, list_sort(list(value)) AS obs, sum(value) AS total FROM metric_events WHERE type = 'histogram' GROUP BY 1)
SELECT key, len(obs) AS count, round(total, 6) AS total, round(total / len(obs), 6) AS mean, round(obs[1], 6) AS min,
  round(obs[len(obs)], 6) AS max, round(obs[len(obs) // 2 + 1], 6) AS p50,
  round(obs[least(CAST(floor(len(obs) * 0.99) AS BIGINT), len(obs) - 1) + 1], 6) AS p99 FROM g""")
def metric_histograms(t: Feed) -> DataFrame:
    return metrics.metric_histograms(t.metric_events)


@query("A12", CATALOG["metric_histograms"].sql)
def metric_histograms_rolled(t: Feed) -> DataFrame:
    """From a roll-up written in three parts."""
    path = f"{shared_folder(t.spark)}/rollup-{uuid.uuid4().hex}"
    for part in range(3):
        metrics.write_rollup(t.metric_events.where(F.pmod(F.xxhash64("value", "at"), F.lit(3)) == part), path)
    return metrics.stored_histograms(t.spark, path)


@query("A13", """
SELECT bool_or(starts_with(name, 'scorer.')) AS scorer, bool_or(starts_with(name, 'pipeline.')) AS pipeline,
  bool_or(starts_with(name, 'fetcher.')) AS fetcher, bool_or(starts_with(name, 'web.')) AS web FROM metric_events""")
def metric_coverage(t: Feed) -> DataFrame:
    return metrics.metric_coverage(t.metric_events)


# --- media cache, narratives, authors -----------------------------------------------------------------------------


@query("M23", "SELECT media_url, result, hits FROM media_cache")
def media_cache(t: Feed) -> DataFrame:
    return media.cache_latest(t.media_log).select("media_url", "result", "hits")


def _media_posts(t: Feed) -> DataFrame:
    item = F.struct(
        F.col("media_url").alias("url"), F.when(F.col("n") % 14 == 0, "chart").alias("kind"),
    )
    return t.posts.where("has_media").select("id", F.array(item).alias("media_items"))


@query("G13", """
SELECT id, media_url AS url, result AS cached FROM posts LEFT JOIN media_cache USING (media_url) WHERE has_media AND n % 14 <> 0""")
def media_cache_lookup(t: Feed) -> DataFrame:
    pending = media.pending_media(_media_posts(t))
    found = media.cache_lookup(pending, media.cache_latest(t.media_log), "gemini", "vision")
    return found.select("id", "url", "cached")


@query("G13", """
SELECT DISTINCT media_url AS url FROM posts WHERE has_media AND n % 14 <> 0 AND media_url NOT IN (SELECT media_url FROM media_cache)""")
def media_cache_misses(t: Feed) -> DataFrame:
    return media.cache_misses(media.pending_media(_media_posts(t)), media.cache_latest(t.media_log), "gemini", "vision")


@query("M24", """
, m AS (SELECT unnest(narratives) AS name, sentiment, tick, id FROM analyses)
SELECT name, count(*) AS mention_count, epoch_us(min(tick)) AS first_seen_at, epoch_us(max(tick)) AS last_mentioned_at,
  arg_max(sentiment, tick) FILTER (sentiment IS NOT NULL) AS sentiment, max(tick) >= TIMESTAMP '2024-01-22 12:00:00' AS active
FROM m GROUP BY 1""")
def narrative_rollup(t: Feed) -> DataFrame:
    return narratives.narrative_rollup(narratives.narrative_mentions(t.analyses), AS_OF)


@query("M25", "SELECT DISTINCT id, name FROM (SELECT id, unnest(narratives) AS name FROM analyses)")
def narrative_links(t: Feed) -> DataFrame:
    return narratives.narrative_links(narratives.narrative_mentions(t.analyses))


@query("M18 M19", """
, c AS (SELECT *, min(seq) FILTER (command = 'upsert') OVER (PARTITION BY handle) AS first FROM author_commands),
  live AS (SELECT * FROM c WHERE seq >= first),
  fold AS (SELECT handle,
    list_reduce(list(struct_pack(c := command, a := coalesce(amount, 0), t := tier) ORDER BY seq),
      lambda x, y: struct_pack(c := '', a := CASE y.c WHEN 'boost' THEN least(100.0, x.a + y.a)
          WHEN 'decay' THEN greatest(10.0, x.a * (1 - y.a)) ELSE x.a END,
        t := CASE y.c WHEN 'upsert' THEN least(x.t, y.t) WHEN 'promote' THEN 1 WHEN 'demote' THEN y.t ELSE x.t END),
      struct_pack(c := '', a := 50.0::DOUBLE, t := CAST(99 AS BIGINT))) AS s,
    arg_max(display_name, seq) FILTER (command = 'upsert' AND display_name IS NOT NULL) AS display_name,
    bool_or(command = 'mute') AS muted FROM live GROUP BY 1)
SELECT handle, display_name, s.t AS tier, round(s.a, 4) AS weight, muted FROM fold""")
def author_fold(t: Feed) -> DataFrame:
    folded = authors.fold_authors(t.author_commands)
    return folded.select("handle", "display_name", "tier", F.round("weight", 4).alias("weight"), "muted")


@query("M20", """
SELECT handle, round(CASE WHEN last_high_signal_at IS NULL OR last_high_signal_at < TIMESTAMP '2024-01-22 12:00:00'
  THEN greatest(10.0::DOUBLE, weight * 0.95::DOUBLE) ELSE weight END, 6) AS weight FROM authors""")
def author_decay(t: Feed) -> DataFrame:
    return authors.decay(t.authors, AS_OF).select("handle", "weight")


@query("M21", """
SELECT author_handle AS handle, count(*) AS posts_seen, count(*) FILTER (score >= 5) AS posts_kept, round(avg(score), 6) AS avg_score,
  epoch_us(max(processed_at) FILTER (score >= 7)) AS last_high_signal_at
FROM posts WHERE processed_at IS NOT NULL AND author_handle IN (SELECT handle FROM authors) GROUP BY 1""")
def author_stats(t: Feed) -> DataFrame:
    return authors.author_stats(t.posts, t.authors)


@query("M26", "SELECT handle, epoch_us(max(executed_at)) AS last_fetched_at FROM fetch_log GROUP BY 1")
def author_last_fetched(t: Feed) -> DataFrame:
    return authors.author_last_fetched(t.fetch_log)


@query("M28", """
SELECT target AS handle, 'mute' AS command, epoch_us(created_at) AS at FROM reactions WHERE reaction_type = 'x_author'""")
def reaction_mutes(t: Feed) -> DataFrame:
    return authors.reaction_mutes(t.reactions)


@query("M28", "SELECT reaction_id FROM reactions WHERE reaction_type NOT IN ('>>', '<', 'x_author', 'x_topic')")
def reaction_rejects(t: Feed) -> DataFrame:
    allowed = [r for r in C.REACTION_TYPES if r != ">"]
    return authors.reaction_rejects(t.reactions, allowed).select("reaction_id")


@query("G14", """
, b AS (SELECT author_handle AS handle, count(*) AS bookmarks FROM posts WHERE bookmarked GROUP BY 1 HAVING count(*) >= 3)
SELECT handle, bookmarks FROM b LEFT JOIN authors USING (handle) WHERE tier IS NULL OR tier > 1""")
def authors_to_promote(t: Feed) -> DataFrame:
    return authors.authors_to_promote(t.posts, t.authors)


@query("T1 T2 T6", """
, e AS (SELECT event_id, ts, timezone('America/New_York', timezone('UTC', ts)) AS l FROM events),
  c AS (SELECT *, CAST(l AS DATE) - CAST(CASE WHEN isodow(l) = 6 THEN 1 WHEN isodow(l) = 7 THEN 2
          WHEN hour(l) < 16 AND isodow(l) = 1 THEN 3 WHEN hour(l) < 16 THEN 1 ELSE 0 END AS INTEGER) AS d FROM e)
SELECT event_id, epoch_us(timezone('America/New_York', CAST(d AS TIMESTAMP) + INTERVAL 16 HOUR)) AS cutoff,
  CAST(CAST(l AS DATE) AS VARCHAR) AS et_date, hour(ts) >= 23 OR hour(ts) < 8 AS quiet FROM c""")
def market_times(t: Feed) -> DataFrame:
    from tidewire.functions import times

    ts = F.col("ts")
    return t.table("events").select(
        "event_id", times.market_day_cutoff(ts).alias("cutoff"), times.et_date(ts).alias("et_date"),
        times.quiet_hours(ts).alias("quiet"),
    )


@query("T5", """
SELECT count(*) FILTER (created_at >= TIMESTAMP '2024-01-26 12:00:00') AS recent, count(*) AS unlimited FROM posts""")
def vision_age(t: Feed) -> DataFrame:
    from tidewire.functions.times import vision_age_ok

    return t.posts.agg(
        F.count_if(vision_age_ok(F.col("created_at"), 3, AS_OF)).alias("recent"),
        F.count_if(vision_age_ok(F.col("created_at"), None, AS_OF)).alias("unlimited"),
    )


@query("S2", """
SELECT event_id, epoch_us(date_trunc('second', ts)) AS parsed FROM events""")
def parse_times(t: Feed) -> DataFrame:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    classic = F.date_format("ts", "EEE MMM dd HH:mm:ss '+0000' yyyy")
    text = F.when(F.col("event_id") % 2 == 0, iso).otherwise(classic)
    return t.table("events").select("event_id", parse_timestamp(text).alias("parsed"))
