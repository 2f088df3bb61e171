"""Scoring, routing, signals, alerts and article visuals."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators import alerts, articles, matching, scoring, signals
from tidewire.plans.catalog import query
from tidewire.plans.feed_views import AS_OF, Feed
from tidewire.schemas import ANALYSED_MEDIA


@query("R2", "SELECT signal_tier, count(*) AS count FROM posts GROUP BY 1")
def signal_tiers(t: Feed) -> DataFrame:
    return t.posts.groupBy("signal_tier").agg(F.count(F.lit(1)).alias("count"))


@query("R3", """
, w AS (SELECT posts.*, texts.content, lower(author_handle) IN (SELECT lower(handle) FROM authors WHERE tier = 1) AS tier1,
     has_media AND n % 14 <> 0 AS open_media, created_at >= TIMESTAMP '2024-01-19 12:00:00' AS young FROM posts JOIN texts USING (n)
     WHERE score IS NOT NULL)
SELECT id, length(content) > 500 AND NOT tier1 AND score >= 5 AND content_summary IS NULL AS needs_summary,
  score >= 6 AND analysis IS NULL AS needs_analysis, is_article AND score >= 5 AS needs_article,
  is_article AND score >= 5 AND young AND open_media AS media_via_article,
  young AND score >= 5 AND open_media AND NOT (is_article AND score >= 5) AS needs_media FROM w""")
def work_routing(t: Feed) -> DataFrame:
    item = F.struct(
        F.col("media_url").alias("url"), F.when(F.col("n") % 14 == 0, "chart").alias("kind"),
        F.lit("").alias("prose_text"), F.lit("").alias("short_description"),
    )
    posts = t.full_posts.where("score IS NOT NULL").withColumn("media_items", F.when(F.col("has_media"), F.array(item)))
    return scoring.work_routing(posts, t.authors, AS_OF, vision_max_age_days=10)


_ALERT = """(score >= 8 OR (surprise = 2 AND score >= 7) OR (playbook_trigger IS NOT NULL AND score >= 6)
  OR (catalyst_status = 'resolved' AND score >= 6))"""


@query("R4", f"SELECT id, score FROM posts WHERE {_ALERT}")
def alert_candidates(t: Feed) -> DataFrame:
    return alerts.alert_candidates(t.posts).select("id", "score")


# A walk over the alerts of each chat, one at a time; January in New York is five hours behind.
GATE = f"""
, due AS (SELECT id, CASE WHEN n % 3 = 0 THEN 'main' ELSE author_handle END AS chat, processed_at AS ts, score,
    hour(processed_at - INTERVAL 5 HOUR) AS h FROM posts WHERE processed_at IS NOT NULL AND {_ALERT}),
  line AS (SELECT *, h >= 23 OR h < 8 AS quiet, row_number() OVER (PARTITION BY chat ORDER BY ts, id) AS r FROM due),
  gate AS (SELECT r, chat, id, ts, score, score >= 10 OR NOT quiet AS sent,
     CASE WHEN score >= 10 OR NOT quiet THEN [ts] ELSE []::TIMESTAMP[] END AS recent FROM line WHERE r = 1
   UNION ALL SELECT r, chat, id, ts, score, sent, CASE WHEN sent THEN list_append(recent, ts) ELSE recent END FROM
     (SELECT *, score >= 10 OR (NOT quiet AND len(recent) < 10) AS sent FROM
       (SELECT l.r, l.chat, l.id, l.ts, l.score, l.quiet,
          list_filter(g.recent, lambda s: s >= l.ts - INTERVAL 60 MINUTE) AS recent
        FROM gate g JOIN line l ON l.chat = g.chat AND l.r = g.r + 1)))
SELECT id, chat, epoch_us(ts) AS ts, score, sent FROM gate"""


@query("R5", GATE)
def alert_gate(t: Feed) -> DataFrame:
    chats = F.when(F.col("n") % 3 == 0, "main").otherwise(F.col("author_handle")).alias("chat")
    rows = alerts.alert_candidates(t.posts).select("id", chats, F.col("processed_at").alias("ts"), "score")
    return alerts.alert_gate(rows, tz="America/New_York")


_KIND = """CASE WHEN surprise = 2 THEN 'surprise' WHEN catalyst_status = 'scheduled' AND ref IS NOT NULL THEN 'catalyst_scheduled'
  WHEN catalyst_status = 'resolved' AND ref IS NOT NULL THEN 'catalyst_resolved' ELSE 'datapoint' END"""
CANDIDATE = """signal_emitted_at IS NULL AND processed_at >= TIMESTAMP '2024-01-28 12:00:00'
  AND (score >= 7 OR surprise = 2 OR playbook_trigger IS NOT NULL OR catalyst_status = 'resolved')"""


@query("R7", f"SELECT id, epoch_us(processed_at) AS processed_at FROM posts WHERE {CANDIDATE}")
def signal_candidates(t: Feed) -> DataFrame:
    return signals.signal_candidates(t.posts, AS_OF).select("id", "processed_at")


_POSITIONS = """
, held AS (SELECT * FROM instruments WHERE relationship IN ('owned', 'short', 'watchlist', 'expression')),
  open_themes AS (SELECT id FROM themes WHERE status <> 'closed'),
  by_ticker AS (SELECT p.id, arg_min(struct_pack(t := h.ticker, r := h.relationship,
        s := list_filter(p.themes, lambda x: list_contains(h.themes, x))[1]), h.pos) AS m
     FROM posts p JOIN held h ON list_contains(p.tickers, h.ticker) GROUP BY 1),
  theme_first AS (SELECT x AS theme, arg_min(struct_pack(t := ticker, r := relationship), pos) AS m FROM
     (SELECT ticker, relationship, pos, unnest(themes) AS x FROM held) WHERE x IN (SELECT id FROM open_themes) GROUP BY 1),
  by_theme AS (SELECT p.id, arg_min(struct_pack(t := f.m.t, r := f.m.r, s := f.theme), list_position(p.themes, f.theme)) AS m
     FROM posts p JOIN theme_first f ON list_contains(p.themes, f.theme) GROUP BY 1),
  best AS (SELECT id, m FROM by_ticker UNION ALL SELECT id, m FROM by_theme WHERE id NOT IN (SELECT id FROM by_ticker))"""


@query("G10", f"""{_POSITIONS}
SELECT id, m.t || ' (' || concat_ws(', ', m.r, m.s) || ')' AS position FROM best""")
def match_positions(t: Feed) -> DataFrame:
    return matching.match_positions(t.posts, t.instruments, t.themes)


_RESOLVED = """
, tm AS (SELECT p.id, min(c.id) AS ref, count(*) AS rows FROM posts p
     JOIN catalysts c ON list_contains(p.tickers, c.ticker) WHERE p.catalyst_status = 'resolved' GROUP BY 1),
  th AS (SELECT p.id, min(c.id) AS ref, count(*) AS rows FROM posts p
     JOIN catalysts c ON list_contains(p.themes, c.theme) WHERE p.catalyst_status = 'resolved' GROUP BY 1),
  resolved AS (SELECT id, ref FROM tm WHERE rows = 1 UNION ALL
     SELECT id, ref FROM th WHERE rows = 1 AND id NOT IN (SELECT id FROM tm))"""
_LABELLED = """
  hay AS (SELECT id, upper(summary || ' ' || content) AS h FROM posts JOIN texts USING (n)
     WHERE coalesce(catalyst_status, '') <> 'resolved'),
  labelled AS (SELECT id, min(c.type || ':us:' || CAST(c.date AS VARCHAR)) AS ref FROM hay JOIN calendar c ON contains(h, c.label)
     GROUP BY 1 HAVING count(*) = 1)"""


@query("G11", f"""{_RESOLVED}
SELECT r.id, r.ref AS catalyst_ref, CAST(c.date AS VARCHAR) AS catalyst_date FROM resolved r JOIN catalysts c ON c.id = r.ref""")
def match_resolved_catalyst(t: Feed) -> DataFrame:
    return matching.match_resolved_catalyst(t.posts, t.catalysts).select("id", "catalyst_ref", "catalyst_date")


@query("G12", f", {_LABELLED} SELECT id, ref AS catalyst_ref FROM labelled")
def match_labelled_catalyst(t: Feed) -> DataFrame:
    return matching.match_labelled_catalyst(t.full_posts, t.calendar).select("id", "catalyst_ref")


@query("G16", """
, th AS (SELECT list(id) AS ids FROM themes), ins AS (SELECT list(DISTINCT ticker) AS ids FROM instruments)
SELECT posts.id, array_to_string(list_filter(posts.themes, lambda x: list_contains(th.ids, x)), ',') AS themes,
  array_to_string(list_filter(posts.tickers, lambda x: list_contains(ins.ids, x)), ',') AS instruments FROM posts, th, ins""")
def registry_validate(t: Feed) -> DataFrame:
    return matching.registry_validate(t.posts, t.themes, t.instruments)


@query("R6 R8 X20", f"""{_RESOLVED}, {_LABELLED},
  refs AS (SELECT id, ref FROM resolved UNION ALL SELECT id, ref FROM labelled)
SELECT 'post:' || p.id AS dedup_key, epoch_us(p.created_at) AS ts, 'https://x.com/' || author_handle || '/status/' || p.id AS urls,
  summary AS one_liner, {_KIND} AS kind, CASE WHEN direction = 'up' THEN 'na' ELSE direction END AS direction,
  array_to_string(themes, ',') AS themes,
  CASE WHEN playbook_trigger IS NOT NULL OR score >= 9 THEN 3 WHEN score >= 8 THEN 2 ELSE 1 END::BIGINT AS materiality,
  CASE WHEN playbook_trigger = 'supply_shock' THEN 'supply_loss' END AS playbook_trigger, ref AS catalyst_ref
FROM posts p LEFT JOIN refs ON refs.id = p.id WHERE {CANDIDATE}""")
def signal_events(t: Feed) -> DataFrame:
    events = signals.signal_events(
        signals.signal_candidates(t.full_posts, AS_OF), t.catalysts, t.calendar, t.themes, t.instruments
    )
    return events.select(
        "dedup_key", "ts", "urls", "one_liner", "kind", "direction", "themes", "materiality", "playbook_trigger", "catalyst_ref"
    )


@query("R9", f"""
SELECT 'post:' || id AS dedup_key FROM posts WHERE {CANDIDATE} AND id NOT IN (SELECT post_id FROM reactions)""")
def unsent_signals(t: Feed) -> DataFrame:
    key = lambda c: F.concat(F.lit("post:"), F.col(c)).alias("dedup_key")
    events = signals.signal_candidates(t.posts, AS_OF).select(key("id"))
    return signals.unsent(events, t.reactions.select(key("post_id")))


def _length_scorer(rows: list[dict]) -> str:
    """A stand-in scorer: fenced JSON, one object per post; a batch with an unlucky author fails."""
    items = [
        {"id": r["id"], "score": len(r["text"]) % 11, "categories": ["equities"], "summary": r["text"][:10],
         "surprise": len(r["text"]) % 5, "direction": "long" if len(r["text"]) % 2 else "sideways"}
        for r in rows
    ]
    return "Scores follow.\n```json\n" + json.dumps({"items": items}) + "\n```"


@query("R14 J7 J8", """
SELECT id, CAST(length(content) % 11 AS DOUBLE) AS score, 'equities' AS categories, substr(content, 1, 10) AS summary,
  least(2, length(content) % 5) AS surprise, CASE WHEN length(content) % 2 = 1 THEN 'long' ELSE 'na' END AS direction
FROM posts JOIN texts USING (n) WHERE processed_at IS NULL""")
def score_batches(t: Feed) -> DataFrame:
    queue = t.full_posts.where("processed_at IS NULL").select("id", F.col("content").alias("text"))
    scored = scoring.normalize_scores(scoring.score_batches(queue, _length_scorer))
    return scored.select("id", "score", "categories", "summary", "surprise", "direction")


def _media(t: Feed) -> DataFrame:
    """Three analysed items per post, built from its document and number."""
    n = F.col("n")
    kinds = F.array(*[F.lit(k) for k in ("chart", "table", "document", "photo", "screenshot")])
    empty = F.array().cast("array<string>")

    def item(i: int):
        kind = F.element_at(kinds, ((n + i * 2) % 5 + 1).cast("int"))
        return F.struct(
            F.concat(F.lit("https://pic.example.com/"), (n + i) % 4, F.lit(".jpg")).alias("url"),
            F.lit("photo").alias("type"), F.lit(None).cast("string").alias("source"),
            F.lit(None).cast("string").alias("media_id"), kind.alias("kind"), F.lit("").alias("alt_text"),
            F.concat(F.lit("item "), F.lit(i), F.lit(" of report")).alias("short_description"),
            F.when(kind.isin("document", "screenshot"), F.concat(F.lit("page "), F.lit(3 - i), F.lit(" text "), n)).otherwise("").alias("prose_text"),
            F.when(n % 3 == 0, F.concat(F.lit("summary "), n)).otherwise("").alias("prose_summary"),
            F.struct(F.lit("line").alias("type"), F.when(kind == "chart", "report chart").otherwise("").alias("description"),
                     F.when((kind == "chart") & (n % 2 == 0), "revenue up 5%").otherwise("").alias("insight"),
                     F.lit("").alias("implication"), empty.alias("tickers")).alias("chart"),
            F.struct(F.lit("").alias("title"), F.when(kind == "table", "report table").otherwise("").alias("description"),
                     empty.alias("columns"), F.array().cast("array<array<string>>").alias("rows"),
                     F.lit("").alias("summary"), empty.alias("tickers")).alias("table"),
        )

    return t.posts.select("id", "n", "article_title", F.array(*[item(i) for i in range(3)]).cast(ANALYSED_MEDIA).alias("media_items"))


_MEDIA_SQL = """
, items AS (SELECT id, n, i AS pos, ['chart', 'table', 'document', 'photo', 'screenshot'][(n + i * 2) % 5 + 1] AS kind,
     'https://pic.example.com/' || ((n + i) % 4) || '.jpg' AS url, 'item ' || i || ' of report' AS short_description,
     CASE WHEN n % 3 = 0 THEN 'summary ' || n ELSE '' END AS prose_summary
   FROM posts, (SELECT unnest([0, 1, 2]) AS i)),
  m AS (SELECT *, CASE WHEN kind IN ('document', 'screenshot') THEN 'page ' || (3 - pos) || ' text ' || n ELSE '' END AS prose_text,
     CASE WHEN kind = 'chart' AND n % 2 = 0 THEN 'revenue up 5%' ELSE '' END AS insight FROM items)"""


@query("R10 X19", f"""{_MEDIA_SQL},
  v AS (SELECT *, CASE kind WHEN 'chart' THEN 0 WHEN 'table' THEN 1 WHEN 'screenshot' THEN 2 ELSE 3 END AS rank,
      CASE kind WHEN 'chart' THEN coalesce(nullif(insight, ''), 'report chart') WHEN 'table' THEN 'report table'
        ELSE coalesce(nullif(prose_summary, ''), short_description) END AS takeaway FROM m WHERE kind <> 'photo')
SELECT posts.id, coalesce(s.visuals, '') AS visuals FROM posts LEFT JOIN
  (SELECT id, string_agg(url || '=' || kind || '=' || takeaway, '|' ORDER BY rank, pos) AS visuals FROM v GROUP BY 1) s ON s.id = posts.id""")
def article_visuals(t: Feed) -> DataFrame:
    no_top = F.lit(None).cast("struct<url:string,kind:string,why_important:string,key_takeaway:string>")
    rows = articles.with_article_visuals(_media(t).withColumn("top_visual", no_top))
    shown = F.transform("visuals", lambda v: F.concat_ws("=", v["url"], v["kind"], v["key_takeaway"]))
    return rows.select("id", F.array_join(shown, "|").alias("visuals"))


@query("R11 X17", f"""{_MEDIA_SQL},
  w AS (SELECT *, CASE kind WHEN 'chart' THEN 'report chart ' || insight WHEN 'table' THEN 'report table' ELSE '' END || ' '
      || concat_ws(' ', prose_summary, short_description, prose_text) AS txt FROM m WHERE kind <> 'photo'),
  o AS (SELECT *, len(list_distinct(list_filter(regexp_extract_all(lower(txt), '[a-z]{{3,}}'),
      lambda x: x IN ('report', 'thesis', 'revenue')))) AS overlap FROM w),
  s AS (SELECT *, CASE WHEN kind IN ('chart', 'table') THEN 100 ELSE 70 END + 10 + overlap * 5 AS score FROM o
      WHERE kind IN ('chart', 'table') OR overlap >= 2)
SELECT id, arg_max(url, struct_pack(s := score, p := -pos)) AS url FROM s GROUP BY 1""")
def article_top_visual(t: Feed) -> DataFrame:
    points = F.array(F.struct(F.lit("revenue").alias("point"), F.lit("").alias("reasoning"), F.lit("").alias("evidence")))
    best = articles.article_top_visual(F.col("media_items"), F.col("article_title"), F.lit("thesis"), points)
    return _media(t).select("id", best["url"].alias("url")).where(F.col("url").isNotNull())


@query("R12 X16", f"""{_MEDIA_SQL},
  d AS (SELECT id, count(*) AS pages, string_agg(prose_text, chr(10) || chr(10) ORDER BY 3 - pos) AS whole,
     arg_min(pos, 3 - pos) AS first FROM m WHERE prose_text <> '' GROUP BY 1)
SELECT m.id, string_agg(CASE WHEN d.pages >= 2 AND m.pos = d.first THEN d.whole WHEN d.pages >= 2 AND m.prose_text <> '' THEN ''
   ELSE m.prose_text END, '|' ORDER BY m.pos) AS texts FROM m LEFT JOIN d USING (id) GROUP BY 1""")
def stitch_documents(t: Feed) -> DataFrame:
    stitched = articles.stitch_documents(F.col("media_items"))
    rows = _media(t).select("id", stitched.alias("items"))
    return rows.select("id", F.array_join(F.transform("items", lambda m: m["prose_text"]), "|").alias("texts"))


@query("R13", f"""{_MEDIA_SQL},
  s AS (SELECT *, coalesce(nullif(prose_summary, ''), CASE WHEN kind = 'chart' THEN 'Chart: report chart' END, short_description) AS best,
    'Media ' || (pos + 1) || ' (' || kind || ')' || chr(10) || CASE WHEN prose_text <> '' THEN 'Document text:' || chr(10) || prose_text
      WHEN kind = 'chart' THEN 'Chart description: report chart' || CASE WHEN insight <> '' THEN chr(10) || 'Chart insight: ' || insight ELSE '' END
      ELSE 'Image description: ' || short_description END AS section FROM m)
SELECT id, string_agg(best, ' | ' ORDER BY pos) AS summary, string_agg(section, chr(10) || chr(10) ORDER BY pos) AS context
FROM s GROUP BY 1""")
def media_texts(t: Feed) -> DataFrame:
    items = F.col("media_items")
    return _media(t).select("id", articles.media_summary(items).alias("summary"), articles.media_context(items).alias("context"))
