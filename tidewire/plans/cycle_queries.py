"""The whole process cycle as one query."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators import cycle
from tidewire.operators.skew import shared_folder
from tidewire.plans.catalog import query
from tidewire.plans.feed_views import AS_OF, Feed
from tidewire.plans.merge_queries import CONTEXT_SQL, CHOSEN_SQL, EDGES_SQL
from tidewire.plans.score_queries import _length_scorer

_CYCLE = f"""{EDGES_SQL},
  {CHOSEN_SQL},
  chosen AS (SELECT id FROM src UNION SELECT id FROM posts WHERE processed_at IS NULL
    AND id IN (SELECT id FROM l1 UNION SELECT id FROM l2 UNION SELECT id FROM l3)),
  {CONTEXT_SQL},
  scored AS (SELECT id, n, CAST(length(text) % 11 AS DOUBLE) AS score, least(2, length(text) % 5) AS surprise
    FROM asked JOIN chosen USING (id) JOIN posts USING (id)),
  due AS (SELECT id, score, row_number() OVER (ORDER BY id) AS r FROM scored WHERE score >= 8 OR (surprise = 2 AND score >= 7)),
  walk AS (SELECT r, id, TRUE AS sent, 1 AS n FROM due WHERE r = 1
    UNION ALL SELECT d.r, d.id, d.score >= 10 OR w.n < 10, w.n + CAST(d.score >= 10 OR w.n < 10 AS INTEGER)
    FROM walk w JOIN due d ON d.r = w.r + 1)
SELECT s.id, s.score, CASE WHEN s.score >= 8 THEN 'high_signal' WHEN s.score >= 6 THEN 'market_relevant' WHEN s.score >= 4 THEN 'news'
    ELSE 'noise' END AS signal_tier, s.score >= 6 AND p.analysis IS NULL AS needs_analysis,
  s.score >= 5 AND p.has_media AND p.created_at >= TIMESTAMP '2024-01-19 12:00:00' AS needs_media, walk.sent
FROM scored s JOIN posts p USING (id) LEFT JOIN walk USING (id)"""


@query("Q8 G1 G2 X7 G7 G8 R14 J7 J8 R2 R3 R4 R5", _CYCLE)
def process_cycle(t: Feed) -> DataFrame:
    """Everything unprocessed since the 20th and what it depends on, scored, routed and put to the alert gate."""
    item = F.struct(
        F.col("media_url").alias("url"), F.lit("").alias("kind"), F.lit("").alias("prose_text"), F.lit("").alias("short_description"))
    posts = t.paired_posts.withColumn("is_article", F.lit(False)).withColumn("media_items", F.when(F.col("has_media"), F.array(item)))
    since = F.lit(datetime(2024, 1, 20, tzinfo=timezone.utc))
    queue = t.with_texts(posts).where(F.col("processed_at").isNull() & (F.col("created_at") >= since)).select("id")
    url_map = t.table("region").selectExpr("concat('https://t.co/s', r_regionkey) AS url", "concat('https://long.example.com/', r_regionkey) AS target")
    log = f"{shared_folder(t.spark)}/answers-{uuid.uuid4().hex}"
    done = cycle.process_cycle(
        posts, queue, t.authors, url_map, _length_scorer, log, AS_OF, routing={"vision_max_age_days": 10}, texts=t.with_texts)
    flags = done.routing.select("id", "needs_analysis", "needs_media")
    return done.scores.select("id", "score", "signal_tier").join(flags, "id").join(done.alerts.select("id", "sent"), "id", "left")
