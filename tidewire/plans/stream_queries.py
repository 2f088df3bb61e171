"""Streaming jobs driven once over whole tables (all that is there, then stop), read back from their sinks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewire.operators.alerts import alert_gate, should_alert
from tidewire.operators.skew import counted_broadcast, materialize, shared_folder
from tidewire.plans.catalog import query
from tidewire.plans.feed_views import Feed
from tidewire.plans.merge_queries import PACKED
from tidewire.plans.score_queries import GATE
from tidewire.streaming import jobs
from tidewire.streaming.late import late_rows, with_late_rows


# Payloads in a file of an inbox.
_INBOX_ROWS = 1 << 16


def _folder(t: Feed) -> str:
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


def _drain(writer: DataStreamWriter) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


@query("V1 S8", """
, o AS (SELECT event_id // 2 AS post, event_id, 'u' || user_id AS handle,
     CASE WHEN event_id % 2 = 0 THEN split_part(content, '.', 1) || '...' ELSE content END AS content
   FROM events JOIN texts ON texts.n = event_id)
SELECT CAST(post AS VARCHAR) AS id, count(*) AS observations, count(DISTINCT handle) AS handles,
  md5(max(CASE WHEN event_id % 2 = 1 THEN content END)) AS full_text FROM o GROUP BY 1""")
def stream_observations(t: Feed) -> DataFrame:
    folder = _folder(t)
    rows = t.told_events
    said = F.when(F.col("n") % 2 == 0, F.concat(F.split_part("content", F.lit("."), F.lit(1)), F.lit("...")))
    payload = F.struct(
        F.expr("event_id DIV 2").alias("id"), F.coalesce(said, "content").alias("text"),
        F.struct(F.concat(F.lit("u"), "user_id").alias("username")).alias("author"),
    )
    # Packed files are not split: a bounded number of rows keeps the job's tasks small.
    rows.select(F.to_json(payload).alias("value")).write.options(**PACKED, maxRecordsPerFile=_INBOX_ROWS).text(f"{folder}/inbox")
    _drain(jobs.stream_observations(
        t.spark, f"{folder}/inbox", f"{folder}/log", f"{folder}/posts", f"{folder}/checkpoint"
    ))
    whole = F.when(~F.col("content").endswith("..."), F.col("content"))
    log = _greatest_texts(t.spark.read.parquet(f"{folder}/log").select("id", "author_handle", whole.alias("whole")))
    merged = jobs.current_posts(t.spark, f"{folder}/posts").select("id", "observations")
    return merged.join(log, "id").select("id", "observations", "handles", "full_text")


def _greatest_texts(log: DataFrame) -> DataFrame:
    """Number of handles and hash of the greatest text ``whole`` of every id.

    Where the hashes of an id are one, so is its text: only texts of ids with several are compared, and only they move.
    """
    mark = F.unhex(F.md5("whole"))
    seen = materialize(log.groupBy("id").agg(
        F.countDistinct("author_handle").alias("handles"), F.min(mark).alias("low"), F.max(mark).alias("high")))
    several = seen.where("low <> high").select("id")
    chosen = log.join(counted_broadcast(several, several.count()), "id", "left_semi")
    most = chosen.groupBy("id").agg(F.md5(F.max("whole")).alias("most"))
    return seen.join(most, "id", "left").select("id", "handles", F.coalesce("most", F.lower(F.hex("low"))).alias("full_text"))


@query("V2 R9", """
SELECT 'post:' || id AS dedup_key FROM posts WHERE processed_at IS NOT NULL AND score >= 7""")
def stream_signals(t: Feed) -> DataFrame:
    folder = _folder(t)
    once = t.stream_posts.where("processed_at IS NOT NULL AND score >= 7").select(
        F.explode(F.array(F.lit(1), F.lit(2))), F.concat(F.lit("post:"), "id").alias("dedup_key"), "processed_at"
    )
    _drain(jobs.stream_signals(once, f"{folder}/out", f"{folder}/checkpoint"))
    return t.spark.read.parquet(f"{folder}/out").select("dedup_key")


@query("V3 R5", GATE)
def stream_alerts(t: Feed) -> DataFrame:
    folder = _folder(t)
    test = should_alert(*[F.col(c) for c in ("score", "surprise", "playbook_trigger", "catalyst_status")])
    chat = F.when(F.col("n") % 3 == 0, "main").otherwise(F.col("author_handle")).alias("chat")
    rows = t.stream_posts.where(test & F.col("processed_at").isNotNull()).select(
        "id", chat, F.col("processed_at").alias("ts"), "score"
    )
    _drain(jobs.stream_alerts(rows, f"{folder}/out", f"{folder}/checkpoint", tz="America/New_York"))
    return t.spark.read.parquet(f"{folder}/out")


@query("V4 A2", """
, h AS (SELECT date_trunc('hour', processed_at) AS hour, count(*) AS n FROM posts WHERE processed_at IS NOT NULL GROUP BY 1)
SELECT epoch_us(hour) AS hour, n FROM h
WHERE hour + INTERVAL 1 HOUR <= (SELECT max(processed_at) FROM posts) - INTERVAL 2 HOUR""")
def stream_counts(t: Feed) -> DataFrame:
    folder = _folder(t)
    _drain(jobs.stream_counts(t.stream_posts.where("processed_at IS NOT NULL"), f"{folder}/out", f"{folder}/checkpoint"))
    return t.spark.read.parquet(f"{folder}/out")


@query("V4 A2", """
, h AS (SELECT date_trunc('hour', processed_at) AS hour FROM posts WHERE processed_at < TIMESTAMP '2024-01-29 12:00:00')
SELECT count(*) FILTER (hour >= TIMESTAMP '2024-01-29 11:00:00') AS last_hour,
  count(*) FILTER (hour >= TIMESTAMP '2024-01-28 12:00:00') AS last_24h,
  count(*) FILTER (hour >= TIMESTAMP '2024-01-22 12:00:00') AS last_7d FROM h""")
def rolled_counts(t: Feed) -> DataFrame:
    from tidewire.plans.feed_views import AS_OF

    return jobs.rolled_counts(jobs.hourly_counts(t.posts.where("processed_at IS NOT NULL")), AS_OF)


@query("V1 S1", """
SELECT '{"id": ' || event_id || ', "text": tru}' AS value FROM events WHERE event_id % 10 = 3""")
def stream_quarantine(t: Feed) -> DataFrame:
    """Every tenth payload is no JSON: the job keeps it in its quarantine."""
    folder, n = _folder(t), F.col("event_id")
    good = F.to_json(F.struct(n.alias("id"), F.col("event_type").alias("text")))
    bad = F.concat(F.lit('{"id": '), n, F.lit(', "text": tru}'))
    t.table("events").select(F.when(n % 10 == 3, bad).otherwise(good).alias("value")).write.text(f"{folder}/inbox")
    _drain(jobs.stream_observations(
        t.spark, f"{folder}/inbox", f"{folder}/log", f"{folder}/posts", f"{folder}/checkpoint"
    ))
    return jobs.quarantined_payloads(t.spark, f"{folder}/log").select("value")


@query("V1 M1", """
SELECT CAST(event_id // 3 AS VARCHAR) AS id, count(*) AS observations, 'u' || arg_min(user_id, event_id % 3) AS author_handle,
  list_reduce(list_prepend('', list(event_type || ' ' || repeat('x', CAST(event_id % 3 * 130 AS INTEGER)) ORDER BY event_id % 3)),
    lambda a, b: CASE WHEN a = '' OR length(b) >= length(a) + 120 THEN b ELSE a END) AS content
FROM events GROUP BY 1""")
def posts_over_batches(t: Feed) -> DataFrame:
    """Three batches in three starts of the job; every post is seen in each and composed from the stored states."""
    folder, n = _folder(t), F.col("event_id")
    said = F.concat("event_type", F.lit(" "), F.repeat(F.lit("x"), (n % 3 * 130).cast("int")))
    payload = F.struct(
        F.expr("event_id DIV 3").alias("id"), said.alias("text"), F.struct(F.concat(F.lit("u"), "user_id").alias("username")).alias("author"))
    for part in range(3):
        rows = t.table("events").where(n % 3 == part).select(F.to_json(payload).alias("value"))
        rows.write.mode("append").text(f"{folder}/inbox")
        _drain(jobs.stream_observations(
            t.spark, f"{folder}/inbox", f"{folder}/log", f"{folder}/posts", f"{folder}/checkpoint", every=2
        ))
    return jobs.current_posts(t.spark, f"{folder}/posts").select("id", "observations", "author_handle", "content")


# Arrivals are dealt to five batches by number, so all but the first bring old rows.
_LATE = """
, a AS (SELECT id, n % 5 AS batch, processed_at AS ts FROM posts WHERE processed_at IS NOT NULL),
  w AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM a GROUP BY 1),
  split AS (SELECT a.id, a.batch, a.ts, coalesce({until} <= date_trunc('millisecond', most) - INTERVAL {delay}, false) AS late
    FROM a JOIN w USING (batch))"""


def _arrivals(t: Feed, folder: str, job, delay: str, until=None) -> DataFrame:
    """The posts in five batches, each with a start of the job; late rows beside those in time."""
    rows = t.posts.where("processed_at IS NOT NULL").select("id", "n", "processed_at")
    for part in range(5):
        rows.where(F.col("n") % 5 == part).write.mode("append").parquet(f"{folder}/inbox")
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{folder}/inbox")
        with_late_rows(stream, "processed_at", delay, f"{folder}/split", job, until).trigger(availableNow=True).start().awaitTermination()
    return late_rows(t.spark, f"{folder}/split", rows.schema)


@query("V2", _LATE.format(until="a.ts", delay="24 HOURS") + "SELECT 'post:' || id AS dedup_key, late FROM split")
def stream_signals_and_late_rows(t: Feed) -> DataFrame:
    folder = _folder(t)
    key = F.concat(F.lit("post:"), "id").alias("dedup_key")
    late = _arrivals(
        t, folder, lambda s: jobs.stream_signals(s.withColumn("dedup_key", key), f"{folder}/out", f"{folder}/own"), "24 hours"
    )
    out = t.spark.read.parquet(f"{folder}/out").select("dedup_key", F.lit(False).alias("late"))
    return out.unionByName(late.select(key, F.lit(True).alias("late")))


@query("V4", _LATE.format(until="date_trunc('hour', a.ts) + INTERVAL 1 HOUR", delay="2 HOURS") + """
, closed AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM split WHERE NOT late GROUP BY 1)
SELECT epoch_us(hour) AS hour, n, false AS late FROM closed
  WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM a) - INTERVAL 2 HOURS
UNION ALL SELECT epoch_us(date_trunc('hour', ts)), count(*), true FROM split WHERE late GROUP BY 1""")
def stream_counts_and_late_rows(t: Feed) -> DataFrame:
    folder = _folder(t)
    hour = F.date_trunc("hour", "processed_at")
    late = _arrivals(
        t, folder, lambda s: jobs.stream_counts(s, f"{folder}/out", f"{folder}/own"), "2 hours", hour + F.expr("INTERVAL 1 hour")
    )
    out = t.spark.read.parquet(f"{folder}/out").select("hour", "n", F.lit(False).alias("late"))
    behind = late.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n")).withColumn("late", F.lit(True))
    return out.unionByName(behind)


_SHORT = (("hour(processed_at - INTERVAL 5 HOUR) AS h", "hour(processed_at) AS h"), ("h >= 23 OR h < 8 AS quiet", "h >= 2 AND h < 4 AS quiet"),
          ("INTERVAL 60 MINUTE", "INTERVAL 180 MINUTE"), ("len(recent) < 10", "len(recent) < 3"))
SHORT_GATE = reduce(lambda sql, pair: sql.replace(*pair), _SHORT, GATE)


def _due(posts: DataFrame) -> DataFrame:
    test = should_alert(*[F.col(c) for c in ("score", "surprise", "playbook_trigger", "catalyst_status")])
    chat = F.when(F.col("n") % 3 == 0, "main").otherwise(F.col("author_handle")).alias("chat")
    return posts.where(test & F.col("processed_at").isNotNull()).select("id", chat, F.col("processed_at").alias("ts"), "score")


@query("R5", SHORT_GATE)
def alert_gate_short_quiet(t: Feed) -> DataFrame:
    """Quiet hours shorter than the window: chats are cut at pauses."""
    return alert_gate(_due(t.posts), quiet=(2, 4), max_per_window=3, window_minutes=180)


@query("V3 R5", SHORT_GATE)
def stream_alerts_short_quiet(t: Feed) -> DataFrame:
    folder = _folder(t)
    _drain(jobs.stream_alerts(
        _due(t.stream_posts), f"{folder}/out", f"{folder}/checkpoint", quiet=(2, 4), max_per_window=3, window_minutes=180
    ))
    return t.spark.read.parquet(f"{folder}/out")
