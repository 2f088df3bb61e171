"""Sinks and readers over whole tables: written to the shared folder, a new one for each run, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators import feed, signals, state, stats
from tidewire.operators.skew import shared_folder
from tidewire.plans.catalog import CATALOG, DAY, query
from tidewire.plans.feed_queries import golden_eval  # noqa: F401 its SQL is used below
from tidewire.plans.feed_views import AS_OF, Feed
from tidewire.plans.score_queries import CANDIDATE
from tidewire.sources import files

# Ids in one file of seen ids.
IDS_PER_FILE = 20_000


def _folder(t: Feed) -> str:
    return f"{shared_folder(t.spark)}/sink-{uuid.uuid4().hex}"


@query("S8", "SELECT seq, id, 'home' AS source, md5(content) AS content FROM observations WHERE id <> ''")
def appended_observations(t: Feed) -> DataFrame:
    path = _folder(t)
    files.append_observations(t.observations, path, "home")
    return t.spark.read.parquet(path).select("seq", "id", "source", F.md5("content").alias("content"))


@query("S9", "SELECT id, score FROM posts WHERE created_at >= TIMESTAMP '2024-01-22 12:00:00'")
def exported_json(t: Feed) -> DataFrame:
    path = _folder(t)
    files.write_recent_json(t.posts, path, AS_OF, 7)
    return t.spark.read.schema("id string, score double").json(path)


@query("M17", "SELECT id FROM posts WHERE NOT (created_at < TIMESTAMP '2024-01-15 12:00:00' AND included_in_digest IS NOT NULL)")
def pruned_files(t: Feed) -> DataFrame:
    path = _folder(t)
    files.write_pruned(state.prune(t.posts, AS_OF), path)
    return t.spark.read.parquet(path).select("id")


@query("S10", """
SELECT 'u' || c_custkey AS handle, 'upsert' AS command, CAST(2 AS BIGINT) AS tier FROM customer WHERE c_mktsegment <> 'BUILDING'""")
def author_file(t: Feed) -> DataFrame:
    path = _folder(t)
    line = F.when(F.col("c_mktsegment") == "BUILDING", "# skipped").otherwise(F.format_string("\t@u%d ", "c_custkey"))
    t.table("customer").select(line).write.text(path)
    return files.read_author_list(t.spark, path)


@query("S11", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, 'unknown' AS author_handle, '[migrated from seen.json]' AS content, 'migration' AS source
FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events)""")
def seen_files(t: Feed) -> DataFrame:
    path, key = _folder(t), F.col("o_orderkey")
    listed = t.table("orders").groupBy(F.floor(key / IDS_PER_FILE).alias("file")).agg(F.collect_list(key.cast("string")).alias("seen"))
    listed.select("file", F.to_json(F.struct("seen"))).repartition("file").write.partitionBy("file").text(path)
    return files.read_seen_ids(t.spark, path, t.posts)


@query("S12 A15", CATALOG["golden_eval"].sql)
def golden_file(t: Feed) -> DataFrame:
    path = _folder(t)
    t.golden.write.json(path)
    return stats.golden_eval(files.read_golden(t.spark, path), t.golden_results)


@query("R9", f"SELECT 'post:' || id AS dedup_key FROM posts WHERE {CANDIDATE}")
def emitted_signals(t: Feed) -> DataFrame:
    """Sent in two runs, the second with everything: each event is in the ledger once."""
    path = _folder(t)
    events = signals.signal_candidates(t.posts, AS_OF).select(F.concat(F.lit("post:"), "id").alias("dedup_key"), "created_at")
    signals.emit_signals(events.where("created_at < TIMESTAMP '2024-01-29 00:00:00'"), path)
    signals.emit_signals(events, path)
    return t.spark.read.parquet(path).select("dedup_key")


@query("M15 Q15", """
SELECT id, '2024-01-15' AS included_in_digest FROM posts WHERE processed_at IS NOT NULL AND score >= 5
  AND created_at >= TIMESTAMP '2024-01-15' AND created_at < TIMESTAMP '2024-01-16'""")
def written_digest_marks(t: Feed) -> DataFrame:
    path = _folder(t)
    feed.digest_mark_rows(feed.digest(t.posts, DAY), DAY, AS_OF).write.mode("append").parquet(path)
    return state.digest_marks(t.spark.read.parquet(path))


@query("R9", f"SELECT 'post:' || id AS dedup_key, CASE WHEN created_at < TIMESTAMP '2024-01-29 00:00:00' THEN 0 ELSE 1 END AS turn FROM posts WHERE {CANDIDATE}")
def events_sent_once(t: Feed) -> DataFrame:
    """Sent by two runs of the claim protocol, the second with everything."""
    ledger = _folder(t)
    events = signals.signal_candidates(t.posts, AS_OF).select(F.concat(F.lit("post:"), "id").alias("dedup_key"), "created_at")
    signals.emit_once(events.where("created_at < TIMESTAMP '2024-01-29 00:00:00'"), ledger)
    signals.emit_once(events, ledger)
    return signals.emitted(t.spark, ledger, events.schema).select("dedup_key", "turn")


@query("M17", CATALOG["pruned_files"].sql)
def pruned_in_place(t: Feed) -> DataFrame:
    """Only the folders of dates that lose rows are written again."""
    path, staging = _folder(t), _folder(t)
    files.write_pruned(t.posts, path)
    files.prune_dates(t.spark, path, AS_OF, staging)
    return t.spark.read.parquet(path).select("id")
