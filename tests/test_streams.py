"""Streaming jobs over several micro-batches: stored states, restarts, quarantine, late rows, gates."""

import json
import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidewire.operators.alerts import alert_gate
from tidewire.operators.merge import compose_states, merge_posts, merge_states, posts_of
from tidewire.sources.payloads import normalize_payloads, parse_payloads
from tidewire.streaming import jobs
from tidewire.streaming.late import late_rows, with_late_rows

START = datetime(2024, 1, 15, 0, 0, tzinfo=timezone.utc)


def walk_gate(rows, tz, quiet, max_per_window, window_minutes):
    sent, recent = {}, {}
    for post, chat, ts, score in sorted(rows, key=lambda r: (r[2], r[0])):
        log = [t for t in recent.get(chat, []) if t >= ts - timedelta(minutes=window_minutes)]
        hour = ts.astimezone(ZoneInfo(tz)).hour
        start, end = quiet
        asleep = (hour >= start or hour < end) if start > end else start <= hour < end
        sent[post] = score >= 10 or (not asleep and len(log) < max_per_window)
        recent[chat] = log + [ts] if sent[post] else log
    return sent


def drain(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None


def payload(rng, number):
    text = rng.choice(["short", "cut off...", "a much longer text " * rng.randint(1, 20), ""])
    made = {"id": str(number), "text": text, "author": {"username": f"u{rng.randint(0, 3)}"}}
    if rng.random() < 0.4:
        made["quotedTweet"] = {"id": str(rng.randint(0, 9))}
    if rng.random() < 0.3:
        made["article"] = {"title": "T" * rng.randint(1, 9), "previewText": "p"}
    if rng.random() < 0.5:
        made["entities"] = {"urls": [{"url": f"https://t.co/{rng.randint(0, 5)}", "expanded_url": "https://x.example.com/a"}]}
    return json.dumps(made)


def plain(rows):
    return sorted(json.dumps(r.asDict(recursive=True), default=str, sort_keys=True) for r in rows)


def test_states_compose_at_any_cut(spark):
    rng = random.Random(5)
    lines = [(n, payload(rng, rng.randint(0, 12))) for n in range(160)]
    raw = spark.createDataFrame(lines, "seq long, value string")
    observations = normalize_payloads(parse_payloads(raw, "value").drop("value")).withColumn("source", F.lit("home")).cache()
    want = plain(merge_posts(observations).collect())
    for cuts in ([40, 41], [1]):
        edges = [0, *cuts, 160]
        parts = [merge_states(observations.where((F.col("seq") >= a) & (F.col("seq") < b))) for a, b in zip(edges, edges[1:])]
        states = parts[0]
        for part in parts[1:]:
            states = states.unionByName(part)
        assert plain(posts_of(compose_states(states)).collect()) == want


def test_posts_of_a_stream_with_restarts(spark, tmp_path):
    """Five batches in three starts, bases every two: the last start equals one merge of everything."""
    rng, folder, broken = random.Random(2), str(tmp_path), []
    (tmp_path / "inbox").mkdir()
    number = 0
    for start in range(3):
        for _ in range(2 if start else 1):
            lines = [payload(rng, rng.randint(0, 30)) for _ in range(40)] + [f"no json {number}", ""]
            broken.append(f"no json {number}")
            (tmp_path / "inbox" / f"{number:03}.txt").write_text("\n".join(lines))
            number += 1
        drain(jobs.stream_observations(
            spark, f"{folder}/inbox", f"{folder}/log", f"{folder}/posts", f"{folder}/checkpoint", files=1, buckets=4, every=2
        ))
    log = spark.read.parquet(f"{folder}/log")
    merged = merge_posts(log.drop("batch"), jobs._LEVELS)
    assert plain(jobs.current_posts(spark, f"{folder}/posts").select(*merged.columns).collect()) == plain(merged.collect())
    assert log.select("batch").distinct().count() == 5
    assert sorted(r["value"] for r in jobs.quarantined_payloads(spark, f"{folder}/log").collect()) == sorted(broken)
    bases = spark.read.parquet(f"{folder}/posts-states/base")
    assert sorted(r[0] for r in bases.select("upto").distinct().collect()) == [1, 3]


def events(spark, rows):
    return spark.createDataFrame(rows, "id string, dedup_key string, processed_at timestamp")


def arrivals(rng, batches=5, size=60):
    """Batches whose times run on, each with some rows of long before and some without a time."""
    made, number = [], 0
    for batch in range(batches):
        rows = []
        for _ in range(size):
            at = START + timedelta(hours=batch * 10, minutes=rng.randint(0, 600))
            if rng.random() < 0.25:
                at -= timedelta(hours=rng.randint(1, 40))
            rows.append((str(number), f"k{rng.randint(0, 150)}", None if rng.random() < 0.05 else at))
            number += 1
        made.append(rows)
    return made


def watermark_walk(batches, delay, until=lambda t: t):
    """Late rows by a plain walk: (id, batch)."""
    late, most = set(), None
    for number, rows in enumerate(batches):
        limit = most - delay if most else datetime(1970, 1, 1, tzinfo=timezone.utc)
        for i, _, at in rows:
            if at is None or until(at) <= limit:
                late.add((i, number))
        most = max([t for _, _, t in rows if t is not None] + ([most] if most else []))
    return late


@pytest.mark.parametrize("kind", ["signals", "counts"])
def test_rows_in_and_late_rows_are_all_rows(spark, tmp_path, kind):
    rng, folder = random.Random(kind), str(tmp_path)
    batches = arrivals(rng)
    schema = events(spark, []).schema
    hour_end = F.date_trunc("hour", "processed_at") + F.expr("INTERVAL 1 hour")
    for rows in batches:
        events(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/inbox")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/inbox")
        if kind == "signals":
            job = lambda s: jobs.stream_signals(s, f"{folder}/out", f"{folder}/own", "5 hours")
            drain(with_late_rows(stream, "processed_at", "5 hours", f"{folder}/split", job))
        else:
            job = lambda s: jobs.stream_counts(s, f"{folder}/out", f"{folder}/own")
            drain(with_late_rows(stream, "processed_at", "2 hours", f"{folder}/split", job, hour_end))
    every = [r for rows in batches for r in rows]
    late = late_rows(spark, f"{folder}/split", schema).collect()
    inside = spark.read.parquet(f"{folder}/split/in").collect()
    assert sorted(r["id"] for r in [*late, *inside]) == sorted(r[0] for r in every)
    if kind == "signals":
        assert {(r["id"], r["batch"]) for r in late} == watermark_walk(batches, timedelta(hours=5)) and len(late) > 20
        # Nothing of what is in time was dropped by the job: each key is there.
        assert {r["dedup_key"] for r in spark.read.parquet(f"{folder}/out").collect()} == {r["dedup_key"] for r in inside}
    else:
        trunc = lambda t: t.replace(minute=0, second=0, microsecond=0) + timedelta(hours=1)
        assert {(r["id"], r["batch"]) for r in late} == watermark_walk(batches, timedelta(hours=2), trunc)
        hours = {}
        for r in inside:
            at = r["processed_at"].astimezone(timezone.utc).replace(minute=0, second=0, microsecond=0)
            hours[at] = hours.get(at, 0) + 1
        counted = {r["hour"].astimezone(timezone.utc): r["n"] for r in spark.read.parquet(f"{folder}/out").collect()}
        # Every closed hour holds all its rows that were in time; the last hours are still open.
        assert counted and all(hours[h] == n for h, n in counted.items())
        most = max(hours)
        assert {h for h in hours if h + timedelta(hours=1) <= most - timedelta(hours=2)} <= set(counted)


def test_a_batch_again_writes_nothing_twice(spark, tmp_path):
    """The checkpoint of the first step is lost after its writes: the same batch runs again, with the same result."""
    folder, schema = str(tmp_path), events(spark, []).schema
    rows = [(str(i), f"k{i}", START + timedelta(minutes=i)) for i in range(20)]
    events(spark, rows).coalesce(1).write.parquet(f"{folder}/inbox")
    job = lambda s: jobs.stream_signals(s, f"{folder}/out", f"{folder}/own")
    for turn in range(2):
        stream = spark.readStream.schema(schema).parquet(f"{folder}/inbox")
        writer = with_late_rows(stream, "processed_at", "24 hours", f"{folder}/split", job)
        drain(writer.option("checkpointLocation", f"{folder}/checkpoint-{turn}"))
    assert spark.read.parquet(f"{folder}/out").count() == 20 and spark.read.parquet(f"{folder}/split/in").count() == 20


@pytest.mark.parametrize("quiet", [(23, 0), (0, 0), (2, 3), (23, 8)])
@pytest.mark.parametrize("window", [60, 180])
def test_gates_equal_a_plain_walk_for_any_quiet_hours(spark, tmp_path, quiet, window):
    rng = random.Random(window)
    rows, at = [], START
    for n in range(400):
        at += timedelta(seconds=rng.choice([1, 30, 400, 600, 4000, 15_000]))
        rows.append((str(n), rng.choice(["main", "main", "b", None]), at, float(rng.choice([8, 9, 10]))))
    frame = spark.createDataFrame(rows, "id string, chat string, ts timestamp, score double")
    options = dict(tz="America/New_York", quiet=quiet, max_per_window=4, window_minutes=window)
    want = walk_gate(rows, **options)
    found = {r["id"]: r["sent"] for r in alert_gate(frame, **options).collect()}
    assert found == want and any(want.values()) and not all(want.values())
    if window == 60 and quiet in ((0, 0), (2, 3)):
        folder = str(tmp_path)
        for start in range(0, 400, 100):
            spark.createDataFrame(rows[start : start + 100], frame.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(frame.schema).parquet(f"{folder}/in")
            drain(jobs.stream_alerts(stream, f"{folder}/out", f"{folder}/c", **options))
        streamed = {r["id"]: r["sent"] for r in spark.read.parquet(f"{folder}/out").collect()}
        assert streamed == want


@pytest.mark.parametrize("quiet", [(23, 8), (2, 3)])
def test_chats_share_keys_of_the_gate(spark, tmp_path, quiet):
    """Many chats in several batches: decisions of a plain walk, while the state has a bounded number of keys a day."""
    rng, rows, at = random.Random(9), [], START + timedelta(hours=14)
    for n in range(1500):
        at += timedelta(seconds=rng.choice([0, 1, 5, 30]))
        chat = rng.choice(["main", None, f"u{rng.randrange(500)}", f"u{rng.randrange(20)}"])
        rows.append((str(n), chat, at, float(rng.choice([8, 9, 9, 10]))))
    schema = "id string, chat string, ts timestamp, score double"
    options = dict(tz="UTC", quiet=quiet, max_per_window=3, window_minutes=60)
    folder, keys = str(tmp_path), []
    for start in range(0, 1500, 500):
        spark.createDataFrame(rows[start : start + 500], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        query = jobs.stream_alerts(stream, f"{folder}/out", f"{folder}/c", **options).trigger(availableNow=True).start()
        query.awaitTermination()
        keys += [s.numRowsTotal for p in query.recentProgress for s in p.stateOperators]
    found = {r["id"]: r["sent"] for r in spark.read.parquet(f"{folder}/out").collect()}
    assert found == walk_gate(rows, **options) and len(set(found.values())) == 2
    assert 0 < max(keys) <= 2 * jobs._SHARES


def test_greatest_texts_by_their_hashes(spark):
    import hashlib

    from tidewire.plans.stream_queries import _greatest_texts

    rows = [("a", "u", "x"), ("a", "v", "x"), ("a", "v", None), ("b", "u", "x"), ("b", "u", "xy"), ("b", "w", "Z"), ("c", "u", None), ("d", None, "")]
    log = spark.createDataFrame(rows, "id string, author_handle string, whole string")
    md5 = lambda text: hashlib.md5(text.encode()).hexdigest()
    found = {r["id"]: (r["handles"], r["full_text"]) for r in _greatest_texts(log).collect()}
    assert found == {"a": (2, md5("x")), "b": (2, md5("xy")), "c": (1, None), "d": (0, md5(""))}


def test_stream_keeps_texts_packed(spark, tmp_path):
    import glob

    (tmp_path / "inbox").mkdir()
    (tmp_path / "inbox" / "1.txt").write_text("\n".join(payload(random.Random(1), n) for n in range(20)))
    folder = str(tmp_path)
    drain(jobs.stream_observations(spark, f"{folder}/inbox", f"{folder}/log", f"{folder}/posts", f"{folder}/checkpoint", buckets=2, every=1))
    for kind in ("log/", "posts/", "posts-states/delta/", "posts-states/base/"):
        files = glob.glob(f"{folder}/{kind}**/*.parquet", recursive=True)
        assert files and all(".zstd." in f for f in files)
