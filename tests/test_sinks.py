"""Emission by several writers, pruning in place."""

import os
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewire.operators import signals
from tidewire.operators.state import prune
from tidewire.sources import files, paths

AS_OF = datetime(2024, 2, 1, 12, tzinfo=timezone.utc)


def frame(spark, low, high):
    return spark.range(low, high).select(F.concat(F.lit("post:"), "id").alias("dedup_key"), F.col("id").alias("n"))


def sent(spark, ledger):
    return sorted(r["n"] for r in signals.emitted(spark, ledger, frame(spark, 0, 1).schema).collect())


def test_concurrent_writers_send_each_event_once(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    ranges = [(0, 60), (30, 90), (0, 90), (50, 120), (0, 120), (10, 20)]
    with ThreadPoolExecutor(6) as pool:
        turns = list(pool.map(lambda r: signals.emit_once(frame(spark, *r), ledger), ranges))
    assert sent(spark, ledger) == list(range(120))
    taken = [t for t in turns if t is not None]
    assert sorted(taken) == list(range(len(taken))) and len(taken) > 1
    assert signals.emit_once(frame(spark, 0, 120), ledger) is None


def test_two_writers_at_the_same_turn(spark, tmp_path, monkeypatch):
    """The second writer commits between the first one's staging and its claim."""
    ledger, raced = str(tmp_path), []

    def late(*args):
        if not raced:
            raced.append(1)
            assert signals.emit_once(frame(spark, 5, 15), ledger) == 0
        return paths.claim(*args)

    monkeypatch.setattr(signals, "claim", late)
    assert signals.emit_once(frame(spark, 0, 10), ledger) == 1
    rows = signals.emitted(spark, ledger, frame(spark, 0, 1).schema).collect()
    assert sorted((r["turn"], r["n"]) for r in rows) == [(0, n) for n in range(5, 15)] + [(1, n) for n in range(5)]


def test_a_writer_that_dies_before_its_claim(spark, tmp_path, monkeypatch):
    ledger = str(tmp_path)

    def dies(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(signals, "claim", dies)
    with pytest.raises(RuntimeError):
        signals.emit_once(frame(spark, 0, 10), ledger)
    monkeypatch.undo()
    assert sent(spark, ledger) == []
    assert signals.emit_once(frame(spark, 0, 10).union(frame(spark, 0, 10)), ledger) == 0
    assert sent(spark, ledger) == list(range(10))


def test_one_claim_wins(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: paths.claim(spark, f"file:{tmp_path}/turns/7", f"writer {i}", f"w{i}"), range(16)))
    assert sum(won) == 1 and (tmp_path / "turns" / "7").read_text() == f"writer {won.index(True)}"
    assert [n for n in os.listdir(tmp_path / "turns") if n.startswith("_w")] == []


def posts(spark):
    day = F.lit(AS_OF) - F.make_interval(days=F.col("id") % 30, hours=F.col("id") % 5)
    digest = F.when((F.col("id") % 30 == 20) | (F.col("id") % 3 == 0), F.lit("2024-01-20").cast("date"))
    created = F.when(F.col("id") % 31 > 0, day)
    return spark.range(600).select(F.col("id").cast("string").alias("id"), created.alias("created_at"), digest.alias("included_in_digest"))


def listing(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_prune_touches_only_dates_that_lose_rows(spark, tmp_path):
    path = str(tmp_path / "posts")
    files.write_pruned(posts(spark), path)
    before = listing(path)
    pruned = files.prune_dates(spark, path, AS_OF, str(tmp_path / "staging"))
    dates = {str(r["created_date"]) for r in pruned.collect()}
    want = sorted(r["id"] for r in prune(posts(spark), AS_OF).collect())
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == want and len(want) < 600
    after = listing(path)
    untouched = {f: t for f, t in before.items() if not any(f"created_date={d}" in f for d in dates)}
    assert dates and untouched and untouched.items() <= after.items()
    assert max(dates) <= str((AS_OF - timedelta(days=14)).date())
    assert pruned.agg(F.sum("pruned")).first()[0] == 600 - len(want)
    # Nothing is left to prune.
    assert files.prune_dates(spark, path, AS_OF, str(tmp_path / "again")).collect() == []


def test_a_prune_that_died_is_resumed(spark, tmp_path, monkeypatch):
    path, staging = str(tmp_path / "posts"), str(tmp_path / "staging")
    files.write_pruned(posts(spark), path)
    calls = []

    def dies(*args):
        calls.append(args)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return paths.exists(*args)

    monkeypatch.setattr(files, "exists", dies)
    with pytest.raises(RuntimeError):
        files.prune_dates(spark, path, AS_OF, staging)
    monkeypatch.undo()
    files.prune_dates(spark, path, AS_OF, staging)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == sorted(r["id"] for r in prune(posts(spark), AS_OF).collect())
