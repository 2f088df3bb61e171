"""Alerts: which posts qualify, and the rate-limited gate."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import non_blank
from tidewire.functions.times import quiet_hours


def should_alert(
    score: Column, surprise: Column, playbook_trigger: Column, catalyst_status: Column, threshold: float = 8
) -> Column:
    test = (
        (score >= threshold)
        | ((surprise == 2) & (score >= 7))
        | (non_blank(playbook_trigger).isNotNull() & (score >= 6))
        | ((catalyst_status == "resolved") & (score >= 6))
    )
    return F.coalesce(test, F.lit(False))


def alert_candidates(posts: DataFrame, threshold: float = 8) -> DataFrame:
    columns = [F.col(c) for c in ("score", "surprise", "playbook_trigger", "catalyst_status")]
    return posts.where(should_alert(*columns, threshold))


def _with_stretches(rows: DataFrame, window: int) -> DataFrame:
    """A number ``day`` for each stretch of a chat that no pause of more than ``window`` microseconds interrupts.

    Within a cell as long as the window nothing pauses that long, so first and last times of the cells tell all pauses:
    what is sorted for a chat is one row for each window of time, however many candidates it has.
    """
    cell = F.floor(F.unix_micros("ts") / F.lit(window))
    keyed = rows.withColumn("_chat", F.to_json(F.struct("chat"))).withColumn("_cell", cell)
    cells = keyed.groupBy("_chat", "_cell").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    order = Window.partitionBy("_chat").orderBy("_cell")
    pause = F.unix_micros("lo") - F.unix_micros(F.lag("hi").over(order))
    cells = cells.withColumn("_new", F.when(pause > window, 1).otherwise(0))
    cells = cells.select("_chat", "_cell", F.sum("_new").over(order).alias("day"))
    return keyed.join(cells, ["_chat", "_cell"]).drop("_chat", "_cell")


_DECISION = "id string, chat string, ts timestamp, score double, sent boolean"


def alert_gate(
    candidates: DataFrame,
    tz: str = "UTC",
    quiet: tuple[int, int] = (23, 8),
    max_per_window: int = 10,
    window_minutes: int = 60,
    override_score: float = 10,
) -> DataFrame:
    """Walks the alerts of each chat in time order (columns id, chat, ts, score) and decides which are sent.

    A score at the override always passes. Else the hour must not be quiet and fewer than the cap may have been
    sent in the window before; every sent alert counts. The walk is sequential, but in quiet hours only overrides
    pass, whatever came before. So each local day that begins at the end of the quiet hours is walked on its own,
    after a replay of the overrides of the last window before it; even a chat with most of the alerts is split
    into days. Quiet hours shorter than the window do not empty it: there a chat is cut wherever it has no candidate for
    longer than a window. State is the send times of one window.
    """
    start, end = quiet
    rows = candidates.select("id", "chat", "ts", "score")
    window = window_minutes * 60_000_000
    span = (end - start) % 24
    if span * 60 >= window_minutes and start != end:
        local = F.from_utc_timestamp("ts", tz)
        day = F.to_date(local - F.make_interval(hours=F.lit(end)))
        begin = F.to_utc_timestamp(F.date_add("day", 1).cast("timestamp") + F.make_interval(hours=F.lit(end)), tz)
        rows = rows.withColumn("day", day).withColumn("replay", F.lit(False))
        late = F.col("ts") >= begin - F.make_interval(mins=F.lit(window_minutes))
        replay = (
            rows.where((F.col("score") >= override_score) & late & (F.col("ts") < begin))
            .withColumn("day", F.date_add("day", 1))
            .withColumn("replay", F.lit(True))
        )
        rows = rows.unionByName(replay)
    else:
        rows = _with_stretches(rows, window).withColumn("replay", F.lit(False))
    rows = rows.withColumn("quiet", quiet_hours(F.col("ts"), tz, start, end))
    rows = rows.withColumn("run", F.struct("chat", "day").cast("string"))
    rows = rows.withColumn("us", F.unix_micros("ts"))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, recent = None, deque()
        for frame in frames:
            decisions = []
            for row in frame.itertuples(index=False):
                if row.run != run:
                    run, recent = row.run, deque()
                while recent and recent[0] < row.us - window:
                    recent.popleft()
                sent = row.score >= override_score or (not row.quiet and len(recent) < max_per_window)
                if sent:
                    recent.append(row.us)
                decisions.append(sent)
            out = frame.assign(sent=decisions)[~frame["replay"]]
            yield out[["id", "chat", "ts", "score", "sent"]]

    ordered = rows.repartition("run").sortWithinPartitions("run", "us", "id")
    return ordered.mapInPandas(walk, _DECISION)
