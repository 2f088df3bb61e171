"""Continuous jobs. Each has a batch twin, which is its test oracle."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewire.functions.times import quiet_hours
from tidewire.operators.merge import merge_states
from tidewire.sources.payloads import normalize_payloads, parse_payloads, quarantined
from tidewire.streaming.store import BUCKETS, CODEC, EVERY, PostStates

# Layout of a place in the log: batch, then partition, then row.
_ROW_BITS, _PARTITION_BITS = 22, 14
# Levels for folds over these places: a last group holds a state per 4,096 micro-batches.
_LEVELS = (12, 24, 36, 48)


def _arrival(batch_id: int):
    """Unique place of a row in the log; the job stops rather than let two rows share one."""
    number = F.monotonically_increasing_id()
    row, partition = number.bitwiseAND((1 << 33) - 1), F.shiftright(number, 33)
    place = F.lit(batch_id << (_ROW_BITS + _PARTITION_BITS)) + F.shiftleft(partition, _ROW_BITS) + row
    fits = (row < (1 << _ROW_BITS)) & (partition < (1 << _PARTITION_BITS))
    return F.when(fits, place).otherwise(F.raise_error(F.lit("micro-batch too large: lower maxFilesPerTrigger")))


def stream_observations(
    spark: SparkSession, inbox: str, log: str, posts: str, checkpoint: str, source: str = "home", files: int = 1000,
    buckets: int = BUCKETS, every: int = EVERY,
) -> DataStreamWriter:
    """New payload files (one object per line) -> observation log; posts touched by a batch are merged again.

    A batch folds its own rows and composes them with the stored states of the ids it touches (``PostStates``, beside the
    posts); it never reads the log. Payloads that are no JSON go to ``quarantine`` beside the log. Every batch overwrites
    its own folders only, so a batch that is run again after a failure changes nothing.
    """
    states = PostStates(spark, f"{posts}-states", buckets, every)

    def step(batch: DataFrame, batch_id: int) -> None:
        quarantined(batch, "value").write.mode("overwrite").text(f"{log}-quarantine/batch={batch_id}")
        rows = parse_payloads(batch, "value").withColumn("seq", _arrival(batch_id)).drop("value")
        observations = normalize_payloads(rows).withColumn("source", F.lit(source))
        target = f"{log}/batch={batch_id}"
        observations.write.mode("overwrite").option("compression", CODEC).parquet(target)
        written = spark.read.schema(observations.schema).parquet(target)
        delta = states.write_delta(batch_id, merge_states(written, _LEVELS))
        states.touched_posts(batch_id, delta).write.mode("overwrite").option("compression", CODEC).parquet(f"{posts}/batch={batch_id}")
        states.compact(batch_id, delta.schema)

    lines = spark.readStream.option("maxFilesPerTrigger", files).text(inbox)
    return lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def quarantined_payloads(spark: SparkSession, log: str) -> DataFrame:
    """Payloads that the job could not open."""
    return spark.read.text(f"{log}-quarantine")


def current_posts(spark: SparkSession, posts: str) -> DataFrame:
    """Latest merged version of every post."""
    rows = spark.read.parquet(posts)
    others = [c for c in rows.columns if c not in ("id", "batch")]
    # A maximum for each column, all of the same row: columns that nobody asks for, such as texts, do not move.
    return rows.groupBy("id").agg(*[F.max_by(F.col(f"`{c}`"), "batch").alias(c) for c in others])


def stream_signals(events: DataFrame, out: str, checkpoint: str, watermark: str = "24 hours") -> DataStreamWriter:
    """Signal events once per dedup key; keys are forgotten when the emission window has passed."""
    once = events.withWatermark("processed_at", watermark).dropDuplicatesWithinWatermark(["dedup_key"])
    return once.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)


# No alert of a run comes later than a day (25 hours where clocks change) after another one.
_EXPIRY_MS = 26 * 3600 * 1000
_SENT = "id string, chat string, ts timestamp, score double, sent boolean"
# Chats of a day that share a key of the state, by a hash of their names: so many keys a day. A checkpoint holds to its number.
_SHARES = 64


def gate_stream(
    candidates: DataFrame, tz: str = "UTC", quiet: tuple[int, int] = (23, 8), max_per_window: int = 10,
    window_minutes: int = 60, override_score: float = 10, watermark: str = "1 hour",
) -> DataFrame:
    """Streaming twin of ``alert_gate`` for candidates that arrive in time order.

    Chats are walked by the local day from the end of the quiet hours, with overrides of the last window copied into the
    next day. Where the quiet hours are shorter than the window, all of a chat is one walk. A key of the state is a day and a
    share of the chats: most chats have few candidates a day, and a key costs far more than a row. State is the send times
    of one window by chat; it expires once the watermark is a window past the last candidate, as nothing that still
    counts is in it then.
    """
    start, end = quiet
    by_day = (end - start) % 24 * 60 >= window_minutes and start != end
    window = window_minutes * 60_000_000
    day = F.to_date(F.from_utc_timestamp("ts", tz) - F.make_interval(hours=F.lit(end)))
    begin = F.to_utc_timestamp(F.date_add("day", 1).cast("timestamp") + F.make_interval(hours=F.lit(end)), tz)
    late = (F.col("ts") >= begin - F.make_interval(mins=F.lit(window_minutes))) & (F.col("score") >= override_score)
    own = F.struct(F.col("day"), F.lit(False).alias("replay"))
    copy = F.struct(F.date_add("day", 1).alias("day"), F.lit(True).alias("replay"))
    copied = late if by_day else F.lit(False)
    rows = (
        candidates.select("id", "chat", "ts", "score")
        .withWatermark("ts", watermark)
        .withColumn("day", day if by_day else F.lit(None).cast("date"))
        .withColumn("run", F.explode(F.when(copied, F.array(own, copy)).otherwise(F.array(own))))
        .select("id", "chat", "ts", "score", "run.*", quiet_hours(F.col("ts"), tz, start, end).alias("quiet"))
        .withColumn("us", F.unix_micros("ts"))
        .withColumn("share", F.pmod(F.xxhash64("chat"), F.lit(_SHARES)).cast("int"))
    )

    expiry = _EXPIRY_MS if by_day else window // 1000 + 1

    def walk(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = {}
        for chat, us in zip(*state.get) if state.exists else ():
            recent.setdefault(chat, []).append(us)
        recent = {chat: deque(sorted(times)) for chat, times in recent.items()}
        batch = pd.concat(list(frames)).sort_values(["us", "id"], ignore_index=True)
        sent = []
        for chat, us, score, quiet in zip(*(batch[c].tolist() for c in ("chat", "us", "score", "quiet"))):
            times = recent.setdefault(chat, deque())
            while times and times[0] < us - window:
                times.popleft()
            passes = score >= override_score or (not quiet and len(times) < max_per_window)
            if passes:
                times.append(us)
                if len(times) > 1 and times[-2] > us:
                    recent[chat] = deque(sorted(times))
            sent.append(passes)
        # Rows come in time order: what lies a window before the watermark counts for none that is to come.
        least = state.getCurrentWatermarkMs() * 1000 - window
        kept = [(chat, us) for chat, times in recent.items() for us in times if us >= least]
        state.update(([chat for chat, _ in kept], [us for _, us in kept]))
        last = max([int(batch["us"].max()), *(us for _, us in kept)])
        state.setTimeoutTimestamp(max(last // 1000 + expiry, state.getCurrentWatermarkMs() + 1))
        yield batch.assign(sent=sent)[~batch["replay"]][["id", "chat", "ts", "score", "sent"]]

    return rows.groupBy("share", "day").applyInPandasWithState(
        walk, _SENT, "chats array<string>, recent array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_alerts(candidates: DataFrame, out: str, checkpoint: str, **gate) -> DataStreamWriter:
    decided = gate_stream(candidates, **gate)
    return decided.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)


def hourly_counts(posts: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """Processed posts per hour; counts of 1 h, 24 h and 7 days are summed from these at read."""
    return (
        posts.withWatermark("processed_at", watermark)
        .groupBy(F.window("processed_at", "1 hour").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("hour"), "n")
    )


def stream_counts(posts: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    counts = hourly_counts(posts)
    return counts.writeStream.outputMode("append").format("parquet").option("path", out).option(
        "checkpointLocation", checkpoint
    )


def rolled_counts(hours: DataFrame, as_of_hour) -> DataFrame:
    """Counts over the last whole hour, 24 hours and 7 days before an hour boundary."""
    end = F.lit(as_of_hour)
    spans = {"last_hour": 1, "last_24h": 24, "last_7d": 168}
    return hours.where(F.col("hour") < end).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("hour") >= end - F.make_interval(hours=F.lit(h)), F.col("n"))), F.lit(0)).alias(n)
            for n, h in spans.items()
        ]
    )
