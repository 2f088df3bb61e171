"""Signal events: selection, canonical rows and once-only emission."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import constants as C
from tidewire.functions.text import event_one_liner, non_blank
from tidewire.functions.times import before
from tidewire.functions.urls import post_url
from tidewire.operators.matching import match_catalysts, registry_validate
from tidewire.operators.skew import materialize
from tidewire.sources.paths import claim, exists


def signal_kind(surprise: Column, catalyst_status: Column, catalyst_ref: Column) -> Column:
    referenced = catalyst_ref.isNotNull()
    return (
        F.when(surprise == 2, "surprise")
        .when((catalyst_status == "scheduled") & referenced, "catalyst_scheduled")
        .when((catalyst_status == "resolved") & referenced, "catalyst_resolved")
        .otherwise("datapoint")
    )


def materiality(score: Column, playbook_trigger: Column) -> Column:
    return F.when(non_blank(playbook_trigger).isNotNull() | (score >= 9), 3).when(score >= 8, 2).otherwise(1)


def signal_candidates(posts: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Recently processed posts worth an event and not emitted yet."""
    worth = (
        (F.col("score") >= 7)
        | (F.col("surprise") == 2)
        | F.col("playbook_trigger").isNotNull()
        | (F.col("catalyst_status") == "resolved")
    )
    return posts.where(
        F.col("signal_emitted_at").isNull() & (F.col("processed_at") >= before(as_of, hours=hours)) & worth
    )


def _event_id(post_id: Column) -> Column:
    return F.concat(F.lit("sig_"), F.substring(F.sha2(F.concat(F.lit("signal:"), post_id), 256), 1, 24))


_USED = [
    "id", "author_handle", "created_at", "processed_at", "summary", "content", "score", "surprise", "direction", "themes",
    "tickers", "playbook_trigger", "catalyst_status",
]


def signal_events(
    candidates: DataFrame, catalysts: DataFrame, calendar: DataFrame, themes: DataFrame, instruments: DataFrame
) -> DataFrame:
    """One canonical event per candidate, with a deterministic id and a dedup key.

    Candidates (a day's best posts) are read by each matcher, hence materialised first.
    """
    candidates = materialize(candidates.select(*_USED))
    valid = registry_validate(candidates, themes, instruments).withColumnRenamed("themes", "valid_themes")
    refs = match_catalysts(candidates, catalysts, calendar)
    rows = candidates.join(valid, "id", "left").join(refs, "id", "left")
    names = F.create_map(*[F.lit(x) for pair in C.PLAYBOOK_EVENT_NAMES.items() for x in pair])
    ref = F.col("catalyst_ref")
    kind = signal_kind(F.col("surprise"), F.col("catalyst_status"), ref)
    scheduled = kind == "catalyst_scheduled"
    empty = F.array().cast("array<string>")
    return rows.select(
        _event_id(F.col("id")).alias("id"),
        F.lit(1).alias("schema_version"),
        F.coalesce("created_at", "processed_at").alias("ts"),
        F.array(post_url(F.coalesce(non_blank(F.col("author_handle")), F.lit("i")), F.col("id"))).alias("urls"),
        event_one_liner(F.col("summary"), F.col("content")).alias("one_liner"),
        kind.alias("kind"),
        F.coalesce(F.when(F.col("direction").isin(C.DIRECTIONS), F.col("direction")), F.lit("na")).alias("direction"),
        F.coalesce("valid_themes", empty).alias("themes"),
        F.coalesce("instruments", empty).alias("instruments"),
        materiality(F.coalesce("score", F.lit(0.0)), F.col("playbook_trigger")).alias("materiality"),
        names[F.col("playbook_trigger")].alias("playbook_trigger"),
        ref.alias("catalyst_ref"),
        F.concat(F.lit("post:"), F.col("id")).alias("dedup_key"),
        F.when(scheduled, F.col("catalyst_date")).alias("catalyst_date"),
        F.when(scheduled, F.col("catalyst_type")).alias("catalyst_type"),
        F.col("processed_at"),
    )


def unsent(events: DataFrame, emitted: DataFrame) -> DataFrame:
    """Events whose dedup key is not in the emitted log."""
    return events.dropDuplicates(["dedup_key"]).join(emitted.select("dedup_key"), "dedup_key", "left_anti")


def emit_signals(events: DataFrame, emitted_path: str) -> None:
    """Append events not sent before. The ledger itself is the emitted log, so one write both sends and marks.

    A task that is lost and run again cannot send twice: files become visible with the commit of the whole write,
    and a repeated run finds the keys in the ledger. For one writer at a time; several use ``emit_once``.
    """
    spark = events.sparkSession
    try:
        fresh = unsent(events, spark.read.parquet(emitted_path))
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        fresh = events.dropDuplicates(["dedup_key"])
    fresh.write.mode("append").parquet(emitted_path)


def emitted(spark: SparkSession, ledger: str, schema) -> DataFrame:
    """Events that runs of ``emit_once`` have committed, with the columns of ``schema`` and their ``turn``."""
    if not exists(spark, f"{ledger}/turns"):
        return spark.createDataFrame([], schema).withColumn("turn", F.lit(None).cast("long"))
    name = F.col("_metadata.file_name")
    turns = spark.read.text(f"{ledger}/turns").select(F.col("value").alias("run"), name.cast("long").alias("turn"))
    staged = spark.read.schema(schema).option("basePath", f"{ledger}/runs").parquet(f"{ledger}/runs/run=*")
    return staged.join(turns, "run").drop("run")


def emit_once(events: DataFrame, ledger: str) -> int | None:
    """Send the events whose ``dedup_key`` nobody has sent, whatever other writers do meanwhile; the turn taken, if any.

    A run stages its events where no reader looks and then claims the next turn of the ledger, a file that exactly one
    writer can create; with it the staged events count as sent. A writer that finds the turn taken leaves out what the
    others have sent since and tries the next one. A run that dies before its claim has sent nothing, one that dies after
    it has sent everything, and when it starts again it finds its own events in the ledger. One event of each key goes.
    """
    spark = events.sparkSession
    fresh, schema = events.dropDuplicates(["dedup_key"]), events.schema
    while True:
        run = f"r{uuid.uuid4().hex}"
        sent = emitted(spark, ledger, schema)
        # One number: the last turn this attempt knows of. What came later makes the claim fail.
        last = sent.agg(F.max("turn")).first()[0] if exists(spark, f"{ledger}/turns") else None
        known = sent.where(F.col("turn") <= F.lit(-1 if last is None else last))
        path = f"{ledger}/runs/run={run}"
        fresh.join(known.select("dedup_key"), "dedup_key", "left_anti").select(*events.columns).write.parquet(path)
        fresh = spark.read.schema(schema).parquet(path)
        if fresh.isEmpty():
            return None
        turn = 0 if last is None else last + 1
        if claim(spark, f"{ledger}/turns/{turn:012d}", run + "\n", run):
            return turn
