"""Other inputs and the append-only outputs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import or_blank, strip
from tidewire.functions.times import at
from tidewire.operators.feed import export_recent
from tidewire.operators.state import prunable
from tidewire.schemas import GOLDEN
from tidewire.sources.paths import exists, finished

# Days written side by side by one task before it sorts the rest, and bytes that are held for each.
OPEN_DAYS, BUFFER = 64, 8 << 20


def observations_to_append(observations: DataFrame, source: str) -> DataFrame:
    """Observations with an id, labelled with their source."""
    return observations.where(or_blank(F.col("id")) != "").withColumn("source", F.lit(source))


def fetch_log_row(observations: DataFrame, known: DataFrame, endpoint: str, executed_at: datetime) -> DataFrame:
    """Fetched and new counts of one run: distinct ids first, so that only ids are shuffled."""
    ids = observations.where(or_blank(F.col("id")) != "").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    flagged = ids.join(known.select("id", F.lit(True).alias("known")), "id", "left")
    return flagged.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("fetched"), F.count_if(F.col("known").isNull()).alias("new")
    ).select(F.lit(endpoint).alias("endpoint"), at(executed_at).alias("executed_at"), "fetched", "new")


def append_observations(observations: DataFrame, path: str, source: str) -> None:
    """Append to the observation log, partitioned by day of creation (posts without a time in their own folder)."""
    rows = observations_to_append(observations, source)
    dated = rows.withColumn("created_date", F.to_date("created_at"))
    # Files of this many days are open at once, with small buffers, so that whole texts need not be sorted (and spilled) by day.
    conf, name = rows.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, str(OPEN_DAYS))
    try:
        dated.write.mode("append").option("parquet.block.size", BUFFER).option("compression", "zstd").partitionBy("created_date").parquet(path)
    finally:
        conf.set(name, before)


def write_recent_json(posts: DataFrame, path: str, as_of: datetime, days: int = 7) -> None:
    """Export of the last days as JSON lines, newest first across the numbered files."""
    export_recent(posts, as_of, days).write.mode("errorifexists").json(path)


def write_pruned(kept: DataFrame, target: str) -> None:
    """Write what a prune keeps to a new place; a job never overwrites the path it reads."""
    kept.withColumn("created_date", F.to_date("created_at")).write.mode("errorifexists").partitionBy("created_date").parquet(
        target
    )


def prune_dates(spark: SparkSession, path: str, as_of: datetime, staging: str, days: int = 14) -> DataFrame:
    """Prune a table written by ``append_observations`` or ``write_pruned`` in place; (created_date, pruned) per date.

    Only dates up to the limit are read, and only those that lose rows are written again, first to ``staging`` (a folder of
    this prune alone), then over their own folder; all other dates keep their files. A prune that died is resumed by the
    same call: what it staged is put in place first.
    """
    table = spark.read.parquet(path)
    limit = at(as_of) - F.make_interval(days=F.lit(days))
    old = table.where(F.col("created_date") <= F.to_date(limit))
    if not finished(spark, f"{staging}/pruned"):
        counts = old.groupBy("created_date").agg(F.count_if(prunable(as_of, days)).alias("pruned")).where("pruned > 0")
        counts.write.mode("overwrite").parquet(f"{staging}/dates")
        dates = spark.read.parquet(f"{staging}/dates")
        # A few dates, broadcast by their measured size.
        kept = old.join(dates.select("created_date"), "created_date", "left_semi").where(~prunable(as_of, days))
        kept.write.mode("overwrite").partitionBy("created_date").parquet(f"{staging}/kept")
        dates.write.mode("overwrite").parquet(f"{staging}/pruned")
    pruned = spark.read.parquet(f"{staging}/pruned")
    schema = table.drop("created_date").schema
    # One folder per date; a date of which nothing is kept stays as an empty one.
    for row in pruned.select(F.col("created_date").cast("string").alias("d")).orderBy("d").collect():
        source = f"{staging}/kept/created_date={row['d']}"
        rows = spark.read.schema(schema).parquet(source) if exists(spark, source) else spark.createDataFrame([], schema)
        rows.write.mode("overwrite").parquet(f"{path}/created_date={row['d']}")
    return pruned


def read_author_list(spark: SparkSession, path: str, tier: int = 2) -> DataFrame:
    """Handles of a text file as upsert commands; blank lines and ``#`` comments are skipped."""
    return author_lines(spark.read.text(path), tier)


def author_lines(lines: DataFrame, tier: int = 2) -> DataFrame:
    line = strip(F.col("value"))
    rows = lines.where((line != "") & ~line.startswith("#"))
    handle = F.regexp_replace(line, "^@+", "")
    return rows.select(handle.alias("handle"), F.lit("upsert").alias("command"), F.lit(tier).alias("tier"))


def read_seen_ids(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """Ids of a ``{"seen": [...]}`` file as placeholder posts; known ids are skipped."""
    return seen_placeholders(spark.read.text(path, wholetext=True), known)


def seen_placeholders(texts: DataFrame, known: DataFrame) -> DataFrame:
    listed = F.from_json("value", "struct<seen:array<string>>")["seen"]
    ids = texts.select(F.explode(listed).alias("id")).where(or_blank(F.col("id")) != "").distinct()
    # Text and source of a placeholder are fixed values.
    return ids.join(known.select("id"), "id", "left_anti").select(
        "id",
        F.lit("unknown").alias("author_handle"),
        F.lit("[migrated from seen.json]").alias("content"),
        F.lit("migration").alias("source"),
    )


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Labelled rows; a line without ``expected`` stops the read with an error."""
    rows = spark.read.schema(GOLDEN).json(path)
    complete = F.assert_true(F.col("expected").isNotNull(), F.lit("golden row without expected labels"))
    return rows.where(complete.isNull())
