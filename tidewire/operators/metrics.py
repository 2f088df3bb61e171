"""Metric events rolled up by labelled name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.operators.skew import lookup, materialize

# Prefix of metric names per subsystem (fixed values).
SUBSYSTEMS = {"scorer": "scorer.", "pipeline": "pipeline.", "fetcher": "fetcher.", "web": "web."}


def label_key(name: Column, labels: Column) -> Column:
    """``name{a=1,b=2}`` with labels in order; the bare name without labels."""
    parts = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    keyed = F.concat(name, F.lit("{"), F.array_join(parts, ","), F.lit("}"))
    return F.when(F.coalesce(F.size(labels), F.lit(0)) > 0, keyed).otherwise(name)


def _keyed(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("type") == kind).withColumn("key", label_key(F.col("name"), F.col("labels")))


def metric_counters(events: DataFrame) -> DataFrame:
    return _keyed(events, "counter").groupBy("key").agg(F.sum("value").alias("value"))


def metric_gauges(events: DataFrame) -> DataFrame:
    return _keyed(events, "gauge").groupBy("key").agg(F.max_by("value", F.struct("at", "value")).alias("value"))


# Values lie in buckets a hundredth wide: the same for every key and time, so counts of buckets add up over any roll-up and
# tell exactly in which bucket a place lies and how many values are below it.
_WIDTH = 1.01
# More than the number of the bucket of the smallest and of the largest double.
_EDGE = 100_000
ROLLUP = "key string, hour timestamp, bucket int, n long, total double, least double, most double"


def value_bucket(value: Column) -> Column:
    """The bucket of a double, in the order of the doubles; NaN is above all."""
    size = F.abs(value)
    place = F.when(size == float("inf"), _EDGE).otherwise(F.ceil(F.ln(size) / F.ln(F.lit(_WIDTH))).cast("int")) + 2 * _EDGE
    return F.when(F.isnan(value), 4 * _EDGE).when(value == 0, 0).when(value > 0, place).otherwise(-place)


def histogram_values(events: DataFrame) -> DataFrame:
    """(key, hour, bucket, value, n): how often each value occurred in an hour. Counts combine in tasks first."""
    rows = _keyed(events, "histogram").where(F.col("value").isNotNull())
    hour = F.date_trunc("hour", "at").alias("hour")
    return rows.select("key", hour, value_bucket(F.col("value")).alias("bucket"), "value").groupBy(
        "key", "hour", "bucket", "value").agg(F.count(F.lit(1)).alias("n"))


def rolled(values: DataFrame) -> DataFrame:
    """(key, hour, bucket, n, total, least, most): the roll-up that reports read first."""
    times = F.col("value") * F.col("n")
    return values.groupBy("key", "hour", "bucket").agg(
        F.sum("n").alias("n"), F.sum(times).alias("total"), F.min("value").alias("least"), F.max("value").alias("most")
    )


def write_rollup(events: DataFrame, path: str) -> None:
    """Append the roll-up of these events and the counted values behind it; hours may be written in any number of parts."""
    values = materialize(histogram_values(events))
    ordered = values.repartitionByRange("key", "bucket").sortWithinPartitions("key", "bucket")
    ordered.write.mode("append").parquet(f"{path}/values")
    rolled(values).write.mode("append").parquet(f"{path}/rollup")


def histograms_of(rollup: DataFrame, values: DataFrame) -> DataFrame:
    """Count, total, mean, min, max and exact p50/p99 (the values at places n//2 and min(int(.99n), n-1)) per key.

    The roll-up tells the bucket of each place, closed on both sides, and what lies below it. Only the values of these
    two buckets are ranked, by their counts; no task sees more of a key than a hundredth of the range of its values.
    """
    buckets = materialize(rollup.groupBy("key", "bucket").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most")))
    base = buckets.groupBy("key").agg(
        F.sum("n").alias("count"), F.sum("total").alias("total"), F.min("least").alias("min"), F.max("most").alias("max"))
    base = base.withColumn("mean", F.col("total") / F.col("count"))
    # A key has at most some hundred thousand buckets, as many as doubles have.
    upto = F.sum("n").over(W.partitionBy("key").orderBy("bucket"))
    places = F.array(
        F.struct(F.lit("p50").alias("p"), F.expr("count div 2").alias("place")),
        F.struct(F.lit("p99").alias("p"), F.least(F.floor(F.col("count") * 0.99).cast("long"), F.col("count") - 1).alias("place")),
    )
    wanted = buckets.select("key", "bucket", "n", upto.alias("upto")).join(base.select("key", F.explode(places).alias("w")), "key")
    below = (F.col("upto") - F.col("n")).alias("below")
    brackets = wanted.where((F.col("upto") > F.col("w.place")) & (F.col("upto") - F.col("n") <= F.col("w.place"))).select(
        F.struct("key", "bucket").alias("at"), F.struct("w.p", "w.place", below).alias("b"))
    brackets = brackets.groupBy("at").agg(F.collect_list("b").alias("brackets"))
    inside = lookup(values.withColumn("at", F.struct("key", "bucket")), brackets, "at", "inner")
    counted = inside.groupBy("key", "value", "brackets").agg(F.sum("n").alias("n")).select("key", "value", "n", F.explode("brackets").alias("b"))
    reached = F.sum("n").over(W.partitionBy("key", "b.p").orderBy("value"))
    picked = counted.withColumn("reached", F.col("b.below") + reached).where(F.col("reached") > F.col("b.place")).groupBy("key").agg(
        *[F.min(F.when(F.col("b.p") == p, F.col("value"))).alias(p) for p in ("p50", "p99")])
    return base.join(picked, "key").select("key", "count", "total", "mean", "min", "max", "p50", "p99")


def metric_histograms(events: DataFrame) -> DataFrame:
    """The same straight from events: their values are counted once and rolled up on the way."""
    values = materialize(histogram_values(events))
    return histograms_of(rolled(values), values)


def stored_histograms(spark: SparkSession, path: str) -> DataFrame:
    """The same from what ``write_rollup`` has left; of the values, only those of two buckets for each key are kept."""
    return histograms_of(spark.read.parquet(f"{path}/rollup"), spark.read.parquet(f"{path}/values"))


def metric_coverage(events: DataFrame) -> DataFrame:
    return events.agg(
        *[F.coalesce(F.bool_or(F.startswith("name", F.lit(p))), F.lit(False)).alias(s) for s, p in SUBSYSTEMS.items()]
    )
