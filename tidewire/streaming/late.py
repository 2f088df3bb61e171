"""Rows that come too late for a stateful job, kept in a side table instead of lost.

A stateful stream drops rows behind its watermark without a trace. Here a first step sees every micro-batch, knows the
watermark the stateful job will use (the greatest event time of earlier batches, less the delay, kept with the progress of
the batch before), and splits the rows: those in time go on to the job, the others to the side table. Both steps run one
after the other for each micro-batch, so they agree on the watermark, and the job's own check finds nothing to drop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from tidewire.sources.paths import finished


def with_late_rows(
    rows: DataFrame, time: str, delay: str, folder: str, job: Callable[[DataFrame], DataStreamWriter], until: Column | None = None
) -> DataStreamWriter:
    """Run ``job`` over the rows of a stream that are in time; the others are in ``late_rows(spark, folder)``.

    ``time`` is the event time, ``delay`` the watermark's (an interval); ``job`` must use both. A row is late when the
    time up to which it matters (``until``, by default its event time; the end of its window where windows are counted)
    is not behind the watermark, or when it has no event time. Under ``folder`` lie the rows in time, the late ones, the
    progress and this step's checkpoint; ``job`` has a checkpoint of its own. A batch that runs again after a failure
    writes nothing that it finished before. The times are compared in milliseconds, as Spark's watermark is.
    """
    schema = StructType([f for f in rows.schema])
    until = F.col(time) if until is None else until

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{folder}/progress/batch={number - 1}"
        known = spark.read.parquet(before).first()["most"] if number else 0
        if not finished(spark, f"{folder}/progress/batch={number}"):
            least = F.timestamp_millis(F.lit(known)) - F.expr(f"INTERVAL {delay}")
            watermark = F.greatest(least, F.timestamp_millis(F.lit(0)))
            in_time = F.coalesce(until > watermark, F.lit(False))
            for name, keep in (("in", in_time), ("late", ~in_time)):
                if not finished(spark, f"{folder}/{name}/batch={number}"):
                    batch.where(keep).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
            here = spark.read.schema(schema).parquet(f"{folder}/in/batch={number}").agg(F.max(F.unix_millis(time)).alias("m"))
            most = F.greatest(F.coalesce("m", F.lit(0)), F.lit(known)).cast("long").alias("most")
            here.select(most).write.mode("overwrite").parquet(f"{folder}/progress/batch={number}")
        job(spark.readStream.schema(schema).parquet(f"{folder}/in")).trigger(availableNow=True).start().awaitTermination()

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")


def late_rows(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Every row that came too late, with the micro-batch it came in."""
    return spark.read.schema(StructType(schema.fields)).option("basePath", f"{folder}/late").parquet(f"{folder}/late/batch=*")
