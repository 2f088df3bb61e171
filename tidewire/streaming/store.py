"""Fold states of posts, kept beside the log: a delta for every batch, gathered into a base from time to time.

Both are parted by a bucket of the id, so a batch reads the buckets it touches and never the log. An id has at most one
state in the base and one in each delta since, which compose.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.merge import compose_states, posts_of
from tidewire.operators.skew import union_all

BUCKETS = 64
# Batches from one base to the next.
EVERY = 16
# States and posts hold whole texts.
CODEC = "zstd"


@dataclass(frozen=True)
class PostStates:
    """States under ``folder``. Batches are numbered from 0 without gaps; a batch overwrites its own parts only."""

    spark: SparkSession
    folder: str
    buckets: int = BUCKETS
    every: int = EVERY

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _delta(self, batch: int) -> str:
        return f"{self.folder}/delta/batch={batch}"

    def _base(self, batch: int) -> str:
        return f"{self.folder}/base/upto={batch}"

    def write_delta(self, batch: int, states: DataFrame) -> DataFrame:
        """Keep the states of one batch's own rows; they are returned as stored."""
        rows = states.withColumn("bucket", self.bucket(F.col("id")))
        rows.write.mode("overwrite").option("compression", CODEC).partitionBy("bucket").parquet(self._delta(batch))
        return self.spark.read.schema(rows.schema).parquet(self._delta(batch))

    def before(self, batch: int, schema) -> DataFrame | None:
        """All stored states of earlier batches, several for an id, with their bucket; None for the first batch.

        Which parts these are follows from the batch's number alone, so a batch that runs again reads the same.
        """
        base = batch // self.every * self.every - 1
        frames = []
        if base >= 0:
            frames.append(self.spark.read.schema(schema).parquet(self._base(base)))
        if base + 1 < batch:
            paths = [self._delta(b) for b in range(base + 1, batch)]
            rows = self.spark.read.schema(schema).option("basePath", f"{self.folder}/delta").parquet(*paths)
            frames.append(rows.select(*schema.names))
        return union_all(frames) if frames else None

    def touched_posts(self, batch: int, delta: DataFrame) -> DataFrame:
        """Posts that the batch touched, as they are after it: its states and the older ones of the same ids."""
        older = self.before(batch, delta.schema)
        if older is None:
            # One state per id already.
            return posts_of(delta.drop("bucket"))
        # At most ``buckets`` numbers.
        buckets = [r["bucket"] for r in delta.select("bucket").distinct().collect()]
        mine = older.where(F.col("bucket").isin(buckets)).join(delta.select("id"), "id", "left_semi")
        delta = mine.select(*delta.columns).unionByName(delta)
        return posts_of(compose_states(delta.drop("bucket")))

    def compact(self, batch: int, schema) -> None:
        """After every ``every`` batches gather all states into a new base; older parts are left to the folder's owner."""
        if (batch + 1) % self.every == 0:
            rows = self.all_states(batch, schema)
            rows = rows.withColumn("bucket", self.bucket(F.col("id")))
            rows.write.mode("overwrite").option("compression", CODEC).partitionBy("bucket").parquet(self._base(batch))

    def all_states(self, batch: int, schema) -> DataFrame:
        """One state per id after this batch."""
        delta = self.spark.read.schema(schema).parquet(self._delta(batch))
        older = self.before(batch, schema)
        every = delta if older is None else older.select(*delta.columns).unionByName(delta)
        return compose_states(every.drop("bucket"))
