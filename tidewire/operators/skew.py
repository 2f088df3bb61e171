"""Joins and folds that stay whole when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

# A key is hot above the share of rows of one shuffle partition, or this share where partitions are fewer. There can never
# be more than 1/share hot keys: the set of them (and one looked-up row for each) has a proven size and may be broadcast.
HOT_SHARE = 1 / 500
# Salts a hot key is spread over.
SPREAD = 64


def hot_share(spark: SparkSession) -> float:
    return min(HOT_SHARE, 1 / int(spark.conf.get("spark.sql.shuffle.partitions")))


def hot_keys(df: DataFrame, key: str, share: float | None = None) -> DataFrame:
    """Keys above ``share`` of the keyed rows of ``df``: at most ``1/share`` rows. Counts combine before the shuffle."""
    share = hot_share(df.sparkSession) if share is None else share
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n"))
    return counts.where(F.col("_n") > total.scalar() * F.lit(share)).select(F.col(key).alias("_hot"))


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left", share: float | None = None) -> DataFrame:
    """Join ``left`` to ``right`` (unique on ``key``) so that no key sends its rows to one task.

    With ``left_semi`` and ``left_anti`` only the keys of ``right`` count, and they may repeat.

    Rows of hot keys are spread over ``SPREAD`` salts and their looked-up rows (at most one per hot key, so few) are
    copied to each salt; rows without a key are spread too, as they match nothing. All others join as usual.
    """
    if how in ("left_semi", "left_anti"):
        right = right.select(key).distinct()
    elif how not in ("left", "inner"):
        raise ValueError(f"unsupported lookup: {how!r}")
    hot = F.broadcast(hot_keys(left, key, share))
    is_hot = F.col("_hot").isNotNull()
    hashed = [f.name for f in left.schema if isinstance(f.dataType, AtomicType)]
    spread = F.pmod(F.xxhash64(*[F.col(f"`{n}`") for n in hashed]), F.lit(SPREAD)).cast("int")
    salted_left = left.join(hot, F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt", F.when(is_hot | F.col(key).isNull(), spread).otherwise(0)
    )
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    salted_right = right.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(salts))
    joined = salted_left.drop("_hot").join(salted_right.drop("_hot"), [key, "_salt"], how)
    return joined.drop("_salt")


# Rows of a few narrow columns that may be broadcast; ``counted_broadcast`` checks.
BROADCAST_ROWS = 10_000


def counted_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` narrow rows as counted, marked for broadcast if they are few; else it is shuffled."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; unset, one in the warehouse, which is shared as well."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


def materialize(df: DataFrame) -> DataFrame:
    """Checkpoint a frame that later steps read several times, so that its lineage is cut and its work done once."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def _pluck(name: str) -> Column:
    return F.transform("_rows", lambda row: row[name])


def tree_fold(
    df: DataFrame,
    key: str,
    order: str,
    leaf: dict[str, Column],
    collapse: dict[str, object],
    commutative: dict[str, object] | None = None,
    level_bits: tuple[int, ...] = (12, 24),
    share: float | None = None,
) -> DataFrame:
    """Order-dependent fold per key; rows of ordinary keys move once, hot keys fold as a tree over the arrival order.

    ``order`` is a non-negative long that names each row's place in the log; rows of one key have distinct
    places. A key below ``share`` (less than a shuffle partition of rows) is gathered in one step. A hot key is
    combined level by level: rows whose places share all but the lowest ``bits`` bits, so with levels 12 bits apart
    no group gathers more than ``2**12`` members, however hot the key; the last one gathers a state per
    ``2**level_bits[-1]`` places of the log. ``leaf`` turns a row into a state,
    ``collapse[name]`` maps the ordered array of states of one block to one state of the same type, and
    ``commutative[name]`` is an aggregate over the like-named leaf column (combined before the shuffle).
    Rows without a key form one group and fold as a tree.
    """
    commutative = commutative or {}
    hot = F.broadcast(hot_keys(df, key, share))
    marked = df.join(hot, F.col(key) == F.col("_hot"), "left").withColumn(
        "_tree", F.col("_hot").isNotNull() | F.col(key).isNull()
    )

    def level(state: DataFrame, bits: int | None) -> DataFrame:
        block = F.lit(0).cast("long") if bits is None else F.shiftright(F.col("_at"), bits)
        gathered = F.sort_array(F.collect_list(F.struct("_at", *collapse))).alias("_rows")
        grouped = state.withColumn("_block", block).groupBy(key, "_block").agg(
            F.min("_at").alias("_at"), gathered, *[f(F.col(n)).alias(n) for n, f in commutative.items()]
        )
        return grouped.select(key, "_at", *commutative, *[f(_pluck(n)).alias(n) for n, f in collapse.items()])

    def leaves(rows: DataFrame) -> DataFrame:
        return rows.select(key, F.col(order).alias("_at"), *[c.alias(n) for n, c in leaf.items()])

    once = level(leaves(marked.where(~F.col("_tree"))), None)
    tree = leaves(marked.where("_tree"))
    for bits in (*level_bits, None):
        tree = level(tree, bits)
    return once.unionByName(tree).drop("_at")


def newest(df: DataFrame, order: str, sequence: str = "seq") -> Column:
    """What to order rows of one key by, for a later maximum: ``order``, then ``sequence`` where the rows have it, then a
    hash of the whole row, so that rows of one time give the same result in every run. Null where ``order`` is."""
    tie = [F.col(sequence)] if sequence in df.columns and sequence != order else []
    return F.when(F.col(order).isNotNull(), F.struct(F.col(order), *tie, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
