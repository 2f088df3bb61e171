"""Helpers the operators of this subpackage share: worker-side caches, bounded Arrow slices, cut lineage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Text bytes a Python worker turns into objects at a time.
SLICE_BYTES = 8_000_000
# A word: what lies between ASCII blanks.
WORD = "[^ \t-\r]+"


def worker_cache(name: str, build: Callable[[], object]) -> object:
    """``build()`` once per Python worker process, also when functions travel by value."""
    shelf = sys.modules.setdefault("_tidewire_worker_shelf", types.ModuleType("_tidewire_worker_shelf"))
    if not hasattr(shelf, name):
        setattr(shelf, name, build())
    return getattr(shelf, name)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text; one longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for row, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def shared_folder(spark: SparkSession) -> None:
    """Checkpoints go to the folder the cluster names in ``spark.checkpoint.dir``; unset, as in tests, beside the warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(
            spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        )


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder: later reads survive lost executors and repeat no work."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    made = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        made.append(name)
    return made


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column, folds: int) -> Column:
    """The remainder that deals documents to folds: CRC-32 of the id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
