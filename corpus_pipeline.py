"""A corpus through five operators: language, repeated lines, near-duplicates, personal data, packing."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm import language, packing, privacy, simhash, winnow
from tidewire.llm.common import checkpointed, fresh, quoted
from tidewire.operators.skew import shared_folder

# Documents whose letters are less like every profile than this have no language; prose stays far above.
LEAST_LIKENESS = 0.25


def _measured(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with ``n_chars`` of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*[quoted(c) for c in columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letters, or letters unlike every learned profile."""
    model = language.fit(docs)
    lang, score = fresh(docs, "lang_pred", "score")
    found = language.identify(docs, model, into=(lang, score))
    return found.where(~language.rejected(quoted(lang), quoted(score), LEAST_LIKENESS)).select(*map(quoted, docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go; every document stays, without them."""
    (removed,) = fresh(docs, "n_removed")
    return _measured(winnow.dedup_lines(docs, removed=removed), docs.columns)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (sets of five-word shingles with a similarity of 0.8 or more, verified)
    stays: the one with the least id, and one row of it."""
    n, i, h, place = fresh(docs, "n", "i", "h", "place")
    key = privacy.identity(F.col("doc_id"), F.col("text"))
    marked = docs.withColumns({n: key["id"].isNull(), i: F.coalesce(key["id"], F.lit(0)), h: key["h"]})
    named = marked.select(F.struct(n, i, h).alias("doc_id"), "text")
    found = checkpointed(simhash.similar_groups(named))
    first = found.groupBy("component").agg(F.min("doc_id").alias("k")).select(
        F.col(f"k.{n}").alias(n), F.col(f"k.{i}").alias(i), F.col(f"k.{h}").alias(h))
    same = Window.partitionBy(n, i, h).orderBy(n)
    kept = marked.join(first, [n, i, h]).withColumn(place, F.row_number().over(same)).where(quoted(place) == 1)
    return kept.select(*map(quoted, docs.columns))


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data go; every document stays, without them."""
    return _measured(privacy.sanitise(docs), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids, one row per piece."""
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added)


STAGES = [
    ("language", language_stage), ("lines", line_stage), ("near_duplicates", duplicate_stage), ("privacy", privacy_stage),
    ("packing", packing_stage),
]

# Stages count in Python and tokenise: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What a stage returns is written as Parquet to the shared folder, a new one for each
    run, and read again by the next, which thus scans only the columns it needs and repeats nothing when executors go."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
