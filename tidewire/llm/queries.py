"""The registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.chat_sql import OP2_SQL
from tidewire.llm.common import fold_of, table
from tidewire.llm.manifest_sql import OP12_SQL
from tidewire.llm.negatives_sql import OP13_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {
    "op2_quotation_linking": OP2_SQL, "op12_merkle_manifest": OP12_SQL, "op13_hard_negatives": OP13_SQL,
}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode the ids; digests of both."""
    from tidewire.llm import bpe

    vocab = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.encode(documents, vocab, public_tokenizers.PATTERN, decoded=True)
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query
def op10_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 1024 ids."""
    from tidewire.llm import packing

    vocab = public_tokenizers.path("byte_bpe_50k.tiktoken")
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(table(spark, sf_dir, "documents"), vocab, public_tokenizers.PATTERN, added=added)


@query
def op9_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from two thirds of the labelled texts, predict all."""
    from tidewire.llm import language

    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold_of(F.col("doc_id"), 3) == 1
    model = language.fit(documents.where(~held_out))
    return language.identify(documents.drop("lang"), model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


@query
def op8_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count on three folds of labelled texts, calibrate on the fourth, score all."""
    from tidewire.llm import toxicity

    fold = fold_of(F.col("doc_id"), 5)
    scored = toxicity.score(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=fold > 1, calibrate=fold == 1
    )
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base test and the posterior's verdict on every document."""
    from tidewire.llm import quality

    return quality.assess(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


@query
def op5_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from tidewire.llm import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_winnowing_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of lines that came before, as digests."""
    from tidewire.llm import winnow

    left = winnow.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


@query
def op6_balanced_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector among all others."""
    from tidewire.llm import neighbours

    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op4_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added spans of personal data in every document."""
    from tidewire.llm import privacy

    found = privacy.all_spans(table(spark, sf_dir, "documents"))
    base, added = privacy.spans_text(F.col("base")), privacy.spans_text(F.col("added"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in privacy.KINDS]
    return found.select(
        F.col("key.id").alias("doc_id"), *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.when(F.size("base") > 0, base), F.when(F.size("added") > 0, added)).alias("spans"),
    )


@query
def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without its quotes, formatted and in reply order."""
    from tidewire.llm import chat

    return ordered_digest(chat.link(table(spark, sf_dir, "conversations")))


def ordered_digest(linked: DataFrame) -> DataFrame:
    """Messages in reply order, with their branches as text."""
    from tidewire.llm import chat

    ordered = chat.reply_ordered(linked)
    path = F.array_join(F.transform("path", lambda b: F.concat_ws("-", -b["back"], b["first"])), "/")
    return ordered.select("conv_id", "turn", "role", "parent_turn", "n_quotes", "n_linked", path.alias("branches"), "formatted")


@query
def op11_crf_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added spans of secrets in every document."""
    from tidewire.llm import secrets

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find(documents, secrets.fit(documents))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    every = secrets.spans_text(secrets.ordered(F.concat("base", "added")))
    base = F.sha2(secrets.spans_text(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, every.alias("spans"), F.size("added").cast("long").alias("n_added"))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree per source over all documents; proofs checked against texts that lost their line feeds for half of the ids."""
    from tidewire.llm import manifest

    documents = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    altered = fold_of(F.col("doc_id"), 2) == 0
    text = F.when(altered, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest.prove(
        documents, manifest.leaf_of(*fields, F.col("text")), manifest.leaf_of(*fields, text), F.col("source"), F.col("doc_id"),
        keep={"doc_id": F.col("doc_id")},
    )


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 100th vector, for each of its five nearest of the same label."""
    from tidewire.llm import negatives

    vectors = table(spark, sf_dir, "embeddings")
    x = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    sound = F.forall(x, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(sound).select(
        "vec_id", moved.alias("label"), F.transform(x, lambda x: F.floor(x * 256)).alias("vector")
    )
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)
