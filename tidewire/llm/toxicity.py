"""Toxicity by class-conditional Kneser-Ney models of words as letter sequences.

Both classes count letter n-grams of the top order apart; all lower orders are continuation counts that they share, so
a rare expression is smoothed alike in both and only what the classes write differently counts. The score of a text
is the log-likelihood ratio of its words per word, turned into a probability by a logistic curve.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import checkpointed, slices

ORDER = 5
DISCOUNT = 0.75
# Labelled rows, at most, that the logistic curve is fitted on.
CALIBRATION_ROWS = 20_000
# Evidence of one word, in nats, beyond which it counts as strong: ordinary words rarely get so far by chance.
STRONG = 2.0
# Letters of text, about, whose documents meet the model together.
BLOCK = 16_000_000
_EDGE = "\x02"
_WORDS = re.compile(r"[^\W\d_]+").findall


def word_counts(df: DataFrame, text: str, label: str) -> DataFrame:
    """(word, n0, n1): how often each lower-cased letter run occurs in texts of either class; counted in tasks first."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                counts: dict[str, list[int]] = {}
                for value, toxic in zip(part.column("text").to_pylist(), part.column("label").to_pylist()):
                    for word in _WORDS(value.lower()):
                        counts.setdefault(word, [0, 0])[toxic] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(counts), pa.string()), *[pa.array([n[i] for n in counts.values()], pa.int64()) for i in (0, 1)]],
                    ["word", "n0", "n1"],
                )

    rows = df.select(F.col(text).cast("string").alias("text"), (F.col(label) == 1).cast("int").alias("label")).dropna()
    counted = rows.mapInArrow(run, "word string, n0 long, n1 long")
    return counted.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _gram_counts(words: DataFrame, order: int) -> DataFrame:
    """(gram, c0, c1) of the top order; words carry edge marks, so their beginnings are n-grams too."""

    def run(batches):
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for word, n0, n1 in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for gram in _grams_of(word, order):
                    held = counts.get(gram)
                    if held is None:
                        counts[gram] = [n0, n1]
                    else:
                        held[0] += n0
                        held[1] += n1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), *[pa.array([n[i] for n in counts.values()], pa.int64()) for i in (0, 1)]],
                ["gram", "n0", "n1"],
            )

    rows = words.select("word", "n0", "n1").mapInArrow(run, "gram string, n0 long, n1 long")
    return rows.groupBy("gram").agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"))


def _head(column: str, size: int):
    return F.substring(column, 1, size)


def fit_slots(df: DataFrame, text: str, label: str, order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    """(gram, ratio): log-likelihood ratios of every n-gram seen, and of every context (a letter shorter) for n-grams not
    seen after it, each under its own letters. All labelled texts count; nothing is gathered.
    """
    top = checkpointed(_gram_counts(word_counts(df, text, label), order))
    d = F.lit(discount)
    # Shared lower orders: continuation counts, interpolated from the shortest up.
    kinds = top.select("gram")
    levels = []
    for size in range(order - 1, 0, -1):
        kinds = kinds.groupBy(F.substring("gram", 2, size).alias("gram")).agg(F.count(F.lit(1)).alias("k"))
        levels.append(kinds)
    letters = levels[-1]
    share = letters.select("gram", (F.col("k") / letters.agg(F.sum("k")).scalar()).alias("p"))
    for size in range(2, order):
        level = levels[order - 1 - size].withColumn("context", _head("gram", size - 1))
        total = level.groupBy("context").agg(F.sum("k").alias("sum"), F.count(F.lit(1)).alias("types"))
        below = share.select(F.col("gram").alias("tail"), "p")
        share = (
            level.join(total, "context").withColumn("tail", F.substring("gram", 2, size - 1)).join(below, "tail")
            .select("gram", (F.greatest(F.col("k") - d, F.lit(0.0)) / F.col("sum")
                             + d * F.col("types") / F.col("sum") * F.col("p")).alias("p"))
        )
    seen = top.withColumn("context", _head("gram", order - 1))
    contexts = seen.groupBy("context").agg(
        *[F.sum(f"c{c}").alias(f"s{c}") for c in (0, 1)],
        *[F.sum((F.col(f"c{c}") > 0).cast("long")).alias(f"t{c}") for c in (0, 1)],
    )
    weight = {c: F.when(F.col(f"s{c}") > 0, d * F.col(f"t{c}") / F.col(f"s{c}")).otherwise(1.0) for c in (0, 1)}
    below = share.select(F.col("gram").alias("tail"), "p")
    chance = {
        c: F.when(F.col(f"s{c}") > 0, F.greatest(F.col(f"c{c}") - d, F.lit(0.0)) / F.col(f"s{c}")).otherwise(0.0)
        + weight[c] * F.col("p")
        for c in (0, 1)
    }
    ratios = (
        seen.join(contexts, "context").withColumn("tail", F.substring("gram", 2, order - 1)).join(below, "tail")
        .select("gram", (F.log(chance[1]) - F.log(chance[0])).alias("ratio"))
    )
    backing = contexts.select(F.col("context").alias("gram"), (F.log(weight[1]) - F.log(weight[0])).alias("ratio"))
    return checkpointed(ratios.unionByName(backing))


def _grams_of(word: str, order: int):
    marked = _EDGE * (order - 1) + word + _EDGE
    return (marked[i : i + order] for i in range(len(word) + 1))


def _wanted(words: list[str], order: int) -> dict[str, int]:
    """Each distinct n-gram of the words, and each context, with its place."""
    known: dict[str, int] = {}
    for word in words:
        for gram in _grams_of(word, order):
            if gram not in known:
                known[gram] = len(known)
                known.setdefault(gram[:-1], len(known))
    return known


def _word_ratios(words: list[str], places, ratios, order: int) -> np.ndarray:
    """The sum over each word's n-grams of the ratio at its place, else at its context's; neither: nothing."""
    known = _wanted(words, order)
    found = np.full(len(known), np.nan)
    if len(places):
        found[places] = ratios
    held = dict(zip(known, found.tolist()))
    values = np.zeros(len(words))
    for i, word in enumerate(words):
        total = 0.0
        for gram in _grams_of(word, order):
            ratio = held[gram]
            if ratio != ratio:
                ratio = held[gram[:-1]]
                if ratio != ratio:
                    continue
            total += ratio
        values[i] = total
    return values


class _Words(dict):
    """Word -> log-likelihood ratio of its letters, and as imaginary part what of it exceeds ``STRONG``: for looking at
    single words, one query each."""

    def __init__(self, ratios: DataFrame, order: int):
        self.ratios, self.order = ratios, order

    def __missing__(self, word: str) -> complex:
        one = self.ratios.sparkSession.createDataFrame([(0, word)], "doc_id long, text string")
        row = likelihoods(one, self.ratios, order=self.order).collect()[0]
        self[word] = complex(row["ratio"], row["strong"])
        return self[word]


def _packed(numbers) -> bytes:
    """Numbers as compressed planes of their bytes."""
    planes = np.array(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpacked(body: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(body, 4 * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, size).T).view("<u4").reshape(-1).astype(np.int64)


def _squeezed(words) -> bytes:
    return zlib.compress("\n".join(words).encode(), 6)


def _words_of(squeezed: bytes) -> list[str]:
    whole = zlib.decompress(squeezed).decode()
    return whole.split("\n") if whole else []


def _blocks(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per slice of documents: its distinct words, and of each document the words (their places) and counts."""

    def run(batches):
        from pyspark import TaskContext

        block, known = TaskContext.get().partitionId() << 32, defaultdict()
        known.default_factory = known.__len__
        ids, sizes, places, counts, held = [], [], array("I"), array("I"), 0

        def made():
            columns = [
                pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())),
                *[pa.array([x], pa.binary()) for x in (_squeezed(known), _packed(places), _packed(counts))],
            ]
            return pa.RecordBatch.from_arrays(columns, ["block", "ids", "sizes", "words", "places", "counts"])

        for batch in batches:
            for part in slices(batch, "text"):
                for doc, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = Counter(_WORDS(value.lower())) if value else {}
                    places.extend(map(known.__getitem__, found))
                    counts.extend(found.values())
                    ids.append(doc)
                    sizes.append(len(found))
                    held += len(value or "") + 64
                if held >= BLOCK:
                    yield made()
                    block, held = block + 1, 0
                    for x in (known, ids, sizes):
                        x.clear()
                    del places[:], counts[:]
        if ids:
            yield made()

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "block long, ids array<long>, sizes array<int>, words binary, places binary, counts binary")


def likelihoods(df: DataFrame, ratios: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, ratio, strong, n_words): each whole text's log-likelihood ratio, the sum of what single words have beyond
    ``STRONG``, and its words. Null and wordless texts: zeros.

    The distinct n-grams of each slice of documents are joined with the model, and come back to the slice as its part of it.
    """
    held = checkpointed(_blocks(df, doc_id, text))

    def name(batches):
        for batch in batches:
            for block, squeezed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = list(_wanted(_words_of(squeezed), order))
                places = np.arange(len(grams), dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(grams), block, np.int64)), pa.array(places), pa.array(grams, pa.string())], ["block", "place", "gram"]
                )

    named = held.select("block", "words").mapInArrow(name, "block long, place int, gram string")
    found = named.join(ratios, "gram").groupBy("block").agg(
        F.collect_list(F.struct("place", "ratio")).alias("found")
    ).select("block", F.col("found.place").alias("known"), F.col("found.ratio").alias("ratios"))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(n)[row] for n in ("sizes", "words", "places", "counts", "known", "ratios")}
                sizes = one["sizes"].values.to_numpy(zero_copy_only=False).astype(np.int64)
                total = int(sizes.sum())
                places, counts = _unpacked(one["places"].as_py(), total), _unpacked(one["counts"].as_py(), total)
                part = [one[n].values.to_numpy() if one[n].is_valid else [] for n in ("known", "ratios")]
                values = _word_ratios(_words_of(one["words"].as_py()), *part, order)
                ratio, beyond = values[places] * counts, np.maximum(values - STRONG, 0.0)[places] * counts
                sums = np.zeros((3, len(sizes)))
                for doc, (end, size) in enumerate(zip(np.cumsum(sizes).tolist(), sizes.tolist())):
                    within = slice(end - size, end)
                    sums[:, doc] = ratio[within].sum(), beyond[within].sum(), counts[within].sum()
                columns = [batch.column("ids")[row].values, *map(pa.array, sums[:2]), pa.array(sums[2].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ratio", "strong", "n_words"])

    return held.join(found, "block", "left").mapInArrow(run, "doc_id long, ratio double, strong double, n_words long")


def features() -> list:
    """What the curve sees: the ratio per word, the strong evidence per word and per root of words, and all of it."""
    size = F.greatest("n_words", F.lit(1))

    def within(value, low, high):
        return F.greatest(F.least(value, F.lit(float(high))), F.lit(float(low)))

    return [
        within(F.col("ratio") / size, -2, 4), within(F.col("strong") / size, 0, 4),
        within(F.col("strong") / F.sqrt(size), 0, 20), F.log1p("strong"), F.lit(1.0),
    ]


def fit_curve(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Weights of the logistic curve by Newton steps with a small ridge; without rows all weights are 0."""
    weights = np.zeros(x.shape[1])
    for _ in range(50 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        grad = x.T @ (toxic - p) - 0.1 * weights
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(weights)), grad)
        weights = weights + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return weights


def score(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          learn=None, calibrate=None, calibration_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``df``; score from 0 to 1, higher for label 1, predicted from 0.5.

    ``learn`` and ``calibrate`` are conditions on ``doc_id`` that pick, among the labelled rows, those whose texts the
    models count (all of them) and those the curve is fitted on (at most ``calibration_rows``, by a hash of the id).
    Null labels teach nothing; a document labelled twice counts by its highest label. Null and empty texts score as
    texts without evidence. Without any labelled row all scores are equal.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("_label"))
    learn = F.lit(True) if learn is None else learn
    calibrate = F.lit(True) if calibrate is None else calibrate
    # Merged at every size: labels grow with the documents, so they are never sent to all tasks.
    texts = df.where(learn).select(doc_id, text).join(known.where(learn).hint("merge"), doc_id)
    ratios = fit_slots(texts, text, "_label")
    found = checkpointed(likelihoods(df, ratios, doc_id, text))
    rows = (
        found.where(calibrate).join(known.where(calibrate).withColumnRenamed(doc_id, "doc_id"), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(calibration_rows)
        .select(F.array(*features()).alias("x"), F.col("_label").cast("double").alias("y")).toPandas()
    )
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(features()))
    weights = fit_curve(x, rows["y"].to_numpy(float)).tolist()
    total = reduce(lambda a, b: a + b, [F.lit(w) * f for w, f in zip(weights, features())])
    value = 1 / (1 + F.exp(-total))
    return found.select("doc_id", value.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
