"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams of a language, most frequent first. A document's own list is
compared with each profile: every n-gram costs the difference of its two ranks, or the full length of a profile where
the profile lacks it. The language with the smallest sum wins.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidewire.llm.common import SLICE_BYTES, fresh, quoted, slices, worker_cache

# Length of a profile, and letters of the longest n-gram (three code points of 21 bits fill a long).
PROFILE = 400
GRAM = 3
UNKNOWN = "und"
# Texts of more code points are read in stretches of this many, so memory stays bounded.
STRETCH = 1 << 20


def _letters() -> np.ndarray:
    """Code point -> the code point itself for a letter, 0 (a gap between words) for all else."""
    codes = np.arange(sys.maxunicode + 1, dtype=np.uint64)
    codes[[i for i in range(sys.maxunicode + 1) if not chr(i).isalpha()]] = 0
    return codes


def _grams_of(codes: np.ndarray, known: int) -> np.ndarray:
    """Codes of all n-grams of 1 to ``GRAM`` letters that end behind the first ``known`` places; a gap counts as a letter
    at a word's edge and never stands inside."""
    found = []
    for length in range(1, GRAM + 1):
        part = codes[max(0, known - length + 1) :]
        count = len(part) - length + 1
        if count <= 0:
            continue
        grams, whole = np.zeros(count, np.uint64), np.ones(count, bool)
        for place in range(length):
            grams = (grams << np.uint64(21)) | part[place : place + count]
            if length == 1 or 0 < place < length - 1:
                whole &= part[place : place + count] > 0
        tag = np.uint64(1 << 63) if length == 2 else np.uint64(0)
        found.append(grams[whole] | tag)
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def count_grams(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of the whole text and their counts, read in stretches that carry their last places over."""
    gap = np.zeros(1, np.uint64)
    last, keys, counts = gap, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for start in range(0, len(text), STRETCH):
        points = np.frombuffer(text[start : start + STRETCH].lower().encode("utf-32-le", "replace"), np.uint32)
        codes = np.concatenate([last, letters[points], gap if start + STRETCH >= len(text) else gap[:0]])
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
        codes = codes[keep]
        some, n = np.unique(_grams_of(codes, len(last)), return_counts=True)
        if start:
            some, inverse = np.unique(np.concatenate([keys, some]), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([counts, n]), minlength=len(some)).astype(np.int64)
        keys, counts, last = some, n, codes[-(GRAM - 1) :]
    return keys, counts


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, most frequent first, ties by code."""
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        some = counts >= least
        keys, counts = keys[some], counts[some]
    return keys[np.lexsort((keys, -counts))][:size]


def profiles(df: DataFrame, lang: str = "lang", text: str = "text", size: int = PROFILE) -> DataFrame:
    """(lang, rank from 0, gram): at most ``size`` rows per value of ``lang``. Rows without lang or text teach nothing.

    Counts combine in each task before the shuffle, so a language that holds most rows sends one row per n-gram and task.
    """

    def run(batches):
        letters = worker_cache("letters", _letters)
        for batch in batches:
            for part in slices(batch, "text", 4 * SLICE_BYTES):
                by_lang: dict[str, list] = {}
                for name, value in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    by_lang.setdefault(name, []).append(count_grams(value, letters))
                for name, found in by_lang.items():
                    keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                    counts = np.bincount(inverse, weights=np.concatenate([n for _, n in found]), minlength=len(keys))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))],
                        ["lang", "gram", "n"],
                    )

    rows = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).dropna()
    counted = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # The filter is on the number itself: only then does each task pass on no more than ``size`` n-grams of a language.
    best = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    return best.select("lang", (F.col("rank") - 1).alias("rank"), "gram")


class Model:
    """Profiles as a table of ranks: one column per language, one row per n-gram that any profile holds."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.unique(np.array([r[2] for r in rows], np.int64).view(np.uint64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        column = {name: i for i, name in enumerate(self.langs)}
        places = np.searchsorted(self.grams, np.array([r[2] for r in rows], np.int64).view(np.uint64))
        for place, (name, rank, _) in zip(places.tolist(), rows):
            self.ranks[place, column[name]] = rank

    def predict(self, text: str | None, letters: np.ndarray) -> tuple[str, float]:
        if not text or not self.langs:
            return UNKNOWN, 0.0
        grams = ranked(*count_grams(text, letters), self.size)
        if not len(grams):
            return UNKNOWN, 0.0
        places = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        places[self.grams[places] != grams] = len(self.grams)
        theirs = self.ranks[places]
        cost = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(grams))[:, None])).sum(axis=0)
        best = int(np.argmin(cost))
        return self.langs[best], float(1 - cost[best] / (self.size * len(grams)))


def fit(df: DataFrame, lang: str = "lang", text: str = "text", size: int = PROFILE) -> Model:
    """Profiles of all rows of ``df``. The driver holds ``size`` n-grams per language, nothing that grows with the rows."""
    return Model([tuple(r) for r in profiles(df, lang, text, size).collect()], size)


def identify(df: DataFrame, model: Model, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the predicted language and a score from 0 to 1 (1: the document's n-grams stand as in the profile).

    Null texts and texts without a letter get ``und`` and 0; equal distances go to the language that sorts first. The
    ``into`` columns replace columns of these names; all other columns pass untouched in the JVM, only texts go to
    Python. No shuffle.
    """
    kind = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast((model.langs, model.grams, model.ranks, model.size))

    @F.arrow_udf(kind)
    def udf(texts: pa.Array) -> pa.Array:
        letters = worker_cache("letters", _letters)
        own = object.__new__(Model)
        own.langs, own.grams, own.ranks, own.size = shared.value
        found = [own.predict(value.as_py(), letters) for value in texts]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang", "score"]
        )

    (made,) = fresh(df, "made")
    scored = df.withColumn(made, udf.asNondeterministic()(quoted(text).cast("string")))
    return scored.withColumns({into[0]: quoted(made)["lang"], into[1]: quoted(made)["score"]}).drop(made)


def rejected(lang_pred: Column, score: Column, least: float) -> Column:
    """Documents without a language: no letters, or letters unlike every profile."""
    return (lang_pred == UNKNOWN) | (score < least)
