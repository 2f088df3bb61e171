"""Quality by weak supervision.

Rules vote on a document or abstain; expectation-maximisation over the counts of vote patterns estimates how often each
rule is right, and a document is kept by the posterior probability that it is good. Nobody labels anything.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import WORD, checkpointed, slices

_words = re.compile(WORD).findall
SYMBOLS = "#*$%&|<>"
# What lies between words; other white space, such as no-break spaces, is part of them.
BLANKS = " \t\n\v\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_lines", "n_ended")


def repeated_words(words: list[str], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more, the first time included.

    Windows are compared exactly: words get numbers, runs of twice the length get numbers from pairs of runs.
    """
    n = len(words)
    if n <= width:
        return 0
    known: dict[str, int] = {}
    single = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        return 0
    runs, size = single, 1
    while size < width:
        step = min(size, width - size)
        keys = runs[: n - size - step + 1] * (n + 1) + runs[step : step + n - size - step + 1]
        runs = np.unique(keys, return_inverse=True)[1]
        size += step
    counts = np.bincount(runs)
    starts = np.flatnonzero(counts[runs] > 1)
    if not len(starts):
        return 0
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + width, -1)
    return int((np.cumsum(marks[:n]) > 0).sum())


def measure_text(text: str) -> tuple[int, ...]:
    """The counts of ``COUNTS`` for one whole text."""
    words = _words(text)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text)) if text.lower() != text else 0
    ended = sum((x.rstrip()[-1:] or x[-1]) in ".!?\"'" for x in lines)
    return (
        len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(words), upper, letters, len(lines), ended,
    )


def measure(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, counts of ``COUNTS``) for every row; null texts count as empty. No shuffle."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = [measure_text(t) if t else (0,) * len(COUNTS) for t in part.column(1).to_pylist()]
                columns = [pa.array(c, pa.int64()) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *COUNTS])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


@dataclass(frozen=True)
class Rule:
    """Votes good (1) or bad (-1) where its condition holds, and abstains (0) elsewhere."""

    name: str
    good: Column
    bad: Column

    def vote(self) -> Column:
        return F.when(self.bad, -1).when(self.good, 1).otherwise(0)


def default_rules() -> list[Rule]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    length = F.col("word_chars") / words
    return [
        Rule("size", F.col("n_words") >= 50, F.col("n_words") < 20),
        Rule("word_length", length.between(3, 9), (length < 2) | (length > 14)),
        Rule("symbols", F.col("n_symbols") * 50 <= words, F.col("n_symbols") * 10 > words),
        Rule("repeats", F.col("n_repeat_words") * 20 <= words, F.col("n_repeat_words") * 5 > words),
        Rule("lines", F.col("n_dup_lines") == 0, F.col("n_dup_lines") * 4 > lines),
        Rule("capitals", F.col("n_upper") * 8 <= F.col("n_letters"), F.col("n_upper") * 2 > F.col("n_letters")),
        Rule("letters", F.col("n_letters") * 10 >= F.col("word_chars") * 8, F.col("n_letters") * 10 < F.col("word_chars") * 6),
        Rule("endings", F.col("n_ended") * 10 >= lines * 7, F.col("n_ended") * 10 < lines * 2),
    ]


@dataclass(frozen=True)
class Estimate:
    """Share of good documents, and per rule how often it votes bad, abstains and votes good on good and bad documents."""

    prior: float
    on_good: tuple[tuple[float, float, float], ...]
    on_bad: tuple[tuple[float, float, float], ...]

    def weights(self) -> list[tuple[float, float, float]]:
        """What each vote adds to the log odds of a good document."""
        return [tuple(float(np.log(g / b)) for g, b in zip(*pair)) for pair in zip(self.on_good, self.on_bad)]


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 200, most_false: float = 0.1) -> Estimate:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) and how many documents show each.

    Each rule has its own rates of votes on good and on bad documents, and rules err independently. It starts from
    documents that some rule votes against being bad more likely than not. Two anchors keep the classes' meaning: a
    rule votes bad on at most ``most_false`` of the good documents, and more often on bad ones. Without documents the
    starting rates stay.
    """
    against = (votes < 0).any(axis=1)
    good, shown = np.where(against, 0.2, 0.95), np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    start = np.array([[[0.02, 0.08, 0.9]], [[0.3, 0.2, 0.5]]])
    rates = np.repeat(start, votes.shape[1], axis=1)
    prior, total = 0.9, counts.sum()
    for _ in range(rounds if total else 0):
        new = np.empty_like(rates)
        for k, share in enumerate((good, 1 - good)):
            held = np.einsum("p,prv->rv", counts * share, shown) + 10 * start[k]
            new[k] = held / held.sum(axis=1, keepdims=True)
        false = np.minimum(new[0, :, 0], most_false)
        new[0, :, 1:] *= ((1 - false) / (1 - new[0, :, 0]))[:, None]
        new[0, :, 0] = false
        hit = np.maximum(new[1, :, 0], np.minimum(2 * false, 0.9))
        new[1, :, 1:] *= ((1 - hit) / (1 - new[1, :, 0]))[:, None]
        new[1, :, 0] = hit
        prior = float(np.clip((counts * good).sum() / total, 0.05, 0.98))
        odds = np.log(prior / (1 - prior)) + np.einsum("prv,rv->p", shown, np.log(new[0] / new[1]))
        good = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        done = np.abs(new - rates).max() < 1e-9
        rates = new
        if done:
            break
    return Estimate(prior, *[tuple(map(tuple, r.tolist())) for r in rates])


def judge(counts: DataFrame, rules: list[Rule] | None = None, least: float = 0.5) -> tuple[DataFrame, Estimate]:
    """Adds ``votes`` (array), ``posterior`` (double) and ``good`` (boolean: posterior of at least ``least``).

    The votes of all rows are counted by pattern in Spark; the driver gets at most ``3 ** rules`` counts. ``counts`` is
    read twice: pass a frame whose work is done.
    """
    rules = default_rules() if rules is None else rules
    votes = F.array(*[r.vote() for r in rules])
    patterns = counts.groupBy(votes.alias("votes")).agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()
    found = estimate(
        np.array([r["votes"] for r in patterns], float).reshape(-1, len(rules)), np.array([r["n"] for r in patterns], float)
    )
    weights = [
        F.when(r.bad, F.lit(w[0])).when(r.good, F.lit(w[2])).otherwise(F.lit(w[1])) for r, w in zip(rules, found.weights())
    ]
    odds = reduce(lambda a, b: a + b, weights)
    posterior = 1 / (1 + F.exp(-(odds + F.lit(float(np.log(found.prior / (1 - found.prior)))))))
    judged = counts.withColumn("votes", votes).withColumn("posterior", posterior)
    return judged.withColumn("good", F.col("posterior") >= least), found


def assess(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """Counts, base test and verdict for every row.

    ``base_failed``: under 10 words, or over 20 % of the words in repeated windows. ``kept`` is false for these, else
    the posterior's verdict. Null and empty texts have no words and fail; rows with equal ids are judged each.
    """
    judged, _ = judge(checkpointed(measure(df, doc_id, text)), least=least)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("good"))
