"""Language, toxicity, quality and nearest neighbours: held-out accuracy, brute force and awkward rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import awkward, documents
from tidewire.llm import language, neighbours, quality, toxicity
from tidewire.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_language_accuracy(spark):
    found = QUERIES["op9_rank_order_language"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r["lang"] == r["lang_pred"] for r in rows) > 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_on_awkward_rows(spark):
    df = documents(spark, awkward())
    model = language.fit(df)
    assert model.langs == ["de", "en"]
    out = language.identify(df, model)
    # score is replaced, lang_pred is new, all others pass.
    assert set(out.columns) == set(df.columns) | {"lang_pred"}
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in out.collect()]
    assert len(got) == len(awkward())
    for doc in (1, 2, 3, 8):
        assert (doc, "und", 0.0) in got
    assert [p for i, p, _ in got if i in (4, None)] == ["de"] * 3
    empty = language.fit(df.limit(0))
    assert {r["lang_pred"] for r in language.identify(df, empty).collect()} == {"und"}


def test_grams_by_definition():
    letters = language._letters()
    text = "Ab, c-3 äö!\n" + "xy " * 3
    words = re.findall(r"[^\W\d_]+", text.lower())
    want = Counter()
    for w in words:
        want.update(("1", c) for c in w)
        padded = "_" + w + "_"
        want.update(("2", padded[i : i + 2]) for i in range(len(padded) - 1))
        want.update(("3", padded[i : i + 3]) for i in range(len(padded) - 2))
    keys, counts = language.count_grams(text, letters)
    assert sorted(counts.tolist()) == sorted(want.values())
    # The same in stretches.
    whole = language.STRETCH
    try:
        long = text * 20
        once = language.count_grams(long, letters)
        language.STRETCH = 64
        parts = language.count_grams(long, letters)
        assert once[0].tolist() == parts[0].tolist() and once[1].tolist() == parts[1].tolist()
    finally:
        language.STRETCH = whole


def test_held_out_toxicity(spark):
    rows = QUERIES["op8_kneser_ney_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    clean = [r for r in rows if not r["toxic"]]
    toxic = [r for r in rows if r["toxic"]]
    assert sum(r["predicted"] for r in clean) < 0.05 * len(clean)
    assert np.mean([r["score"] for r in toxic]) > np.mean([r["score"] for r in clean]) + 0.3


def test_toxicity_on_awkward_rows(spark):
    df = documents(spark, awkward())
    labels = spark.createDataFrame([(4, 0, 0), (5, 0, 1), (5, 0, 0), (6, 1, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(df, labels).collect()
    assert len(rows) == len(awkward()) and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in rows)
    none = toxicity.score(df, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert toxicity.score(df.limit(0), labels).count() == 0


def test_shared_backoff_is_a_distribution(spark):
    """Ratios of a context's followers, weighed by the ordinary model, sum to one toxic distribution."""
    texts = [("the cat sat on the mat", 0), ("the cad sat on the rat", 1)] * 5
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(texts)], "doc_id long, text string, label int")
    slots = toxicity.fit_slots(df, "text", "label", order=3)
    words = toxicity._Words(slots, 3)
    assert words["cad"].real > 0.5 > -0.5 > words["mat"].real


def test_every_ngram_keeps_its_own_ratio(spark):
    """Words without any n-gram of the labelled texts have no evidence, however many n-grams the model holds."""
    pick = random.Random(8)
    toxic = ["".join(pick.choice("abcdefghijklm") for _ in range(120)) for _ in range(1500)]
    unseen = ["".join(pick.choice("nopqrstuvwxyz") for _ in range(120)) for _ in range(50)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(toxic)] + [(-1, "abc", 0)], "doc_id long, text string, label int")
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(unseen)] + [(99, " ".join(unseen)), (100, None)], "doc_id long, text string")
    rows = toxicity.likelihoods(texts, toxicity.fit_slots(df, "text", "label")).collect()
    assert len(rows) == 52
    # Only the edge before a word was seen: its first letter backs off to that, no other n-gram has a ratio.
    edge = {r["doc_id"]: r["ratio"] for r in rows}
    assert edge[100] == 0 and all(abs(edge[i] - edge[0]) < 1e-9 for i in range(50)) and abs(edge[99] - 50 * edge[0]) < 1e-6


def repeated_by_force(words, width=5):
    windows = Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
    inside = set()
    for i in range(len(words) - width + 1):
        if windows[tuple(words[i : i + width])] > 1:
            inside.update(range(i, i + width))
    return len(inside)


def test_quality_counts_by_definition():
    pick = random.Random(4)
    for _ in range(300):
        text = "".join(pick.choice(["a", "bb", "É", "#", "|", " ", " ", "\n", "\x0b", " ", "c."]) for _ in range(pick.randint(0, 80)))
        words = re.findall("[^\x20\x09-\x0d]+", text)
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        got = quality.measure_text(text)[:5]
        assert got == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated_by_force(words)
        ), text


def test_lines_of_other_blanks_are_lines_of_words():
    for blank in "\xa0\u3000\u2028\x85\x1c\x1f\u2003":
        text = f"a.\n{blank}\n \t\n{blank}\nb.\n\n"
        counts = dict(zip(quality.COUNTS, quality.measure_text(text)))
        assert (counts["n_words"], counts["n_lines"], counts["n_dup_lines"], counts["n_ended"]) == (4, 4, 1, 2), repr(blank)


def test_expectation_maximisation_finds_the_bad_class():
    random_ = np.random.default_rng(1)
    bad = random_.random(20_000) < 0.2
    hit, false = np.array([0.6, 0.7, 0.5, 0.4]), np.array([0.02, 0.05, 0.03, 0.01])
    votes = np.where(random_.random((len(bad), 4)) < np.where(bad[:, None], hit, false), -1, 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    found = quality.estimate(patterns.astype(float), counts.astype(float))
    assert abs(1 - found.prior - 0.2) < 0.05
    assert all(abs(r[0] - h) < 0.1 for r, h in zip(found.on_bad, hit))
    assert quality.estimate(np.zeros((0, 4)), np.zeros(0)).prior == 0.9


def test_quality_on_awkward_rows(spark):
    rows = quality.assess(documents(spark, awkward())).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(awkward()) and by_id[1]["base_failed"] and not by_id[1]["kept"]
    assert by_id[5]["n_repeat_words"] == 30_000 and not by_id[5]["kept"] and by_id[4]["n_words"] == 39
    assert quality.assess(documents(spark, []).limit(0)).count() == 0


def test_clean_documents_are_kept(spark):
    found = QUERIES["op3_weak_supervision"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    rows = [r for r in found.collect() if not r["base_failed"]]
    good = [r["kept"] for r in rows if r["quality"]]
    poor = [r["kept"] for r in rows if not r["quality"]]
    assert np.mean(good) > 0.97 and np.mean(poor) < 0.8


def nearest_by_force(vectors, query, k):
    scores = sorted((-float((np.array(v) * np.array(vectors[query])).sum()), i) for i, v in vectors.items() if i != query)
    return [(i, -s) for s, i in scores[:k]]


def test_neighbours_recall_ties_and_awkward_vectors(spark):
    random_ = np.random.default_rng(2)
    vectors = {i: random_.normal(size=8).tolist() for i in range(1500)}
    copy = random_.normal(size=8).tolist()
    vectors |= {i: copy for i in range(1500, 2000)}
    odd = [(5000, None), (5020, [0.0] * 8), (5040, [float("nan")] + [1.0] * 7), (5060, [None] + [1.0] * 7), (5080, [float("inf")] * 8),
           (5100, [1.0] * 5), (None, copy)]
    df = spark.createDataFrame(list(vectors.items()) + odd, "vec_id long, embedding array<double>").repartition(4)
    rows = neighbours.search(df, df["vec_id"] % 20 == 0, list_size=64).collect()
    by_query = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        by_query.setdefault(r["query_id"], []).append(r)
    assert set(by_query) == {i for i in vectors if i % 20 == 0}
    hits = 0
    for query, found in by_query.items():
        want = nearest_by_force(vectors, query, 20)
        assert [r["rank"] for r in found] == list(range(1, 21)) and query not in {r["vec_id"] for r in found}
        hits += len({i for i, _ in want} & {r["vec_id"] for r in found})
        for r in found:
            assert r["score"] == pytest.approx(float(np.dot(vectors[query], vectors[r["vec_id"]])), abs=1e-12)
        if query >= 1500:
            assert [r["vec_id"] for r in found] == [i for i, _ in want]
    assert hits >= 0.95 * 20 * len(by_query)


def test_neighbours_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    rows = neighbours.search(few, few["vec_id"] % 20 == 0).collect()
    assert {(r["query_id"], r["vec_id"]) for r in rows} == {(0, 20), (0, 3), (20, 0), (20, 3)}
    # Equal scores: the smaller id first.
    assert [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == 20] == [0, 3]
    assert neighbours.search(few.limit(0), few["vec_id"] % 20 == 0).count() == 0


def test_a_word_of_a_million_letters_is_counted_in_seconds(spark):
    import time

    from tidewire.llm import toxicity

    word = "abcdefghij" * 100_000
    df = spark.createDataFrame([(1, word, 1), (2, "plain words here", 0)], "doc_id long, text string, toxic int")
    start = time.time()
    grams = {r["gram"]: (r["c0"], r["c1"]) for r in toxicity._gram_counts(toxicity.word_counts(df, "text", "toxic"), 4).collect()}
    assert time.time() - start < 60
    assert grams["abcd"] == (0, 100_000) and grams["jabc"] == (0, 99_999) and grams["\x02pla"] == (1, 0)


def test_rows_without_an_id_are_not_held_out(spark, tmp_path):
    from tests.llm.helpers import awkward, documents
    from tidewire.llm.queries import QUERIES

    documents(spark, awkward()).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name in ("op8_kneser_ney_toxicity", "op9_rank_order_language"):
        rows = QUERIES[name](spark, str(tmp_path)).collect()
        assert len(rows) == len(awkward()) and all(r["held_out"] is not None for r in rows)


def test_queries_run_from_a_foreign_directory(tmp_path):
    """Workers find nothing of this package on their path: whatever they need travels with the job."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = f"""
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config(
    "spark.checkpoint.dir", {str(tmp_path / 'shared')!r}).getOrCreate()
queries = entry.queries()
for name in sorted(n for n in queries if n.startswith("op")):
    print(name, queries[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.split("\n")) == 14
