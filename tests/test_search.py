"""Stored search beside the scan: same rows and ranks, accents and phrases included."""

import pytest
from pyspark.sql import functions as F

from tidewire.operators import search
from tidewire.operators.search import Term

TEXTS = [
    "Café über alles, the of the of the", "cafe CAFÉ uber", "the of", "of the sea", "Ǆ ǆ ꙁ été ά Ά", "", None, "a-b_c 12 the",
    "the " * 3000 + "of the", "ḍạṭạ data ＡＢ",
]
SEARCHES = [
    dict(must=[Term("café")]), dict(should=[Term("of the"), Term("über", column="content")]), dict(must=[Term("ca", prefix=True)]),
    dict(must=[Term("the")], must_not=[Term("of the")]), dict(should=[Term("été"), Term("data"), Term("Ά")]),
    dict(must=[Term("of th", prefix=True)], order="score"), dict(must=[Term("nowhere")]), dict(should=[Term("!!"), Term("sea")]),
]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = [(str(i), t, None if i % 3 else "the sum", f"u{i}", "T1 X", float(i)) for i, t in enumerate(TEXTS)]
    posts = spark.createDataFrame(rows, "id string, content string, summary string, author_handle string, tickers_text string, score double")
    path = str(tmp_path_factory.mktemp("index") / "search")
    search.write_index(posts, path)
    return posts, path


@pytest.mark.parametrize("asked", SEARCHES, ids=str)
def test_stored_search_equals_the_scan(corpus, asked):
    posts, path = corpus
    kept = [F.col("id"), F.round("rank", 9)]
    scan = search.text_search(search.search_index(posts), **asked).select(*kept).collect()
    stored = search.stored_search(path, posts, **asked).select(*kept).collect()
    assert stored == scan
    assert bool(scan) == (asked != dict(must=[Term("nowhere")]))


def test_a_search_needs_a_term(corpus):
    with pytest.raises(ValueError):
        search.stored_search(corpus[1], corpus[0], must_not=[Term("the")])


def scanned(df):
    """Rows that the scans of postings gave out."""
    df.collect()
    total, open_ = 0, [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            open_.append(node.executedPlan())
        elif "QueryStage" in name:
            open_.append(node.plan())
        elif name.startswith("Scan parquet") and "places" in node.toString():
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return total


@pytest.fixture(scope="module")
def lengths(spark, tmp_path_factory):
    """Posts of all lengths, written in three parts and merged."""
    import random

    rng, rows = random.Random(3), []
    for i in range(600):
        # Longer posts use more different words, as texts do: what they hold of one word does not grow with them.
        size = int(2 ** rng.uniform(1, 9))
        rows.append((f"{i:05}", " ".join(f"w{rng.randrange(8 + 2 * size)}" for _ in range(size)), None, f"u{i % 7}", None, float(i % 10)))
    posts = spark.createDataFrame(rows, "id string, content string, summary string, author_handle string, tickers_text string, score double")
    path = str(tmp_path_factory.mktemp("lengths"))
    for part in range(3):
        search.write_index(posts.where(f"CAST(id AS INT) % 3 = {part}"), f"{path}/parts")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "50")
    search.merge_index(spark, f"{path}/parts", f"{path}/whole")
    spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    return posts, path


@pytest.mark.parametrize("asked", [
    dict(should=[Term("w1")]), dict(should=[Term("w1"), Term("w2", column="content")]), dict(must=[Term("w3"), Term("u3")]),
    dict(must=[Term("w1")], must_not=[Term("w2")]), dict(should=[Term("nowhere")]), dict(should=[Term("w5"), Term("w6")], min_score=7),
    dict(should=[Term("w1 w2")]), dict(must=[Term("w", prefix=True)]), dict(should=[Term("w1")], limit=2000),
], ids=str)
def test_top_search_equals_the_whole_one(lengths, asked):
    posts, path = lengths
    asked = {"limit": 10} | asked
    kept = [F.col("id"), F.round("rank", 9)]
    want = search.text_search(search.search_index(posts), **asked).select(*kept).collect()
    for part in ("parts", "whole"):
        assert search.top_search(f"{path}/{part}", posts, **asked).select(*kept).collect() == want


def test_top_search_reads_less(lengths):
    posts, path = lengths
    whole = search.stored_search(f"{path}/whole", posts, should=[Term("w1")], limit=10).select("id", "rank")
    top = search.top_search(f"{path}/whole", posts, should=[Term("w1")], limit=10).select("id", "rank")
    assert scanned(top) < scanned(whole) and top.collect() == whole.collect()
    shelves = search._shelf_bounds(f"{path}/whole", posts.sparkSession, [Term("w1")])
    read = search._shelves_to_read(shelves, 10, lambda some: search.stored_search(f"{path}/whole", posts, should=[Term("w1")], limit=10, shelves=some))
    assert len(read) < len(shelves)


def test_postings_are_grouped_within_posts(spark, lengths):
    """No shuffle of words before the files' own: repeated words of a post meet in its row; repeated ids still merge."""
    posts, _ = lengths
    index = search.search_index(posts)
    grouped = search._grouped(index)
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()

    def by_force(rows):
        want = {}
        for r in rows:
            for number, name in enumerate(search.TEXT_COLUMNS):
                for at, word in enumerate(r[f"t_{name}"]):
                    want.setdefault((word, name, r["id"], r["n_tokens"]), []).append(number * search.FIELD_ROOM + at)
        return {k: sorted(v) for k, v in want.items()}

    def plain(df):
        rows = df.collect()
        assert all(r["shelf"] is not None for r in rows)
        made = {(r["term"], r["field"], r["id"], r["n_tokens"]): r["places"] for r in rows}
        assert len(made) == len(rows)
        return made

    want = by_force(index.collect())
    assert plain(grouped) == want
    assert grouped.agg(F.sum("tf")).first()[0] == index.agg(F.sum("n_tokens")).first()[0]
    twice = posts.unionByName(posts.where("score > 5")).unionByName(posts.limit(3).withColumn("id", F.lit(None).cast("string")))
    assert plain(search.postings(twice)) == by_force(search.search_index(twice).collect())
    assert search.postings(posts.limit(0)).count() == 0


def test_index_of_repeated_ids_equals_its_postings(spark, lengths, tmp_path):
    posts, _ = lengths
    twice = posts.unionByName(posts.where("score > 5"))
    search.write_index(twice, str(tmp_path / "twice"))
    search.write_index(posts.limit(0), str(tmp_path / "none"))
    read = lambda part: spark.read.parquet(str(tmp_path / "twice" / part))
    stored, made = read("postings").drop("write"), search.postings(twice)
    assert stored.columns == made.columns
    assert "Exchange" not in search._bounds(stored)._jdf.queryExecution().executedPlan().toString()
    assert stored.exceptAll(made).isEmpty() and made.exceptAll(stored).isEmpty()
    size = search.search_index(twice).agg(F.count(F.lit(1)), F.sum("n_tokens")).first()
    assert tuple(read("totals").first()) == tuple(size)
    most = made.groupBy("term", "shelf", "id").agg(F.sum(F.size("places")).alias("tf")).groupBy("term", "shelf").agg(F.max("tf"), F.count(F.lit(1)))
    found = read("bounds").where("field IS NULL").groupBy("term", "shelf").agg(F.max("most"), F.sum("posts"))
    assert found.exceptAll(most).isEmpty() and most.exceptAll(found).isEmpty()
    assert tuple(spark.read.parquet(str(tmp_path / "none" / "totals")).first()) == (0, 0)
