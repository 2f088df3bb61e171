"""Which columns the plans of wide queries shuffle: long texts stay out of their exchanges."""

import hashlib
import random

from pyspark.sql import functions as F

from tidewire.operators import graph, merge
from tidewire.plans.feed_views import Feed


def write_tables(spark, folder):
    events = spark.range(60).selectExpr(
        "id AS event_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, CAST(id AS INT)) AS ts", "id % 7 AS user_id",
        "CASE WHEN id % 2 = 0 THEN 'click' ELSE 'view' END AS event_type", "CAST(id AS DOUBLE) AS value")
    events.unionByName(events.where("event_id % 10 = 0")).write.parquet(f"{folder}/events.parquet")
    spark.range(25).selectExpr("id AS doc_id", "concat('text ', id, '. more of it ', repeat('x', CAST(id AS INT) * 9)) AS text").write.parquet(
        f"{folder}/documents.parquet")
    return Feed(spark, str(folder))


def exchanged_above_texts(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Exchange" in plan[: plan.index("Join [_doc")]


def test_texts_join_last_with_the_rows_of_a_join_by_id(spark, tmp_path):
    t = write_tables(spark, tmp_path)
    assert not exchanged_above_texts(t.full_posts.select(F.md5("content")))
    assert not exchanged_above_texts(t.observations.select(F.md5("content")))
    by_id = t.posts.join(t.texts, "n")
    assert t.full_posts.columns == by_id.columns
    assert sorted(map(str, t.full_posts.collect())) == sorted(map(str, by_id.collect()))


def test_merge_reads_kept_texts_only(spark, tmp_path):
    t = write_tables(spark, tmp_path)
    plain, read = merge.merge_posts(t.observations), merge.merge_posts(t.observations, texts=t.observed_texts)
    assert sorted(map(str, plain.collect())) == sorted(map(str, read.collect()))


def test_context_takes_texts_after_the_joins(spark, tmp_path):
    t = write_tables(spark, tmp_path)
    no = F.lit(False)
    plain = graph.context_text(t.full_posts.withColumn("is_article", no))
    late = graph.context_text(t.paired_posts.withColumn("is_article", no), texts=t.with_texts)
    assert not exchanged_above_texts(late)
    assert sorted(map(str, plain.collect())) == sorted(map(str, late.collect()))


def test_first_sights_move_only_what_is_asked_for(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(str(rng.randrange(5)), i, f"said {i}") for i in range(40)], "id string, seq long, content string")
    found = merge.dedupe_first_seen(rows)
    assert all(r["content"] == f"said {r['seq']}" for r in found.collect())
    assert "content" not in found.select("id", "seq")._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]


def test_first_sights_are_whole_rows(spark, tmp_path):
    """The query gives every column of the first row, texts too, and one row per id where events and documents repeat."""
    from tidewire.plans import catalog

    write_tables(spark, tmp_path)
    doubled = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id < 5").collect()
    spark.createDataFrame(doubled, "doc_id long, text string").write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for r in sorted(Feed(spark, str(tmp_path)).observations.collect(), key=lambda r: r["seq"]):
        want.setdefault(r["id"], r)
    found = catalog.load()["dedupe_first_seen"].build(Feed(spark, str(tmp_path))).collect()
    assert len(found) == len(want)
    md5 = lambda text: None if text is None else hashlib.md5(text.encode()).hexdigest()
    for r in found:
        first = want[r["id"]]
        for name in ("seq", "author_handle", "source", "author_name", "created_at", "reply_id", "article_title", "original_content"):
            assert r[name] == first[name]
        assert (r["content"], r["article_text"]) == (md5(first["content"]), md5(first["article_text"]))
        assert r["media"] == (first["media_items"] and [m["url"] for m in first["media_items"]])
