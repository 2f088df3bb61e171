"""Answer log, ties, trims and the process cycle."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewire.operators import cycle, feed, media, scoring, state, stats

AT = datetime(2024, 1, 15, 12, tzinfo=timezone.utc)


class Counting:
    """A scorer that notes every call in a folder, one file each."""

    def __init__(self, folder, fails=()):
        self.folder, self.fails = str(folder), tuple(fails)

    def __call__(self, rows):
        import uuid

        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as note:
            note.write(",".join(r["id"] for r in rows))
        if any(r["id"] in self.fails for r in rows):
            raise RuntimeError("no answer")
        return json.dumps([{"id": r["id"], "score": len(r["text"])} for r in rows if not r["id"].endswith("9")])


def calls(folder):
    return sorted(i for f in folder.iterdir() for i in f.read_text().split(","))


def posts(spark, low, high, extra=""):
    return spark.range(low, high).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("text" + extra), "id").alias("text"))


def test_scorer_is_called_once_over_scores_failures_and_reruns(spark, tmp_path):
    notes, log = tmp_path / "calls", str(tmp_path / "log")
    notes.mkdir()
    scorer = Counting(notes)
    for _ in range(2):
        answers = scoring.logged_answers(posts(spark, 0, 40), scorer, log, batch_size=7)
        scored = sorted(r["id"] for r in scoring.normalize_scores(answers).collect())
        failed = sorted(i for r in scoring.score_failures(answers).collect() for i in r["ids"])
        assert scored + failed == sorted(map(str, range(40)), key=lambda i: (i.endswith("9"), i))
    assert calls(notes) == sorted(map(str, range(40)))
    # New posts alone are asked; an altered text is a new question.
    scoring.logged_answers(posts(spark, 20, 50), scorer, log, batch_size=7).collect()
    assert calls(notes) == sorted(map(str, range(50)))
    changed = scoring.logged_answers(posts(spark, 0, 3, "!"), scorer, log).collect()
    assert len(calls(notes)) == 53 and sorted(i for r in changed for i in r["ids"]) == ["0", "1", "2"]


def test_failed_calls_are_asked_again(spark, tmp_path):
    notes, log = tmp_path / "calls", str(tmp_path / "log")
    notes.mkdir()
    asked = posts(spark, 1, 9).coalesce(1)
    first = scoring.logged_answers(asked, Counting(notes, fails=["2"]), log, batch_size=100)
    assert [r["error"] for r in first.collect()] == ["RuntimeError: no answer"] * first.count()
    again = scoring.logged_answers(asked, Counting(notes), log, batch_size=100)
    assert scoring.score_failures(again).count() == 0 and scoring.normalize_scores(again).count() == 8


def test_rows_of_one_time_are_ordered(spark):
    rows = [(f"p{i % 10}", AT, i, f"v{i}", None if i % 3 else f"w{i}") for i in range(300)]
    log = spark.createDataFrame(rows, "id string, at timestamp, seq long, a string, b string").repartition(7)
    want = {f"p{k}": f"v{max(i for i in range(300) if i % 10 == k)}" for k in range(10)}
    assert {r["id"]: r["a"] for r in state.latest_scores(log, "at").collect()} == want
    seen = {f"p{k}": f"w{max(i for i in range(300) if i % 10 == k and i % 3 == 0)}" for k in range(10)}
    assert {r["id"]: r["b"] for r in state.apply_enrichment(log).collect()} == seen
    article = log.select("id", "at", "seq", F.col("a").alias("short_summary"), F.col("b").alias("top_visual"), F.lit(True).alias("set_top_visual"))
    found = {r["id"]: (r["short_summary"], r["top_visual"]) for r in state.apply_article(article).collect()}
    assert found == {k: (v, next((f"w{i}" for i in [int(v[1:])] if i % 3 == 0), None)) for k, v in want.items()}
    fetched = log.select(F.col("id").alias("endpoint"), F.col("at").alias("executed_at"), "seq", "a")
    assert {r["endpoint"]: r["a"] for r in feed.last_fetch(fetched).collect()} == want
    # Without a place in the log the choice is by content: the same whatever the order of rows.
    bare = log.drop("seq")
    picks = [sorted(map(tuple, state.latest_scores(bare.repartition(n), "at").collect())) for n in (1, 5)]
    assert picks[0] == picks[1]


def test_golden_takes_the_last_result(spark):
    expected = "struct<score_min:double,score_max:double,surprise:int,is_stale_repeat:boolean,playbook_trigger:string,catalyst:string,direction:string>"
    golden = spark.createDataFrame([(f"g{i}", (5.0, 6.0, 0, False, None, None, "na")) for i in range(20)], f"id string, expected {expected}")
    rows = [(f"g{i}", n, 5.5 if n == 3 else 1.0, 0, False, None, None, "na") for i in range(20) for n in range(4)]
    results = spark.createDataFrame(rows, "id string, seq long, score double, surprise int, is_stale_repeat boolean, playbook_trigger string, catalyst_status string, direction string")
    report = stats.golden_eval(golden, results.repartition(5)).first()
    assert report["band_accuracy"] == 1.0 and report["total"] == 20


def test_media_keys_are_trimmed_of_all_white_space(spark):
    log = spark.createDataFrame(
        [("\thttps://a/1.jpg\n", " Gemini\t", "Vision \r\n", "first", False, AT), ("https://a/1.jpg", "gemini", "vision", "second", False, AT + timedelta(1)),
         ("https://a/1.jpg\x0b", "gemini", "vision", None, True, AT)],
        "media_url string, provider string, model string, result string, is_hit boolean, updated_at timestamp")
    latest = media.cache_latest(log).collect()
    assert [(r["media_url"], r["provider"], r["model"], r["result"], r["hits"]) for r in latest] == [("https://a/1.jpg", "gemini", "vision", "second", 1)]
    pending = spark.createDataFrame([("p", 0, "\nhttps://a/1.jpg "), ("p", 1, " https://a/2.jpg\t")], "id string, pos int, url string")
    assert [r["cached"] for r in media.cache_lookup(pending, media.cache_latest(log), "gemini ", "\tvision").orderBy("pos").collect()] == ["second", None]
    assert [r["url"] for r in media.cache_misses(pending, media.cache_latest(log), "gemini", "vision").collect()] == ["https://a/2.jpg"]


@pytest.fixture
def small_feed(spark):
    link = "array<struct<url:string,expanded_url:string,display_url:string>>"
    schema = f"""id string, author_handle string, content string, created_at timestamp, processed_at timestamp, has_quote boolean, quote_id string,
      reply_id string, links {link}, has_media boolean, media_items array<struct<url:string,kind:string,prose_text:string,short_description:string>>,
      is_article boolean, article_title string, article_preview string, article_text string, content_summary string, analysis string, article_processed_at timestamp"""

    def post(i, content, done=False, quote=None, reply=None, links=()):
        return (i, "a", content, AT, AT if done else None, quote is not None, quote, reply, list(links), False, None, False, None, None, None, None, None, None)

    rows = [
        post("1", "one", quote="2"), post("2", "two two"), post("3", "three", done=True), post("4", "four", reply="3"),
        post("5", "five", links=[("https://t.co/x", "https://t.co/x", "")]), post("6", "six is reached through the map"), post("7", "seven, not asked for"),
    ]
    return spark.createDataFrame(rows, schema)


def test_cycle_follows_quotes_replies_and_resolved_links(spark, tmp_path, small_feed):
    notes = tmp_path / "calls"
    notes.mkdir()
    queue = small_feed.where("id in ('1', '4', '5')").select("id")
    authors = spark.createDataFrame([("a", 1, "macro", 8.4)], "handle string, tier int, category string, avg_score double")
    url_map = spark.createDataFrame([("https://t.co/x", "https://x.com/u/status/6")], "url string, target string")
    done = cycle.process_cycle(
        small_feed, queue, authors, url_map, Counting(notes), str(tmp_path / "log"), AT, alert_threshold=40, gate={"tz": "UTC"})
    assert calls(notes) == ["1", "2", "4", "5", "6"]
    scores = {r["id"]: r["score"] for r in done.scores.collect()}
    context = "\n\nDirect context:\n- "
    assert scores == {
        "1": len("one" + context + "Quoted tweet @a: two two"), "2": len("two two"), "4": len("four" + context + "Reply parent @a: three"),
        "5": len("five" + context + "Context @a: six is reached through the map"), "6": len("six is reached through the map"),
    }
    assert done.failures.count() == 0
    assert {r["id"] for r in done.routing.collect()} == set(scores) and done.routing.where("needs_analysis").count() > 0
    assert {r["id"]: r["sent"] for r in done.alerts.collect()} == {i: True for i, n in scores.items() if n >= 40}
    # A second run asks nothing.
    cycle.process_cycle(small_feed, queue, authors, url_map, Counting(notes), str(tmp_path / "log"), AT).scores.collect()
    assert len(calls(notes)) == 5
