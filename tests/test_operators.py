"""Single operators on small hand-made rows, against truth tables or a brute-force walk."""

import html.entities
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewire.functions import times, urls
from tidewire.functions.text import fixed, let, looks_truncated, unescape_html
from tidewire.operators import alerts, feed, graph, matching, metrics, scoring, search, signals, skew, stats, usage


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_tiers_and_alert_truth_table(spark):
    tiers = [one(spark, scoring.signal_tier(F.lit(s)))[0] for s in (8.0, 7.9, 6.0, 5.9, 4.0, 3.9)]
    assert tiers == ["high_signal", "market_relevant", "market_relevant", "news", "news", "noise"]
    assert one(spark, scoring.signal_tier(F.lit(6.0), 5))[0] == "high_signal"
    none = F.lit(None).cast("string")
    rows = [
        (8.0, 0, none, none, True), (7.0, 2, none, none, True), (6.9, 2, none, none, False),
        (6.0, 0, F.lit("supercycle"), none, True), (5.9, 0, F.lit("supercycle"), none, False),
        (6.0, 0, none, F.lit("resolved"), True), (6.0, 0, none, F.lit("scheduled"), False),
    ]
    for score, surprise, trigger, status, want in rows:
        assert one(spark, alerts.should_alert(F.lit(score), F.lit(surprise), trigger, status))[0] is want


def test_signal_kind_and_materiality(spark):
    kind = lambda s, c, r: one(spark, signals.signal_kind(F.lit(s), F.lit(c), F.lit(r).cast("string")))[0]
    assert kind(2, "resolved", "ref") == "surprise"
    assert kind(1, "resolved", "ref") == "catalyst_resolved"
    assert kind(1, "scheduled", "ref") == "catalyst_scheduled"
    assert kind(1, "resolved", None) == "datapoint"
    level = lambda s, p: one(spark, signals.materiality(F.lit(s), F.lit(p).cast("string")))[0]
    assert [level(9.0, None), level(7.0, "x"), level(8.0, None), level(7.0, None)] == [3, 3, 2, 1]


def test_cost_example(spark):
    prices = spark.createDataFrame([("gemini", "m", 1.5, 7.5, 0.15)], "provider string, model string, input_per_million double, "
                                   "output_per_million double, cached_input_per_million double")
    calls = spark.createDataFrame([(1, " Gemini", "M-2026", 1_000_000, 100_000, 100_000, 100_000)],
                                  "attempt_id long, provider string, model string, input_tokens long, output_tokens long, "
                                  "reasoning_tokens long, cached_input_tokens long").withColumn("total_tokens", F.lit(0))
    assert usage.per_call_cost(calls, prices).first()["cost_usd"] == pytest.approx(2.865)


def test_time_ranges_and_dst_days(spark):
    now = datetime(2025, 1, 20, 12, tzinfo=timezone.utc)
    assert times.time_range(" 7D ", now) == (now - timedelta(days=7), None)
    assert times.time_range("2m", now) == (now - timedelta(days=60), None)
    day = datetime(2025, 1, 15, tzinfo=timezone.utc)
    assert times.time_range("2025-01-15", now) == (day, day + timedelta(days=1))
    assert times.time_range("2025-01-15..2025-01-20", now) == (day, datetime(2025, 1, 21, tzinfo=timezone.utc))
    assert times.time_range("nonsense", now) == (None, None)
    assert times.time_range("today", now) == (datetime(2025, 1, 17, 21, tzinfo=timezone.utc), None)
    start, end = times.et_day_bounds(F.lit("2025-03-09"))
    assert one(spark, ((F.unix_seconds(end) - F.unix_seconds(start)) / 3600).alias("h"))["h"] == 23


def test_links_of_a_post(spark):
    def links(text, media, post="9"):
        none = F.array().cast("array<struct<url:string,expanded_url:string,display_url:string>>")
        kinds = urls.link_kinds(F.lit(post), F.lit(text), none, F.lit(media))
        row = one(spark, urls.display_text(F.lit(text), kinds).alias("d"), urls.inline_links(kinds).alias("i"),
                  urls.external_links(kinds).alias("e"))
        return row["d"], [k["id"] for k in row["i"]], [k["url"] for k in row["e"]]

    assert links("look https://t.co/abc", True) == ("look", [], [])
    assert links("look https://t.co/abc", False) == ("look https://t.co/abc", [], ["https://t.co/abc"])
    assert links("own https://x.com/a/status/9 end", False) == ("own end", [], [])
    assert links("see https://twitter.com/i/web/status/12 and https://x.com/b/status/12", False) == ("see and", ["12"], [])
    assert links("read https://news.example.com/a, now", False)[2] == ["https://news.example.com/a"]


def test_text_edges(spark):
    row = one(spark, looks_truncated(F.lit("a… \n")).alias("a"), looks_truncated(F.lit("a.. .")).alias("b"),
              unescape_html(F.lit("&lt;b&gt; &amp;amp; &#8364; &notit; R&D")).alias("c"))
    assert tuple(row) == (True, False, "<b> &amp; € ¬it; R&D")


def test_lookup_with_a_hot_key_and_missing_keys(spark):
    keys = ["hot"] * 600 + [f"k{i}" for i in range(300)] + [None] * 100
    left = spark.createDataFrame(list(enumerate(keys)), "id long, key string")
    right = spark.createDataFrame([("hot", 1), ("k7", 2), ("unused", 3)], "key string, v long")
    got = {r["id"]: r["v"] for r in skew.lookup(left, right, "key").collect()}
    assert got == {i: {"hot": 1, "k7": 2}.get(k) for i, k in enumerate(keys)}
    assert skew.lookup(left, right, "key", "inner").count() == 601
    assert [r[0] for r in skew.hot_keys(left, "key", 0.1).collect()] == ["hot"]


def test_alert_gate_equals_a_plain_walk(spark):
    rng = random.Random(5)
    start = datetime(2024, 3, 9, 12, tzinfo=timezone.utc)
    rows = [
        (f"p{i}", rng.choice(["a", "a", "b"]), start + timedelta(minutes=rng.uniform(0, 5 * 24 * 60)), rng.choice([8.0, 9.0, 10.0]))
        for i in range(3000)
    ]
    df = spark.createDataFrame(rows, "id string, chat string, ts timestamp, score double")
    for quiet in ((23, 8), (0, 0)):
        sent, recent = {}, {}
        for post, chat, ts, score in sorted(rows, key=lambda r: (r[2], r[0])):
            log = [t for t in recent.get(chat, []) if t >= ts - timedelta(minutes=60)]
            asleep = (ts.hour >= quiet[0] or ts.hour < quiet[1]) if quiet[0] > quiet[1] else quiet[0] <= ts.hour < quiet[1]
            sent[post] = score >= 10 or (not asleep and len(log) < 10)
            recent[chat] = log + [ts] if sent[post] else log
        got = {r["id"]: r["sent"] for r in alerts.alert_gate(df, quiet=quiet).collect()}
        assert got == sent


def test_histogram_places_are_exact(spark):
    rng = random.Random(1)
    values = [round(rng.gauss(0, 1), 3) for _ in range(50_000)]
    rows = [("m", v) for v in values] + [("tiny", 3.0)]
    df = spark.createDataFrame(rows, "name string, value double").selectExpr(
        "name", "map('k', 'v') AS labels", "'histogram' AS type", "value", "current_timestamp() AS at")
    got = {r["key"]: r for r in metrics.metric_histograms(df).collect()}
    ordered = sorted(values)
    assert got["m{k=v}"]["p50"] == ordered[25_000]
    assert got["m{k=v}"]["p99"] == ordered[49_500]
    assert (got["tiny{k=v}"]["p50"], got["tiny{k=v}"]["p99"]) == (3.0, 3.0)


def test_rolled_histograms_in_parts(spark, tmp_path):
    rng = random.Random(6)
    keys = {
        "spread": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(3000)], "few": [float(rng.randint(-3, 3)) for _ in range(5000)],
        "odd": [float("inf"), -float("inf"), 0.0, -0.0, 5e-324, 1.7e308, -1.0, 1.0], "one": [2.5], "narrow": [1 + rng.random() / 1e6 for _ in range(4000)],
    }
    rows = [(k, v, i % 50) for k, values in keys.items() for i, v in enumerate(values)]
    events = spark.createDataFrame(rows, "name string, value double, h long").selectExpr(
        "name", "map() AS labels", "'histogram' AS type", "value", "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, h) AS at", "h")
    path = str(tmp_path / "rollup")
    for part in range(3):
        metrics.write_rollup(events.where(f"h % 3 = {part}"), path)
    for got in (metrics.stored_histograms(spark, path), metrics.metric_histograms(events)):
        found = {r["key"]: r for r in got.collect()}
        assert set(found) == set(keys)
        for k, values in keys.items():
            ordered, n = sorted(values), len(values)
            want = (n, ordered[0], ordered[-1], ordered[n // 2], ordered[min(int(0.99 * n), n - 1)])
            assert tuple(found[k][c] for c in ("count", "min", "max", "p50", "p99")) == want


def test_positions_prefer_exact_tickers(spark):
    instruments = spark.createDataFrame(
        [("AAA", "owned", ["t1"], 0), ("BBB", "watch_list", ["t1"], 1), ("CCC", "short", ["t2"], 2)],
        "ticker string, relationship string, themes array<string>, pos int")
    themes = spark.createDataFrame([("t1", "open", 0), ("t2", "closed", 1)], "id string, status string, pos int")
    posts = spark.createDataFrame([("1", ["ccc"], ["t1"]), ("2", [], ["t2", "t1"]), ("3", ["BBB"], []), ("4", [], ["t2"])],
                                  "id string, tickers array<string>, themes array<string>")
    got = {r["id"]: r["position"] for r in matching.match_positions(posts, instruments, themes).collect()}
    assert got == {"1": "CCC (short)", "2": "AAA (owned, t1)"}


def test_labels_of_any_length_match(spark):
    posts = spark.createDataFrame([("1", "cpi print", "x"), ("2", "fomc and cpi", ""), ("3", None, "the FOMC met")],
                                  "id string, summary string, content string").withColumn("catalyst_status", F.lit(None).cast("string"))
    calendar = spark.createDataFrame([("CPI", "cpi"), ("FOMC", "fomc")], "label string, type string").selectExpr(
        "label", "type", "'us' AS scope", "DATE'2024-01-01' AS date")
    want = {"1": "cpi:us:2024-01-01", "3": "fomc:us:2024-01-01"}
    got = matching.match_labelled_catalyst(posts, calendar).collect()
    assert {r["id"]: r["catalyst_ref"] for r in got} == want
    # A row that stands there twice is two candidates.
    twice = matching.match_labelled_catalyst(posts, calendar.unionByName(calendar.where("type = 'cpi'"))).collect()
    assert {r["id"] for r in twice} == {"3"}
    assert matching.match_labelled_catalyst(posts, calendar.where("false")).count() == 0


def test_two_rows_of_one_catalyst_are_ambiguous(spark):
    schema = "id string, date string, type string, instruments array<string>, themes array<string>"
    rows = [("a", "d", "t", ["A"], ["x"]), ("b", "d", "t", ["B"], ["x"]), ("b", "d", "t", ["C"], []), ("c", "d", "t", ["D"], [])]
    posts = spark.createDataFrame(
        [("1", ["A"], []), ("2", ["B", "C"], []), ("3", ["B"], []), ("4", ["Z"], ["x"]), ("5", ["D"], ["x"])],
        "id string, tickers array<string>, themes array<string>").withColumn("catalyst_status", F.lit("resolved"))

    def refs(catalysts):
        return {r["id"]: r["catalyst_ref"] for r in matching.match_resolved_catalyst(posts, catalysts).collect()}

    registry = spark.createDataFrame(rows, schema)
    assert refs(registry) == {"1": "a", "3": "b", "5": "c"}
    assert refs(registry.unionByName(registry.where("id = 'c'"))) == {"1": "a", "3": "b"}


def test_html_references_decode_as_html_defines(spark):
    names = sorted(html.entities.html5)
    texts = [f"a &{n} b" for n in names] + [f"&{n}tail &{n.rstrip(';')}= x" for n in names]
    texts += [f"&#{c}; &#x{c:x} &#X{c:X};z" for c in [*range(0, 0x180), 0x20AC, 0xD800, 0xFDD0, 0xFFFE, 0x1F600, 0x10FFFF, 0x110000, 10**12]]
    texts += ["", "no reference", "&", "&;", "&#;", "&#x;", "&#00065;", "&nosuchname; &ampamp;amp;", "&" * 50]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string").select("i", unescape_html(F.col("t")).alias("t"))
    got = dict(tuple(r) for r in df.collect())
    assert got.pop(-1) is None
    wrong = [(t, got[i], html.unescape(t)) for i, t in enumerate(texts) if got[i] != html.unescape(t)]
    assert not wrong, wrong[:5]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_decimals_round_by_their_exact_value(spark):
    rng = random.Random(3)
    values = [k / 8 for k in range(-40, 200)] + [k / 20 for k in range(400)] + [k / 200 for k in range(400)]
    values += [rng.uniform(0, 100) for _ in range(500)] + [0.0, 1e12, 123456.125]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", fixed(F.col("v"), 1).alias("one"), fixed(F.col("v"), 2).alias("two"))
    wrong = [tuple(r) for r in df.collect() if (r["one"], r["two"]) != (f"{r['v']:.1f}", f"{r['v']:.2f}")]
    assert not wrong, wrong[:5]


def test_replies_of_a_thread_share_one_budget(spark):
    edges = [("1", None), ("2", "1"), ("3", "1"), ("10", "1"), ("4", "2"), ("5", "3"), ("6", "5"), ("7", "6"), ("8", "9")]
    posts = spark.createDataFrame(edges, "id string, reply_id string")

    def ids(roots, **limits):
        found = graph.thread_replies(posts, spark.createDataFrame([(r,) for r in roots], "id string"), **limits)
        return [r["id"] for r in found.orderBy("depth", F.length("id"), "id").collect()]

    assert ids(["1"]) == ["2", "3", "10", "4", "5"]
    assert ids(["1", "2"]) == ["3", "4", "10", "5"]  # a root is never a reply
    assert ids(["1"], max_nodes=3) == ["2", "3", "10"]
    assert ids(["1"], depth=4, max_nodes=6) == ["2", "3", "10", "4", "5", "6"]
    assert ids(["9"], depth=0) == [] and ids(["404"]) == []


def test_hot_keys_fold_like_others(spark):
    rows = [("hot" if i % 3 else f"k{i % 50}", i, f"t{i}") for i in range(3000)] + [(None, 3000 + i, "x") for i in range(5)]
    df = spark.createDataFrame(rows, "key string, seq long, v string").repartition(7)
    fold = {"said": lambda states: F.flatten(states)}
    leaf = {"said": F.array("v"), "n": F.lit(1).cast("long")}
    for share in (None, 2.0):
        got = {r["key"]: (r["said"], r["n"]) for r in skew.tree_fold(df, "key", "seq", leaf, fold, {"n": F.sum}, (4, 8), share).collect()}
        want = {}
        for key, _, v in rows:
            want.setdefault(key, []).append(v)
        assert got == {k: (v, len(v)) for k, v in want.items()}


def test_quote_chain_stops_at_cycles(spark):
    links = "array<struct<url:string,expanded_url:string,display_url:string>>"
    posts = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "x"), ("s", "s")], "id string, quote_id string")
    posts = posts.selectExpr("*", "'' AS content", "true AS has_quote", "false AS has_media", f"CAST(array() AS {links}) AS links")
    got = {r["id"]: tuple(r)[1:] for r in graph.quote_chain(posts).collect()}
    assert got["a"] == ("b", "a", None) and got["c"] == ("d", "e", None) and got["s"] == (None, None, None)
    page = posts.where("id IN ('a', 'c')")
    assert {r["id"]: tuple(r)[1:] for r in graph.quote_chain(posts, page).collect()} == {k: got[k] for k in "ac"}


def test_failed_batches_leave_posts_unprocessed(spark):
    def scorer(rows):
        if any(r["id"] == "3" for r in rows):
            raise RuntimeError("no answer")
        return '```json\n[{"id": "%s", "score": 12, "surprise": 9, "direction": "up"' % rows[0]["id"]

    posts = spark.range(40).selectExpr("CAST(id AS STRING) AS id", "'text' AS text").coalesce(1)
    batches = scoring.score_batches(posts, scorer)
    failed = scoring.score_failures(batches).collect()
    assert len(failed) == 3  # one raised, two returned a list cut before its first object closed
    good = scoring.score_batches(posts, lambda rows: '{"items": [{"id": 7, "score": "6.5", "themes": "x", "catalyst": "maybe"}, {"id"')
    assert scoring.normalize_scores(good).count() == 0
    fine = scoring.score_batches(posts, lambda rows: '[{"id": 7, "score": "6.5", "themes": "x"}, {"id"')
    row = scoring.normalize_scores(fine).first()
    assert (row["id"], row["score"], row["categories"], row["direction"], row["themes"]) == ("7", 6.5, ["noise"], "na", [])


def test_golden_canary_is_left_out(spark):
    schema = ("id string, expected struct<score_min:double,score_max:double,surprise:int,is_stale_repeat:boolean,"
              "playbook_trigger:string,catalyst:string,direction:string>")
    golden = spark.createDataFrame([("1", (0.0, 5.0, 0, False, "vol_substitution", None, "na")),
                                    ("2", (5.0, 9.0, 1, False, "supercycle", None, "long"))], schema)
    results = spark.createDataFrame([("1", 3.0, 0, False, "supercycle", None, "na"), ("2", 9.5, 1, False, "supercycle", None, "long")],
                                    "id string, score double, surprise int, is_stale_repeat boolean, playbook_trigger string, "
                                    "catalyst_status string, direction string")
    row = stats.golden_eval(golden, results).first()
    assert (row["trigger_precision"], row["trigger_recall"], row["band_accuracy"], row["passed"]) == (1.0, 1.0, 0.5, False)


def test_bad_arguments_are_rejected(spark):
    posts = spark.createDataFrame([], "id string, created_at timestamp, score double, processed_at timestamp")
    with pytest.raises(ValueError):
        feed.feed(posts, order="oldest")
    with pytest.raises(ValueError):
        search.text_search(posts, must=[])


def test_let_binds_once(spark):
    assert one(spark, let(F.lit(3), lambda x: x * x + x))[0] == 12
