"""Edge rows: text beside JSON, deep wrappers, bad scores, partial dates, hot keys."""

import pytest
from pyspark.sql import functions as F

from tidewire.functions import decode
from tidewire.functions.times import parse_timestamp
from tidewire.operators import graph, matching, scoring
from tidewire.operators.skew import lookup
from tidewire.sources import payloads


def value(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize("text, want", [
    ('["A", "B"]', ["A", "B"]), ('["A"], B', ['["A"]', "B"]), ('["A"] x', ['["A"] x']), ('["A"]]', ['["A"]]']),
    ("A, B", ["A", "B"]), ("", []), (None, []), ("[]", []), ('"a"} b', ['"a"} b']),
])
def test_lists_cover_the_whole_text(spark, text, want):
    assert value(spark, text, decode.json_list_or_csv) == want


@pytest.mark.parametrize("raw, scored", [
    ('3 results: [{"id": "1", "score": 5}]', ["1"]), ('5', []), ('"x" then [{"id": "1", "score": 5}]', ["1"]),
    ('Note [1]: [{"id": "1", "score": 5}, {"id": "2", "score": 6}]', ["1", "2"]), ("[1, 2]", []),
    ('[{"id": "1", "score": 5}] and that is all', ["1"]), ('{"items": [{"id": "2", "score": 1}]} done', ["2"]),
    ('[{"id": "1", "score": "high"}, {"id": "2", "score": 3}]', ["2"]), ('[{"id": "9", "score": 3}]', []),
    ('[{"id": "1", "score": 5, "surprise": 1000000000000}, {"id": "2"}]', ["1", "2"]),
])
def test_scores_and_failures_cover_every_id(spark, raw, scored):
    batches = spark.createDataFrame([(["1", "2"], raw, None)], "ids array<string>, raw string, error string")
    good = scoring.normalize_scores(batches).collect()
    assert sorted(r["id"] for r in good) == scored and all(0 <= r["surprise"] <= 2 for r in good)
    failed = [i for r in scoring.score_failures(batches).collect() for i in r["ids"]]
    assert sorted(failed + scored) == ["1", "2"]


def test_deep_payloads_are_posts_and_broken_ones_quarantine(spark, tmp_path):
    deep = "[" * 20 + '{"id": "9", "text": "t ]]] \\" [["}' + "]" * 20
    paged = '{"tweets": [' * 12 + '{"id": "8"}' + "]}" * 12
    lines = ['[[[[{"id": "1", "text": "t"}]]]]', '{"tweets": [{"id": "2"}, [{"id": "3"}]]}', '{"id": "4"} junk', "no json", deep, paged]
    (tmp_path / "in.txt").write_text("\n".join(lines))
    path = str(tmp_path / "in.txt")
    found = payloads.read_observations(spark, path)
    assert sorted(r["i"] for r in found.select(payloads.post_id(F.col("v")).alias("i")).collect()) == ["1", "2", "3", "8", "9"]
    assert sorted(r["value"] for r in payloads.read_quarantine(spark, path).collect()) == sorted(lines[2:4])


@pytest.mark.parametrize("text, known", [
    ("2024", False), ("12:30", False), ("2024-01", False), ("2024-01-02", True), ("2024-01-02T03:04:05Z", True), ("T12:00", False),
    ("Tue Jan 02 03:04:05 +0000 2024", True), ("", False), (None, False),
])
def test_times_need_a_date(spark, text, known):
    assert (value(spark, text, parse_timestamp) is not None) is known


@pytest.mark.parametrize("how, want", [
    ("left_semi", {"hot": 3000, "b": 1}), ("left_anti", {"c": 1, None: 2}), ("inner", {"hot": 3000, "b": 1}),
    ("left", {"hot": 3000, "b": 1, "c": 1, None: 2}),
])
def test_lookups_of_a_hot_key(spark, how, want):
    left = spark.createDataFrame([("hot", i) for i in range(3000)] + [("b", 1), ("c", 2), (None, 3), (None, 4)], "id string, n int")
    right = spark.createDataFrame([("hot",), ("b",), ("x",)] + ([("hot",)] if "left_" in how else []), "id string")
    rows = lookup(left, right, "id", how).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in rows} == want


def test_missing_dependencies_of_a_part(spark):
    links = "array<struct<url:string,expanded_url:string,display_url:string>>"
    posts = spark.createDataFrame([("1", "2", None), ("2", None, "7")], "id string, quote_id string, reply_id string")
    posts = posts.selectExpr(
        "*", "'' AS content", "quote_id IS NOT NULL AS has_quote", "false AS has_media", f"CAST(array() AS {links}) AS links",
        "CAST(null AS string) AS conversation_id", "CAST(null AS string) AS in_reply_to_id")
    assert {r["id"] for r in graph.missing_dependencies(posts).collect()} == {"7"}
    assert {r["id"] for r in graph.missing_dependencies(posts, posts.where("id = '1'")).collect()} == {"2", "7"}


def test_registry_of_any_size_keeps_order(spark):
    posts = spark.createDataFrame([("p", ["metals", "unknown", "energy"], ["tk1", "no", "tk0"]), ("q", [], [])], "id string, themes array<string>, tickers array<string>")
    themes = spark.createDataFrame([("energy",), ("metals",)], "id string")
    for size in (2, 1500):
        instruments = spark.range(size).selectExpr("concat('TK', id) AS ticker")
        got = {r["id"]: (r["themes"], r["instruments"]) for r in matching.registry_validate(posts, themes, instruments).collect()}
        assert got == {"p": (["metals", "energy"], ["TK1", "TK0"]), "q": ([], [])}
