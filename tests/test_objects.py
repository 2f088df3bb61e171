"""Objects of large lists read by many tasks, against Python's own reader."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewire.sources import objects, payloads

AWKWARD = ['plain', 'a } b { c', '"quoted" \\\\ } ]', '[[', ']]', '"tweets": [', 'é 漢 🙂 }', '\\', '}' * 30, '']


def thing(rng, number):
    inner = {"id": str(number), "text": rng.choice(AWKWARD) * rng.randint(1, 4), "n": {"a": [1, {"b": rng.choice(AWKWARD)}], "e": {}}}
    if rng.random() < 0.2:
        inner["user"] = {"tweets": [{"id": "inner"}], "x": "}"}
    return inner


def wrapped(rng, things):
    """Things in lists and pages at random depth, whose order stays."""
    out = []
    while things:
        take = rng.randint(1, 4)
        part, things = things[:take], things[take:]
        kind = rng.random()
        if kind < 0.5 or len(things) > 60:
            out += part
        elif kind < 0.7:
            out.append(wrapped(rng, part[:1]) + part[1:])
        else:
            head = {"meta": {"id": "page", "s": "}"}} if rng.random() < 0.5 else {}
            out.append({**head, "tweets": part, "cursor": {"id": "no", "t": rng.choice(AWKWARD)}})
    return out


@pytest.fixture
def small_blocks(spark):
    for key, value in (("spark.sql.files.maxPartitionBytes", "1500"), ("spark.sql.files.openCostInBytes", "100")):
        spark.conf.set(key, value)
    yield
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(key)


@pytest.mark.parametrize("seed", range(4))
def test_objects_of_cut_files(spark, tmp_path, small_blocks, seed):
    rng, want = random.Random(seed), []
    for number in range(3):
        things = [thing(rng, 1000 * number + i) for i in range((120, rng.choice([0, 1, 60]), 120)[number])]
        want += things
        body = wrapped(rng, things)
        text = json.dumps(body, indent=rng.choice([None, 1]), ensure_ascii=bool(number))
        if number == 1:
            text = json.dumps({"next": "}", "tweets": body, "end": [{"id": "no"}]}, indent=2)
        (tmp_path / f"{number}.json").write_text(text + rng.choice(["", "\n", "  "]))
    (tmp_path / "lines.json").write_text('{"id": "l1"}\n{"id": "l2", "t": "}"}')
    want += [{"id": "l1"}, {"id": "l2", "t": "}"}]
    rows = objects.read_objects(spark, str(tmp_path))
    found = rows.collect()
    assert all(r["whole"] for r in found), [r for r in found if not r["whole"]][:3]
    assert sorted((json.loads(r["value"]) for r in found), key=str) == sorted(want, key=str)
    assert objects._fragments(spark, str(tmp_path)).select("file", "block").distinct().count() > 20


def test_broken_files(spark, tmp_path, small_blocks):
    (tmp_path / "cut.json").write_text('[{"id": "1"}, {"id": "2", "text": "' + "x" * 4000)
    (tmp_path / "junk.json").write_text('{"id": "3"} junk ]\n"text"')
    (tmp_path / "bad.json").write_text('[{"id": "4"}, {"id": tru}, 5, "}", null]')
    (tmp_path / "open.json").write_text('{"tweets": [{"id": "5"}')
    (tmp_path / "empty.json").write_text("")
    path = str(tmp_path)
    ids = payloads.read_observations(spark, path, whole_files=True).select(payloads.post_id(F.col("v")).alias("i"))
    assert sorted(r["i"] for r in ids.collect()) == ["1", "3", "4", "5"]
    broken = {r["value"] for r in payloads.read_quarantine(spark, path, whole_files=True).collect()}
    assert {"junk", "]", '"text"', '{"id": tru}', "{["} <= broken
    assert any(b.startswith('{"id": "2"') for b in broken) and len(broken) == 6


def test_one_object_over_many_blocks(spark, tmp_path, small_blocks):
    big = {"id": "1", "parts": [{"t": "} ] [ {" * 20, "n": i} for i in range(200)]}
    (tmp_path / "big.json").write_text(json.dumps([big, {"id": "2"}, big]))
    rows = objects.read_objects(spark, str(tmp_path)).collect()
    assert sorted((json.loads(r["value"])["id"] for r in rows)) == ["1", "1", "2"]
    assert [json.loads(r["value"]) for r in rows if r["value"].startswith('{"id": "1"')] == [big, big]


def test_packed_file(spark, tmp_path):
    import gzip

    for name, text in (("a", '[{"id": "1"}, {"id": "2"}]\n'), ("b", '{"tweets": [{"id": "3"}]}'), ("c", '{"id": "4"}')):
        (tmp_path / f"{name}.json.gz").write_bytes(gzip.compress(text.encode()))
    rows = objects.read_objects(spark, str(tmp_path)).collect()
    assert sorted(json.loads(r["value"])["id"] for r in rows if r["whole"]) == ["1", "2", "3", "4"] and all(r["whole"] for r in rows)


def test_whole_files_are_walked_once(spark, tmp_path):
    """Files of one block need no report of how they begin and have no pieces that cross: nothing is shuffled."""
    import gzip

    (tmp_path / "a.json").write_text('[{"id": "1"}, {"id": "2", "t": "}"}]')
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(b'{"tweets": [{"id": "3"}, {"id": "4", "t": "cut'))
    rows = objects.read_objects(spark, str(tmp_path))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    found = {(r["value"], r["whole"]) for r in rows.collect()}
    want = {('{"id": "1"}', True), ('{"id": "2", "t": "}"}', True), ('{"id": "3"}', True), ('{"id": "4", "t": "cut', False)}
    assert found == want
    quarantine = payloads.read_quarantine(spark, str(tmp_path), whole_files=True)
    # Each file is read once, for both kinds of broken records.
    assert quarantine._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    assert [r["value"] for r in quarantine.collect()] == ['{"id": "4", "t": "cut']


@pytest.mark.parametrize("told", [10_000, -1])
def test_packed_files_beside_cut_ones(spark, tmp_path, small_blocks, monkeypatch, told):
    """Blocks of open files keep their begins whatever other files lie beside them, told by broadcast or by a join."""
    import gzip

    monkeypatch.setattr(objects, "BROADCAST_ROWS", told)
    rng = random.Random(5)
    things = [thing(rng, i) for i in range(300)]
    (tmp_path / "open.json").write_text(json.dumps(wrapped(rng, things[:100]), indent=1))
    (tmp_path / "short.json").write_text(json.dumps(things[100:101]))
    for n in range(3):
        (tmp_path / f"{n}.json.gz").write_bytes(gzip.compress(json.dumps(things[101 + n * 60 : 161 + n * 60]).encode()))
    found = objects.read_objects(spark, str(tmp_path)).collect()
    assert all(r["whole"] for r in found)
    assert sorted((json.loads(r["value"]) for r in found), key=str) == sorted(things[:281], key=str)


def reference_walk(text, in_string):
    """Brackets outside of strings, one byte after another."""
    out, at = [], 0
    while at < len(text):
        sign = text[at : at + 1]
        if in_string and sign == b"\\":
            at += 1
        elif sign == b'"':
            in_string = not in_string
        elif not in_string and sign in (b"{", b"}", b"[", b"]"):
            out.append((at, ord(sign)))
        at += 1
    return out, in_string


@pytest.mark.parametrize("in_string", [False, True])
def test_signs_equal_a_plain_walk(in_string):
    rng = random.Random(1)
    for _ in range(3000):
        parts = [b"{", b"}", b"[", b"]", b'"', b"\\", b'\\"', b'\\\\"', b"a", b" ", b'"tweets": [']
        text = b"".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))
        places, signs, _, after = objects.Signs(text).outside(in_string)
        plain = [ord("[") if s == ord("T") else s for s in signs]
        # A backslash at the very end takes the brace that follows every stretch.
        assert (list(zip(places, plain)), after) == reference_walk(text, in_string)


def test_lists_of_packed_files(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    from tests.test_moved_texts import write_tables
    from tidewire.plans import merge_queries

    monkeypatch.setattr(merge_queries, "_LIST", 4)
    texts = [f'{{"id": {n}}},' for n in range(22)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[a:b], pa.string())], ["value"]) for a, b in ((0, 3), (3, 13), (13, 13), (13, 22))]
    lines = [x for b in merge_queries._listed(iter(batches)) for x in b.column(0).to_pylist()]
    lists = [json.loads("\n".join(lines[a : a + 6])) for a in range(0, len(lines), 6)]
    assert [x["id"] for part in lists for x in part[:-1]] == list(range(22)) and [len(part) for part in lists] == [5] * 5 + [3]
    monkeypatch.undo()
    folder = merge_queries._array_files(write_tables(spark, tmp_path)).removeprefix("file:")
    import os

    files = [f for f in os.listdir(folder) if f.startswith("part-")]
    assert files and all(f.endswith(".gz") for f in files)
