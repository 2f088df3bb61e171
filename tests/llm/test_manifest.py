"""Merkle manifest and multiproofs against a plain walk."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, documents
from tidewire.llm import manifest
from tidewire.llm.queries import QUERIES


def h(text):
    return sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def proof_of(levels, at):
    found = []
    for level in levels[:-1]:
        start = at // 3 * 3
        found += [(start + i < at, x) for i, x in enumerate(level[start : start + 3]) if start + i != at]
        found.append(None)
        at //= 3
    return found


def by_force(rows):
    """The contract of the manifest query, one document after another."""
    def leaf(r, text):
        return h("".join(map(field, (r[0], r[3], r[2], r[4], text))))

    groups = {}
    for r in rows:
        altered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
        groups.setdefault(r[3], []).append((r, leaf(r, r[1]), leaf(r, r[1].replace("\n", "") if altered else r[1])))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        groups[source].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[source] = levels_of([x[1] for x in groups[source]])
    top = levels_of([trees[s][-1][0] for s in order])
    found = []
    for n, source in enumerate(order):
        for at, (r, own, claim) in enumerate(groups[source]):
            proof, folded = proof_of(trees[source], at) + proof_of(top, n), claim
            left, right = "", ""
            for sibling in proof:
                if sibling is None:
                    folded, left, right = h(left + folded + right), "", ""
                elif sibling[0]:
                    left += sibling[1]
                else:
                    right += sibling[1]
            digest = h("".join(s[1] for s in proof if s))
            found.append((r[0], own, trees[source][-1][0], top[-1][0], digest, folded, folded == top[-1][0]))
    return sorted(found, key=str)


def run(spark, tmp_path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, leaf string, _key string"
    spark.createDataFrame([(*r, "x", "y") for r in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    return [tuple(r) for r in QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).collect()]


@pytest.mark.parametrize("sources", [1, 3, 40])
def test_manifest_by_force(spark, tmp_path, sources):
    random.seed(sources)
    rows = [(i, random.choice(["a\nb", "a", None, "", "\n\n é 漢"]) , random.choice(["en", None]),
             "hot" if random.random() < 0.4 else random.choice([None, "", *(f"s{k}é" for k in range(sources))]), None if i % 7 else i)
            for i in random.sample(range(10_000), 500)]
    rows += rows[:20] + [(None, "x\ny", None, None, 1), (None, "x", "en", "hot", None)]
    assert sorted(run(spark, tmp_path, rows), key=str) == by_force(rows)


def test_awkward_and_empty(spark, tmp_path):
    rows = [tuple(r)[:5] for r in documents(spark, awkward()).collect()]
    assert sorted(run(spark, tmp_path / "a", rows), key=str) == by_force(rows)
    assert run(spark, tmp_path / "b", []) == []


def test_small_tasks_and_real_proofs(spark):
    """Partitions and rounds of a few leaves, arity 2: the proofs themselves lead to the root."""
    df = spark.range(300).select(F.col("id"), F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 11).cast("string")).alias("g"))
    leaf = manifest.leaf_of(F.col("id"))
    found = manifest.prove(df, leaf, leaf, F.col("g"), F.col("id"), {"id": F.col("id")}, arity=2, leaves_of_task=16, span=2, with_proof=True).collect()
    assert len(found) == 300 and all(r["verified"] for r in found) and len({r["root"] for r in found}) == 1
    assert all(len(r["proof"]) % 64 == 0 and h(r["proof"]) == r["proof_sha256"] for r in found)


def test_multiproof_is_least_and_enough():
    random.seed(1)
    for size in (1, 2, 3, 4, 9, 10, 28, 100):
        levels = [[bytes.fromhex(x) for x in level] for level in levels_of([h(str(i)) for i in range(size)])]
        for _ in range(10):
            some = sorted(random.sample(range(size), random.randint(1, size)))
            needed = manifest.missing(np.array(some), size)
            known = [{} for _ in levels]
            known[0] = {i: levels[0][i] for i in some}
            for level, numbers in enumerate(needed):
                known[level].update({int(n): levels[level][n] for n in numbers})
            derivable = [dict(x) for x in known]
            manifest.derive(derivable, size)
            assert derivable[-1][0] == levels[-1][0]
            # Without any one of them the root cannot be had.
            for level, numbers in enumerate(needed):
                for n in numbers.tolist():
                    less = [dict(x) for x in known]
                    del less[level][n]
                    manifest.derive(less, size)
                    assert 0 not in less[-1] or len(levels) == 1
