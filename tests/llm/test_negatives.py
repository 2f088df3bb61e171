"""Hard negatives against brute force, ties, copies and odd rows included."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import negatives
from tidewire.llm.queries import QUERIES, SQL

SCHEMA = "vec_id long, vector array<long>, label int, key string, ids string, v string, shelf int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "i", "v", 1) for r in rows], SCHEMA)


def by_force(rows, step, positives=5, wanted=10, low=30, high=90):
    rows = sorted({(i, tuple(v), l) for i, v, l in rows if None not in (i, v, l) and v and None not in v})
    found = []
    for i, v, own in rows:
        if i % step:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, l) for j, w, l in rows if j != i)
        for s, j, _ in [x for x in scored if x[2] == own][:positives]:
            inside = [x for x in scored if x[2] != own and low * -s <= 100 * -x[0] <= high * -s]
            found += [(i, j, n, x[1], -s, -x[0]) for n, x in enumerate(inside[:wanted], 1)]
    return sorted(found)


@pytest.mark.parametrize("kind", ["spread", "ties", "copies", "one"])
def test_by_force(spark, kind):
    random.seed(kind)
    dim = {"one": 1}.get(kind, 5)
    span = 2 if kind == "ties" else 60
    rows = [(i, [random.randint(-span, span) for _ in range(dim)], random.randint(0, 3)) for i in range(300)]
    if kind == "copies":
        rows = [(i, [9, 9, 9, 1, 1] if i % 3 == 0 else v, l) for i, v, l in rows] + rows[:30]
    rows += [(None, [1] * dim, 1), (901, None, 1), (902, [None] * dim, 1), (903, [1] * dim, None), (904, [], 1), (905, [1] * (dim + 1), 1)]
    expected = by_force([r for r in rows if r[0] != 905], 10)
    found = negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, sample=64, cell=8)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, found.collect())) == expected and (expected or kind == "none")


def test_empty_and_large_numbers(spark):
    assert negatives.mine(frame(spark, []), F.lit(True)).collect() == []
    # Scores beyond what doubles hold exactly.
    big = [(i, [2**29 + i * 7, 2**28 - i, 3], i % 2) for i in range(40)]
    assert sorted(map(tuple, negatives.mine(frame(spark, big), F.col("vec_id") % 10 == 0).collect())) == by_force(big, 10)
    # Beyond a long: such rows take no part.
    assert negatives.mine(frame(spark, [(0, [2**31, 2**31], 0), (1, [2**31, 1], 0)]), F.lit(True)).collect() == []


def test_cells_fall_and_cover():
    random.seed(3)
    v = np.array([[random.randint(-50, 50) for _ in range(6)] for _ in range(400)])
    books = [negatives.codebook(x.astype(float), 6) for x in negatives.halves(v)]
    (a, a_far), (b, b_far) = (negatives.nearest(x.astype(float), book) for x, book in zip(negatives.halves(v), books))
    radii = [np.array([far[own == i].max(initial=0) for i in range(len(book))]) for own, far, book in ((a, a_far, books[0]), (b, b_far, books[1]))]
    for q in v[:20]:
        scores = negatives.products(q[None, :], v)[0]
        for least, most in ((np.sort(scores)[-5], np.inf), (100, 900)):
            cells = set(negatives.wanted_cells(q.astype(float), books, radii, least, most))
            inside = np.flatnonzero((scores >= least) & (scores <= most))
            assert {int(c) for c in (a * len(books[1]) + b)[inside]} <= cells
    falling = [s for s, _, _ in negatives.falling_cells(np.array([3.0, 1.0, 2.0]), np.array([0.5, -4.0]))]
    assert len(falling) == 6 and falling == sorted(falling, reverse=True)


def test_query_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    columns = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    found = sorted(map(tuple, QUERIES["op13_hard_negatives"](spark, sf).collect()))
    assert found == sorted(con.execute(f"select {columns} from ({SQL['op13_hard_negatives']})").fetchall())
