"""Hard negatives through an inverted multi-index.

Vectors are cut in two halves, each half has its own codebook, and a pair of codewords is a cell. No vector of a cell
scores more with a query than the sum of its halves' bounds: codeword product plus query length times the codeword's
radius. A heap over the two sorted lists of half-scores gives the cells in falling order of that sum. A search stops
where the next cell cannot hold anything better than what a bounded sample of the rows has already shown to exist, so
what it returns is exact. Cells are laid end to end over shelves of bounded size; a task compares the queries that ask
for a shelf with the vectors on it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import checkpointed
from tidewire.operators.skew import lookup

# Distinct vectors the codebooks are fitted on and the stopping scores are taken from, at most.
SAMPLE = 8_192
# Codewords of a half, at most; vectors a cell holds about; components on a shelf; queries that meet a shelf at once.
MOST_WORDS = 64
CELL = 64
SHELF_COMPONENTS = 1 << 21
SHELF_QUERIES = 2_048
# Squared lengths from here on could give scores beyond a long.
LIMIT = float(1 << 62)


def codebook(x: np.ndarray, words: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Means of ``words`` groups of near rows."""
    if not x.shape[1]:
        return np.zeros((1, 0))
    x = np.unique(x, axis=0)
    words = max(1, min(words, len(x)))
    book = x[np.random.default_rng(seed).choice(len(x), words, replace=False)]
    for _ in range(rounds):
        own, _ = nearest(x, book)
        sums = np.zeros_like(book)
        np.add.at(sums, own, x)
        sizes = np.bincount(own, minlength=words)
        book = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], book)
    return book


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword of each row and its distance, never less than the true one."""
    own = np.zeros(len(x), np.int64)
    for start in range(0, len(x), 4096):
        part = x[start : start + 4096]
        own[start : start + 4096] = np.argmin((book**2).sum(axis=1) - 2 * part @ book.T, axis=1)
    return own, np.sqrt(((x - book[own]) ** 2).sum(axis=1)) * (1 + 1e-9)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]


def half_scores(q: np.ndarray, books: list, radii: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each half the middle of each codeword's scores and how far a member's score may lie from it."""
    found = []
    for part, book, radius in zip(halves(q[None, :]), books, radii):
        middle = book @ part[0]
        # Rounding of doubles stays far below this.
        slack = 1 + 1e-9 * np.abs(middle)
        found.append((middle, np.sqrt((part**2).sum()) * (1 + 1e-9) * radius + slack))
    return found


def falling_cells(first: np.ndarray, second: np.ndarray):
    """(sum, i, j) of all pairs by falling sum: a heap over two sorted lists, a pair pushed when the one before it goes."""
    one, two = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap = [(-(first[one[0]] + second[two[0]]), 0, 0)]
    while heap:
        score, i, j = heapq.heappop(heap)
        yield -score, int(one[i]), int(two[j])
        if j + 1 < len(two):
            heapq.heappush(heap, (-(first[one[i]] + second[two[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(one):
            heapq.heappush(heap, (-(first[one[i + 1]] + second[two[0]]), i + 1, 0))


def wanted_cells(q: np.ndarray, books: list, radii: list, least: float, most: float) -> list[int]:
    """Cells that may hold a score from ``least`` to ``most``: the walk ends at the first sum below ``least``."""
    (a, a_far), (b, b_far) = half_scores(q, books, radii)
    found = []
    for bound, i, j in falling_cells(a + a_far, b + b_far):
        if bound < least:
            break
        if a[i] - a_far[i] + b[j] - b_far[j] <= most:
            found.append(i * len(b) + j)
    return found


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; doubles where they hold them exactly."""
    largest = max((np.abs(x.astype(np.float64)).max(initial=0) for x in (q, v)))
    if largest**2 * max(v.shape[1], 1) < 1 << 52:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def first_rows(scores: np.ndarray, ids: list[np.ndarray], rows: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The first ``k`` (score, id) of these rows, each of which stands for some ids: higher scores, then smaller ids."""
    if len(rows) > k:
        least = np.partition(scores[rows], len(rows) - k)[len(rows) - k]
        rows = rows[scores[rows] >= least]
    found = sorted((-int(scores[r]), int(i)) for r in rows.tolist() for i in ids[r])
    return [(-s, i) for s, i in found[:k]]


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest whole ``n`` with low * score <= 100 * n <= high * score."""
    return -(-low * score // 100), high * score // 100


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), -1)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def mine(df: DataFrame, anchor: Column, positives: int = 5, wanted: int = 10, low: int = 30, high: int = 90,
         vec_id: str = "vec_id", vector: str = "vector", label: str = "label", sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """(anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score).

    ``vector`` holds whole numbers; a score is the inner product. For each row that ``anchor`` holds for, its positives
    are its first ``positives`` other rows of the same label, and for each of them the first ``wanted`` rows of another
    label with low * positive_score <= 100 * negative_score <= high * positive_score are returned: higher scores first,
    ties to smaller ids. Rows equal in id, label and vector count once; rows that share an id alone are rows of their own,
    but for the anchor itself: rows with its id are none of its positives. Rows with a null id, label or vector, a null
    component, no components, another length than most (ties: the shorter) or a squared length of 2**62 or more take no part.
    Copies of a vector under one label meet once, with their smallest ids, as many as can be returned. An empty table
    gives no rows. Codebooks and stopping scores come from at most ``sample`` vectors; every row is indexed, and what is
    returned is exact.
    """
    spark = df.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    whole = F.col(vector).cast("array<long>")
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("v"), anchor.alias("asks"))
    rows = rows.where("id is not null and label is not null and v is not null").where(F.forall("v", lambda x: x.isNotNull()))
    rows = rows.where((length < LIMIT) & (F.size("v") > 0))
    common = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common["dim"]
    named = F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.array_join("v", ",")), 256)
    rows = rows.where(F.size("v") == dim).withColumn("key", named)
    keep = max(positives + 1, wanted)
    once = rows.groupBy("key", "id").agg(F.any_value("label").alias("label"), F.any_value("v").alias("v"), F.max("asks").alias("asks"))
    once = checkpointed(once)
    least = once.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("_n") <= keep)
    classes = checkpointed(least.groupBy("key").agg(
        F.any_value("label").alias("label"), F.any_value("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids")
    ))
    anchors = checkpointed(once.where("asks").select("key", F.col("id").alias("anchor_id")))

    # A bounded sample: the vectors of the least hashes.
    total = classes.count()
    picked = classes.select(F.xxhash64("key").alias("h"), "label", "v", "ids").orderBy("h").limit(sample).toArrow()
    seen, seen_labels = _vectors(picked.column("v")), picked.column("label").to_numpy()
    seen_ids = [np.array(i) for i in picked.column("ids").to_pylist()]
    words = int(max(1, min(MOST_WORDS, round((total / cell) ** 0.5))))
    books = [codebook(h, words) for h in halves(seen.astype(np.float64))]
    second = len(books[1])

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                v = _vectors(batch.column("v")).astype(np.float64)
                (a, a_far), (b, b_far) = (nearest(h, book) for h, book in zip(halves(v), books))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(a * second + b, pa.int32()), pa.array(a_far), pa.array(b_far)],
                    [*batch.schema.names, "cell", "far_first", "far_second"],
                )

    entry = "key string, label long, v array<long>, ids array<long>"
    entries = checkpointed(classes.mapInArrow(assign, entry + ", cell int, far_first double, far_second double"))
    # One row per cell: at most MOST_WORDS squared.
    cells = entries.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("far_first").alias("first"), F.max("far_second").alias("second")
    ).orderBy("cell").collect()
    radii = [np.zeros(len(book)) for book in books]
    for row in cells:
        i, j = divmod(row["cell"], second)
        radii[0][i], radii[1][j] = max(radii[0][i], row["first"]), max(radii[1][j], row["second"])
    shelf = max(1024, SHELF_COMPONENTS // max(dim, 1))
    starts, at = {}, 0
    for row in cells:
        starts[row["cell"]] = (at, row["n"])
        at += row["n"]
    # A cell's vectors lie anywhere in its stretch of the shelves: a hot cell takes as many shelves as it needs.
    laid = F.broadcast(spark.createDataFrame([(c, s, n) for c, (s, n) in starts.items()], "cell int, start long, n long"))
    on_shelf = F.floor((F.col("start") + F.pmod(F.xxhash64("key"), F.col("n"))) / shelf).cast("int")
    shelved = entries.join(laid, "cell").select("key", "label", "v", "ids", on_shelf.alias("shelf"))

    def shelves_of(q: np.ndarray, least: float, most: float) -> list[int]:
        found: set[int] = set()
        for number in wanted_cells(q.astype(np.float64), books, radii, least, most):
            if number in starts:
                start, n = starts[number]
                found.update(range(start // shelf, (start + n - 1) // shelf + 1))
        return sorted(found)

    def asked(batch: pa.RecordBatch, bounds) -> pa.RecordBatch:
        """Each row once for every shelf that may hold what it looks for."""
        vectors, labels = _vectors(batch.column("v")), batch.column("label").to_numpy()
        places, shelves = [], []
        for start in range(0, len(vectors), 256):
            scores = products(vectors[start : start + 256], seen)
            for place, row in enumerate(scores, start):
                for limits in bounds(place, labels[place], row):
                    on = shelves_of(vectors[place], *limits)
                    places += [place] * len(on)
                    shelves += on
        taken = batch.take(pa.array(places, pa.int64()))
        return pa.RecordBatch.from_arrays([*taken.columns, pa.array(shelves, pa.int32())], [*batch.schema.names, "shelf"])

    def ask_positives(batches):
        for batch in batches:
            def bounds(place, own, row):
                there = first_rows(row, seen_ids, np.flatnonzero(seen_labels == own), positives + 1)
                yield (there[-1][0] if len(there) > positives else -np.inf), np.inf

            yield asked(batch, bounds)

    def ask_windows(batches):
        for batch in batches:
            found = batch.column("scores").to_pylist()

            def bounds(place, own, row):
                other = seen_labels != own
                limits = []
                for score in found[place]:
                    bottom, top = window_of(score, low, high)
                    if bottom <= top:
                        there = first_rows(row, seen_ids, np.flatnonzero(other & (row >= bottom) & (row <= top)), wanted)
                        limits.append((there[-1][0] if len(there) == wanted else bottom, top))
                if limits:
                    yield min(b for b, _ in limits), max(t for _, t in limits)

            yield asked(batch, bounds)

    def met(questions: DataFrame, compare, returns: str) -> DataFrame:
        """Questions beside the vectors of their shelf. Where many ask for one shelf they are cut, and its vectors copied."""
        per_shelf = questions.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / SHELF_QUERIES).cast("int").alias("parts"))
        per_shelf = checkpointed(per_shelf)
        dealt = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
        left = questions.join(per_shelf, "shelf").withColumn("part", dealt).drop("parts")
        each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        right = shelved.join(per_shelf, "shelf").withColumn("part", each).drop("parts", "key")
        return left.groupBy("shelf", "part").cogroup(right.groupBy("shelf", "part")).applyInPandas(compare, returns)

    def nearest_same(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        made = []
        if len(queries) and len(vectors):
            labels, ids = vectors["label"].to_numpy(), vectors["ids"].tolist()
            v = _stack(vectors["v"])
            for own, group in queries.groupby("label"):
                rows = np.flatnonzero(labels == own)
                if len(rows):
                    keys, ids_here = group["key"].tolist(), [ids[r] for r in rows.tolist()]
                    q, every = _stack(group["v"]), np.arange(len(rows))
                    for start in range(0, len(q), 128):
                        for place, row in enumerate(products(q[start : start + 128], v[rows]), start):
                            made += [(keys[place], s, i) for s, i in first_rows(row, ids_here, every, positives + 1)]
        return pd.DataFrame(made, columns=["key", "score", "id"])

    def nearest_other(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        made = []
        if len(queries) and len(vectors):
            labels, ids, v = vectors["label"].to_numpy(), vectors["ids"].tolist(), _stack(vectors["v"])
            keys, own, wished, q = queries["key"].tolist(), queries["label"].tolist(), queries["scores"].tolist(), _stack(queries["v"])
            for start in range(0, len(q), 128):
                for place, row in enumerate(products(q[start : start + 128], v), start):
                    rows = np.flatnonzero(labels != own[place])
                    scores = row[rows]
                    for score in wished[place]:
                        bottom, top = window_of(int(score), low, high)
                        inside = rows[(scores >= bottom) & (scores <= top)]
                        made += [(keys[place], int(score), s, i) for s, i in first_rows(row, ids, inside, wanted)]
        return pd.DataFrame(made, columns=["key", "positive_score", "score", "id"])

    asking = classes.join(anchors.select("key").distinct(), "key", "left_semi").select("key", "label", "v")
    question = "key string, label long, v array<long>"
    questions = checkpointed(asking.mapInArrow(ask_positives, question + ", shelf int"))
    near = met(questions, nearest_same, "key string, score long, id long")
    order = [F.desc("score"), F.asc("id")]
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("_n") <= positives + 1)
    near = checkpointed(near.groupBy("key").agg(F.collect_list(F.struct("score", "id")).alias("found")))
    scores = near.select("key", F.array_distinct(F.col("found.score")).alias("scores"))
    windows = asking.join(scores, "key")
    windows = checkpointed(windows.mapInArrow(ask_windows, question + ", scores array<long>, shelf int"))
    others = met(windows, nearest_other, "key string, positive_score long, score long, id long")
    best = Window.partitionBy("key", "positive_score").orderBy(*order)
    others = others.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= wanted)
    found = others.groupBy("key").agg(F.collect_list(F.struct("positive_score", "rank", F.col("score").alias("negative_score"), F.col("id").alias("negative_id"))).alias("negatives"))
    answers = near.join(found, "key")
    # Anchors that are copies of one vector share its answers; each leaves itself out of its positives.
    mine_own = lookup(anchors, answers, "key", "inner")
    others_first = F.slice(F.filter("found", lambda p: p["id"] != F.col("anchor_id")), 1, positives)
    ordered = F.sort_array(F.transform("found", lambda p: F.struct((-p["score"]).alias("o"), p["id"].alias("id"), p["score"].alias("score"))))
    pairs = mine_own.withColumn("found", ordered).withColumn("found", others_first).select(
        "anchor_id", F.explode("found").alias("p"), "negatives"
    )
    matched = F.filter("negatives", lambda n: n["positive_score"] == F.col("p.score"))
    listed = pairs.select("anchor_id", F.col("p.id").alias("positive_id"), F.explode(matched).alias("n"))
    return listed.select("anchor_id", "positive_id", "n.rank", "n.negative_id", "n.positive_score", "n.negative_score")
