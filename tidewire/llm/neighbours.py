"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors are lengthened by one component so that the largest inner product becomes the smallest distance. Lists are cells
of centroids fitted on a bounded sample, cells that grew too large split; a vector near a border stands in several
lists. A query walks a graph over the centroids in memory, takes the lists whose centroid is at most a ratio farther
than the nearest one, and compares itself with all their vectors. The ratio is fitted on the sample for a wished recall.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import checkpointed

# Vectors the centroids and the ratio are fitted on, at most, and centroids, at most.
SAMPLE = 16_384
MOST_LISTS = 4_096
LIST_SIZE = 256
# Lists a border vector stands in, and how much farther than the nearest centroid theirs may be.
COPIES = 2
BORDER = 0.05
WISHED_RECALL = 0.98
DEGREE = 16
# Components of the vectors, and queries, that meet in one task: short lists stand on one shelf, long ones are cut.
SHELF_COMPONENTS = 1 << 21
SHELF_QUERIES = 4_096


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    square = (x**2).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(axis=1)
    return np.sqrt(np.maximum(square, 0))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin(distances(x[i : i + 1024], centroids), axis=1) for i in range(0, len(x), 1024)])


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """About ``lists`` centroids; a cell with over twice the mean is split in two and small ones give way."""
    random = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    lists = max(1, min(lists, len(x)))
    centroids = x[random.choice(len(x), lists, replace=False)]
    for turn in range(rounds):
        own = _nearest(x, centroids)
        sizes = np.bincount(own, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
        if turn < rounds - 2:
            large = np.argsort(-sizes)
            large = large[sizes[large] > 2 * len(x) / lists]
            for big, small in zip(large, np.argsort(sizes, kind="stable")):
                members = np.flatnonzero(own == big)
                centroids[[big, small]] = x[random.choice(members, 2, replace=False)]
    return centroids


def centroid_graph(centroids: np.ndarray, degree: int = DEGREE) -> list[np.ndarray]:
    """Each centroid's nearest others, both ways, and one before it in number, so the graph is connected."""
    n, around = len(centroids), [set() for _ in range(len(centroids))]
    for i in range(n):
        far = distances(centroids[i : i + 1], centroids)[0]
        far[i] = np.inf
        near = np.argsort(far, kind="stable")[: min(degree, n - 1)].tolist()
        if i:
            near.append(int(np.argmin(far[:i])))
        for j in near:
            around[i].add(j)
            around[j].add(i)
    return [np.array(sorted(a), np.int64) for a in around]


@dataclass
class Index:
    centroids: np.ndarray
    graph: list[np.ndarray]
    ratio: float
    radius: float
    sizes: np.ndarray | None = None
    shelf: np.ndarray | None = None

    def lengthened(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.radius**2 - (x**2).sum(axis=1), 0))
        if query:
            x = x * (self.radius / np.sqrt((x**2).sum(axis=1)))[:, None]
        return np.concatenate([x, rest[:, None]], axis=1)

    def lists_of(self, x: np.ndarray) -> list[np.ndarray]:
        """Lists of lengthened vectors, the nearest first; border vectors get up to ``COPIES``."""
        far = distances(x, self.centroids)
        order = np.argsort(far, axis=1, kind="stable")[:, :COPIES]
        near = np.take_along_axis(far, order, axis=1)
        return [o[n <= (1 + BORDER) * n[0] + 1e-12] for o, n in zip(order, near)]

    def search(self, q: np.ndarray, wanted: int) -> list[int]:
        """Lists for one lengthened query: a best-first walk over the graph, pruned by the distance ratio.

        The walk goes on until nothing within the ratio is open and the lists found hold ``wanted`` vectors or all are seen.
        """
        def far(nodes):
            return np.sqrt(((self.centroids[nodes] - q) ** 2).sum(axis=1))

        seen = np.zeros(len(self.centroids), bool)
        seen[0] = True
        first = float(far(np.array([0]))[0])
        open_, best, reached = [(first, 0)], first, []
        held = 0
        while open_:
            distance, node = heapq.heappop(open_)
            if distance > 1.05 * self.ratio * best and held >= wanted:
                break
            reached.append((distance, node))
            held += int(self.sizes[node])
            fresh = self.graph[node][~seen[self.graph[node]]]
            if len(fresh):
                seen[fresh] = True
                for d, n in zip(far(fresh).tolist(), fresh.tolist()):
                    best = min(best, d)
                    heapq.heappush(open_, (d, n))
        reached.sort()
        chosen, held = [], 0
        for distance, node in reached:
            if distance > self.ratio * best and held >= wanted:
                break
            chosen.append(node)
            held += int(self.sizes[node])
        return chosen


def fit(sample: np.ndarray, radius: float, lists: int, recall: float = WISHED_RECALL, nearest: int = 20) -> Index:
    """Centroids, graph and distance ratio from a bounded sample of original vectors."""
    index = Index(np.zeros((0, 0)), [], 1.0, radius)
    long = index.lengthened(sample)
    index.centroids = balanced_centroids(long, lists)
    index.graph = centroid_graph(index.centroids)
    own = [np.array(a) for i in range(0, len(long), 1024) for a in index.lists_of(long[i : i + 1024])]
    step = max(1, len(sample) // 256)
    needed = []
    for i in range(0, len(sample), step):
        score = sample @ sample[i]
        score[i] = -np.inf
        far = distances(index.lengthened(sample[i : i + 1], query=True), index.centroids)[0]
        far = far / max(far.min(), 1e-12)
        needed += [far[own[j]].min() for j in np.argsort(-score)[: min(nearest, len(sample) - 1)]]
    index.ratio = float(np.quantile(needed, recall)) + 1e-9 if needed else 1.0
    return index


def shelve(posted: dict[int, int], lists: int, most: int) -> tuple[np.ndarray, dict[int, int]]:
    """Shelf of each list, and into how many blocks each shelf is cut: lists one after another, about ``most`` vectors."""
    shelf, held, size = np.zeros(lists, np.int32), {0: 0}, 0
    now = 0
    for number in range(lists):
        size = posted.get(number, 0)
        if held[now] and held[now] + size > most:
            now += 1
            held[now] = 0
        held[now] += size
        shelf[number] = now
    return shelf, {k: max(1, -(-n // most)) for k, n in held.items()}


def _best(q: np.ndarray, wanted: list, v: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int):
    """Rows of the ``k`` largest inner products of each query among the lists it wants, ties to smaller ids."""
    edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
    for start in range(0, len(q), 128):
        part = q[start : start + 128]
        score = np.full((len(part), len(v)), -np.inf)
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            asks = [i for i in range(len(part)) if own[low] in wanted[start + i]]
            if asks:
                score[asks, low:high] = part[asks] @ v[low:high].T
        # A vector may stand in several lists of a shelf: take as many more and keep the first of each.
        take = min(k * COPIES, len(v))
        least = np.partition(score, len(v) - take, axis=1)[:, len(v) - take]
        for i, row in enumerate(score):
            rows = np.flatnonzero((row >= least[i] - 1e-9) & (row > -np.inf))
            rows = rows[np.unique(ids[rows], axis=0, return_index=True)[1]]
            exact = (v[rows] * part[i]).sum(axis=1)
            order = np.lexsort((ids[rows, 0], -exact))[:k]
            yield start + i, rows[order], exact[order]


def search(df: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
           sample: int = SAMPLE, list_size: int = LIST_SIZE) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each row that ``is_query`` holds for, the ``k`` nearest others found.

    Nearness is the inner product of the original vectors in double precision; ties go to the smaller id. Vectors that
    are null, zero, or hold null or non-finite components take no part, nor do those without an id or of another length
    than most. Copies of a vector meet once: only their ``k + 1`` least ids can be among the nearest, so only these are
    kept, exactly. Every other vector is listed. With at most ``k`` candidates all are returned; without a valid vector
    nothing is.
    """
    spark = df.sparkSession
    vector = F.col(embedding).cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(vec_id).cast("long").alias("id"), vector.alias("v"), is_query.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(sound)
    common = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    rows = checkpointed(rows.where(F.size("v") == common["dim"]).withColumn("h", F.xxhash64("v")))
    same = Window.partitionBy("h", "v").orderBy("id")
    least = rows.select("h", "v", "id").distinct().withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1)
    classes = least.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = checkpointed(classes.select(F.struct(F.col("ids")[0].alias("id"), "h").alias("key"), "v", "ids"))
    asking = rows.where("asks").select("h", "v", F.col("id").alias("query_id")).distinct()
    # The class of each asking row: its vector's least id, by hash and then by the vector itself.
    asking = asking.join(classes.select(F.col("key.h").alias("h"), "v", "key"), ["h", "v"]).select("query_id", "key")
    asking = checkpointed(asking)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    total, radius = classes.agg(F.count(F.lit(1)), F.sqrt(F.max(square))).first()
    picked = classes.select(F.xxhash64("key.id", "key.h").alias("o"), "v").orderBy("o").limit(sample).select("v").toPandas()
    lists = max(1, min(MOST_LISTS, -(-total // list_size)))
    index = fit(np.array(picked["v"].tolist(), float), radius * (1 + 1e-9), lists, nearest=k)
    # Arrays alone are sent: workers need not have this package.
    shared = spark.sparkContext.broadcast(dict(vars(index)))

    def listed(batches):
        own = Index(**shared.value)
        for batch in batches:
            vectors = np.array(batch.column("v").to_pylist(), float).reshape(batch.num_rows, -1)
            found = own.lists_of(own.lengthened(vectors)) if len(vectors) else []
            places = np.repeat(np.arange(len(found)), [len(f) for f in found])
            numbers = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
            first = np.concatenate([np.arange(len(f)) == 0 for f in found]) if found else np.zeros(0, bool)
            taken = batch.take(pa.array(places))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(numbers), pa.array(first)], [*batch.schema.names, "list", "own"])

    kind = "key struct<id:long,h:long>, v array<double>"
    posted = checkpointed(classes.mapInArrow(listed, kind + ", ids array<long>, list int, own boolean"))
    # One row per list: at most MOST_LISTS.
    counted = posted.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("own").cast("long")).alias("own")).collect()
    index.sizes = np.zeros(len(index.centroids), np.int64)
    for row in counted:
        index.sizes[row["list"]] = row["own"]
    most = max(1024, SHELF_COMPONENTS // common["dim"])
    index.shelf, blocks = shelve({r["list"]: r["n"] for r in counted}, len(index.centroids), most)
    probing = spark.sparkContext.broadcast(dict(vars(index)))

    def probe(batches):
        own = Index(**probing.value)
        for batch in batches:
            vectors = np.array(batch.column("v").to_pylist(), float).reshape(batch.num_rows, -1)
            places, shelves, lists = [], [], []
            for place, q in enumerate(own.lengthened(vectors, query=True) if len(vectors) else []):
                by_shelf: dict[int, list[int]] = {}
                for number in own.search(q, k + 1):
                    by_shelf.setdefault(int(own.shelf[number]), []).append(number)
                places += [place] * len(by_shelf)
                shelves += list(by_shelf)
                lists += list(by_shelf.values())
            taken = batch.take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(shelves, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], [*batch.schema.names, "shelf", "lists"]
            )

    questions = classes.select("key", "v").join(asking.select("key").distinct(), "key", "left_semi")
    probes = checkpointed(questions.mapInArrow(probe, kind + ", shelf int, lists array<int>"))
    # One row per shelf, fewer than lists.
    asked = {r["shelf"]: r["n"] for r in probes.groupBy("shelf").agg(F.count(F.lit(1)).alias("n")).collect()}
    cuts = [(s, blocks[s], -(-n // SHELF_QUERIES)) for s, n in asked.items()]
    cut = F.broadcast(spark.createDataFrame(cuts, "shelf int, blocks int, rounds int"))
    shelf_of = F.broadcast(spark.createDataFrame([(i, int(s)) for i, s in enumerate(index.shelf)], "list int, shelf int"))

    def dealt(number: str):
        return (F.pmod(F.xxhash64("key.id", "key.h", F.lit(1)), F.col(number))).cast("int")

    def all_of(number: str):
        return F.explode(F.sequence(F.lit(0), F.col(number) - 1))

    left = probes.join(cut, "shelf").withColumn("round", dealt("rounds")).withColumn("block", all_of("blocks"))
    right = posted.join(shelf_of, "list").join(cut, "shelf").withColumn("block", dealt("blocks")).withColumn("round", all_of("rounds"))

    def compare(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        made = []
        if len(queries) and len(vectors):
            vectors = vectors.sort_values("list", kind="stable").reset_index(drop=True)
            ids = np.array([(x["id"], x["h"]) for x in vectors["key"]], np.int64)
            v, q = np.array(vectors["v"].tolist(), float), np.array(queries["v"].tolist(), float)
            wanted = [set(x.tolist()) for x in queries["lists"]]
            for i, found, exact in _best(q, wanted, v, vectors["list"].to_numpy(), ids, k + 1):
                key = queries["key"].iloc[i]
                made += [(key["id"], key["h"], vectors["ids"].iloc[j], s) for j, s in zip(found.tolist(), exact.tolist())]
        return pd.DataFrame(made, columns=["id", "h", "ids", "score"])

    by = ["shelf", "round", "block"]
    met = left.select("key", "v", "lists", *by).groupBy(*by).cogroup(right.select("key", "v", "ids", "list", *by).groupBy(*by))
    scored = met.applyInPandas(compare, "id long, h long, ids array<long>, score double")
    once = scored.groupBy("id", "h", "ids").agg(F.max("score").alias("score"))
    of_query = Window.partitionBy("id", "h")
    near = once.withColumn("place", F.row_number().over(of_query.orderBy(F.desc("score"), F.col("ids")[0]))).where(F.col("place") <= k + 1)
    near = near.select("id", "h", "score", F.explode("ids").alias("vec_id"))
    near = near.withColumn("place", F.row_number().over(of_query.orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    answers = asking.select("query_id", F.col("key.id").alias("id"), F.col("key.h").alias("h")).join(near, ["id", "h"])
    answers = answers.where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("place")).alias("rank")
    return answers.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)
