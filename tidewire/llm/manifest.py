"""Merkle manifest of a dataset, proved by octopus multiproofs.

Rows become leaves of one tree per group, the trees' roots leaves of a last tree over the groups. Leaves are dealt by
range, so a partition holds runs of neighbouring leaves: it computes every node that its own leaves give, hands on only
those whose parent it cannot compute, and a few rounds over these few nodes give all nodes above. For its proofs a
partition names the least set of nodes that it needs besides its own, fetches that set once, derives the shared nodes
from it, and expands the proof of each leaf by itself.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import checkpointed

ARITY = 3
# Leaves of a task, about; and levels that one round over the nodes between partitions climbs.
LEAVES = 1 << 18
SPAN = 6
# The number of the tree over the groups; those of the groups count from 0.
TOP = -1


def encoded(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """Lower-case hex digest of the values, each with its length."""
    return F.sha2(F.concat(*map(encoded, values)), 256)


def level_sizes(leaves: int, arity: int = ARITY) -> list[int]:
    """Nodes of each level, from the leaves to the root."""
    sizes = [leaves]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // arity))
    return sizes


def parent_of(children: list[bytes]) -> bytes:
    """The digest over the children's digests as hex text."""
    return sha256("".join(c.hex() for c in children).encode()).digest()


def missing(positions: np.ndarray, leaves: int, arity: int = ARITY) -> list[np.ndarray]:
    """For each level the least set of nodes that prove these leaves together needs from elsewhere."""
    needed, known = [], np.unique(positions)
    for size in level_sizes(leaves, arity)[:-1]:
        parents = np.unique(known // arity)
        children = (parents[:, None] * arity + np.arange(arity)).ravel()
        needed.append(np.setdiff1d(children[children < size], known, assume_unique=True))
        known = parents
    return needed


def derive(known: list[dict[int, bytes]], leaves: int, arity: int = ARITY, to: int | None = None) -> None:
    """Adds to ``known`` (a dictionary of nodes for each level) every parent all of whose children are known."""
    sizes = level_sizes(leaves, arity)
    last = len(sizes) - 1 if to is None else min(to, len(sizes) - 1)
    for level in range(last):
        here, above = known[level], known[level + 1]
        for parent in {i // arity for i in here}:
            if parent not in above:
                run = [here.get(i) for i in range(parent * arity, min(parent * arity + arity, sizes[level]))]
                if None not in run:
                    above[parent] = parent_of(run)


def frontier(known: list[dict[int, bytes]], arity: int = ARITY):
    """(level, number, digest) of the known nodes whose parent is not known."""
    for level, nodes in enumerate(known):
        above = known[level + 1] if level + 1 < len(known) else {}
        for number, digest in nodes.items():
            if number // arity not in above:
                yield level, number, digest


class Path:
    """Proofs of the leaves of one tree, whose needed nodes are all known; ``tail`` goes on behind each of them.

    Leaves are asked for in order: what neighbours share of their proofs is put together once.
    """

    def __init__(self, known: list[dict[int, bytes]], leaves: int, tail: str = "", arity: int = ARITY):
        self.known, self.sizes, self.tail, self.arity = known, level_sizes(leaves, arity), tail, arity
        self._last: list[tuple[int, str]] = [(-1, "")] * len(self.sizes)

    def _run(self, level: int, number: int) -> range:
        start = number // self.arity * self.arity
        return range(start, min(start + self.arity, self.sizes[level]))

    def siblings(self, position: int, level: int = 0) -> str:
        """Digests as hex text, level by level, left to right."""
        if level == len(self.sizes) - 1:
            return self.tail
        parent, above = self._last[level]
        if parent != position // self.arity:
            parent = position // self.arity
            above = self.siblings(parent, level + 1)
            self._last[level] = (parent, above)
        nodes = self.known[level]
        return "".join(nodes[i].hex() for i in self._run(level, position) if i != position) + above

    def fold(self, position: int, leaf: bytes) -> bytes:
        """The root that ``leaf`` gives in this position beside the other leaves."""
        for level in range(len(self.sizes) - 1):
            nodes = self.known[level]
            leaf = parent_of([leaf if i == position else nodes[i] for i in self._run(level, position)])
            position //= self.arity
        return leaf


def _runs(keys: list) -> list[tuple[int, int]]:
    """(start, stop) of the runs of equal neighbours."""
    edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if a < b]


def _placed(summary: list, partition: int, keys: list) -> list[tuple[int, int, int, int, int]]:
    """(tree, its leaves, first position, start, stop) of each run of a partition."""
    first_tree, before, first_total, last_total = summary[partition]
    found, runs = [], _runs(keys)
    for number, (start, stop) in enumerate(runs):
        total = first_total if number == 0 else last_total if number == len(runs) - 1 else stop - start
        found.append((first_tree + number, total, before if number == 0 else 0, start, stop))
    return found


def _summarise(rows: list) -> tuple[dict[int, tuple[int, int, int, int]], int]:
    """From one row per partition: its first tree, that tree's leaves before it, leaves of its first and last tree; and
    the number of trees."""
    begun, totals, tree, last = {}, {}, -1, None
    for row in rows:
        if last is None or row["first"] != last:
            tree += 1
            totals[tree] = 0
        end = tree + row["runs"] - 1
        begun[row["pid"]] = (tree, totals[tree], end)
        totals[tree] += row["n_first"]
        # Trees between the first and the last lie whole in this partition: their sizes are known there.
        if end > tree:
            totals[end] = row["n_last"]
        tree, last = end, row["last"]
    return {p: (first, before, totals[first], totals[end]) for p, (first, before, end) in begun.items()}, tree + 1


NODES = "tree long, level int, number long, digest binary, leaves long"


def _nodes(found: list[tuple]) -> pa.Table:
    kinds = [("tree", pa.int64()), ("level", pa.int32()), ("number", pa.int64()), ("digest", pa.binary()), ("leaves", pa.int64())]
    return pa.table({name: pa.array([f[i] for f in found], kind) for i, (name, kind) in enumerate(kinds)})


def _climb(nodes: DataFrame, most_leaves: int, arity: int, span: int) -> DataFrame:
    """All nodes above the given ones. A round gathers the nodes under one ancestor ``span`` levels up, never more."""
    def climb(table: pa.Table) -> pa.Table:
        found = []
        rows = table.to_pylist()
        known = [{} for _ in range(len(level_sizes(rows[0]["leaves"], arity)))]
        for row in rows:
            known[row["level"]][row["number"]] = row["digest"]
        given = [set(nodes) for nodes in known]
        derive(known, rows[0]["leaves"], arity, rows[0]["floor"] + span)
        for level, nodes in enumerate(known):
            found += [(rows[0]["tree"], level, n, d, rows[0]["leaves"]) for n, d in nodes.items() if n not in given[level]]
        return _nodes(found)

    everything = checkpointed(nodes)
    for floor in range(0, max(len(level_sizes(most_leaves, arity)) - 1, 0), span):
        here = everything.where((F.col("level") >= floor) & (F.col("level") < floor + span)).withColumn("floor", F.lit(floor))
        up = F.pow(F.lit(float(arity)), F.lit(floor + span) - F.col("level")).cast("long")
        made = here.withColumn("_up", up).withColumn("ancestor", F.expr("number div _up")).drop("_up")
        above = made.groupBy("tree", "ancestor").applyInArrow(climb, NODES)
        everything = checkpointed(everything.unionByName(above))
    return everything


def prove(df: DataFrame, leaf: Column, claimed: Column, group: Column, order: Column, keep: dict[str, Column],
          arity: int = ARITY, leaves_of_task: int = LEAVES, span: int = SPAN, with_proof: bool = False) -> DataFrame:
    """``keep``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified`` for every row.

    ``leaf`` and ``claimed`` are hex digests: the manifest is built from ``leaf``, the folded root starts from
    ``claimed`` with the siblings of ``leaf``. Leaves of one ``group`` ascend by ``order`` (null first; ties by digest,
    then in no fixed order: equal rows are told apart by their place alone), groups ascend too (null first, then by
    bytes). ``with_proof`` adds ``proof``, the siblings' digests as text. Every row is a leaf, repeated ones too; an empty
    table gives no rows. No task holds more than about ``leaves_of_task`` leaves; the driver sees one short row for each
    partition.
    """
    spark = df.sparkSession
    names = list(keep)
    spare = [f"_k{i}" for i in range(len(names))]
    claim = F.when(claimed != leaf, F.unhex(claimed))
    rows = df.select(
        group.cast("string").alias("_group"), order.alias("_order"), F.unhex(leaf).alias("_leaf"), claim.alias("_claim"),
        *[c.alias(s) for c, s in zip(keep.values(), spare)],
    )
    leaves = checkpointed(rows)
    total = leaves.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // leaves_of_task))
    tied = leaves.withColumn("_tie", F.monotonically_increasing_id())
    by = ["_group", "_order", "_leaf", "_tie"]
    dealt = tied.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = checkpointed(dealt.select(
        F.monotonically_increasing_id().alias("_at"), F.sha2(encoded(F.col("_group")), 256).alias("_key"), "_leaf", "_claim", *spare
    ).withColumn("_pid", F.shiftright("_at", 33).cast("int")))

    def summarise(batches):
        first = last = pid = None
        runs = n_first = n_last = 0
        for batch in batches:
            keys = batch.column("_key").to_pylist()
            pid = batch.column("_pid")[0].as_py() if keys else pid
            for start, stop in _runs(keys):
                if keys[start] != last:
                    runs, n_last, last = runs + 1, 0, keys[start]
                    first = last if first is None else first
                n_last += stop - start
                if runs == 1:
                    n_first = n_last
        if pid is not None:
            yield pa.RecordBatch.from_pylist([
                {"pid": pid, "runs": runs, "first": first, "n_first": n_first, "last": last, "n_last": n_last}
            ], pa.schema([("pid", pa.int32()), ("runs", pa.int64()), ("first", pa.string()), ("n_first", pa.int64()),
                          ("last", pa.string()), ("n_last", pa.int64())]))

    # One row per partition.
    summary, trees = _summarise(
        placed.select("_pid", "_key")
        .mapInArrow(summarise, "pid int, runs long, first string, n_first long, last string, n_last long")
        .orderBy("pid").collect()
    )

    def own_nodes(keys: list, digests: list, pid: int):
        """Runs of a partition, and for each the nodes its leaves give; then the nodes of the top tree they give."""
        runs, tops = _placed(summary, pid, keys), [{} for _ in level_sizes(trees, arity)]
        grown = []
        for tree, size, before, start, stop in runs:
            known = [{} for _ in level_sizes(size, arity)]
            known[0] = dict(zip(range(before, before + stop - start), digests[start:stop]))
            derive(known, size, arity)
            grown.append(known)
            if known[-1]:
                tops[0][tree] = known[-1][0]
        return runs, grown, tops

    def climb_own(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        keys = [k for b in held for k in b.column("_key").to_pylist()]
        digests = [d for b in held for d in b.column("_leaf").to_pylist()]
        runs, grown, tops = own_nodes(keys, digests, held[0].column("_pid")[0].as_py())
        found = []
        for (tree, size, *_), known in zip(runs, grown):
            if not known[-1]:
                found += [(tree, *node, size) for node in frontier(known, arity)]
        derive(tops, trees, arity)
        found += [(TOP, *node, trees) for node in frontier(tops, arity)]
        yield from _nodes(found).to_batches()

    def ask(batches):
        """The least union of nodes each partition needs: only its first and last tree reach beyond it."""
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                ends = [(row["first_tree"], row["before"], row["n_first"], row["first_total"])]
                if row["runs"] > 1:
                    ends.append((row["first_tree"] + row["runs"] - 1, 0, row["n_last"], row["last_total"]))
                ends.append((TOP, row["first_tree"], row["runs"], trees))
                for tree, start, count, size in ends:
                    for level, numbers in enumerate(missing(np.arange(start, start + count), size, arity)):
                        found += [(row["pid"], tree, level, int(n)) for n in numbers]
            kinds = [("_pid", pa.int32()), ("tree", pa.int64()), ("level", pa.int32()), ("number", pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], kind) for i, (_, kind) in enumerate(kinds)], [n for n, _ in kinds]
            )

    frontiers = checkpointed(placed.select("_pid", "_key", "_leaf").mapInArrow(climb_own, NODES))
    most = max([max(s[2], s[3]) for s in summary.values()], default=0)
    split = _climb(frontiers.where(F.col("tree") != TOP), most, arity, span)
    sizes = len(level_sizes(max(most, 1), arity))
    powers = F.array(*[F.lit(arity**i).cast("long") for i in range(sizes + 1)])
    is_root = (F.get(powers, F.col("level")) >= F.col("leaves")) & (F.col("number") == 0)
    subroots = split.where(is_root).select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("number"), "digest",
        F.lit(trees).cast("long").alias("leaves"),
    )
    top = _climb(frontiers.where(F.col("tree") == TOP).unionByName(subroots), trees, arity, span)
    nodes = split.unionByName(top).select("tree", "level", "number", "digest")
    firsts = placed.select("_pid", "_key").mapInArrow(
        summarise, "pid int, runs long, first string, n_first long, last string, n_last long"
    ).drop("first", "last")
    known = spark.createDataFrame(
        [(p, *s) for p, s in summary.items()], "pid int, first_tree long, before long, first_total long, last_total long"
    )
    asked = firsts.join(F.broadcast(known), "pid").mapInArrow(ask, "_pid int, tree long, level int, number long")
    fetched = asked.join(nodes, ["tree", "level", "number"])

    kept_types = [(s, f.dataType.simpleString()) for s, f in zip(spare, leaves.select(*spare).schema)]
    made = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    schema = ", ".join([f"{s} {t}" for s, t in kept_types] + [made] + (["proof string"] if with_proof else []))

    def expand(rows: pa.Table, needed: pa.Table) -> pa.Table:
        rows = rows.sort_by("_at")
        keys, digests, claims = (rows.column(c).to_pylist() for c in ("_key", "_leaf", "_claim"))
        pid = rows.column("_pid")[0].as_py()
        runs, grown, tops = own_nodes(keys, digests, pid)
        by_tree = {run[0]: known for run, known in zip(runs, grown)} | {TOP: tops}
        for tree, level, number, digest in zip(*(needed.column(c).to_pylist() for c in ("tree", "level", "number", "digest"))):
            by_tree[tree][level][number] = digest
        out: dict[str, list] = {n: [] for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof")}
        for (tree, size, *_), tree_nodes in zip(runs, grown):
            derive(tree_nodes, size, arity)
            tops[0][tree] = tree_nodes[-1][0]
        derive(tops, trees, arity)
        root, above = tops[-1][0], Path(tops, trees, "", arity)
        for (tree, size, before, start, stop), tree_nodes in zip(runs, grown):
            subroot = tree_nodes[-1][0]
            path = Path(tree_nodes, size, above.siblings(tree), arity)
            out["subroot"] += [subroot.hex()] * (stop - start)
            for place in range(start, stop):
                position = before + place - start
                proof, claim = path.siblings(position), claims[place]
                # From the leaf itself the fold is what the shared nodes have given already.
                folded = root if claim is None else above.fold(tree, path.fold(position, claim))
                out["leaf"].append(digests[place].hex())
                out["proof_sha256"].append(sha256(proof.encode()).hexdigest())
                out["folded_root"].append(folded.hex())
                out["verified"].append(folded == root)
                if with_proof:
                    out["proof"].append(proof)
        out["root"] = [root.hex()] * len(digests)
        arrays = {s: rows.column(s) for s in spare} | {
            n: pa.array(v, pa.bool_() if n == "verified" else pa.string()) for n, v in out.items() if n != "proof" or with_proof
        }
        return pa.table(arrays)

    proved = placed.groupBy("_pid").cogroup(fetched.groupBy("_pid")).applyInArrow(expand, schema)
    rest = [c for c in proved.columns if c not in spare]
    return proved.select(*[F.col(s).alias(n) for s, n in zip(spare, names)], *rest)
