"""SimHash near-duplicates through an inverted index over byte positions with count filtering.

A fingerprint has eight bytes at eight positions. Two fingerprints at most three bits apart differ in at most three
bytes, so they share at least five positional bytes. The index lists fingerprints under every five positional bytes at
once: two stand in one list exactly when their tally of shared bytes reaches the guaranteed five. (Lists of single
bytes would hold a 256th of all fingerprints each and give quadratic pairs.) A list leaves three bytes open, so it
holds at most 2**24 fingerprints, however many documents there are. Pairs are tallied and verified inside their list,
and a list reports a tree that spans each linked group, never all pairs.
"""

from __future__ import annotations

import math
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tidewire.llm.common import checkpointed, slices
from tidewire.llm.components import components
from tidewire.operators.skew import counted_broadcast, lookup

POSITIONS = 8
MOST_BITS = 3
SHARED = POSITIONS - MOST_BITS
SHINGLE = 3
# Shingles hashed at a time: a text of any length takes bounded memory for its bits.
BLOCK = 1 << 16
_words = re.compile(rb"[^ \t-\r]+").findall
MASKS = [sum(0xFF << 8 * p for p in kept) for kept in combinations(range(POSITIONS), SHARED)]


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The SimHash of the whole text as a signed long; 0 without words.

    A-Z are lower-cased; a shingle is ``width`` words joined by blanks (a shorter text: all its words), repeats
    included; its hash is XXH64 with seed 42. A bit is 1 when more than half of the hashes have it.
    """
    words = _words(text.encode().lower()) if text else []
    if not words:
        return 0
    if len(words) < width:
        shingles, total = iter([b" ".join(words)]), 1
    else:
        shingles, total = map(b" ".join, zip(*[words[i:] for i in range(width)])), len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, total, BLOCK):
        size = min(BLOCK, total - start)
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for _, s in zip(range(size), shingles)), np.uint64, size)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total).view(">i8")[0])


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row, ids of any type; null texts have fingerprint 0. No shuffle."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = StructType([StructField("doc_id", rows.schema["doc_id"].dataType), StructField("fp", LongType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = [fingerprint(t, width) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return rows.mapInArrow(run, schema)


def _tree(members: np.ndarray, most_bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that span the linked groups of one list: each member is compared with those not reached yet."""
    left, ends, roots = members, [], []
    while len(left) > 1:
        root, left = left[:1], left[1:]
        front = [root]
        while front and len(left):
            apart = left ^ front.pop()
            shared = (apart.view(np.uint8).reshape(-1, POSITIONS) == 0).sum(axis=1)
            near = np.flatnonzero(shared >= SHARED)
            near = near[np.bitwise_count(apart[near]) <= most_bits]
            if len(near):
                reached = left[near]
                ends.append(reached)
                roots.append(np.repeat(root, len(reached)))
                front += [reached[i : i + 1] for i in range(len(reached))]
                left = np.delete(left, near)
    return ends, roots


def _links_of(keys: np.ndarray, values: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of lists that lie whole in these sorted arrays."""
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    sizes = np.diff(edges)
    pairs = edges[:-1][sizes == 2]
    left, right = values[pairs], values[pairs + 1]
    near = np.bitwise_count(left ^ right) <= most_bits
    a, b = [left[near]], [right[near]]
    for start, size in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        ends, roots = _tree(values[start : start + size], most_bits)
        a += ends
        b += roots
    return np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)


def links(prints: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(a, b): links that span every group of distinct fingerprints ``fp`` linked at ``most_bits`` or fewer bits.

    Every fingerprint is listed under 56 keys; a task reads its lists in order of their keys, one at a time.
    """
    if not 0 <= most_bits <= MOST_BITS:
        raise ValueError(f"the index is exact up to {MOST_BITS} bits")
    # A list is named by which bytes it holds and their values: the mask's number goes into the open bytes' room.
    keys = [F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("k")) for i, mask in enumerate(MASKS)]
    listed = prints.select("fp").distinct().select("fp", F.explode(F.array(*keys)).alias("_key"))
    named = listed.select(F.xxhash64("_key.m", "_key.k").alias("key"), "fp")

    def run(batches):
        keys = values = None
        for batch in batches:
            more = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            keys = more[0] if keys is None else np.concatenate([keys, more[0]])
            values = more[1].view(np.uint64) if values is None else np.concatenate([values, more[1].view(np.uint64)])
            if keys[0] == keys[-1]:
                continue
            whole = int(np.searchsorted(keys, keys[-1], side="left"))
            a, b = _links_of(keys[:whole], values[:whole], most_bits)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            keys, values = keys[whole:].copy(), values[whole:].copy()
        if keys is not None and len(keys):
            a, b = _links_of(keys, values, most_bits)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = named.repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE,
           most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, fp, component) for every row: rows share a component, named by one of its fingerprints, exactly if links
    of fingerprints join them. Equal fingerprints (0 for texts without words too) always link; copies meet as one
    fingerprint before anything is paired. Repeated rows are returned each; an empty table gives no rows."""
    prints = checkpointed(fingerprints(df, doc_id, text, width))
    distinct = prints.select("fp").distinct()
    roots = components(links(prints, most_bits))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("component"))
    return prints.join(placed, "fp").select("doc_id", "fp", "component")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE,
                    most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the least id reachable over links of fingerprints.

    As ``groups``, with ids that are longs. Rows without an id get a null component unless rows with one are reachable.
    """
    found = checkpointed(groups(df, doc_id, text, width, most_bits).withColumn("doc_id", F.col("doc_id").cast("long")))
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "component").select("doc_id", "fp", "component_id")


# --- similarity of shingle sets ----------------------------------------------------------------------------------
# Texts whose sets of shingles have a Jaccard similarity of 0.8 differ in about 15 % of a SimHash's bits, far more than an
# index over single fingerprints can promise to find. So a longer fingerprint is taken, and lists stand under each run of
# positional bytes of it; two texts are compared where they share a list, that is one such run at least, by 128 of their
# bits first and by their sets themselves in the end. That puts large groups together at little cost, but misses links.
#
# The rest is exact: in one order of all shingles, two similar sets share one of their first few (``prefix_length``).
# Lists stand under each of these; those of one set, or of one group, end there. The others meet once more at the least
# node in them, which brings lists of much the same members together, with the parities of each member once and not in
# every list. Pairs of two groups are told only if their parities leave them similar, once for each such place and with the
# number of lists they share there, which rules out more; those that are left are compared themselves.

WIDTH = 5
SIMILARITY = 0.8
# Tables, and bytes of a key: the second pair is for more texts than the first number. With p = 0.151 differing bits
# at the least similarity a pair shares one of the keys with 1 - (1 - (1 - p) ** bits) ** tables: 0.91 and 0.92.
TABLES = ((1 << 24, 32, 2), (1 << 62, 128, 3))
# Bits of 128 in which texts as similar as that may differ: 19 on average, with a deviation of 4.
NEAR_BITS = 36
_MIX = 0x9E3779B97F4A7C15
# Texts whose shingles are counted, and shingles found in LEAST or more of them that are put last, at most. They settle the
# order of shingles and thus the length of lists, never what is found.
COUNTED, LEAST, FREQUENT = 1 << 14, 3, 1 << 16
# Bytes of a shingle's hash that name a list; lists of two shingles in one only give pairs to look at in vain.
NAME_BYTES = 5
# Lists up to this size are compared together, longer ones one at a time; and pairs handed on at a time.
SHORT, PAIRS = 64, 1 << 16
# Bytes of the parities of a set: at least so many, else a bit for each shingle, as a power of two; and of those compared at a time.
LEAST_PARITIES, COMPARED = 64, 1 << 24


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of the distinct shingles of a text (words and lower case as in ``fingerprint``), sorted; none without words."""
    words = _words(text.encode().lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    shingles = map(b" ".join, zip(*[words[i:] for i in range(width)]))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(words) - width + 1))


def long_fingerprint(hashes: np.ndarray, size: int) -> bytes:
    """``size`` bytes of a SimHash over distinct hashes, each 64 bits of it from the hashes mixed anew."""
    words = []
    for seed in range(1, -(-size // 8) + 1):
        ones = np.zeros(64, np.int64)
        for start in range(0, len(hashes), BLOCK):
            mixed = (hashes[start : start + BLOCK] ^ np.uint64(seed * _MIX & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(32)
            ones += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        words.append(np.packbits(2 * ones > len(hashes)))
    return np.concatenate(words)[:size].tobytes()


def parities(hashes: np.ndarray) -> bytes:
    """A bit for each remainder of the hashes of a set: whether an odd number of them has it.

    Two sets differ in as many hashes at least as these bits differ; the longer ones are folded to the length of the others.
    """
    bits = max(8 * LEAST_PARITIES, 1 << max(len(hashes) - 1, 0).bit_length())
    counts = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts.astype(np.uint8) & 1).tobytes()


def _levels(parts: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the place of each of the parities (-1: none), and those as long or, folded, twice as long as rows of words."""
    length, levels = np.array([len(p) for p in parts], np.int64), {}
    for size in np.unique(length).tolist():
        own, double = np.flatnonzero(length == size), np.flatnonzero(length == 2 * size)
        halves = np.frombuffer(b"".join(parts[i] for i in double), np.uint64).reshape(-1, 2, size // 8)
        rows = np.frombuffer(b"".join(parts[i] for i in own), np.uint64).reshape(-1, size // 8)
        place = np.full(len(parts), -1, np.int64)
        place[own], place[double] = np.arange(len(own)), len(own) + np.arange(len(double))
        levels[size] = place, np.concatenate([rows, halves[:, 0] ^ halves[:, 1]])
    return levels


def _fits(i: np.ndarray, j: np.ndarray, sizes: np.ndarray, levels: dict, similarity: float) -> np.ndarray:
    """Whether the pairs (i, j) of sets can be as similar as that, by their sizes and parities."""
    most = (1 - similarity) / (1 + similarity) * (sizes[i] + sizes[j]) + 1e-6
    fits, left = np.zeros(len(i), bool), np.abs(sizes[i] - sizes[j]) <= most
    # Sets that can be similar differ by less than half in size, so their parities are as long or twice as long.
    for size in sorted(levels, reverse=True):
        place, rows = levels[size]
        at = np.flatnonzero(left & (place[i] >= 0) & (place[j] >= 0))
        step = max(COMPARED // size, 1)
        for part in (at[start : start + step] for start in range(0, len(at), step)):
            fits[part] = np.bitwise_count(rows[place[i[part]]] ^ rows[place[j[part]]]).sum(axis=1) <= most[part]
        left[at] = False
    return fits


def _near_tree(nodes: np.ndarray, bits: np.ndarray, most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links from each member to those not reached yet that differ in at most ``most`` bits; ``bits`` is (members, 2)."""
    ends, roots = [], []
    left = np.arange(len(nodes))
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(bits[left] ^ bits[at]).sum(axis=1) <= most
            if near.any():
                reached, left = left[near], left[~near]
                ends.append(nodes[reached])
                roots.append(np.full(len(reached), nodes[at]))
                front += reached[::-1].tolist()
    return ends, roots


def _near_links(keys: np.ndarray, nodes: np.ndarray, bits: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of lists that lie whole in these sorted arrays."""
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    sizes = np.diff(edges)
    pairs = edges[:-1][sizes == 2]
    near = np.bitwise_count(bits[pairs] ^ bits[pairs + 1]).sum(axis=1) <= most
    a, b = [nodes[pairs + 1][near]], [nodes[pairs][near]]
    for start, size in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        ends, roots = _near_tree(nodes[start : start + size], bits[start : start + size], most)
        a += ends
        b += roots
    return np.concatenate(a), np.concatenate(b)


def prefix_length(size: int, similarity: float) -> int:
    """Of how many first shingles, in any one order, a set as large as that shares one with every set as similar as that."""
    return size - math.ceil(similarity * size - 1e-6) + 1


def prefix(hashes: np.ndarray, frequent: np.ndarray, counts: np.ndarray, similarity: float) -> bytes:
    """Names of the first shingles of a set: those not in ``frequent`` (sorted) by hash, then the others by count and hash."""
    if not len(hashes):
        return b""
    weight = np.zeros(len(hashes), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        weight = np.where(frequent[at] == hashes, counts[at], 0)
    first = hashes[np.argsort(weight, kind="stable")[: prefix_length(len(hashes), similarity)]]
    return first.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NAME_BYTES].tobytes()


def _names(prefixes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The names in these prefixes as longs, and how many each prefix has."""
    flat = np.frombuffer(b"".join(prefixes), np.uint8).reshape(-1, NAME_BYTES)
    wide = np.zeros((len(flat), 8), np.uint8)
    wide[:, :NAME_BYTES] = flat
    return wide.view("<i8").ravel(), np.array([len(p) // NAME_BYTES for p in prefixes], np.int64)


def _pairs_across(keys: np.ndarray, groups: np.ndarray, sizes: np.ndarray, similarity: float):
    """Places (i, j) of all pairs in whole lists, sorted by key and size, of two groups and of sizes that can be similar."""
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    long = np.diff(edges) > SHORT
    # Short lists: each member with the next one, the one after that, and so on while its list goes on.
    ends = np.repeat(np.where(long, 0, edges[1:]), np.diff(edges))
    at, step = np.arange(len(keys)), 1
    while len(at):
        at = at[at + step < ends[at]]
        at = at[similarity * sizes[at + step] <= sizes[at] + 1e-6]
        apart = at[groups[at] != groups[at + step]]
        if len(apart):
            yield apart, apart + step
        step += 1
    # Long lists: members of the largest group are not compared among themselves.
    for start, end in zip(edges[:-1][long].tolist(), edges[1:][long].tolist()):
        own, size = groups[start:end], sizes[start:end]
        kinds, of, many = np.unique(own, return_inverse=True, return_counts=True)
        if len(kinds) == 1:
            continue
        rank = np.where(of == many.argmax(), -1, np.arange(len(own)))
        for i in np.flatnonzero(rank >= 0).tolist():
            fits = (rank < i) & (of != of[i]) & (similarity * np.maximum(size, size[i]) <= np.minimum(size, size[i]) + 1e-6)
            near = np.flatnonzero(fits)
            if len(near):
                yield near + start, np.full(len(near), i + start)


def _frequent(rows: DataFrame, total: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in several of the counted texts, sorted, and in how many: at most ``FREQUENT`` of them."""

    def read(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_set(t, width) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["shingle"])

    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(-(-total // COUNTED) or 1)) == 0).select("text")
    counts = some.mapInArrow(read, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)
    found = counts.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    shingles, n = found["shingle"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(shingles)
    return shingles[order], n[order]


def _verified(rows: DataFrame, every: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose whole sets have the similarity."""
    involved = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # One row of each set that has to be looked at.
    chosen = checkpointed(every.select("node", "doc_id").join(involved, "node"))
    chosen = counted_broadcast(chosen, chosen.count())

    def sets_of(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_set(t, width).view(np.int64) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    texts = rows.join(chosen, rows["doc_id"].eqNullSafe(chosen["doc_id"])).select("node", "text")
    sets = checkpointed(texts.mapInArrow(sets_of, "node long, shingles array<long>").dropDuplicates(["node"]))
    left = lookup(pairs, sets.select(F.col("node").alias("a"), F.col("shingles").alias("one")), "a", "inner")
    both = lookup(left, sets.select(F.col("node").alias("b"), F.col("shingles").alias("two")), "b", "inner")

    def verify(batches):
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("one"), batch.column("two")):
                one, two = one.values.to_numpy(), two.values.to_numpy()
                shared = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(shared >= similarity * (len(one) + len(two) - shared) - 1e-9)
            taken = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([taken.column("a"), taken.column("b")], ["a", "b"])

    return both.select("a", "b", "one", "two").mapInArrow(verify, "a long, b long")


def _whole_runs(batches):
    """The batches as tables that cut no run of equal values of the first column, which is sorted."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        inside = int(np.searchsorted(keys, keys[-1], side="left"))
        # A batch that is one run may go on with the last one of those held.
        if inside:
            whole = held.num_rows - len(keys) + inside
            yield held.slice(0, whole).combine_chunks()
            held = held.slice(whole)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _left_out(nodes: DataFrame, placed: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of nodes (node, size, prefix, parities) in two components that can be similar."""

    def listed(batches):
        for batch in batches:
            keys, many = _names(batch.column("prefix").to_pylist())
            columns = [np.repeat(batch.column(c).to_numpy(), many) for c in ("node", "component")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys, *columns)], ["key", "node", "component"])

    def led(batches):
        for table in _whole_runs(batches):
            key, node, component = (_column(table, c) for c in ("key", "node", "component"))
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            many = np.diff(np.append(starts, len(key)))
            several = np.minimum.reduceat(component, starts) < np.maximum.reduceat(component, starts)
            kept = np.repeat(several, many)
            columns = [np.repeat(node[starts], many), node, key, component]
            yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in columns], ["leader", "node", "key", "component"])

    def across(batches):
        for table in _whole_runs(batches):
            # A member is a node at a leader, an entry is a member in a list; a list has one leader.
            lists = table.column("keys").combine_chunks()
            member = np.repeat(np.arange(table.num_rows), np.diff(lists.offsets.to_numpy()))
            key = lists.flatten().to_numpy()
            node, component, size = (_column(table, c) for c in ("node", "component", "size"))
            order = np.lexsort([size[member], key])
            key, member = key[order], member[order]
            levels = _levels(table.column("parities").to_pylist())
            found, shared = np.zeros(0, np.int64), np.zeros(0, np.int64)
            waiting, many = [], 0

            def joined():
                """What was found so far and waits, each pair of members once."""
                i, j = (np.concatenate([w[k] for w in waiting]) for k in (0, 1))
                i, j = np.minimum(i, j), np.maximum(i, j)
                fits = _fits(i, j, size, levels, similarity)
                pairs, n = np.unique(i[fits] * table.num_rows + j[fits], return_counts=True)
                every, at = np.unique(np.concatenate([found, pairs]), return_inverse=True)
                return every, np.bincount(at, np.concatenate([shared, n]), len(every)).astype(np.int64)

            for i, j in _pairs_across(key, component[member], size[member], similarity):
                waiting.append((member[i], member[j]))
                many += len(i)
                if many >= PAIRS:
                    found, shared = joined()
                    waiting, many = [], 0
            if waiting:
                found, shared = joined()
            for start in range(0, len(found), PAIRS):
                told = found[start : start + PAIRS]
                i, j = told // table.num_rows, told % table.num_rows
                columns = [np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), np.minimum(size[i], size[j]),
                           np.maximum(size[i], size[j]), shared[start : start + PAIRS]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "small", "large", "shared"])

    lists = nodes.select("node", "prefix").join(placed, "node").mapInArrow(listed, "key long, node long, component long")
    dealt = lists.repartition("key").sortWithinPartitions("key", "node")
    entries = dealt.mapInArrow(led, "leader long, node long, key long, component long")
    members = entries.groupBy("leader", "node").agg(F.collect_list("key").alias("keys"), F.any_value("component").alias("component"))
    # A node has no more leaders than its prefix has shingles.
    whole = members.join(nodes.select("node", "size", "parities"), "node")
    met = whole.select("leader", "node", "component", "size", "parities", "keys").repartition("leader").sortWithinPartitions("leader", "node")
    pairs = met.mapInArrow(across, "a long, b long, small long, large long, shared long")
    # What two sets share is in the prefixes of both, or behind the prefix of the one whose prefix ends first in the order.
    behind = F.ceil(similarity * F.col("large") - 1e-6) - 1
    enough = F.col("shared") + behind >= F.lit(similarity / (1 + similarity)) * (F.col("small") + F.col("large")) - 1e-6
    return pairs.groupBy("a", "b", "small", "large").agg(F.sum("shared").alias("shared")).where(enough).select("a", "b")


def _likely(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sizes and parities leave them similar."""
    sides = nodes.select("node", "size", "parities")
    for end in ("a", "b"):
        pairs = lookup(pairs, sides.select(*[F.col(c).alias(end if c == "node" else f"{c}_{end}") for c in sides.columns]), end, "inner")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.concatenate([batch.column(f"size_{end}").to_numpy() for end in ("a", "b")])
            levels = _levels([p for end in ("a", "b") for p in batch.column(f"parities_{end}").to_pylist()])
            at = np.arange(batch.num_rows)
            taken = batch.filter(pa.array(_fits(at, at + batch.num_rows, sizes, levels, similarity)))
            yield pa.RecordBatch.from_arrays([taken.column("a"), taken.column("b")], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def similar_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                   similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, node, component) for every row: rows share a component exactly if verified links join them.

    A node is a set of shingles (``width`` words; a shorter text: all its words; texts without words share the empty set),
    so copies meet before anything is paired. Links have a Jaccard similarity of at least ``similarity``, computed on the
    whole sets. Most are found by fingerprints, where the members of a similar group are linked as a tree, never pair by
    pair; all pairs of different groups that may be left are then found by the prefixes of their sets, so none is missed.
    Nulls, repeated rows and empty tables as in ``groups``.
    """
    if not SIMILARITY <= similarity <= 1:
        raise ValueError(f"the lists are laid out for similarities from {SIMILARITY}")
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    total = rows.count()
    tables, width_of_key = next((t, w) for most, t, w in TABLES if total <= most)
    kind = rows.schema["doc_id"].dataType
    frequent, counts = _frequent(rows, total, width)
    schema = StructType([
        StructField("doc_id", kind), StructField("node", LongType()), StructField("size", LongType()), StructField("long", BinaryType()),
        StructField("prefix", BinaryType()), StructField("parities", BinaryType())])

    def read(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_set(t, width) for t in part.column(1).to_pylist()]
                nodes = [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets]
                made = [long_fingerprint(s, tables * width_of_key) for s in sets]
                first = [prefix(s, frequent, counts, similarity) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(made, pa.binary()),
                     pa.array(first, pa.binary()), pa.array([parities(s) for s in sets], pa.binary())],
                    ["doc_id", "node", "size", "long", "prefix", "parities"],
                )

    prints = checkpointed(rows.mapInArrow(read, schema))
    # Copies meet in the tasks first: a node that most rows share sends one row for each task.
    every = checkpointed(prints.groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.any_value("long").alias("long"), F.any_value("size").alias("size"),
        F.any_value("prefix").alias("prefix"), F.any_value("parities").alias("parities")))
    nodes = every.where("size > 0")

    def listed(batches):
        for batch in batches:
            whole = np.frombuffer(b"".join(batch.column("long").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            keys = np.zeros((batch.num_rows, tables), np.int64)
            for i in range(width_of_key):
                keys = keys << 8 | whole[:, i::width_of_key]
            keys |= np.arange(tables, dtype=np.int64) << 8 * width_of_key
            bits = np.ascontiguousarray(whole[:, :16]).view(np.int64)
            columns = [keys.ravel(), *(np.repeat(c, tables) for c in (batch.column("node").to_numpy(), bits[:, 0], bits[:, 1]))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "x", "y"])

    lists = nodes.select("node", "long").mapInArrow(listed, "key long, node long, x long, y long")

    def near(batches):
        held = None
        for batch in batches:
            more = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held = more if held is None else [np.concatenate([h, m]) for h, m in zip(held, more)]
            whole = int(np.searchsorted(held[0], held[0][-1], side="left")) if len(held[0]) else 0
            if whole:
                yield told(*(h[:whole] for h in held))
                held = [h[whole:].copy() for h in held]
        if held is not None and len(held[0]):
            yield told(*held)

    def told(key, node, x, y):
        a, b = _near_links(key, node, np.stack([x, y], axis=1).view(np.uint64), NEAR_BITS)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = lists.repartition("key").sortWithinPartitions("key", "node")
    least, most = F.least("a", "b"), F.greatest("a", "b")
    pairs = checkpointed(dealt.mapInArrow(near, "a long, b long").select(least.alias("a"), most.alias("b")).distinct())
    pairs = checkpointed(_likely(pairs, nodes, similarity))
    roots = components(_verified(rows, every, pairs, width, similarity))
    placed = checkpointed(every.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component")))
    more = _verified(rows, every, checkpointed(_left_out(nodes, placed, similarity)), width, similarity)
    # The links left out join whole components.
    for end in ("a", "b"):
        more = more.join(placed.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")), end)
    again = components(more.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).withColumnRenamed("node", "component")
    placed = lookup(placed, again, "component").select("node", F.coalesce("root", "component").alias("component"))
    # Rows of a hot node are spread by a hash of their ids.
    told = prints.select("doc_id", "node", F.xxhash64("doc_id").alias("spread"))
    return lookup(told, placed, "node", "inner").select("doc_id", "node", "component")
