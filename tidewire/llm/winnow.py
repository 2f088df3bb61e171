"""Line deduplication by winnowing.

A gram is a run of lines with at least ``NOISE`` words, hashed; a window is a run of lines with at least ``GUARANTEE``
words that would have fewer without its first or without its last line. Of the grams inside each window the one with the
least hash is its fingerprint, so equal windows have equal fingerprints. Fingerprints that occur once settle most texts;
the windows of the others are joined to the first occurrence of the same lines in the order of documents and lines, and the
later ones go. Neighbouring windows overlap to both sides: together they cover every line of every run that came before.
Each deleted line equals an earlier one, so the first of all copies always stays.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import checkpointed, fresh, quoted, slices
from tidewire.operators.skew import lookup

NOISE = 25
GUARANTEE = 50


def read_lines(text: str) -> tuple[list[int], list[int], list[int]]:
    """Places, hashes and words of the lines that have a word; blanks at a line's ends do not count."""
    places, hashes, words = [], [], []
    for place, line in enumerate(text.split("\n")):
        size = len(line.split())
        if size:
            places.append(place)
            hashes.append(xxhash.xxh64_intdigest(line.strip()) - (1 << 63))
            words.append(size)
    return places, hashes, words


def fingerprint_of_starts(
    hashes: list[int], words: list[int], noise: int = NOISE, guarantee: int = GUARANTEE
) -> list[tuple[int, int, int] | None]:
    """For each line the fingerprint (hash, first line, last line) of the shortest window that begins there; from the first
    line on that no window begins with, the list ends. A document shorter than a window is one window."""
    n = len(words)
    ends, end, held = [], 0, 0
    for start in range(n):
        while end < n and held < noise:
            held += words[end]
            end += 1
        if held < noise:
            break
        ends.append(end - 1)
        held -= words[start]
    grams = [
        xxhash.xxh64_intdigest(struct.pack(f"<{e - s + 1}q", *hashes[s : e + 1])) - (1 << 63) for s, e in enumerate(ends)
    ]
    if not grams:
        return []
    chosen, queue, stop, held, put, head = [], [], 0, 0, 0, 0
    for start in range(n):
        while stop < n and held < guarantee:
            held += words[stop]
            stop += 1
        if held < guarantee and start:
            break
        # Grams that end before ``stop`` join the queue, kept so that the least hash, the last of equals, is in front.
        while put < len(ends) and ends[put] < stop:
            while len(queue) > head and grams[queue[-1]] >= grams[put]:
                queue.pop()
            queue.append(put)
            put += 1
        while head < len(queue) and queue[head] < start:
            head += 1
        chosen.append((grams[queue[head]], queue[head], ends[queue[head]]) if head < len(queue) else None)
        held -= words[start]
    return chosen


def winnow(hashes: list[int], words: list[int], noise: int = NOISE, guarantee: int = GUARANTEE) -> list[tuple[int, int, int]]:
    """Fingerprints (hash, first line, last line) of a document, each once."""
    return list(dict.fromkeys(f for f in fingerprint_of_starts(hashes, words, noise, guarantee) if f is not None))


def windows(words: list[int], guarantee: int = GUARANTEE) -> list[tuple[int, int]]:
    """(first line, last line) of all windows: the shortest from each line on, and the shortest up to each line."""
    n, found, end, held = len(words), set(), 0, 0
    for start in range(n):
        while end < n and held < guarantee:
            held += words[end]
            end += 1
        if held < guarantee:
            break
        found.add((start, end - 1))
        held -= words[start]
    start = held = 0
    for end in range(n):
        held += words[end]
        while held - words[start] >= guarantee:
            held -= words[start]
            start += 1
        if held >= guarantee:
            found.add((start, end))
    return sorted(found) if found or not n else [(0, n - 1)]


def _key(doc_id: Column, text: Column) -> Column:
    """A document's identity and place in the order: its id, nulls last, then its text's hash."""
    return F.struct(
        doc_id.isNull().alias("n"), F.coalesce(doc_id.cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("h")
    )


def repeated_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", noise: int = NOISE,
                   guarantee: int = GUARANTEE) -> DataFrame:
    """(key, keep): for every document that loses lines, a flag for each of its lines (split at line feeds)."""
    key_type = "key struct<n:boolean,id:long,h:long>"
    schema = key_type + ", total int, places array<int>, hashes array<long>, words array<int>, grams array<long>"

    def read(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = [read_lines(value or "") for value in part.column("text").to_pylist()]
                totals = [(value or "").count("\n") + 1 for value in part.column("text").to_pylist()]
                grams = [[g for g, _, _ in winnow(hashes, words, noise, guarantee)] for _, hashes, words in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(totals, pa.int32()),
                     *[pa.array([f[i] for f in found], pa.list_(kind)) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int32()))],
                     pa.array(grams, pa.list_(pa.int64()))],
                    ["key", "total", "places", "hashes", "words", "grams"],
                )

    # A row equal to another in id and text is the same document: both get its flags.
    texts = df.select(_key(quoted(doc_id), quoted(text)).alias("key"), quoted(text).cast("string").alias("text"))
    read_once = checkpointed(texts.mapInArrow(read, schema).where(F.size("grams") > 0))
    # Rows of one document twice only make its fingerprints look repeated.
    prints = read_once.select("key.*", F.explode("grams").alias("gram"))
    repeated = prints.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    shared = lookup(prints, repeated, "gram", "left_semi")
    # At most the distinct fingerprints of one document.
    by_doc = shared.groupBy(F.struct("n", "id", "h").alias("key")).agg(F.collect_set("gram").alias("shared"))

    def spread(batches):
        """The windows whose fingerprint occurs again, under a hash of their lines."""
        for batch in batches:
            rows = {name: batch.column(name).to_pylist() for name in ("key", "hashes", "words", "shared")}
            made = []
            for key, hashes, words, grams in zip(*rows.values()):
                grams, starts = set(grams), fingerprint_of_starts(hashes, words, noise, guarantee)
                packed = struct.pack(f"<{len(hashes)}q", *hashes)
                for first, last in windows(words, guarantee):
                    if starts[first] is not None and starts[first][0] in grams:
                        made.append((key["n"], key["id"], key["h"], xxhash.xxh3_128_digest(packed[8 * first : 8 * last + 8]), first, last))
            kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)], ["n", "id", "h", "w", "first", "last"]
            )

    kept = read_once.select("key", "hashes", "words").join(by_doc, "key").dropDuplicates(["key"])
    listed = checkpointed(kept.mapInArrow(spread, "n boolean, id long, h long, w binary, first int, last int"))
    place = F.struct("n", "id", "h", "first")
    first = listed.groupBy("w").agg(F.min(place).alias("src"), F.max(place).alias("end")).where(F.col("src") < F.col("end"))
    later = lookup(listed, first.select("w", "src"), "w", "inner").where(place > F.col("src"))
    # At most two windows for each line of the document.
    gone = later.groupBy(F.struct("n", "id", "h").alias("key")).agg(F.collect_set(F.struct("first", "last")).alias("gone"))
    united = read_once.select("key", "total", "places").join(gone, "key").dropDuplicates(["key"])

    def flags(batches):
        for batch in batches:
            kept = []
            for total, places, gone in zip(*(batch.column(c).to_pylist() for c in ("total", "places", "gone"))):
                keep = np.ones(total, bool)
                places = np.array(places, np.int64)
                for run in gone:
                    keep[places[run["first"] : run["last"] + 1]] = False
                kept.append(keep)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(kept, pa.list_(pa.bool_()))], ["key", "keep"])

    return united.mapInArrow(flags, key_type + ", keep array<boolean>")


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", noise: int = NOISE, guarantee: int = GUARANTEE,
                removed: str = "n_removed") -> DataFrame:
    """All rows of ``df`` with later repeated runs of lines taken out of ``text``, and their number in ``removed``.

    Every line of a run of at least ``guarantee`` words that occurred before, in an earlier document or earlier in the
    same one, goes; so does a document of at least ``noise`` and under ``guarantee`` words that equals an earlier one line
    by line. Shorter runs stay. Blanks at a line's ends do not count, lines without a word neither. Order: id (null ids last), then a hash of the
    text. Lines without a word belong to no run and stay. Null texts stay null; a text that loses all its lines becomes
    empty. A column ``removed`` is replaced, all others pass.
    """
    key, keep = fresh(df, "key", "keep")
    found = repeated_lines(df, doc_id, text, noise, guarantee).select(F.col("key").alias(key), F.col("keep").alias(keep))
    marked = df.withColumn(key, _key(quoted(doc_id), quoted(text))).join(found, key, "left")
    lines = F.split(quoted(text), "\n", -1)
    left = F.array_join(F.filter(lines, lambda line, i: F.get(quoted(keep), i)), "\n")
    gone = F.when(quoted(keep).isNull(), F.lit(0)).otherwise(F.size(F.filter(quoted(keep), lambda k: ~k)))
    cut = marked.withColumns({
        text: F.when(quoted(keep).isNotNull(), left).otherwise(quoted(text)), removed: gone.cast("long"),
    })
    return cut.drop(key, keep)
