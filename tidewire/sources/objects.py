"""Objects out of JSON files that hold one list or page over several lines, each file read by many tasks.

Spark cuts files at closing braces, so a block of a file is a run of fragments. A task cannot know where in the document
its block begins. It therefore reports what the block does to the open brackets, for a begin outside and inside of a
string; these short reports, put together file by file, tell each block how it begins. Then every block gives out the
objects that it holds whole, and the pieces of those that cross its edges, which are joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.skew import BROADCAST_ROWS, materialize, union_all

# A whole string, or the quote of one that goes on behind a brace.
_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*+"|"', re.DOTALL)
_STRING = re.compile(rb'(?:[^"\\]|\\.)*+\\?', re.DOTALL)
_COLON = re.compile(rb"\s*:\s*")
# Open brackets: object, list, page (an object with a list under "tweets"), and that list.
_OBJECT, _LIST, _PAGE, _LISTED = "{", "[", "P", "T"
_WRAPPERS = re.compile(r"(?:\[|PT)*")
_STRAY = re.compile(rb"[^\s,\]]")
_TWEETS = b'"tweets"'
_QUOTE, _BACKSLASH, _OPEN, _CLOSE, _OPEN_LIST, _CLOSE_LIST, _OPEN_TWEETS = b'"\\{}[]T'
_MARKS = np.zeros(256, bool)
_MARKS[list(b'"{}[]')] = True
# Bytes that are looked at in one go.
_STRETCH = 1 << 20
# Files that Spark never splits, by their names; these codecs need no library of the system.
_PACKED = (".gz", ".deflate")


class Signs:
    """Quotes and brackets of some bytes, found for the whole stretch at once, whether or not it begins in a string."""

    def __init__(self, data: bytes):
        self.data = data
        buffer = np.frombuffer(data, np.uint8)
        self.at = np.flatnonzero(_MARKS[buffer])
        self.kinds = buffer[self.at]
        self.quotes = self.kinds == _QUOTE
        # Quotes behind an odd number of backslashes, by their place among all quotes: in a string they do not end it.
        self.odd: list[int] = []
        if b'\\"' in data:
            places = self.at[self.quotes]
            behind = np.flatnonzero((places > 0) & (buffer[places - 1] == _BACKSLASH))
            back = np.flatnonzero(buffer == _BACKSLASH)
            first = np.concatenate(([True], np.diff(back) > 1))
            begins = back[np.maximum.accumulate(np.where(first, np.arange(len(back)), 0))]
            run = places[behind] - begins[np.searchsorted(back, places[behind] - 1)]
            self.odd = behind[run % 2 == 1].tolist()

    def outside(self, in_string: bool) -> tuple[list[int], list[int], dict[int, int], bool]:
        """Places and signs of the brackets that are in no string; where the keys of lists under "tweets" begin; whether
        the stretch ends in a string."""
        turns, begin = self.quotes, int(in_string)
        if self.odd:
            turns, opened, numbers = turns.copy(), 0, np.flatnonzero(self.quotes)
            for before, place in enumerate(self.odd):
                if (place - before + opened + begin) % 2:
                    turns[numbers[place]] = False
                else:
                    opened += 1
        count = np.cumsum(turns)
        free = np.flatnonzero(~self.quotes & ((count + begin) % 2 == 0))
        places, signs, keys = self.at[free], self.kinds[free], {}
        if _TWEETS in self.data:
            turned = self.at[turns]
            lists = np.flatnonzero((signs == _OPEN_LIST) & (count[free] > 1))
            last = count[free[lists]] - 1
            for number, key, end in zip(lists.tolist(), turned[last - 1].tolist(), turned[last].tolist()):
                place = int(places[number])
                if self.data[key : end + 1] == _TWEETS and _COLON.fullmatch(self.data, end + 1, place):
                    signs[number], keys[place] = _OPEN_TWEETS, key
        return places.tolist(), signs.tolist(), keys, bool((int(count[-1]) if len(count) else 0) + begin & 1)


class Walk:
    """Reads fragments one after another and keeps track of brackets, strings and the object being read.

    ``closed`` are closing brackets whose opening ones lie before the begin, ``stack`` the brackets opened since and still
    open. With ``known`` the stack is that of the whole file, and objects are collected into ``found``.
    """

    def __init__(self, stack: str = "", in_string: bool = False, known: bool = False):
        self.stack, self.closed, self.in_string, self.known = list(stack), [], in_string, known
        self.found: list[tuple[str, bytes]] = []
        wrappers = _WRAPPERS.match(stack).end() if known else 0
        # Depth of the object being read, and its bytes so far. One begun before the block goes on with its first byte.
        self.depth = wrappers if known and stack[wrappers : wrappers + 1] == _OBJECT else None
        self.pieces: list[bytes] = []
        self.begun_before = self.depth is not None
        self.stray: list[bytes] = []

    def _pop(self, sign: str) -> None:
        if self.stack:
            self.stack.pop()
        else:
            self.closed.append(sign)

    def _plain(self, text: bytes, in_string: bool) -> None:
        """What stands outside of everything; a string with a brace in it is told by its quote."""
        if not in_string and not _STRAY.search(text):
            return
        for part in text.split(b"}"):
            at = 0
            while True:
                if in_string:
                    at = _STRING.match(part, at).end()
                    if at >= len(part):
                        break
                    in_string, at = False, at + 1
                match = _TOKEN.search(part, at)
                tokens = [part[at : match.start() if match else len(part)], *([match.group()] if match else [])]
                self.stray += [t.strip() for t in tokens if _STRAY.search(t)]
                if match is None:
                    break
                in_string, at = match.group() == b'"', match.end()

    def feed(self, signs: Signs) -> None:
        """Some fragments, with the closing braces between and behind them."""
        data, stack, known, begun, gap, start = signs.data, self.stack, self.known, self.in_string, 0, 0
        places, kinds, keys, self.in_string = signs.outside(begun)
        for place, sign in zip(places, kinds):
            if known and not stack:
                self._plain(data[gap : keys.get(place, place)], begun and not gap)
            gap = place + 1
            if sign == _CLOSE:
                if known and not stack:
                    self.stray.append(b"}")
                    continue
                self._pop("}")
                if self.depth is not None and len(stack) <= self.depth:
                    self._give("object", data[start:gap])
            elif sign == _OPEN:
                if known and self.depth is None and _WRAPPERS.fullmatch("".join(stack)):
                    self.depth, start, self.pieces, self.begun_before = len(stack), place, [], False
                stack.append(_OBJECT)
            elif sign == _OPEN_LIST:
                stack.append(_LIST)
            elif sign == _CLOSE_LIST:
                if known and not stack:
                    self.stray.append(b"]")
                else:
                    self._pop("]")
            else:
                if known and self.depth is not None and len(stack) == self.depth + 1:
                    # The object is a page: what it lists are the objects.
                    self._give("page", b"")
                if not known or (stack and stack[-1] in (_OBJECT, _PAGE)):
                    # Only the list's own object is a page: it is opened anew as one.
                    self._pop("}")
                    stack += [_PAGE, _LISTED]
                else:
                    stack.append(_LIST)
        if known and not stack:
            self._plain(data[gap:], begun and not gap)
        if self.depth is not None:
            self.pieces.append(data[start:])

    def _give(self, kind: str, last: bytes) -> None:
        """An object is complete, or turned out to be a page."""
        if kind == "object" or self.begun_before:
            self.found.append(("end " + kind if self.begun_before else kind, b"".join(self.pieces) + last))
        self.depth, self.pieces, self.begun_before = None, [], False


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "}").text(path)
    named = (("file_path", "file"), ("file_block_start", "block"), ("file_block_length", "length"), ("file_size", "size"))
    meta = [F.col(f"_metadata.{m}").alias(a) for m, a in named]
    return rows.select(F.col("value").cast("binary").alias("value"), *meta)


def _alone() -> Column:
    """Whether a block is a whole file, which begins outside of everything."""
    return (F.col("block") == 0) & (F.col("length") == F.col("size"))


def _by_block(batches: Iterator[pa.RecordBatch], *columns: str):
    """(row of the other columns, values) of neighbouring fragments of one block."""
    for batch in batches:
        rows = batch.num_rows
        cut = np.zeros(max(rows - 1, 0), bool)
        for name in ("file", "block"):
            column = batch.column(name)
            cut |= pc.not_equal(column.slice(1), column.slice(0, max(rows - 1, 0))).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(cut) + 1).tolist(), rows] if rows else []
        for start, stop in zip(edges, edges[1:]):
            yield tuple(batch.column(c)[start].as_py() for c in columns), batch.column("value").slice(start, stop - start)


def _stretches(values: pa.Array, held: bytes | None = None) -> Iterator[bytes]:
    """Fragments put together again, with a brace behind each."""
    ends = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(values):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _STRETCH)))
        part = values.slice(start, stop - start)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), b"}")[0].as_py() + b"}"
        yield joined if held is None else held + b"}" + joined
        start, held = stop, None
    if held is not None:
        yield held + b"}"


_REPORT = (
    "file string, block long, size long, bytes long, closed string, opened string, quoted boolean, "
    "closed_in string, opened_in string, quoted_in boolean"
)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def told(key, walks, size):
        own = [x for w in walks for x in ("".join(w.closed), "".join(w.stack), w.in_string)]
        return dict(zip(("file", "block", "size", "bytes", "closed", "opened", "quoted", "closed_in", "opened_in", "quoted_in"),
                        (*key, size, *own)))

    last, walks, size = None, [], 0
    schema = pa.schema([(n, pa.bool_() if t == "boolean" else pa.int64() if t == "long" else pa.string())
                        for n, t in (x.split() for x in _REPORT.split(", "))])
    for key, values in _by_block(batches, "file", "block", "size"):
        if key != last:
            if last is not None:
                yield pa.RecordBatch.from_pylist([told(last, walks, size)], schema)
            last, walks, size = key, [Walk(), Walk(in_string=True)], 0
        for data in _stretches(values):
            size += len(data)
            signs = Signs(data)
            for walk in walks if key[1] else walks[:1]:
                walk.feed(signs)
    if last is not None:
        yield pa.RecordBatch.from_pylist([told(last, walks, size)], schema)


_BEGIN = "file string, block long, stack string, quoted boolean, began long, open_end boolean, final boolean"


def _open_end(taken: int, size: int) -> bool | None:
    """Whether no brace follows the last fragment: every byte is in a fragment or is the brace behind it, but for a byte
    order mark; a packed file tells nothing."""
    return {0: False, -3: False, 1: True, -2: True}.get(taken - size)


def _begins(reports: pd.DataFrame) -> pd.DataFrame:
    """How each block of one file begins. ``open_end``: no brace follows its last fragment; null where that is not known."""
    reports = reports.sort_values("block")
    stack, quoted, began, made = "", False, -1, []
    for row in reports.itertuples(index=False):
        closed, opened, after = (row.closed_in, row.opened_in, row.quoted_in) if quoted else (row.closed, row.opened, row.quoted)
        made.append([row.file, row.block, stack, quoted, began, False, False])
        wrappers = _WRAPPERS.match(stack).end()
        kept = stack[: max(0, len(stack) - len(closed))]
        goes_on = stack[wrappers:] != "" and len(kept) > wrappers
        stack, quoted = kept + opened, after
        inside = stack[_WRAPPERS.match(stack).end() :] != ""
        began = (began if goes_on else row.block) if inside else -1
    made[-1][5:] = [_open_end(int(reports["bytes"].sum()), int(reports["size"].iloc[0])), True]
    return pd.DataFrame(made, columns=[x.split()[0] for x in _BEGIN.split(", ")])


_PIECE = "file string, began long, block long, kind string, value binary"


_INSIDE, _CROSSING = ("object", "stray"), ("piece", "end object", "end page")


def _pieces(
    batches: Iterator[pa.RecordBatch], kinds: tuple[str, ...] = _INSIDE + _CROSSING, begins: dict | None = None
) -> Iterator[pa.RecordBatch]:
    """Objects and pieces of the blocks. How a block begins is told by ``begins``, else by the rows; one that is a whole
    file begins outside, and what its end cuts off is no piece of anything."""
    schema = pa.schema([("file", pa.string()), ("began", pa.int64()), ("block", pa.int64()), ("kind", pa.string()), ("value", pa.binary())])
    told = ("stack", "quoted", "began", "open_end", "final") if begins is None else ()
    state: dict = {"key": None}

    def drain(last: bool) -> pa.RecordBatch:
        file, block, alone, _, _, began, open_end, final = state["key"]
        walk, rows = state["walk"], []
        if last and state["held"] is not None:
            if alone:
                open_end = _open_end(state["taken"], state["size"])
            if open_end is False:
                walk.feed(Signs(state["held"] + b"}"))
            elif state["held"]:
                walk.feed(Signs(state["held"]))
            if open_end is None and not walk.in_string and walk.stack and walk.stack[-1] in (_OBJECT, _PAGE):
                walk.feed(Signs(b"}"))
        for kind, value in walk.found:
            rows.append((file, began if kind.startswith("end ") else block, block, kind, value))
        walk.found = []
        rows += [(file, block, block, "stray", s) for s in walk.stray]
        walk.stray = []
        if last and walk.depth is not None:
            rows.append((file, began if walk.begun_before else block, block, "stray" if alone else "piece", b"".join(walk.pieces)))
        if last and final and (walk.stack or walk.in_string) and walk.depth is None:
            rows.append((file, block, block, "stray", "".join(walk.stack).replace(_PAGE, _OBJECT).replace(_LISTED, _LIST).encode()))
        rows = [r for r in rows if r[3] in kinds]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema.names)

    for (file, block, length, size, *row), values in _by_block(batches, "file", "block", "length", "size", *told):
        if state["key"] is None or (file, block) != state["key"][:2]:
            if state["key"] is not None:
                yield drain(True)
            alone = block == 0 and length == size
            begin = ("", False, -1, None, True) if alone else begins[file, block] if begins is not None else tuple(row)
            state = {"key": (file, block, alone, *begin), "walk": Walk(begin[0], begin[1], True), "held": None, "taken": 0, "size": size}
        # Whether a brace follows the block's last fragment is not known yet.
        for data in _stretches(values.slice(0, len(values) - 1), state["held"]):
            state["walk"].feed(Signs(data))
        state["held"] = values[len(values) - 1].as_py()
        state["taken"] += pc.sum(pc.binary_length(values)).as_py() + len(values)
        yield drain(False)
    if state["key"] is not None:
        yield drain(True)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, value, whole): the text of every object in the files' lists and pages, however these are nested.

    An object counts where only lists and pages (objects with a list under ``tweets``) are around it; so do objects one
    behind another without a list. Other values in a list are left out. ``whole`` is false for text that stands outside of
    everything, for an object that the end of its file cuts off, and for the brackets a file leaves open. Blocks are as
    large as Spark's splits of the files; an object is put together in one task, so its size is bounded by memory.
    """
    fragments = _fragments(spark, path)
    packed = reduce(Column.__or__, [F.col("file").endswith(name) for name in _PACKED])
    # Spark reads no file that such a filter rules out, and its splits depend on the files it reads: all reads share it.
    open_files, packed_files = fragments.where(~packed), fragments.where(packed)
    # Most files are one block, whose begin is known. The others are walked once more, to learn how their blocks begin.
    cut = open_files.where(~_alone())
    reports = cut.select("value", "file", "block", "size").mapInArrow(_report, _REPORT)
    begins = materialize(reports.groupBy("file").applyInPandas(_begins, _BEGIN))
    count = begins.count()
    # The blocks are walked twice, for whole objects and for the pieces at their edges, so that no object is written again.
    if count <= BROADCAST_ROWS:
        # One narrow row per block goes to all tasks; fragments stay in the order they are read.
        begin = {"begins": {(r["file"], r["block"]): tuple(r)[2:] for r in begins.collect()}}
        blocks, whole = cut, [open_files, packed_files]
    else:
        placed = cut.withColumn("at", F.monotonically_increasing_id()).join(begins, ["file", "block"])
        blocks, begin = placed.sortWithinPartitions("file", "block", "at").drop("at"), {}
        whole = [open_files.where(_alone()), packed_files]
    inside = union_all([rows.mapInArrow(partial(_pieces, kinds=_INSIDE, begins=begin.get("begins", {})), _PIECE) for rows in whole])
    if not begin:
        inside = inside.unionByName(blocks.mapInArrow(partial(_pieces, kinds=_INSIDE), _PIECE))
    inside = inside.select("file", "value", (F.col("kind") == "object").alias("whole"))
    if count == 0:
        return inside.withColumn("value", F.col("value").cast("string"))
    # Pieces of an object that crosses blocks: as many as it touches blocks.
    parts = blocks.mapInArrow(partial(_pieces, kinds=_CROSSING, **begin), _PIECE).groupBy("file", "began").agg(
        F.array_sort(F.collect_list(F.struct("block", "value"))).alias("parts"), F.bool_or(F.col("kind") == "end object").alias("whole"),
        F.bool_or(F.col("kind") == "end page").alias("page"),
    )
    joined = F.aggregate(F.transform("parts", lambda p: p["value"]), F.lit(b""), lambda a, p: F.concat(a, p))
    crossing = parts.where(~F.col("page")).select("file", joined.alias("value"), "whole")
    return inside.unionByName(crossing).select("file", F.col("value").cast("string").alias("value"), "whole")
