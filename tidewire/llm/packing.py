"""Packing of token sequences into windows of fixed length with bounded space.

Each partition keeps a fixed number of windows open. A document is cut into whole windows first; what remains goes into
the open window it fills best, and where none has room the fullest is emitted and a new one opened. The windows still
open at the end of all partitions are merged by the same rule over small groups of partitions.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.bpe import encode_runs, run_cache
from tidewire.llm.common import checkpointed, slices, worker_cache

WINDOW = 1024
OPEN_WINDOWS = 64
# Partitions whose leftover windows meet in one task: at most this many times OPEN_WINDOWS windows.
MERGE_PARTITIONS = 64
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
_FIELDS = [f.split()[0] for f in PIECES.split(", ")]


class Packer:
    """Best fit into a bounded number of open windows. A window is a list of (length, payload); ``full`` receives it."""

    def __init__(self, window: int, open_windows: int, full):
        self.window, self.most, self.full = window, open_windows, full
        self._room: list[tuple[int, int]] = []  # (room, name) of the open windows, in order
        self._held: dict[int, list] = {}
        self._names = 0

    def add(self, items: list[tuple[int, object]]) -> None:
        """Place items that stay together: they take the window with the least room that still holds them all."""
        size = sum(i[0] for i in items)
        if size == self.window:
            # A whole window needs no open place.
            self.full(items)
            return
        at = bisect_left(self._room, (size, -1))
        if at < len(self._room):
            room, name = self._room.pop(at)
        else:
            if len(self._room) == self.most:
                self.full(self._held.pop(self._room.pop(0)[1]))
            room, name = self.window, self._names
            self._names += 1
            self._held[name] = []
        self._held[name] += items
        if room == size:
            self.full(self._held.pop(name))
        else:
            insort(self._room, (room - size, name))

    def rest(self) -> list[list]:
        left = [self._held[name] for _, name in self._room]
        self._room, self._held = [], {}
        return left


class RankEncoder:
    """Ids of the tokenizer file's vocabulary through its rank file, run by run between blanks.

    ``added`` has the tokenizer file's added tokens: they are found in texts first, and what lies between is encoded.
    """

    def __init__(self, path: str, pattern: str, added: dict[str, int] | None = None):
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._ordinary = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._runs = run_cache(self._whole)
        self._added = {token: id_.to_bytes(4, "little") for token, id_ in (added or {}).items()}
        # Leftmost, then longest.
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")").split

    def _whole(self, text: str) -> bytes:
        return self._ordinary.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not any(token in text for token in self._added):
            return encode_runs(text, self._whole, self._runs)
        parts = self._cut(text)
        return b"".join(
            self._added[part] if i % 2 else encode_runs(part, self._whole, self._runs) for i, part in enumerate(parts) if part
        )


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of a tokenizer file with their ids. Only plain ones: none that strip blanks or stand as single words."""
    import json

    with open(path, encoding="utf-8") as file:
        listed = json.load(file)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in listed):
        raise ValueError(f"an added token of {path} matches by more than its text")
    return {t["content"]: t["id"] for t in listed}


def _rows(made: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*made)) if made else [[] for _ in range(len(_FIELDS) + 1)]
    kinds = [pa.int64()] * len(_FIELDS) + [pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*_FIELDS, "left"])


def pack(
    df: DataFrame,
    vocab: str,
    pattern: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    merge_partitions: int = MERGE_PARTITIONS,
    added: dict[str, int] | None = None,
) -> DataFrame:
    """One row per piece: its document, place and length in the document's ids, CRC-32 and place in a sequence.

    A document's ids are those of its text (null: none; ``added`` tokens inside it are one id each) and then ``end_id``, so every document has a piece; null ids of
    documents and repeated rows are packed like any other row. Every id lies in exactly one piece. Sequences take at
    most ``window`` ids; ``sequence_id`` is the partition's number and a count in it, so a task run again gives the
    same ids. Texts never leave their partition; only pieces of leftover windows are shuffled, and a merging task gets
    those of ``merge_partitions`` partitions, whatever the size of the input.
    """

    def run(batches):
        from pyspark import TaskContext

        encoder = worker_cache(f"pack_{vocab}_{pattern}_{added}", lambda: RankEncoder(vocab, pattern, added))
        base, made, count = TaskContext.get().partitionId() << 32, [], 0

        def full(items, left=False):
            nonlocal count
            offset = 0
            for size, (doc, start, crc, tokens) in items:
                made.append((doc, start, size, crc, tokens, base + count, offset, left))
                offset += size
            count += 1

        packer = Packer(window, open_windows, full)
        tail = end_id.to_bytes(4, "little")
        for batch in batches:
            for part in slices(batch.select([doc_id, text]), text):
                for doc, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = (encoder.encode(value) if value else b"") + tail
                    tokens = len(ids) // 4
                    for start in range(0, tokens, window):
                        cut = ids[4 * start : 4 * (start + window)]
                        packer.add([(len(cut) // 4, (doc, start, zlib.crc32(cut), tokens))])
                yield _rows(made)
                made.clear()
        for items in packer.rest():
            full(items, left=True)
        yield _rows(made)

    columns = df.select(F.col(doc_id).cast("long").alias(doc_id), F.col(text).cast("string").alias(text))
    pieces = checkpointed(columns.mapInArrow(run, PIECES + ", left boolean"))
    done = pieces.where(~F.col("left")).drop("left")
    group = F.shiftright("sequence_id", 32)
    groups = F.floor(group / merge_partitions).cast("int").alias("_group")
    left = pieces.where("left").drop("left").select("*", groups)

    def merge(batches):
        from pyspark import TaskContext

        base, made, count = (1 << 62) + (TaskContext.get().partitionId() << 32), [], 0

        def full(items):
            nonlocal count
            offset = 0
            for size, (doc, start, crc, tokens) in items:
                made.append((doc, start, size, crc, tokens, base + count, offset, False))
                offset += size
            count += 1

        packer, held, current = Packer(window, open_windows, full), [], None
        for batch in batches:
            for row in zip(*[batch.column(n).to_pylist() for n in _FIELDS]):
                doc, start, size, crc, tokens, sequence, _ = row
                if sequence != current and held:
                    packer.add(held)
                    held = []
                current = sequence
                held.append((size, (doc, start, crc, tokens)))
            yield _rows(made)
            made.clear()
        if held:
            packer.add(held)
        for items in packer.rest():
            full(items)
        yield _rows(made)

    dealt = left.repartition("_group").sortWithinPartitions("sequence_id", "offset").drop("_group")
    merged = dealt.mapInArrow(merge, PIECES + ", left boolean").drop("left")
    return done.unionByName(merged)
