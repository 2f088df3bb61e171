"""Byte-level BPE by prefix dynamic programming.

Every prefix of a byte string has one valid encoding, so one valid last token. The table of these last tokens is the
whole encoding: it is read from the end backwards, appended bytes only add entries, and after an edit entries change
only until the table has agreed with the old one for as many bytes as the longest token has.

A token is valid where merging its own bytes by rank gives that token back; two tokens may stand side by side where
merging their joined bytes gives just these two. An encoding is right when all its neighbours may stand side by side.
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tidewire.llm.common import slices, worker_cache

# Entries each generation of a worker's caches holds: bounded memory whatever the corpus.
CACHE_ENTRIES = 300_000
# Prefixes up to this many bytes are kept between pieces.
KNOWN_PREFIX = 24
# Ids decoded at a time.
GATHER = 1 << 18


class Generations(dict):
    """A bounded cache in two generations: when the young one is full it becomes the old one, and what is asked for
    again comes back. ``make`` computes what neither has; keys longer than 64 are not kept."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > 64:
                return found
        self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[key] = value


class Ranks:
    """A rank file and what the prefix tables need to know about its tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.token = {r: t for t, r in self.rank.items()}
        self.longest = max(map(len, self.token.values()))
        # Every ending of a token, with the token's rank where the ending is a token itself.
        self.ending = {t[i:]: -1 for t in self.rank for i in range(len(t))}
        self.ending.update(self.rank)
        # Prefix of a piece -> its last token, the part of the tables that pieces share.
        self.last_of = Generations(None)
        self._beside: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}
        self._parts: dict[int, tuple[int, int]] = {}
        # Whether every merge seen has a higher rank than the merges it is made of, as in vocabularies that were trained.
        self.rising = True

    def merge(self, data: bytes, down_to: int = 1) -> list[int]:
        """Plain merging: the pair of lowest rank first, the leftmost of equals. Only for the bytes of one or two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > down_to:
            ranks = [self.rank.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            at = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[at] == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def alone(self, token: int) -> bool:
        known = self._alone.get(token)
        if known is None:
            known = self._alone[token] = self.merge(self.token[token]) == [token]
        return known

    def parts(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one last; of a single byte, itself twice."""
        known = self._parts.get(token)
        if known is None:
            made = self.merge(self.token[token], 2)
            known = self._parts[token] = (made[0], made[1]) if len(made) == 2 else (token, token)
            self.rising &= len(made) < 2 or max(made) < token
        return known

    def beside(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two valid tokens gives just these two.

        Merges are undone from the latest on, on whichever side it happened, down to the single bytes on both sides of the
        border: a merge across the border that comes before the next undone one would have been made in its stead.
        """
        known = self._beside.get(left << 32 | right)
        if known is None:
            if len(self._beside) > CACHE_ENTRIES:
                self._beside.clear()
            known = self._stays_apart(left, right)
            if not self.rising:
                known = self.merge(self.token[left] + self.token[right]) == [left, right]
            self._beside[left << 32 | right] = known
        return known

    def _stays_apart(self, left: int, right: int) -> bool:
        token, rank = self.token, self.rank
        # Merges with this rank or more come too late to matter. Of equal ranks the leftmost is made first.
        limit = 1 << 60
        while True:
            across = rank.get(token[left] + token[right])
            if across is not None and across < limit:
                return False
            left_open, right_open = len(token[left]) > 1, len(token[right]) > 1
            if not left_open and not right_open:
                return True
            if left_open and (left > right or not right_open):
                limit, left = left, self.parts(left)[1]
            else:
                limit, right = right + 1, self.parts(right)[0]


class PrefixTable:
    """``last[i]`` is the last token of the encoding of the first ``i`` bytes."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", [-1]
        self.append(data)

    def _entry(self, end: int) -> int:
        data, last, ranks = self.data, self.last, self.ranks
        ending, beside = ranks.ending.get, ranks._beside.get
        for start in range(end - 1, -1, -1):
            token = ending(data[start:end])
            if token is None:
                break
            if token >= 0 and ranks.alone(token):
                if start == 0:
                    return token
                fits = beside(last[start] << 32 | token)
                if fits or (fits is None and ranks.beside(last[start], token)):
                    return token
        raise ValueError(f"no token ends at byte {end}")

    def append(self, data: bytes) -> None:
        done = len(self.data)
        self.data += data
        whole, known, put = self.data, self.ranks.last_of, self.last.append
        for end in range(done + 1, min(len(whole), KNOWN_PREFIX) + 1):
            prefix = whole[:end]
            last = known.get(prefix)
            if last is None:
                last = known.old.get(prefix)
                last = self._entry(end) if last is None else last
                known.put(prefix, last)
            put(last)
        for end in range(max(done, KNOWN_PREFIX) + 1, len(whole) + 1):
            put(self._entry(end))

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put ``data`` in the place of bytes ``start:stop``; the number of entries computed anew."""
        old, shift = self.last, len(data) - (stop - start)
        tail = self.data[stop:]
        self.data = self.data[:start] + data + tail
        self.last = old[: start + 1]
        same = 0
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._entry(end))
            same = same + 1 if end - shift > stop and self.last[end] == old[end - shift] else 0
            # Entries look back one token and compare the one before: agreement that long goes on for ever.
            if same >= self.ranks.longest:
                self.last += old[end - shift + 1 :]
                return end - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        found, end = [], len(self.data)
        while end:
            found.append(self.last[end])
            end -= len(self.ranks.token[self.last[end]])
        return found[::-1]


def pack_ids(ids) -> bytes:
    packed = array("I", ids)
    if array("H", [1]).tobytes() != b"\1\0":
        packed.byteswap()
    return packed.tobytes()


# A blank before white space: only there can a piece reach over a blank. All others begin a piece.
_WIDE = re.compile(r" \s")
_CUT = re.compile(r" (?=\S)")


def run_cache(encode) -> Generations:
    """Run of text from one blank to the next, without that blank -> what ``encode`` gives for it with the blank."""
    return Generations(lambda run: encode(" " + run))


def encode_runs(text: str, encode, runs: Generations) -> bytes:
    """``encode(text)``, put together from runs between blanks.

    The splitting pattern joins a blank to what follows it, unless that is white space too. So every blank before
    something else begins a piece, and what lies between two of them splits alike alone and in the text.
    """
    head, *rest = _CUT.split(text) if _WIDE.search(text) else text.split(" ")
    return encode(head) + b"".join(map(runs.__getitem__, rest))


class Encoder:
    """Text -> ids, piece by piece of ``pattern``, through prefix tables."""

    def __init__(self, path: str, pattern: str):
        self.ranks = Ranks(path)
        self.pieces = Generations(self._piece)
        self._split = regex.compile(pattern).findall
        self._runs = run_cache(self._whole)
        # All tokens' bytes end to end, by rank; ranks that no token has are -1 bytes long.
        most = max(self.ranks.token) + 1
        self._sizes = np.array([len(self.ranks.token.get(r, b"")) if r in self.ranks.token else -1 for r in range(most)], np.int64)
        self._starts = np.concatenate([[0], np.cumsum(np.maximum(self._sizes, 0))[:-1]])
        self._bytes = np.frombuffer(b"".join(self.ranks.token.get(r, b"") for r in range(most)), np.uint8)

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.rank.get(data)
        return pack_ids([whole] if whole is not None else PrefixTable(self.ranks, data).ids())

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self._split(text)))

    def encode(self, text: str) -> bytes:
        return encode_runs(text, self._whole, self._runs)

    def decode(self, ids: bytes) -> bytes | None:
        """The bytes of the ids; None where they are no whole ids of the vocabulary."""
        if len(ids) % 4:
            return None
        found = np.frombuffer(ids, "<u4").astype(np.int64)
        if len(found) and (found.max() >= len(self._sizes) or self._sizes[found].min() < 0):
            return None
        parts = [self._gather(found[i : i + GATHER]) for i in range(0, len(found), GATHER)]
        return b"".join(parts)

    def _gather(self, ids: np.ndarray) -> bytes:
        sizes = self._sizes[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(self._starts[ids] - ends + sizes, sizes) + np.arange(ends[-1])
        return self._bytes[places].tobytes()


class EditableText:
    """A text, its pieces and their prefix tables, kept up to date under appends and edits.

    A piece stays when the edit lies beyond all that the pattern saw: two characters behind the piece (white space gives
    its last character to the next piece after a look at what follows) and the three that contractions need; splitting starts again at the first piece that an edit can touch and stops where it meets an
    old boundary behind the edit.
    """

    def __init__(self, path_or_ranks, pattern: str, text: str = ""):
        self.ranks = path_or_ranks if isinstance(path_or_ranks, Ranks) else Ranks(path_or_ranks)
        self._match = regex.compile(pattern).match
        self.text, self.starts, self.tables = "", [], []
        self.replace(0, 0, text)

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, stop: int, text: str) -> None:
        old_starts, old_tables, length = self.starts, self.tables, len(self.text)
        ends = [*old_starts[1:], length]
        keep = 0
        while keep < len(old_starts) and max(ends[keep] + 2, old_starts[keep] + 3) <= start:
            keep += 1
        shift = len(text) - (stop - start)
        self.text = self.text[:start] + text + self.text[stop:]
        self.starts, self.tables = old_starts[:keep], old_tables[:keep]
        behind = {s + shift: i for i, s in enumerate(old_starts) if s >= stop}
        at = old_starts[keep] if keep < len(old_starts) else length
        while at < len(self.text):
            again = behind.get(at)
            if again is not None and at >= start + len(text):
                self.starts += [s + shift for s in old_starts[again:]]
                self.tables += old_tables[again:]
                return
            end = self._match(self.text, at).end()
            self.starts.append(at)
            self.tables.append(self._table(self.text[at:end], old_tables[keep] if keep < len(old_tables) else None))
            at = end

    def _table(self, piece: str, before: PrefixTable | None) -> PrefixTable:
        data = piece.encode()
        if before is not None and data.startswith(before.data) and before.data:
            table = PrefixTable(self.ranks)
            table.data, table.last = before.data, before.last[:]
            table.append(data[len(before.data) :])
            return table
        return PrefixTable(self.ranks, data)

    def ids(self) -> list[int]:
        found: list[int] = []
        for table in self.tables:
            whole = self.ranks.rank.get(table.data)
            found += [whole] if whole is not None else table.ids()
        return found


def _encoder(path: str, pattern: str) -> Encoder:
    return worker_cache(f"bpe_{path}_{pattern}", lambda: Encoder(path, pattern))


def _extended(df: DataFrame, *fields: StructField) -> StructType:
    names = {f.name.lower() for f in fields}
    return StructType([f for f in df.schema if f.name.lower() not in names] + list(fields))


def _with(batch: pa.RecordBatch, schema: StructType, made: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else kept[f.name] for f in schema], schema.names)


def encode(df: DataFrame, vocab: str, pattern: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """Adds ``ids`` (binary: little-endian unsigned 32-bit) and ``n_tokens`` (long) to every row.

    ``vocab`` is a rank file every executor can open, ``pattern`` the splitting pattern. No special tokens: their
    strings are ordinary text. Null text counts as empty (no ids). ``decoded`` adds a column of that name as well, the
    bytes that the ids decode to, in the same pass. Columns named like these are replaced; all others pass. No
    shuffle; a worker holds one slice of texts and bounded caches.
    """
    more = [StructField("decoded", BinaryType())] if decoded else []
    schema = _extended(df, StructField("ids", BinaryType()), StructField("n_tokens", LongType()), *more)

    def run(batches):
        encoder = _encoder(vocab, pattern)
        for batch in batches:
            for part in slices(batch, text):
                found = [encoder.encode(t) if t else b"" for t in part.column(text).to_pylist()]
                made = {"ids": pa.array(found, pa.binary()), "n_tokens": pa.array([len(f) // 4 for f in found], pa.int64())}
                if decoded:
                    made["decoded"] = pa.array([encoder.decode(f) for f in found], pa.binary())
                yield _with(part, schema, made)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, vocab: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary), the bytes of ``ids``; null ids decode to no bytes, and what is no row of whole ids of the
    vocabulary to null. A column ``decoded`` is replaced."""
    schema = _extended(df, StructField("decoded", BinaryType()))

    def run(batches):
        encoder = _encoder(vocab, pattern)
        for batch in batches:
            for part in slices(batch, ids):
                found = [encoder.decode(i) if i else b"" for i in part.column(ids).to_pylist()]
                yield _with(part, schema, {"decoded": pa.array(found, pa.binary())})

    return df.mapInArrow(run, schema)
