"""Secret scanning with a linear-chain conditional random field.

Fixed patterns give the base spans. A chain over a text's tokens then tags each as the begin of a secret, inside one or
outside, from the token's shape, its neighbours and features of the whole text; Viterbi finds the best tagging. Weights
are fitted by likelihood on a bounded sample of texts whose base spans serve as labels, and on generated lines that show
other alphabets and key names.

Most tokens cannot be part of a secret: where a token's scores stay below that of ``outside`` by more than both
transitions can make good, the best tagging has ``outside`` there. Arrays over all tokens of a text tell them; they cut
the chain, and only the stretches between them are decoded, with the same result.
"""

from __future__ import annotations

import random
import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tidewire.llm.common import checkpointed, slices, worker_cache

# The base patterns, least lengths and the group that counts (fixed values).
KINDS = ("assign", "access", "hex")
_PATTERNS = {
    "assign": re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
    ),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
_LEAST = {"assign": 6, "access": 20, "hex": 24}
_VALUE = {"assign": 2, "access": 0, "hex": 0}
# What a text must match for a kind to occur in it at all.
_HINTS = {"assign": "(?i)password|passwd|secret|token|api_?key", "access": "AKIA", "hex": "[0-9a-f]{24}"}
ADDED = "crf"

OUTSIDE, BEGIN, INSIDE = range(3)
# Texts with and without base spans the weights are fitted on, at most; tokens on each side of a span in a training line.
SAMPLE = 200
AROUND = 8
# A chain is at most this many characters of a text, cut at a line feed or else a blank where there is one.
CHAIN = 1 << 20
CACHE_ENTRIES = 500_000
# Words that name secrets.
NAMES = frozenset(
    "password passwd passphrase pwd pass secret token apikey api key auth authorization bearer credential credentials "
    "private access signature session cookie client".split()
)
_token = re.compile(r"[^\W_]+|\S")
_switch = re.compile(r"[0-9]+|[A-Z]+|[a-z]+|[^0-9A-Za-z]+")


def base_spans(text: str, kinds=KINDS) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start, then kind as listed."""
    found = []
    for kind in kinds:
        least, value = _LEAST[kind], _VALUE[kind]
        for match in _PATTERNS[kind].finditer(text):
            if match.end(value) - match.start(value) >= least:
                found.append((match.start(), KINDS.index(kind), match.end()))
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def value_spans(text: str) -> list[tuple[int, int]]:
    """The secrets' own characters among the base spans, united where they overlap."""
    found = sorted(
        match.span(_VALUE[kind]) for kind in KINDS for match in _PATTERNS[kind].finditer(text)
        if match.end(_VALUE[kind]) - match.start(_VALUE[kind]) >= _LEAST[kind]
    )
    united: list[tuple[int, int]] = []
    for start, end in found:
        if united and start < united[-1][1]:
            united[-1] = (united[-1][0], max(end, united[-1][1]))
        else:
            united.append((start, end))
    return united


def _bucket(value: float, edges: tuple) -> int:
    return sum(value >= e for e in edges)


def kind_of(token: str) -> str:
    """A token's coarse shape: itself for a sign, else which characters it is made of."""
    if len(token) == 1 and not token.isalnum():
        return token if token.isascii() else "sign"
    if not token.isascii():
        return "foreign"
    lower, upper, digit = (any(map(test, token)) for test in (str.islower, str.isupper, str.isdigit))
    if digit:
        return "digits" if not (lower or upper) else "mixed" if lower and upper else "lower+digits" if lower else "upper+digits"
    return "both" if lower and upper and not token.istitle() else "title" if lower and upper else "lower" if lower else "upper"


def own_features(token: str) -> list[str]:
    """Features of the token alone."""
    size, kind = len(token), kind_of(token)
    sized = _bucket(size, (2, 4, 6, 8, 12, 16, 20, 24, 32, 40, 64))
    found = ["bias", f"kind {kind}", f"size {sized}", f"kind {kind} size {_bucket(size, (8, 16, 24, 32))}"]
    if token.lower() in NAMES:
        found.append("name")
    if kind in ("mixed", "lower+digits", "upper+digits", "both"):
        found.append(f"switches {_bucket(len(_switch.findall(token)), (2, 3, 4, 6, 9, 14))}")
        found.append(f"distinct {_bucket(len(set(token)), (4, 6, 8, 10, 12, 16))}")
        if not set(token.lower()) - set("0123456789abcdef"):
            found.append(f"hex {_bucket(size, (8, 16, 24, 32, 40))}")
    return found


def around_features(kinds: list[str], names: list[bool], glued: list[bool], at: int, file: list[str]) -> list[str]:
    """Features of a token's neighbours and of its text. ``glued[i]``: no blank between tokens ``i - 1`` and ``i``."""
    n = len(kinds)
    before = kinds[at - 1] if at else "edge"
    found = [
        f"before {before}", f"second before {kinds[at - 2] if at > 1 else 'edge'}", f"after {kinds[at + 1] if at + 1 < n else 'edge'}",
        f"glued {glued[at]}", f"glued after {at + 1 < n and glued[at + 1]}",
        f"name {any(names[max(0, at - 5) : at])} {kinds[at]}",
    ]
    return found + file


def file_features(text: str) -> list[str]:
    """Features of a whole text: share of assignment signs, whether it names secrets, its size."""
    signs = (text.count("=") + text.count(":") + text.count("{")) / max(len(text), 1)
    return [
        f"file signs {_bucket(signs, (0.0005, 0.003, 0.01, 0.03))}",
        f"file names {any(n in text for n in ('password', 'secret', 'token', 'key'))}",
        f"file size {_bucket(len(text), (200, 1000, 5000, 50_000))}",
    ]


def tokens_of(text: str) -> tuple[list[str], list[int], list[bool]]:
    """Tokens, where they start, and whether each is glued to the one before."""
    words, starts, glued, end = [], [], [], -1
    for match in _token.finditer(text):
        words.append(match.group())
        starts.append(match.start())
        glued.append(match.start() == end)
        end = match.end()
    return words, starts, glued


def line_features(words: list[str], glued: list[bool], file: list[str]) -> list[list[str]]:
    kinds, names = [kind_of(w) for w in words], [w.lower() in NAMES for w in words]
    return [own_features(w) + around_features(kinds, names, glued, i, file) for i, w in enumerate(words)]


def training_lines(text: str, most: int = 2) -> list[tuple[list[list[str]], list[int]]]:
    """(features, tags) of tokens around the first base spans and around the longest tokens that are in none."""
    file, lines = file_features(text), []
    spans = value_spans(text)
    longest = sorted(((-len(m.group()), m.start()) for m in _token.finditer(text[:CHAIN])))[:most]
    places = [s for s, _ in spans[:most]] + [s for _, s in longest if not any(a <= s < b for a, b in spans)]
    for place in sorted(set(places)):
        low, high = max(0, place - 40 * AROUND), place + 40 * AROUND
        words, starts, glued = tokens_of(text[low:high])
        tags = [OUTSIDE] * len(words)
        for a, b in spans:
            inside = [i for i, s in enumerate(starts) if a <= s + low < b]
            for n, i in enumerate(inside):
                tags[i] = INSIDE if n else BEGIN
        middle = sum(s + low < place for s in starts)
        cut = slice(max(0, middle - AROUND), middle + AROUND + 1)
        lines.append((line_features(words, glued, file)[cut], tags[cut]))
    return lines


def made_lines(count: int = 240, seed: int = 11) -> list[tuple[list[list[str]], list[int]]]:
    """Generated lines: names and values of many shapes that are secrets, and numbers, dates, links and words that are none."""
    rng = random.Random(seed)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", lower + digits, lower.upper() + digits, lower + lower.upper() + digits]

    def word(alphabet, low, high):
        return "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))

    def harmless():
        shapes = [
            lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: word(digits, 1, 19),
            lambda: f"https://{word(lower, 3, 9)}.example.com/{word(lower, 3, 9)}/{word(digits, 1, 6)}",
            lambda: f"{word(lower, 3, 8)}.{word(digits, 1, 3)}@{word(lower, 3, 8)}{word(digits, 1, 2)}.example.com",
            lambda: f"v{rng.randint(0, 20)}.{rng.randint(0, 99)}.{rng.randint(0, 9)}", lambda: word(lower, 9, 30).title(),
            lambda: word(lower, 2, 12), lambda: word(lower.upper(), 2, 9), lambda: f"{word(lower, 2, 8)}{rng.randint(1, 99)}",
            lambda: f"{word(lower, 2, 8)}_{word(lower, 2, 8)}()", lambda: f"+{word(digits, 2, 3)} {word(digits, 3, 4)}-{word(digits, 3, 4)}",
        ]
        return rng.choice(shapes)()

    lines = []
    for number in range(count):
        before = " ".join(harmless() for _ in range(rng.randint(0, 4)))
        after = " ".join(harmless() for _ in range(rng.randint(0, 4)))
        if number % 2:
            value = word(rng.choice(alphabets), 16, 44)
            if rng.random() < 0.3:
                value = value[: len(value) // 2] + rng.choice("-_.+/") + value[len(value) // 2 :]
            named = rng.choice(["credential", "auth", "private_key", "Bearer", "pwd", "secret", "access key", "client-secret", "apikey"])
            link, quote = rng.choice([" = ", "=", ": ", " "]), rng.choice(["", '"', "'"])
            head = f"{before} {named}{link}{quote}"
            text = f"{head}{value}{quote} {after}"
        else:
            head = value = ""
            named = rng.choice(["name", "count", "date", "token", "key", "id"])
            text = f"{before} {named}{rng.choice([' = ', ': '])}{harmless()} {after}"
        words, starts, glued = tokens_of(text)
        tags = [OUTSIDE] * len(words)
        for n, i in enumerate(i for i, s in enumerate(starts) if value and len(head) <= s < len(head) + len(value)):
            tags[i] = INSIDE if n else BEGIN
        middle = tags.index(BEGIN) if value else len(words) // 2
        cut = slice(max(0, middle - AROUND), middle + AROUND + 1)
        lines.append((line_features(words, glued, file_features(text))[cut], tags[cut]))
    return lines


def _add(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis)


def likelihood(scores: np.ndarray, steps: np.ndarray, sizes: np.ndarray):
    """Of lines padded to one length: log of the sum over all taggings, tag marginals, and marginals of neighbouring tags.

    ``scores`` is (lines, tokens, tags), ``steps`` the transitions. A line begins and ends beside ``outside``.
    """
    lines, length, _ = scores.shape
    ahead, back = np.zeros_like(scores), np.zeros_like(scores)
    inside = np.arange(length)[None, :] < sizes[:, None]
    for t in range(length):
        came = steps[OUTSIDE][None, :] if t == 0 else _add(ahead[:, t - 1, :, None] + steps[None], 1)
        ahead[:, t] = np.where(inside[:, t, None], came + scores[:, t], -1e9)
    rows = np.arange(lines)
    for t in range(length - 1, -1, -1):
        on = 0 if t + 1 == length else _add(steps[None] + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        back[:, t] = np.where((sizes == t + 1)[:, None], steps[:, OUTSIDE][None, :], on)
    total = _add(ahead[rows, sizes - 1] + steps[:, OUTSIDE][None, :], 1)
    single = np.exp(ahead + back - total[:, None, None]) * inside[:, :, None]
    pairs = np.zeros_like(steps)
    for t in range(1, length):
        both = ahead[:, t - 1, :, None] + steps[None] + (scores[:, t] + back[:, t])[:, None, :] - total[:, None, None]
        pairs += np.exp(both[inside[:, t]]).sum(axis=0)
    pairs[OUTSIDE] += single[:, 0].sum(axis=0)
    pairs[:, OUTSIDE] += single[rows, sizes - 1].sum(axis=0)
    return total, single, pairs


def train(lines: list, rounds: int = 40, pull: float = 0.02) -> dict:
    """Weights by penalised likelihood (Adam over all lines): {"weights": {feature: 3 numbers}, "steps": 3 by 3}."""
    lines = [x for x in lines if x[1]]
    names = {f: i for i, f in enumerate(sorted({f for fs, _ in lines for t in fs for f in t}), 1)}
    length, most = max(len(t) for _, t in lines), max(len(t) for fs, _ in lines for t in fs)
    places, tags = np.zeros((len(lines), length, most), np.int32), np.zeros((len(lines), length), np.int64)
    for n, (features, own) in enumerate(lines):
        tags[n, : len(own)] = own
        for t, found in enumerate(features):
            places[n, t, : len(found)] = [names[f] for f in found]
    sizes = np.array([len(t) for _, t in lines])
    inside = np.arange(length)[None, :] < sizes[:, None]
    truth = np.eye(3)[tags] * inside[:, :, None]
    seen = np.zeros((3, 3))
    for _, own in lines:
        np.add.at(seen, ([OUTSIDE, *own], [*own, OUTSIDE]), 1)
    weights, steps = np.zeros((len(names) + 1, 3)), np.zeros((3, 3))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, steps)]
    for turn in range(1, rounds + 1):
        scores = weights[places].sum(axis=2)
        _, single, pairs = likelihood(scores, steps, sizes)
        error = single - truth
        flat = places.ravel()
        grown = np.stack([
            np.bincount(flat, np.repeat(error[:, :, y].ravel(), most), minlength=len(names) + 1) for y in range(3)
        ], axis=1)
        grown[0] = 0
        for p, (one, two), gradient in ((weights, moments[0], grown + pull * weights), (steps, moments[1], pairs - seen + pull * steps)):
            one[:], two[:] = 0.9 * one + 0.1 * gradient, 0.99 * two + 0.01 * gradient**2
            p -= 0.2 * (one / (1 - 0.9**turn)) / (np.sqrt(two / (1 - 0.99**turn)) + 1e-8)
    return {"weights": {f: tuple(weights[i].tolist()) for f, i in names.items()}, "steps": steps.tolist()}


class _Shapes(dict):
    """Token -> number of its shape; tokens with equal features of their own share a shape, so there are few."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.examples: list[tuple] = []

    def __missing__(self, token: str) -> int:
        found = (kind_of(token), tuple(own_features(token)))
        number = self.known.get(found)
        if number is None:
            number = self.known[found] = len(self.examples)
            self.examples.append(found)
        if len(token) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[token] = number
        return number


class Tagger:
    """Viterbi over the tokens of a text, on the stretches where a secret is possible at all."""

    def __init__(self, model: dict):
        self.weights, self.steps = model["weights"], model["steps"]
        self.shapes = _Shapes()
        self.kinds: dict[str, int] = {"edge": 0}
        s, every = self.steps, range(3)
        # What transitions, and blanks beside the token, can add to a tag over ``outside`` at most.
        self.gain = [
            max(s[a][y] + s[y][b] - s[a][OUTSIDE] - s[OUTSIDE][b] for a in every for b in every)
            + sum(max(self._over(f"{g} {v}")[y] for v in (True, False)) for g in ("glued", "glued after"))
            for y in every
        ]
        self._tables()

    def _over(self, *features: str) -> np.ndarray:
        """Weights of the features, for each tag over ``outside``."""
        total = np.zeros(3)
        for f in features:
            w = self.weights.get(f)
            if w is not None:
                total += np.array(w) - w[OUTSIDE]
        return total

    def _tables(self) -> None:
        """Scores of all shapes and kinds seen so far, as arrays."""
        for kind, _ in self.shapes.examples:
            self.kinds.setdefault(kind, len(self.kinds))
        self.own = np.array([self._over(*own) for _, own in self.shapes.examples]).reshape(-1, 3)
        self.kind = np.array([self.kinds[kind] for kind, _ in self.shapes.examples], np.int64)
        self.named = np.array(["name" in own for _, own in self.shapes.examples], bool)
        names = list(self.kinds)
        self.beside = {g: np.array([self._over(f"{g} {k}") for k in names]) for g in ("before", "second before", "after")}
        self.behind_name = np.array([[self._over(f"name {v} {k}") for k in names] for v in (False, True)])

    def possible(self, words: list[str], whole: str, file: list[str]) -> np.ndarray:
        """Places of the tokens that the best tagging may have as part of a secret, by bounds on all that speaks for it."""
        shapes = np.fromiter(map(self.shapes.__getitem__, words), np.int64, len(words))
        if len(self.own) < len(self.shapes.examples):
            self._tables()
        file += [] if file else file_features(whole)
        kind = np.concatenate([[0, 0], self.kind[shapes], [0]])
        seen = np.concatenate([[0] * 6, np.cumsum(self.named[shapes])])
        near = (seen[5:-1] > seen[:-6]).astype(np.int64)
        over = self.own[shapes] + self._over(*file) + self.behind_name[near, kind[2:-1]]
        over += self.beside["before"][kind[1:-2]] + self.beside["second before"][kind[:-3]] + self.beside["after"][kind[3:]]
        # Sums in another order may differ in the last digits.
        return np.flatnonzero((over + self.gain >= -1e-6)[:, (BEGIN, INSIDE)].any(axis=1))

    def best(self, scores: list[tuple]) -> list[int]:
        """The best tagging of a stretch between two tokens that are outside."""
        s, came = self.steps, []
        now = [s[OUTSIDE][y] + scores[0][y] for y in range(3)]
        for score in scores[1:]:
            ways = [max(range(3), key=lambda a: now[a] + s[a][y]) for y in range(3)]
            now = [now[a] + s[a][y] + score[y] for y, a in enumerate(ways)]
            came.append(ways)
        tag = max(range(3), key=lambda y: now[y] + s[y][OUTSIDE])
        tags = [tag]
        for ways in reversed(came):
            tag = ways[tag]
            tags.append(tag)
        return tags[::-1]

    def score(self, words: list[str], glued: list[bool], at: int, file: list[str]) -> tuple:
        low, high = max(0, at - 5), min(len(words), at + 2)
        kinds = [kind_of(w) for w in words[low:high]]
        names = [w.lower() in NAMES for w in words[low:high]]
        # Only a chain's real ends are edges: the part looked at reaches beyond every feature elsewhere.
        found = own_features(words[at]) + around_features(kinds, names, glued[low:high], at - low, file)
        return tuple(self._over(*found))

    def chain(self, text: str, whole: str, file: list[str]) -> list[tuple[int, int]]:
        """(start, end) of the secrets in one chain of the text ``whole``, whose features are put into ``file`` when needed."""
        words = _token.findall(text)
        open_ = self.possible(words, whole, file).tolist() if words else []
        if not open_:
            return []
        words, starts, glued = tokens_of(text)
        found: list[tuple[int, int]] = []
        at = 0
        while at < len(open_):
            stop = at
            while stop + 1 < len(open_) and open_[stop + 1] == open_[stop] + 1:
                stop += 1
            stretch = open_[at : stop + 1]
            tags = self.best([self.score(words, glued, i, file) for i in stretch])
            before = OUTSIDE
            for i, tag in zip(stretch, tags):
                end = starts[i] + len(words[i])
                if tag == INSIDE and before != OUTSIDE:
                    found[-1] = (found[-1][0], end)
                elif tag != OUTSIDE:
                    found.append((starts[i], end))
                before = tag
            at = stop + 1
        return found

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the secrets that the chain finds in a whole text."""
        file, found, start = [], [], 0
        while start < len(text):
            end = min(start + CHAIN, len(text))
            if end < len(text):
                cut = text.rfind("\n", start, end)
                cut = text.rfind(" ", start, end) if cut < 0 else cut
                end = end if cut < 0 else cut + 1
            part = text if end - start == len(text) else text[start:end]
            found += [(a + start, b + start) for a, b in self.chain(part, text, file)]
            start = end
        return found


def _apart(spans: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans that touch no base span."""
    found, at, ordered, reach = [], 0, sorted((a, b) for _, a, b in base), -1
    for start, end in spans:
        while at < len(ordered) and ordered[at][0] < end:
            reach = max(reach, ordered[at][1])
            at += 1
        if reach <= start:
            found.append((ADDED, start, end))
    return found


def _hinted(texts: pa.Array) -> list[list[bool]]:
    return [pc.fill_null(pc.match_substring_regex(texts, _HINTS[kind]), False).to_pylist() for kind in KINDS]


def fit(df: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> dict:
    """Weights from at most ``sample`` texts that hint at a base span, as many that do not, and generated lines.

    Texts are taken by the least hashes of id and text, so all of them count and the choice does not depend on the run.
    Null texts are none. Without any text the generated lines alone are learned.
    """
    hint = F.col("t").rlike("|".join(f"(?:{h})" for h in _HINTS.values()))
    rows = df.select(F.col(doc_id).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("t is not null")
    hashed = rows.select(F.xxhash64("i", "t").alias("h"), hint.alias("hint"), "t")
    marks = checkpointed(hashed.select("h", "hint").distinct())
    # For each kind the hash up to which texts are taken: two numbers of the whole table.
    last = {
        wanted: marks.where(F.col("hint") == wanted).orderBy("h").limit(sample).agg(F.max("h")).first()[0] for wanted in (True, False)
    }
    limit = F.when(F.col("hint"), F.lit(last[True])).otherwise(F.lit(last[False])).cast("long")
    # Copies of one row are one example; at most twice ``sample`` texts, a few short lines of each, come to the driver.
    few = hashed.where(F.col("h") <= limit).drop("hint").dropDuplicates(["h"])

    def read(batches):
        for batch in batches:
            for part in slices(batch, "t"):
                made = [training_lines(t) for t in part.column("t").to_pylist()]
                flat = [(h, f, t) for h, lines in zip(part.column("h").to_pylist(), made) for f, t in lines]
                yield pa.RecordBatch.from_arrays([
                    pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.list_(pa.list_(pa.string()))),
                    pa.array([x[2] for x in flat], pa.list_(pa.int32())),
                ], ["h", "features", "tags"])

    found = few.mapInArrow(read, "h long, features array<array<string>>, tags array<int>").orderBy("h", "features").collect()
    lines = [(r["features"], r["tags"]) for r in found]
    return train(lines + made_lines())


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))


def find(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """All rows of ``df`` without ``text``, with ``base`` and ``added``: arrays of (kind, start, end) in code points.

    ``base`` are the fixed patterns' spans by start, then kind; ``added`` the chain's spans that touch none of them, by
    start. Null and empty texts have none. Columns named ``base`` or ``added`` are replaced, all others pass. Repeated
    rows are returned each. No shuffle; a worker holds one slice of texts, one chain's tokens and bounded caches. A text
    longer than a chain is cut at a line feed, else at a blank, else after ``CHAIN`` characters.
    """
    kept = [f for f in df.schema if f.name.lower() not in ("base", "added", text.lower())]
    names = [f.name for f in kept]
    schema = StructType([*kept, StructField("base", SPANS), StructField("added", SPANS)])
    source = df.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)], F.col(text).cast("string").alias("t"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    # A few hundred features of a fixed set of groups.
    mark = sha256(repr(sorted(model["weights"].items())).encode()).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        tagger = worker_cache(f"secrets_{mark}", lambda: Tagger(shared.value))
        for batch in batches:
            for part in slices(batch, "t"):
                texts = part.column("t")
                hints = _hinted(texts)
                bases, adds = [], []
                for place, value in enumerate(texts.to_pylist()):
                    kinds = [k for k, hinted in zip(KINDS, hints) if hinted[place]]
                    base = base_spans(value, kinds) if kinds else []
                    bases.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                    added = _apart(tagger.spans(value), base) if value else []
                    adds.append([{"kind": k, "start": a, "end": b} for k, a, b in added])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(bases, kind), pa.array(adds, kind)], [*names, "base", "added"]
                )

    return source.mapInArrow(run, schema)


def ordered(spans: Column) -> Column:
    """Spans by start, then kind as listed, those of the chain last."""
    rank = F.create_map(*[x for i, k in enumerate((*KINDS, ADDED)) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.sort_array(keyed)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined; empty without spans."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
