"""Secret scanning: base spans, the chain's likelihood and Viterbi against brute force, held-out values."""

import itertools
import random
import re
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, documents
from tidewire.llm import secrets
from tidewire.llm.queries import QUERIES

PATTERNS = [
    ("assign", "(?ai)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?(?-i:([A-Za-z0-9+/_.=-]+))", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24),
]


@pytest.fixture(scope="module")
def model():
    return secrets.train(secrets.made_lines())


def base_by_force(text):
    found = []
    for n, (kind, pattern, group, least) in enumerate(PATTERNS):
        found += [(m.start(), n, kind, m.end()) for m in re.compile(pattern.replace("(?-i:", "(?:")).finditer(text) if len(m.group(group)) >= least]
    return [(k, a, b) for a, _, k, b in sorted(found)]


TEXTS = [
    "", "token = abc", 'PassWord: "hunter22"', "api_key=aaaaaa apikey: 'bbbbbbb", "AKIA" + "A" * 15, "AKIA" + "Z9" * 8, "0123456789abcdef" * 2,
    "é token = " + "deadbeef" * 5 + " 漢", "tokentoken==x=yyyyyy", "secret\n= abcdefgh", "K\u212aey to\u212aen = abcdefg \u017fecret: abcdefgh", "token =",
    "passwd:" + "a" * 5 + " passwd:" + "a" * 6, "AKIA token=AKIA" + "Q" * 16,
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans(text):
    assert secrets.base_spans(text) == base_by_force(text)
    hinted = [k for k, h in zip(secrets.KINDS, secrets._hinted(__import__("pyarrow").array([text]))) if h[0]]
    assert secrets.base_spans(text, hinted) == base_by_force(text)


def test_likelihood_by_force():
    rng = np.random.default_rng(1)
    scores, steps, sizes = rng.normal(size=(3, 4, 3)), rng.normal(size=(3, 3)), np.array([4, 1, 3])
    total, single, pairs = secrets.likelihood(scores, steps, sizes)
    want_pairs = np.zeros((3, 3))
    for n, size in enumerate(sizes):
        ways = {}
        for tags in itertools.product(range(3), repeat=int(size)):
            path = [0, *tags, 0]
            ways[tags] = sum(steps[a, b] for a, b in zip(path, path[1:])) + sum(scores[n, t, y] for t, y in enumerate(tags))
        z = np.log(sum(np.exp(v) for v in ways.values()))
        assert abs(z - total[n]) < 1e-9
        for t in range(4):
            for y in range(3):
                want = sum(np.exp(v - z) for tags, v in ways.items() if t < size and tags[t] == y)
                assert abs(single[n, t, y] - want) < 1e-9
        for tags, v in ways.items():
            path = [0, *tags, 0]
            for a, b in zip(path, path[1:]):
                want_pairs[a, b] += np.exp(v - z)
    assert np.allclose(pairs, want_pairs)


def whole_chain(tagger, text):
    """Viterbi over every token of a text, nothing left out."""
    words, starts, glued = secrets.tokens_of(text)
    if not words:
        return []
    file = secrets.file_features(text)
    tags = tagger.best([tagger.score(words, glued, i, file) for i in range(len(words))])
    found, before = [], 0
    for start, word, tag in zip(starts, words, tags):
        if tag == 2 and before:
            found[-1] = (found[-1][0], start + len(word))
        elif tag:
            found.append((start, start + len(word)))
        before = tag
    return found


def random_text(rng):
    pieces = ["token", "=", '"', "deadbeef0123", "AB12cd34EF56gh78IJ", "hello", "World", "2024-01-02", "key:", "a_b", "é漢", "\n", "x9" * 12, "Bearer",
              "12345678901", "https://a.example.com/b", "Q" * 30, "###", "secret", "f" * 40, "aZ3-bY4_cX5.dW6"]
    return rng.choice(["", " "]).join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(1, 25)))


def test_cut_chains_equal_whole_ones(model):
    rng, tagger, some = random.Random(4), secrets.Tagger(model), 0
    for _ in range(600):
        text = random_text(rng)
        want = whole_chain(tagger, text)
        assert tagger.spans(text) == want, text
        some += bool(want)
    assert some > 100
    # With weights that leave nothing certain, too.
    wild = {"weights": {f: tuple(np.random.default_rng(i).normal(size=3)) for i, f in enumerate(model["weights"])}, "steps": np.random.default_rng(0).normal(size=(3, 3)).tolist()}
    tagger = secrets.Tagger(wild)
    for _ in range(200):
        text = random_text(rng)
        assert tagger.spans(text) == whole_chain(tagger, text), text


def test_unseen_secrets_and_clean_lines(model):
    rng, tagger = random.Random(9), secrets.Tagger(model)
    lower = "abcdefghijklmnopqrstuvwxyz"
    hits = 0
    for n in range(200):
        value = "".join(rng.choice(lower + lower.upper() + "0123456789") for _ in range(rng.randint(24, 40)))
        text = f"some words before {rng.choice(['my_credential', 'auth', 'Bearer', 'private key'])}: {value} and behind"
        spans = tagger.spans(text)
        hits += any(text[a:b] == value for a, b in spans)
    assert hits >= 180
    clean = ["The quick brown fox jumps over the lazy dog. " * 5, "On 2024-01-02 at 12:30 we paid 1,234.50 to +49 30 123456.",
             "see https://abc.example.com/path/1234 or mail a.b7@mail3.example.com", "Version v1.20.3 of foo_bar() returns key: name", "漢字 é ß " * 20]
    assert [tagger.spans(c) for c in clean] == [[]] * len(clean)


def test_chains_of_long_texts(model, monkeypatch):
    tagger, monkeypatched = secrets.Tagger(model), 200
    text = ("filler words here\n" * 40 + "auth: " + "aB3dE5fG7hI9jK1lM3nO5pQ7rS9\n") * 3 + "x" * 1000 + " " + "y" * 700
    whole = tagger.spans(text)
    assert [text[a:b] for a, b in whole] == ["aB3dE5fG7hI9jK1lM3nO5pQ7rS9"] * 3
    monkeypatch.setattr(secrets, "CHAIN", monkeypatched)
    assert tagger.spans(text) == whole


def test_query(spark, tmp_path, model):
    rows = awkward() + [(20 + i, t, None) for i, t in enumerate(TEXTS)] + [
        (50, "auth: aB3dE5fG7hI9jK1lM3nO5pQ7rS9 and token = 'abcdef123456'", "en"), (50, "auth: aB3dE5fG7hI9jK1lM3nO5pQ7rS9 and token = 'abcdef123456'", "en"),
    ]
    documents(spark, rows).withColumnRenamed("key", "base").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["op11_crf_secrets"](spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    by_text = {}
    for i, t, _ in rows:
        by_text.setdefault(i, []).append(t or "")
    for r in found:
        base = base_by_force(by_text[r["doc_id"]][0])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == sha256(listed.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for k, _, _ in base) for x in secrets.KINDS]
        spans = [s.split(":") for s in r["spans"].split(",")] if r["spans"] else []
        assert [s for s in spans if s[0] != "crf"] == [[k, str(a), str(b)] for k, a, b in base]
        assert [int(s[1]) for s in spans] == sorted(int(s[1]) for s in spans) and sum(s[0] == "crf" for s in spans) == r["n_added"]
    rows = documents(spark, rows).where("doc_id = 50")
    spans = secrets.spans_text(secrets.ordered(F.concat("base", "added"))).alias("s")
    assert [r["s"] for r in secrets.find(rows, model).select(spans).collect()] == ["crf:6:33,assign:38:59"] * 2
    documents(spark, []).write.parquet(str(tmp_path / "e" / "documents.parquet"))
    assert QUERIES["op11_crf_secrets"](spark, str(tmp_path / "e")).collect() == []
