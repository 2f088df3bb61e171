"""Byte-level BPE and packing: against the tokenizer libraries, round trips, edits and awkward rows."""

import base64
import hashlib
import random
import zlib
from array import array

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm.helpers import awkward, documents
from tidewire.llm import bpe, packing

VOCAB = P.path("byte_bpe_multi_50k.tiktoken")
PARTS = [
    "a", "b", "the", " ", "  ", "\n", " \n", "\n ", "'s", "'l", "l", "é", "ß", "漢", "🙂", "\t", "0", "12", "!!", "...", "　", "\xa0",
    "ing", "Т", "'", "़", "ا", "\x85", "<|endoftext|>",
]


def random_texts(n, seed=1):
    pick = random.Random(seed)
    return ["".join(pick.choice(PARTS) for _ in range(pick.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    with open(VOCAB, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(VOCAB, P.PATTERN)


def test_encoding_equals_the_library_and_decodes(encoder, library):
    for text in random_texts(3000):
        ids = encoder.encode(text)
        assert list(array("I", ids)) == library.encode_ordinary(text), text
        assert encoder.decode(ids) == text.encode()


def test_neighbours_by_plain_merging(encoder):
    """Whether two tokens stay apart, for pairs as they stand in texts and random ones, against merging their bytes."""
    pick, ranks = random.Random(7), bpe.Ranks(VOCAB)
    tokens = [t for t in pick.sample(sorted(ranks.token), 4000) if ranks.alone(t)]
    apart = 0
    for _ in range(6000):
        left, right = pick.choice(tokens), pick.choice(tokens)
        if pick.random() < 0.7:
            # Cut a token in two, so that the bytes fit each other.
            whole = ranks.token[left]
            at = pick.randint(1, len(whole))
            halves = ranks.merge(whole[:at])[-1:], ranks.merge(whole[at:])[:1]
            left, right = (halves[0][0], halves[1][0]) if halves[1] else (left, right)
        want = ranks.merge(ranks.token[left] + ranks.token[right]) == [left, right]
        assert ranks.beside(left, right) == want, (ranks.token[left], ranks.token[right])
        apart += want
    assert 1000 < apart < 6000 and ranks.rising


def test_bad_ids_decode_to_null(spark):
    rows = [(1, b""), (2, None), (3, b"\x01\0\0\0"), (4, b"\x01\0\0"), (5, b"\xff\xff\xff\xff"), (6, (50256).to_bytes(4, "little"))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "n long, ids binary, decoded string")
    found = bpe.decode(df, VOCAB, P.PATTERN).orderBy("n").collect()
    assert [r["decoded"] and bytes(r["decoded"]) for r in found] == [b"", b"", b'"', None, None, None]


def test_caches_of_any_size_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 7)
    encoder = bpe.Encoder(VOCAB, P.PATTERN)
    for text in random_texts(400, 11):
        assert list(array("I", encoder.encode(text))) == library.encode_ordinary(text)


def test_edits_and_appends_equal_encoding_anew(encoder, library):
    pick = random.Random(2)
    for text in random_texts(400, 3):
        held = bpe.EditableText(encoder.ranks, P.PATTERN, text)
        for _ in range(4):
            start = pick.randint(0, len(text))
            stop = pick.randint(start, min(len(text), start + 4))
            if pick.random() < 0.4:
                start = stop = len(text)
            new = "".join(pick.choice(PARTS) for _ in range(pick.randint(0, 4)))
            held.replace(start, stop, new)
            text = text[:start] + new + text[stop:]
            assert held.text == text and held.ids() == library.encode_ordinary(text)


def test_an_edit_computes_few_entries(encoder):
    table = bpe.PrefixTable(encoder.ranks, b"the quick brown fox " * 500)
    assert table.replace(5000, 5002, b"zz") < 200
    assert table.ids() == bpe.PrefixTable(encoder.ranks, table.data).ids()


def test_operator_on_awkward_rows(spark, library):
    df = documents(spark, awkward())
    encoded = bpe.encode(df, VOCAB, P.PATTERN)
    assert [c for c in encoded.columns if c != "ids" and c != "n_tokens"] == [c for c in df.columns if c != "ids"]
    rows = bpe.decode(encoded, VOCAB, P.PATTERN).collect()
    assert len(rows) == len(awkward())
    for row in rows:
        assert list(array("I", row["ids"])) == library.encode_ordinary(row["text"] or "")
        assert row["n_tokens"] == len(row["ids"]) // 4 and row["decoded"] == (row["text"] or "").encode()
    assert bpe.encode(df.limit(0), VOCAB, P.PATTERN).count() == 0


def check_pieces(rows, texts, window, added=True):
    """``added``: the library finds its added tokens in texts, as the contract has it; else they are ordinary text."""
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = not added
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            cut = array("I", ids[at : at + r["length"]]).tobytes()
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(cut) and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    return {s: sum(n for _, n in p) for s, p in by_sequence.items()}


def test_packing_covers_every_id_once(spark):
    pick = random.Random(5)
    texts = {i: t for i, t in enumerate(random_texts(300, 7))}
    texts |= {1000: None, 1001: "", 1002: "word " * 5000, 1003: "x" * 3000}
    texts |= {2000 + i: "the cat sat " * pick.randint(1, 150) for i in range(300)}
    df = documents(spark, [(i, t, None) for i, t in texts.items()]).repartition(5)
    rows = packing.pack(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, window=256, open_windows=8, merge_partitions=2).collect()
    sizes = check_pieces(rows, texts, 256, added=False)
    padding = sum(256 - n for n in sizes.values())
    assert padding < 0.08 * sum(sizes.values())
    assert packing.pack(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_packed_ids_are_the_librarys_with_added_tokens(spark, tmp_path):
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}  {end}\n", f"x{end}y <|endoftext| > z", "plain text", f"wide  {end}  blanks", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    from tidewire.llm.queries import QUERIES

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = {r["doc_id"]: r for r in QUERIES["op10_bounded_packing"](spark, str(tmp_path)).collect()}
    for doc, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        row = rows[doc]
        assert (row["doc_tokens"], row["length"]) == (len(ids), len(ids)), text
        assert row["ids_crc32"] == zlib.crc32(array("I", ids).tobytes()), text


def test_repeated_and_unnamed_documents_are_packed_each(spark):
    df = documents(spark, awkward())
    rows = packing.pack(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    whole = [r for r in rows if r["start"] == 0]
    assert len(whole) == len(awkward())
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in whole)


def test_packer_emits_the_fullest():
    done = []
    packer = packing.Packer(10, 2, done.append)
    for size in (6, 7, 5, 4):
        packer.add([(size, size)])
    # 5 finds no room beside 6 and 7: the window of 7 goes. 4 fills the window of 6.
    assert [[s for s, _ in w] for w in done] == [[7], [6, 4]]
    assert [[s for s, _ in w] for w in packer.rest()] == [[5]]


def test_whole_windows_need_no_open_place():
    done = []
    packer = packing.Packer(1024, 2, done.append)
    for size in (600, 500, 1024):
        packer.add([(size, size)])
    assert [[s for s, _ in w] for w in done] == [[1024]] and sorted(s for w in packer.rest() for s, _ in w) == [500, 600]


def test_op1_query_digests(spark):
    from tidewire.llm.queries import QUERIES

    directory = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{directory}/documents.parquet").collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCAB, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in QUERIES["op1_byte_bpe"](spark, directory).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(bpe.pack_ids(ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    rows = QUERIES["op10_bounded_packing"](spark, directory).collect()
    check_pieces(rows, texts, 1024)
