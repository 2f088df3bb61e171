"""SimHash groups, line deduplication and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import awkward, documents
from tidewire.llm import components, simhash, winnow


def groups_by_force(prints, bits=3):
    """Least member reachable, over all pairs."""
    values = sorted(set(prints))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_fingerprint_by_definition():
    for text in ["", None, "One", "one TWO", "A b c d a b c\nÉ ß", "x " * 50]:
        words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        bits = sum(
            1 << b for b in range(64)
            if 2 * sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) > len(shingles)
        )
        assert simhash.fingerprint(text) & (1 << 64) - 1 == bits


@pytest.mark.parametrize("seed", [1, 2])
def test_links_span_all_groups(spark, seed):
    pick = random.Random(seed)
    prints = []
    for _ in range(25):
        base = pick.getrandbits(64)
        for _ in range(pick.randint(1, 25)):
            value = base
            for _ in range(pick.randint(0, 4)):
                value ^= 1 << pick.randrange(64)
            prints.append(value - (1 << 64) if value >> 63 else value)
    df = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(4)
    found = components.components(simhash.links(df))
    roots = {r["node"]: r["root"] for r in found.collect()}
    want = groups_by_force(prints)
    assert {(v, roots.get(v, v)) for v in want} == set(want.items())
    # A tree for each list, so far fewer links than pairs.
    assert simhash.links(df).count() < 56 * len(set(prints))


def test_components_of_a_long_path(spark):
    chain = [(i, i + 1) for i in range(60)] + [(7, 7), (None, 3), (100, 101)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_on_awkward_rows(spark):
    rows = simhash.near_duplicates(documents(spark, awkward())).collect()
    assert len(rows) == len(awkward())
    by_id = {r["doc_id"]: r["component_id"] for r in rows}
    assert by_id[1] == by_id[2] == by_id[3] == 1
    # The row without an id has the text of document 4.
    assert by_id[None] == 4 and by_id[4] == 4
    assert simhash.near_duplicates(documents(spark, []).limit(0)).count() == 0


def prints_by_force(hashes, words, noise, guarantee):
    import struct

    n, grams = len(words), {}
    for a in range(n):
        for b in range(a, n):
            if sum(words[a : b + 1]) >= noise:
                grams[a] = (xxhash.xxh64_intdigest(struct.pack(f"<{b - a + 1}q", *hashes[a : b + 1])) - (1 << 63), b)
                break
    found = set()
    for i in range(n):
        end = next((b for b in range(i, n) if sum(words[i : b + 1]) >= guarantee), None if i else n - 1)
        inside = [(g, -a, b) for a, (g, b) in grams.items() if end is not None and a >= i and b <= end]
        if inside:
            g, a, b = min(inside)
            found.add((g, -a, b))
    return found


def test_winnowing_by_definition():
    pick = random.Random(3)
    for _ in range(200):
        words = [pick.choice([1, 3, 8, 20, 60]) for _ in range(pick.randint(0, 14))]
        hashes = [pick.getrandbits(40) for _ in words]
        assert set(winnow.winnow(hashes, words, 25, 50)) == prints_by_force(hashes, words, 25, 50)


def lines_of(pick, n):
    return [" ".join(pick.choice("alpha beta gamma delta eps zeta eta".split()) + str(pick.randrange(99)) for _ in range(pick.choice([4, 15, 60]))) for _ in range(n)]


def test_later_runs_go_and_first_ones_stay(spark):
    pick = random.Random(9)
    shared = [lines_of(pick, 3) for _ in range(4)]
    texts = {}
    for i in range(40):
        own = lines_of(pick, pick.randint(0, 4))
        for _ in range(pick.randint(0, 2)):
            at = pick.randint(0, len(own))
            own[at:at] = pick.choice(shared)
        texts[i] = "\n".join(own)
    rows = winnow.dedup_lines(documents(spark, [(i, t, None) for i, t in texts.items()]).repartition(3)).collect()
    left = {r["doc_id"]: r["text"].split("\n") if r["text"] else [] for r in rows}
    seen = set()
    for i in sorted(texts):
        lines, kept = texts[i].split("\n") if texts[i] else [], left[i]
        # What is left is a subsequence; what is gone was there before.
        at = 0
        for line in lines:
            if at < len(kept) and kept[at] == line and not (line in seen and len(line.split()) >= 50):
                at += 1
            else:
                assert line in seen
            seen.add(line)
        assert at == len(kept)
    # A run of at least the guaranteed words stays once.
    for run in shared:
        for line in run:
            if len(line.split()) >= 50:
                assert sum(kept.count(line) for kept in left.values()) <= 1
    assert any(r["n_removed"] > 0 for r in rows)


def removal_by_force(texts, guarantee=50, noise=25):
    """Lines that lie in a run of at least the guaranteed words equal to an earlier run; whole short documents too."""
    rows, gone = [], {}
    for doc in sorted(texts):
        lines = [(n, x.strip()) for n, x in enumerate(texts[doc].split("\n")) if x.split()]
        rows.append((doc, [n for n, _ in lines], [x for _, x in lines], [len(x.split()) for _, x in lines]))
    seen = {}
    for doc, places, lines, words in rows:
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                size = sum(words[a : b + 1])
                whole = a == 0 and b == len(lines) - 1
                if size >= guarantee or (whole and size >= noise):
                    run = (size >= guarantee, tuple(lines[a : b + 1]))
                    if run in seen:
                        gone.setdefault(doc, set()).update(places[a : b + 1])
                    else:
                        seen[run] = doc
    return gone


def left_by_force(texts, gone):
    return {d: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(d, ())) for d, t in texts.items()}


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_by_force(spark, seed):
    """Few different lines of all sizes, so that runs begin, end and overlap everywhere."""
    pick = random.Random(seed)
    words = "alpha beta gamma delta eps zeta eta theta".split()
    vocabulary = [" ".join(pick.choice(words) for _ in range(pick.choice([1, 3, 9, 14, 30, 55]))) for _ in range(14)] + ["", "  "]
    texts = {i: "\n".join(pick.choice(vocabulary) for _ in range(pick.randint(0, 14))) for i in range(60)}
    rows = winnow.dedup_lines(documents(spark, [(i, t, None) for i, t in texts.items()]).repartition(3)).collect()
    gone = removal_by_force(texts)
    assert {r["doc_id"]: r["text"] for r in rows} == left_by_force(texts, gone)
    assert {r["doc_id"]: r["n_removed"] for r in rows if r["n_removed"]} == {d: len(g) for d, g in gone.items()}


def test_a_passage_whose_chosen_lines_stood_alone_before_goes(spark):
    pick = random.Random(4)
    lines = [" ".join(pick.choice("abcdefgh") + str(pick.randrange(999)) for _ in range(30)) for _ in range(8)]
    texts = {n: f"own line {n}\n{line}\nanother {n}" for n, line in enumerate(lines)}
    texts |= {50: "\n".join(lines), 60: "before\n" + "\n".join(lines) + "\nbehind"}
    rows = {r["doc_id"]: r["text"] for r in winnow.dedup_lines(documents(spark, [(i, t, None) for i, t in texts.items()])).collect()}
    assert rows[50] == texts[50] and rows[60] == "before\nbehind"


def test_line_dedup_on_awkward_rows(spark):
    df = documents(spark, awkward())
    out = winnow.dedup_lines(df)
    assert set(out.columns) == set(df.columns)
    rows = out.collect()
    assert len(rows) == len(awkward())
    texts = [(r["doc_id"], r["text"]) for r in rows]
    assert (1, None) in texts and (2, "") in texts and (3, "   \n\t ") in texts
    # Equal id and text: one document. The row without an id comes last and loses its only line.
    assert sum(1 for i, t in texts if i == 4 and t) == 2 and (None, "") in texts
    assert winnow.dedup_lines(df.limit(0)).count() == 0


def test_repeated_words_and_bits_stay_bounded():
    text = "w " * 200_000
    assert isinstance(simhash.fingerprint(text), int)
    assert np.bitwise_count(np.uint64(simhash.fingerprint(text) & (1 << 64) - 1)) > 0


def similarity(one, two):
    return len(one & two) / len(one | two) if one or two else 1.0


def shingles_by_force(text, width=5):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} or ({" ".join(words)} if words else set())


def near_copies(pick):
    """Texts, each with copies of which some words are changed, up to similarities about the limit."""
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(60):
        base = [pick.choice(words) for _ in range(pick.randint(30, 300))]
        texts.append(" ".join(base))
        for _ in range(pick.randint(0, 5)):
            copy = base[:]
            for _ in range(pick.randint(0, max(1, len(base) // 35))):
                copy[pick.randrange(len(copy))] = pick.choice(words)
            texts.append(" ".join(copy).upper() if pick.random() < 0.2 else " ".join(copy))
    return texts + ["one two", "one two", "One TWO", "three", "", None, " "]


def test_similar_groups_against_all_pairs(spark):
    texts = near_copies(random.Random(8))
    rows = simhash.similar_groups(documents(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()
    found = {r["doc_id"]: r["component"] for r in rows}
    assert len(rows) == len(texts)
    sets = [shingles_by_force(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    caught = [found[i] == found[j] for i, j in links]
    assert len(links) > 150 and sum(caught) / len(links) >= 0.95
    # Nothing is put together that no links join.
    root = list(range(len(texts)))
    for i, j in links:
        a, b = root[i], root[j]
        root = [b if r == a else r for r in root]
    assert all(root[i] == root[j] for i in range(len(texts)) for j in range(i) if found[i] == found[j])


def test_similar_groups_lose_no_link(spark):
    """Pairs at a similarity of exactly 0.8, which fingerprints miss now and then; texts with much in common beside them."""
    pick, texts, pairs = random.Random(21), [], []
    for n in range(400):
        base = [f"w{pick.randrange(10**6)}" for _ in range(49)]
        # 45 shingles each; five changed by a last word each way leave 40 shared of 50.
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(base), " ".join(base[:-5] + [f"x{n}", *base[-4:]])]
    common = [f"c{i}" for i in range(60)]
    texts += [" ".join(common + [f"y{pick.randrange(10**6)}" for _ in range(40)]) for _ in range(100)]
    sets = [shingles_by_force(t) for t in texts]
    assert all(similarity(sets[i], sets[j]) == 0.8 for i, j in pairs)
    rows = simhash.similar_groups(documents(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()
    found = {r["doc_id"]: r["component"] for r in rows}
    assert all(found[i] == found[j] for i, j in pairs)
    assert len(set(found.values())) == len(texts) - len(pairs)


def test_near_copies_below_the_limit_are_hardly_paired(spark, monkeypatch):
    """A large group of texts that differ just too much: few pairs are compared whole, and the groups are those of all pairs."""
    pick, asked, verified = random.Random(5), [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda rows, every, pairs, *rest: asked.append(pairs.count()) or verified(rows, every, pairs, *rest))
    base = [f"w{i}" for i in range(300)]
    texts = []
    for n in range(120):
        copy = base[:]
        for at in pick.sample(range(300), 5):
            copy[at] = f"x{pick.randrange(10**6)}"
        texts.append(" ".join(copy))
    sets = [shingles_by_force(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    root = list(range(len(texts)))
    for i, j in near:
        a, b = root[i], root[j]
        root = [b if r == a else r for r in root]
    rows = simhash.similar_groups(documents(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()
    found = {r["doc_id"]: r["component"] for r in rows}
    assert len({(found[i], root[i]) for i in found}) == len(set(found.values())) == len(set(root))
    # All pairs are 7,140.
    assert near and len(asked) == 2 and sum(asked) <= 8 * len(texts)


@pytest.mark.parametrize("size", [3, 100, 500, 700, 3000])
def test_parities_rule_out_no_similar_pair(size):
    pick, sets = np.random.default_rng(size), []
    for _ in range(40):
        base = pick.integers(0, 1 << 63, size * 5 // 4, dtype=np.uint64)
        sets += [np.unique(base[: pick.integers(size, len(base) + 1)]) for _ in range(2)]
        sets.append(np.unique(np.concatenate([base[: size * 7 // 8], pick.integers(0, 1 << 63, size // 8, dtype=np.uint64)])))
    i, j = (x.ravel() for x in np.triu_indices(len(sets), 1))
    sizes = np.array([len(s) for s in sets])
    fits = simhash._fits(i, j, sizes, simhash._levels([simhash.parities(s) for s in sets]), 0.8)
    common = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)])
    similar = common >= 0.8 * (sizes[i] + sizes[j] - common)
    assert similar.any() and fits[similar].all()
    assert size < 100 or fits.sum() <= 1.5 * similar.sum()


@pytest.mark.parametrize("seed", range(4))
def test_prefixes_give_every_pair(seed):
    """Short and long lists, with groups: the pairs of two groups whose sizes can be similar, each once a list."""
    pick = np.random.default_rng(seed)
    many = [1, 2, 3, 60, 64, 65, 200, 7]
    keys = np.repeat(np.arange(len(many)), many)
    groups, sizes = pick.integers(0, 3 + seed, len(keys)), pick.integers(1, 30, len(keys))
    order = np.lexsort([sizes, keys])
    groups, sizes = groups[order], sizes[order]
    found = [(min(a, b), max(a, b)) for i, j in simhash._pairs_across(keys, groups, sizes, 0.8) for a, b in zip(i.tolist(), j.tolist())]
    want = [(i, j) for j in range(len(keys)) for i in range(j) if keys[i] == keys[j] and groups[i] != groups[j]
            and 10 * min(sizes[i], sizes[j]) >= 8 * max(sizes[i], sizes[j])]
    assert sorted(found) == sorted(want)


def test_similar_groups_of_awkward_rows(spark):
    df = documents(spark, awkward())
    rows = simhash.similar_groups(df).collect()
    assert len(rows) == len(awkward()) and simhash.similar_groups(df.limit(0)).count() == 0
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], set()).add(r["component"])
    assert by_id[1] == by_id[2] == by_id[3] and by_id[4] == by_id[None] and len({min(c) for c in by_id.values()}) == 6
    with pytest.raises(ValueError):
        simhash.similar_groups(df, similarity=0.5)


def test_recall_of_similar_groups_on_given_tables(spark):
    """Pairs of the given documents with five-word similarities from 0.8 up to below 1, by all pairs that share a shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r["doc_id"]: shingles_by_force(r["text"]) for r in docs.collect()}
    by_shingle = {}
    for i, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    near = {(i, j) for ids in by_shingle.values() if len(ids) < 60 for i in ids for j in ids if i < j and 0.8 <= similarity(sets[i], sets[j]) < 1}
    found = {r["doc_id"]: r["component"] for r in simhash.similar_groups(docs).collect()}
    caught = sum(found[i] == found[j] for i, j in near)
    print("near copies found", caught, "of", len(near))
    assert len(near) >= 10 and caught >= 0.9 * len(near)
