"""Quotation linking, personal data and the pipeline: small cases, brute force and awkward rows."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import awkward, documents
from tests.compare import compare
from tidewire.llm import chat, privacy, simhash
from tidewire.llm.chat_sql import OP2_SQL
from tidewire.llm.queries import QUERIES, ordered_digest



def quoting_conversations(seed):
    """Messages that quote earlier ones, whole or in lines, at several levels, with repeated turns and missing values."""
    draw, rows = random.Random(seed), []
    words = "alpha Beta gamma delta epsilon zeta eta theta".split()
    for conv in range(12):
        said = []
        for turn in range(draw.randint(1, 14)):
            parts = []
            for text in draw.sample(said, min(len(said), draw.randint(0, 2))):
                mark = draw.choice(["> ", ">> ", "> > ", ">"])
                lines = text.split("\n")
                parts += [mark + line for line in (lines if draw.random() < 0.6 else lines[:1])]
                parts += draw.choice([[], [""], ["> never said by anyone"]])
            parts += [" ".join(draw.choices(words, k=draw.randint(0, 5))) for _ in range(draw.randint(0, 3))]
            text = "\n".join(parts)
            said.append(text)
            rows.append((conv, turn, draw.choice(["user", "assistant", None]), text if draw.random() < 0.9 else None))
            if draw.random() < 0.1:
                rows.append(rows[-1])
    return [*rows, (None, 3, "user", "> alpha\nx"), (5, None, "user", "> alpha beta gamma\ny"), (99, 1, "user", "")]


def test_quotation_linking_equals_its_sql(spark):
    rows = quoting_conversations(3)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    conversations = frame.toPandas()  # noqa: F841 read by name
    con.register("conversations", conversations.astype({"conv_id": "Int64", "turn": "Int64"}))
    problem = compare(spark, con, lambda *_: ordered_digest(chat.link(frame)), OP2_SQL, "")
    assert problem is None, problem
    linked = chat.link(frame)
    assert linked.where("n_linked > 0").count() > 20 and linked.where(F.size("path") > 1).count()


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    own = [int(c) for c in digits][::-1]
    return (sum(own[::2]) + sum(2 * d - 9 * (d > 4) for d in own[1::2])) % 10 == 0


def spans_by_force(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {
                "email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(found)


TRICKY = [
    "a@b.c_d@e.f", "x@y", "x@y.z@w.v", "@a.b", "é🙂 a.b+c@d-e.co.uk, q@r.s.", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256 001.02.3.0004",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111 2", "4111  1111 1111 1111", "1 2 3", "04111111111111111", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1",
    "+1 (555) 123-4567", "+1((((", "++49 30 1234567890 ", "+1 2", "+123456789012345 6", "9" * 5000, "a." * 3000 + "@b" + ".c" * 3000, "1 " * 4000, "+" + "1(" * 2000,
    "x@1.2.3.4 +4111111111111111", "", "12.12.12.12" * 300,
]


def test_base_spans_by_definition(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    rows = df.select("text", privacy.spans_text(privacy.base_spans(F.col("text"))).alias("spans")).collect()
    for r in rows:
        assert r["spans"] == spans_by_force(r["text"]), r["text"][:60]


def test_disclosing_terms_far_from_the_entity_and_on_other_lines_go(spark):
    plain = "river mountain valley forest meadow harbour castle village bridge garden".split()
    rows = [(i, " ".join(plain[(i * k) % 10] for k in (1, 3, 7)) + f" w{i}x") for i in range(400)]
    for i in range(5):
        far = " ".join(plain[(i * k) % 10] for k in range(1, 40))
        rows.append((1000 + i, f"quill@example.com {far} number{i} Quillfeather\nQuillfeather {plain[i]} again"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found, text = {r["key"]["id"]: r for r in privacy.all_spans(df).collect()}, dict(rows)
    for i in range(1000, 1005):
        assert [text[i][s["start"] : s["end"]] for s in found[i]["added"]].count("Quillfeather") == 2


def test_disclosing_terms_are_found_and_chance_words_are_not(spark):
    plain = "river mountain valley forest meadow harbour castle village bridge garden".split()
    rows = []
    for i in range(400):
        rows.append((i, " ".join(plain[(i * k) % 10] for k in (1, 3, 7)) + f" w{i}x"))
    for i in range(5):
        a, b = plain[i], plain[9 - i]
        rows.append((1000 + i, f"{a} number{i} from Zanzibar\n{b} Quillfeather {a} quill@example.com {b} {i}"))
    # Copies of one text share one context.
    rows += [(2000 + i, "unique context Hapaxword lone@example.com closing words") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["key"]["id"]: r for r in privacy.all_spans(df).collect()}
    text = dict(rows)
    for i in range(1000, 1005):
        terms = {text[i][s["start"] : s["end"]] for s in found[i]["added"]}
        assert terms == {"Quillfeather"}
    assert all(not found[i]["added"] for i in found if not 1000 <= i < 1005)
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(df).collect()}
    assert "quill" not in clean[1000].lower() and "[EMAIL]" in clean[1000] and clean[5] == text[5]
    assert clean[2000] == "unique context Hapaxword [EMAIL] closing words"


def test_privacy_on_awkward_rows(spark):
    rows = [*awkward(), (None, "me@here.org", None), (7, "+1 (555) 123-4567 me@here.org", "en")]
    df = documents(spark, rows)
    out = privacy.sanitise(df)
    assert set(out.columns) == set(df.columns)
    texts = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(texts) == len(rows) and (None, "[EMAIL]") in texts and (7, "[PHONE] [EMAIL]") in texts and (1, None) in texts
    assert privacy.all_spans(df).count() == len(rows)
    assert privacy.sanitise(df.limit(0)).count() == 0


def test_op4_query_by_force(spark):
    directory = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{directory}/documents.parquet").collect()}
    rows = QUERIES["op4_disclosure_pii"](spark, directory).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = spans_by_force(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and r["spans"].startswith(want)
        assert r["n_email"] == want.count("email:")


def test_segments_follow_quote_levels(spark):
    text = "Hi\n> one\n>two\n> > deep\n>> deeper\n> back\nbye > now"
    row = spark.createDataFrame([(text,)], "t string").select(chat.segments(F.col("t")).alias("s")).first()
    assert [(s["level"], s["body"]) for s in row["s"]] == [
        (0, "Hi"), (1, "one\ntwo"), (2, "deep\ndeeper"), (1, "back"), (0, "bye > now"),
    ]


def linked(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return chat.reply_ordered(chat.link(df)).collect()


def test_quotes_link_and_branches_follow_replies(spark):
    rows = linked(spark, [
        (1, 0, "user", "Shall we meet on Friday at noon?\n\nBring the maps."), (1, 1, "assistant", "> Shall we  meet on friday at NOON?\nYes."),
        (1, 2, "user", "And what about the weather?"), (1, 3, "assistant", "Sunny."),
        (1, 4, "user", "> Yes.\n>> Shall we meet on Friday at noon?\nGreat"), (1, 5, "user", "> And what about the weather?\nStill sunny?"),
        (1, 6, "user", "> never said here before\nHm"), (2, 0, None, None), (2, 5, "user", "> Sunny.\nElsewhere"),
    ])
    by = {(r["conv_id"], r["turn"]): r for r in rows}
    parents = {k: r["parent_turn"] for k, r in by.items()}
    assert parents == {(1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 1, (1, 5): 2, (1, 6): 5, (2, 0): None, (2, 5): 0}
    assert by[1, 4]["body"] == "Great" and by[1, 4]["n_quotes"] == 2 and by[1, 4]["n_linked"] == 2 and by[1, 6]["n_linked"] == 0
    assert by[2, 0]["formatted"] == "<|user|>\n\n"
    # Depth first: each behind the message it answers, older branches of the same message first.
    assert [r["turn"] for r in rows if r["conv_id"] == 1] == [0, 1, 2, 3, 5, 6, 4]


def preorder(parents):
    children = {}
    for turn in sorted(parents):
        children.setdefault(parents[turn], []).append(turn)
    out, stack = [], list(reversed(children.get(None, [])))
    while stack:
        turn = stack.pop()
        out.append(turn)
        stack += reversed(children.get(turn, []))
    return out


def test_reply_order_is_depth_first_over_blocks(spark):
    import random

    pick = random.Random(6)
    rows, parents = [], {}
    for t in range(1500):
        answered = pick.randrange(t) if t and pick.random() < 0.02 else None
        parents[t] = answered if answered is not None else (t - 1 if t else None)
        quote = f"> message number {answered} says so\n" if answered is not None else ""
        rows.append((7, t, "user", f"{quote}message number {t} says so"))
    found = linked(spark, rows)
    assert {r["turn"]: r["parent_turn"] for r in found} == parents
    assert [r["turn"] for r in found] == preorder(parents)


def test_chat_on_awkward_rows(spark):
    rows = linked(spark, [
        (None, 0, "user", "> a b c\nx"), (3, None, "user", "y"), (3, 1, "user", "same words here"), (3, 1, "user", "same words here"),
        (3, 2, "user", "> same words here\nok"), (4, 0, "user", "> " * 400 + "deep"), (4, 1, "user", "line\n" * 20_000),
    ])
    assert len(rows) == 7
    assert [r["parent_turn"] for r in rows if (r["conv_id"], r["turn"]) == (3, 2)] == [1]
    assert chat.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_awkward_and_no_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    df = spark.createDataFrame(
        [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in awkward()],
        "doc_id long, text string, lang string, source string, n_chars long")
    out = stage(spark, df, "")
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == df.columns
    rows = out.collect()
    assert rows
    ids = [r["doc_id"] for r in rows]
    if name == "language":
        assert 1 not in ids and 8 not in ids and ids.count(4) == 2
    if name == "near_duplicates":
        # Documents 1, 2 and 3 have no words, 4 and the unnamed one the same text.
        assert sorted(ids) == [1, 4, 5, 6, 7, 8]
    stage(spark, df.limit(0), "").collect()


def test_pipeline_by_its_stages(spark, tmp_path):
    directory = "/root/testdata/sf0.001"
    docs, kept = spark.read.parquet(f"{directory}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, directory).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.count()
        if name == "near_duplicates":
            groups = {r["component_id"] for r in simhash.near_duplicates(before).collect()}
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == groups
        if name == "privacy":
            assert not any(spans_by_force(r["text"]) for r in docs.collect())
    whole = corpus_pipeline.run(spark, directory)
    pieces = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert pieces(whole) == pieces(docs)
