"""The merge tree against a plain walk over random observation sequences."""

import random

from tidewire.operators.authors import fold_authors
from tidewire.operators.merge import dedupe_first_seen, merge_posts
from tidewire.schemas import AUTHOR_COMMAND, POST_OBSERVATION

FIELDS = [part.strip().split(" ")[0] for part in
          "id, author_handle, author_name, content, created_at, source, has_quote, quote_id, reply_id, conversation_id, "
          "has_media, media_items, has_link, links, is_article, article_title, article_preview, article_text, is_retweet, "
          "retweeted_by_handle, retweeted_by_name, original_id, original_author_handle, original_author_name, "
          "original_content, seq".split(",")]


def cut(text):
    return text is not None and text.rstrip().endswith(("…", "..."))


def walk(rows):
    """Sequential merge of one post's observations, state held in a dict."""
    first, *later = rows
    post = dict(first)
    post["media_items"] = list({m["url"]: m for m in first["media_items"] or []}.values())
    for row in later:
        new, old = row["content"] or "", post["content"] or ""
        if new and (not old or cut(old) or len(new.strip()) >= len(old.strip()) + 120):
            post["content"] = new
        for name in ("author_name", "quote_id", "reply_id"):
            post[name] = post[name] or row[name]
        post["has_quote"] = post["has_quote"] or row["has_quote"]
        new, old = (row["article_title"] or "").strip(), (post["article_title"] or "").strip()
        if len(new) > len(old):
            post["article_title"] = new
        new, old = (row["article_text"] or "").strip(), (post["article_text"] or "").strip()
        if new and (not old or cut(old) or len(new) >= len(old) + 120):
            post["article_text"] = new
        merged = {m["url"]: dict(m) for m in post["media_items"]}
        for item in row["media_items"] or []:
            kept = merged.setdefault(item["url"], dict(item))
            kept.update({k: v for k, v in item.items() if v is not None})
        if len(merged) > len(post["media_items"]):
            post["media_items"] = list(merged.values())
        if row["is_retweet"]:
            post["is_retweet"] = True
            if post["original_id"] is None:
                post["original_id"] = row["original_id"]
            new, old = row["original_content"] or "", post["original_content"] or ""
            longer = len(new.rstrip()) > len(old.rstrip()) and new.rstrip().startswith(old.rstrip())
            if new.strip() and not cut(new) and (not old.strip() or cut(old) or longer):
                post["original_content"] = new
    return post


def random_text(rng):
    kind = rng.random()
    if kind < 0.15:
        return rng.choice([None, ""])
    body = "x" * rng.choice([1, 50, 100, 170, 220, 300, 430, 560])
    return rng.choice([" ", ""]) + body + rng.choice(["", "", "...", "… ", " "]) if kind < 0.9 else "short"


def random_original(rng):
    if rng.random() < 0.25:
        return rng.choice([None, "", "ab...", "q…"])
    return rng.choice(["abcdefgh", "abXYZ", "zzz"])[: rng.randint(1, 8)]


def random_row(rng, post_id, seq):
    media = [
        {"url": f"u{rng.randint(0, 4)}", "type": rng.choice(["photo", None, "video"]), "source": None,
         "media_id": rng.choice([None, str(seq)])}
        for _ in range(rng.randint(0, 2))
    ]
    media = list({m["url"]: m for m in media}.values())
    row = dict.fromkeys(FIELDS)
    row.update(
        id=post_id, seq=seq, author_handle=f"h{seq}", author_name=rng.choice([None, "", f"n{seq}"]),
        content=random_text(rng), source="s", has_quote=rng.random() < 0.2, quote_id=rng.choice([None, "", str(seq)]),
        reply_id=rng.choice([None, str(seq)]), has_media=False, media_items=media, has_link=False, links=[],
        is_article=False, article_title=random_text(rng), article_text=random_text(rng),
        is_retweet=rng.random() < 0.6, original_id=rng.choice([None, str(seq)]), original_content=random_original(rng),
    )
    return row


def test_merge_equals_sequential_walk(spark):
    rng = random.Random(7)
    sequences, seq = {}, 0
    for number in range(150):
        post_id = f"p{number}"
        sequences[post_id] = []
        for _ in range(rng.randint(1, 14)):
            seq += rng.randint(1, 3)
            sequences[post_id].append(random_row(rng, post_id, seq))
    rows = [tuple(r[f] for f in FIELDS) for rs in sequences.values() for r in rs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, POST_OBSERVATION)
    for bits in ((2, 4), (12, 24)):
        got = {r["id"]: r.asDict(recursive=True) for r in merge_posts(df, bits).collect()}
        assert len(got) == len(sequences)
        for post_id, observations in sequences.items():
            want, have = walk(observations), got[post_id]
            for name in ("author_handle", "content", "article_title", "article_text", "original_content",
                         "original_id", "has_quote", "is_retweet", "media_items"):
                assert have[name] == want[name], (bits, name, post_id, have[name], want[name])
            for name in ("author_name", "quote_id", "reply_id"):
                assert (have[name] or None) == (want[name] or None)


def sequential_authors(commands):
    state = {}
    for c in sorted(commands, key=lambda c: c["seq"]):
        handle = c["handle"].lstrip("@")
        if c["command"] == "upsert":
            a = state.setdefault(handle, {"tier": c["tier"], "weight": 50.0, "muted": False, "display_name": None})
            a["tier"] = min(a["tier"], c["tier"])
            a["display_name"] = c["display_name"] or a["display_name"]
        elif handle in state:
            a = state[handle]
            if c["command"] == "promote":
                a["tier"] = 1
            elif c["command"] == "demote":
                a["tier"] = c["tier"]
            elif c["command"] == "mute":
                a["muted"] = True
            elif c["command"] == "boost":
                a["weight"] = min(100.0, a["weight"] + c["amount"])
            elif c["command"] == "decay":
                a["weight"] = max(10.0, a["weight"] * (1 - c["amount"]))
    return state


def test_author_fold_equals_sequential_walk(spark):
    rng = random.Random(3)
    commands = []
    for seq in range(3000):
        kind = rng.choice(["upsert", "promote", "demote", "mute", "boost", "boost", "decay", "decay"])
        if kind == "mute" and rng.random() < 0.8:
            continue
        amount = {"boost": rng.uniform(0, 40), "decay": rng.choice([0.05, 0.5, 1.0])}.get(kind)
        commands.append(
            dict(handle=rng.choice(["", "@"]) + f"a{rng.randint(0, 60)}", command=kind, tier=rng.randint(1, 4),
                 display_name=rng.choice([None, f"n{seq}"]), category=None, amount=amount, seq=seq, at=None)
        )
    df = spark.createDataFrame([tuple(c.values()) for c in commands], AUTHOR_COMMAND)
    want = sequential_authors(commands)
    for bits in ((3, 6), (12, 24)):
        got = {r["handle"]: r for r in fold_authors(df, bits).collect()}
        assert got.keys() == want.keys()
        for handle, author in want.items():
            assert got[handle]["tier"] == author["tier"]
            assert got[handle]["muted"] == author["muted"]
            assert got[handle]["display_name"] == author["display_name"]
            assert abs(got[handle]["weight"] - author["weight"]) < 1e-9


def test_first_seen_row_wins(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("", 0, "no id")], "id string, seq long, v string")
    assert [tuple(r) for r in dedupe_first_seen(df).select("id", "v").collect()] == [("a", "early")]
