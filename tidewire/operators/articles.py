"""Article visuals and media texts; all work on the arrays inside a post's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import (
    let,
    looks_data_text,
    non_blank,
    or_blank,
    overlap_tokens,
    page_hint,
    strip,
)

DATA_KINDS = ["chart", "table", "document", "screenshot"]
# Order in which kinds are shown (fixed values).
_SHOWN_ORDER = ["chart", "table", "screenshot", "document"]
_WHY = "Most relevant quantitative visual supporting the article thesis."


def _text_blob(*parts: Column) -> Column:
    cleaned = F.transform(F.array(*parts), lambda p: F.lower(strip(or_blank(p))))
    return F.array_join(F.filter(cleaned, lambda p: p != ""), " ")


def _described(item: Column) -> Column:
    return _text_blob(*[item[f] for f in ("short_description", "prose_summary", "prose_text", "alt_text")])


def _kind(item: Column) -> Column:
    kind = F.lower(strip(or_blank(item["kind"])))
    chart, table = item["chart"], item["table"]
    has_chart = F.concat_ws("", chart["description"], chart["insight"], chart["implication"]) != ""
    has_table = (F.coalesce(F.size(table["columns"]), F.lit(0)) > 0) | (or_blank(table["summary"]) != "")
    return (
        F.when(kind.isin(DATA_KINDS), kind)
        .when(has_chart, "chart")
        .when(has_table, "table")
        .when(looks_data_text(_described(item)), "chart")
        .otherwise(kind)
    )


def _first_said(*texts: Column) -> Column:
    return strip(F.coalesce(*[non_blank(t) for t in texts], F.lit("")))


def _takeaway(item: Column, kind: Column) -> Column:
    chart, table = item["chart"], item["table"]
    return (
        F.when(kind == "chart", _first_said(chart["insight"], chart["implication"], chart["description"]))
        .when(kind == "table", _first_said(table["summary"], table["description"]))
        .when(kind.isin("document", "screenshot"), _first_said(item["prose_summary"], item["short_description"]))
        .otherwise(_first_said(item["short_description"]))
    )


def _visual(url: Column, kind: Column, is_top: bool, why: Column, takeaway: Column) -> Column:
    return F.struct(
        url.alias("url"),
        F.when(kind.isin(DATA_KINDS), kind).otherwise("chart").alias("kind"),
        F.lit(is_top).alias("is_top"),
        why.alias("why_important"),
        takeaway.alias("key_takeaway"),
    )


_VISUALS = "array<struct<url:string,kind:string,is_top:boolean,why_important:string,key_takeaway:string>>"


def article_visuals(top: Column, media: Column, max_items: int = 4) -> Column:
    """Top visual first, then data visuals by kind, each URL once, at most ``max_items``.

    ``top`` is struct(url, kind, why_important, key_takeaway) or null; ``media`` an array of analysed items.
    """
    none = F.array().cast(_VISUALS)
    if max_items <= 0:
        return none
    why, said = strip(or_blank(top["why_important"])), strip(or_blank(top["key_takeaway"]))
    top_kind = F.lower(strip(or_blank(top["kind"])))
    top_url = strip(or_blank(top["url"]))
    shown = (top_url != "") & (top_kind.isin(DATA_KINDS) | looks_data_text(_text_blob(why, said)))
    head = F.when(shown, F.array(_visual(top_url, top_kind, True, why, said)).cast(_VISUALS)).otherwise(none)
    candidates = F.transform(media, lambda m: let(_kind(m), lambda k: F.struct(
        strip(or_blank(m["url"])).alias("url"),
        k.alias("kind"),
        (k.isin(DATA_KINDS) | looks_data_text(_described(m))).alias("relevant"),
        _takeaway(m, k).alias("takeaway"),
    )))
    usable = F.filter(
        F.coalesce(candidates, F.array().cast("array<struct<url:string,kind:string,relevant:boolean,takeaway:string>>")),
        lambda c: c["relevant"] & (c["url"] != "") & ~F.coalesce(shown & (c["url"] == top_url), F.lit(False)),
    )

    def extras(items: Column) -> Column:
        once = F.filter(items, lambda c, i: ~F.exists(F.slice(items, F.lit(1), i), lambda e: e["url"] == c["url"]))
        visuals = F.transform(once, lambda c: _visual(c["url"], c["kind"], False, F.lit(""), c["takeaway"]))
        return let(visuals, lambda vs: F.concat(*[_of_kind(vs, kind) for kind in _SHOWN_ORDER]))

    return F.slice(F.concat(head, let(usable, extras).cast(_VISUALS)), 1, max_items)


def _of_kind(visuals: Column, kind: str) -> Column:
    return F.filter(visuals, lambda v: v["kind"] == kind)


def article_top_visual(media: Column, title: Column, summary: Column, points: Column) -> Column:
    """Best-evidenced visual of an article, or null.

    Charts and tables need a shared word or a number; documents and screenshots two shared words and a number.
    """
    said = F.flatten(F.transform(points, lambda p: F.array(p["point"], p["reasoning"], p["evidence"])))
    context = F.concat_ws(" ", title, summary, said)

    def candidate(item: Column, words: Column) -> Column:
        kind = F.lower(strip(or_blank(item["kind"])))
        chart, table = item["chart"], item["table"]
        texts = [
            F.concat_ws(" ", chart["description"], chart["insight"], chart["implication"]),
            F.concat_ws(" ", table["title"], table["description"], table["summary"]),
            F.concat_ws(" ", item["prose_summary"], item["short_description"], item["prose_text"]),
        ]
        text = strip(F.concat_ws(" ", *[strip(t) for t in texts]))
        specific = (
            F.when(kind == "chart", _first_said(chart["insight"], chart["description"]))
            .when(kind == "table", _first_said(table["summary"], table["description"]))
        )
        takeaway = F.coalesce(non_blank(specific), _first_said(item["prose_summary"], item["short_description"]))
        return F.struct(
            item["url"].alias("url"),
            kind.alias("kind"),
            text.rlike(r"\d").alias("numbers"),
            F.size(F.array_intersect(overlap_tokens(text), words)).alias("overlap"),
            takeaway.alias("takeaway"),
        )

    def judged(c: Column) -> Column:
        graph = c["kind"].isin("chart", "table")
        paper = c["kind"].isin("document", "screenshot")
        fits = (graph & ((c["overlap"] > 0) | c["numbers"])) | (paper & (c["overlap"] >= 2) & c["numbers"])
        score = F.when(graph, 100).otherwise(70) + F.when(c["numbers"], 10).otherwise(0) + c["overlap"] * 5
        ok = fits & (or_blank(c["url"]) != "") & (c["takeaway"] != "")
        return F.struct(F.when(ok, score).alias("score"), c["url"], c["kind"], c["takeaway"])

    best_type = "struct<score:int,url:string,kind:string,takeaway:string>"
    best = let(overlap_tokens(context), lambda words: F.aggregate(
        F.transform(media, lambda m: let(candidate(m, words), judged)),
        F.lit(None).cast(best_type),
        lambda acc, c: F.when(
            c["score"].isNotNull() & (acc.isNull() | (c["score"] > acc["score"])), c.cast(best_type)
        ).otherwise(acc),
    ))
    return let(best, lambda b: F.when(b.isNotNull(), F.struct(
        b["url"].alias("url"), b["kind"].alias("kind"), F.lit(_WHY).alias("why_important"),
        b["takeaway"].alias("key_takeaway"),
    )))


def stitch_documents(media: Column) -> Column:
    """Pages of a document (two or more with text) joined onto the first page, in page order; the others blanked.

    The joined page keeps its summary until a scorer replaces it.
    """
    pages = F.filter(
        F.transform(media, lambda m, i: F.struct(
            page_hint(strip(or_blank(m["prose_text"]))).alias("page"),
            i.alias("pos"),
            strip(or_blank(m["prose_text"])).alias("text"),
            F.lower(or_blank(m["kind"])).alias("kind"),
        )),
        lambda p: p["kind"].isin("document", "screenshot") & (p["text"] != ""),
    )
    ordered = F.array_sort(F.transform(pages, lambda p: F.struct(
        p["page"].isNull().alias("unnumbered"), p["page"].alias("page"), p["pos"].alias("pos"), p["text"].alias("text"),
    )))

    def stitched(found: Column) -> Column:
        whole = F.array_join(F.transform(found, lambda p: p["text"]), "\n\n")
        first = F.get(found, F.lit(0))["pos"]

        def rewrite(m: Column, i: Column) -> Column:
            blanked = m.withField("prose_text", F.lit("")).withField("prose_summary", F.lit("")).withField(
                "short_description", F.lit("")
            )
            return (
                F.when(i == first, m.withField("prose_text", whole))
                .when(F.exists(found, lambda p: p["pos"] == i), blanked)
                .otherwise(m)
            )

        return F.when(F.size(found) >= 2, F.transform(media, rewrite)).otherwise(media)

    return let(ordered, stitched)


def media_summary(media: Column) -> Column:
    """Best text per item, joined by pipes."""
    best = F.transform(media, lambda m: F.coalesce(
        non_blank(strip(or_blank(m["prose_summary"]))),
        F.concat(F.lit("Chart: "), non_blank(strip(or_blank(m["chart"]["description"])))),
        non_blank(strip(or_blank(m["short_description"]))),
    ))
    return or_blank(F.array_join(F.filter(best, lambda t: t.isNotNull()), " | "))


def media_context(media: Column) -> Column:
    """Numbered sections describing each item; items without text keep their number but give no section."""

    def section(m: Column, i: Column) -> Column:
        text = lambda c: non_blank(strip(or_blank(c)))
        chart = m["chart"]
        parts = [text(chart[f]) for f in ("description", "insight", "implication")]
        charted = F.concat_ws(
            "\n",
            F.concat(F.lit("Chart description: "), or_blank(parts[0])),
            F.concat(F.lit("Chart insight: "), parts[1]),
            F.concat(F.lit("Chart implication: "), parts[2]),
        )
        body = F.coalesce(
            F.concat(F.lit("Document text:\n"), text(m["prose_text"])),
            F.when(F.coalesce(*parts).isNotNull(), charted),
            F.concat(F.lit("Image description: "), text(m["short_description"])),
        )
        kind = F.coalesce(non_blank(m["kind"]), F.lit("image"))
        return F.concat(F.lit("Media "), i + 1, F.lit(" ("), kind, F.lit(")\n"), body)

    return or_blank(F.array_join(F.filter(F.transform(media, section), lambda s: s.isNotNull()), "\n\n"))


def with_article_visuals(posts: DataFrame, max_items: int = 4) -> DataFrame:
    return posts.withColumn("visuals", article_visuals(F.col("top_visual"), F.col("media_items"), max_items))
