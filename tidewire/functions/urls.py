"""Link columns. All of them work on the arrays inside a row, so none needs a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire import constants as C
from tidewire.functions.text import collapse_spaces, let, or_blank, strip
from tidewire.schemas import LINKS

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
_LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def clean_url(value: Column) -> Column:
    return F.regexp_replace(strip(or_blank(value)), C.URL_TRAILING_PUNCTUATION, "")


def extract_urls(text: Column) -> Column:
    """Distinct URLs of a text in order of first appearance, trailing punctuation removed."""
    found = F.regexp_extract_all(or_blank(text), F.lit(C.URL_PATTERN), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, clean_url), lambda u: u != ""))


def status_id(url: Column) -> Column:
    """Numeric id out of a post URL, else null."""
    found = F.regexp_extract(url, C.STATUS_URL_PATTERN, 1)
    return F.when(found != "", found)


def domain(url: Column) -> Column:
    return F.lower(F.regexp_extract(or_blank(url), _HOST, 1))


def display_url(url: Column) -> Column:
    host = domain(url)
    path = F.regexp_replace(F.regexp_extract(url, _PATH, 1), r";[^/]*$", "")
    query = F.regexp_extract(url, _QUERY, 1)
    return F.when(host == "", url).otherwise(
        F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    )


def is_short(url: Column) -> Column:
    return F.split_part(domain(url), F.lit(":"), F.lit(1)).isin(C.SHORTENER_DOMAINS)


def post_url(handle: Column, post_id: Column, host: str = "x.com") -> Column:
    return F.concat(F.lit(f"https://{host}/"), handle, F.lit("/status/"), post_id)


def _link(url: Column, expanded: Column, shown: Column) -> Column:
    return F.struct(url.alias("url"), expanded.alias("expanded_url"), shown.alias("display_url"))


def _normalize(urls: Column, links: Column) -> Column:
    stored = F.transform(
        F.coalesce(links, F.array().cast(LINKS)),
        lambda k: F.struct(
            clean_url(k["url"]).alias("raw"),
            F.coalesce(F.nullif(clean_url(k["expanded_url"]), F.lit("")), clean_url(k["url"])).alias("resolved"),
            strip(or_blank(k["display_url"])).alias("shown"),
        ),
    )
    distinct = F.aggregate(
        F.filter(stored, lambda k: k["resolved"] != ""),
        F.array().cast("array<struct<raw:string,resolved:string,shown:string>>"),
        lambda acc, k: F.when(
            F.exists(acc, lambda a: (a["raw"] == k["raw"]) & (a["resolved"] == k["resolved"])), acc
        ).otherwise(F.array_append(acc, k)),
        lambda acc: F.transform(
            acc,
            lambda k: _link(
                F.when(k["raw"] != "", k["raw"]).otherwise(k["resolved"]),
                k["resolved"],
                F.when(k["shown"] != "", k["shown"]).otherwise(display_url(k["resolved"])),
            ),
        ),
    )

    def with_text_urls(known: Column) -> Column:
        seen = F.concat(F.transform(known, lambda k: k["url"]), F.transform(known, lambda k: k["expanded_url"]))
        return F.concat(
            known, F.transform(F.array_except(urls, seen), lambda u: _link(u, u, display_url(u)))
        )

    return let(distinct, with_text_urls)


def normalize_links(text: Column, links: Column) -> Column:
    """Stored links cleaned and made distinct by (raw, resolved), then the further URLs of the text."""
    return let(extract_urls(text), lambda urls: _normalize(urls, links))


def _pruned_urls(last: Column, normalized: Column, has_media: Column) -> Column:
    """URLs of the unresolved short link that ends a post: a pointer to the post's own media, not content."""
    prune = F.coalesce(has_media, F.lit(False)) | F.exists(normalized, lambda k: ~is_short(k["expanded_url"]))
    pruned = F.filter(
        normalized, lambda k: is_short(k["expanded_url"]) & ((k["url"] == last) | (k["expanded_url"] == last))
    )
    both = F.flatten(F.transform(pruned, lambda k: F.array(k["url"], k["expanded_url"])))
    return F.when(prune & last.isNotNull(), both).otherwise(F.array().cast("array<string>"))


def _tag(normalized: Column, dropped: Column) -> Column:
    return F.transform(
        normalized,
        lambda k, i: F.struct(
            i.alias("pos"),
            F.coalesce(status_id(k["expanded_url"]), status_id(k["url"])).alias("id"),
            k["expanded_url"].alias("url"),
            k["url"].alias("raw"),
            k["display_url"].alias("display_url"),
            (F.array_contains(dropped, k["url"]) | F.array_contains(dropped, k["expanded_url"])).alias("pruned"),
        ),
    )


def _classify(tagged: Column, post_id: Column) -> Column:
    def one(k: Column) -> Column:
        def earlier(test) -> Column:
            return F.exists(tagged, lambda e: (e["pos"] < k["pos"]) & ~e["pruned"] & test(e))

        inline = k["id"].isNotNull()
        kind = (
            F.when(k["pruned"], "pruned")
            .when(inline & (k["id"] == post_id), "self")
            .when(inline & earlier(lambda e: e["id"].isNotNull() & (e["id"] == k["id"])), "repeat")
            .when(inline, "inline")
            .when(earlier(lambda e: e["id"].isNull() & (e["url"] == k["url"])), "repeat")
            .otherwise("external")
        )
        return F.struct(
            k["pos"].alias("pos"),
            kind.alias("kind"),
            k["id"].alias("id"),
            k["url"].alias("url"),
            k["raw"].alias("raw"),
            k["display_url"].alias("display_url"),
            domain(k["url"]).alias("domain"),
        )

    return F.transform(tagged, one)


def link_kinds(post_id: Column, text: Column, links: Column, has_media: Column) -> Column:
    """Array of struct(pos, kind, id, url, raw, display_url, domain), one per distinct link.

    ``kind`` is pruned, self, inline, external, or repeat (of an earlier inline id or external target).
    """

    def with_urls(urls: Column) -> Column:
        last = F.when(F.size(urls) > 0, F.element_at(urls, -1))
        return let(
            _normalize(urls, links),
            lambda normalized: let(
                _tag(normalized, _pruned_urls(last, normalized, has_media)), lambda t: _classify(t, post_id)
            ),
        )

    return let(extract_urls(text), with_urls)


def inline_links(kinds: Column) -> Column:
    return F.transform(
        F.filter(kinds, lambda k: k["kind"] == "inline"),
        lambda k: F.struct(k["id"].alias("id"), k["url"].alias("url")),
    )


def external_links(kinds: Column) -> Column:
    return F.transform(
        F.filter(kinds, lambda k: k["kind"] == "external"),
        lambda k: F.struct(
            k["url"].alias("url"), k["display_url"].alias("display_url"), k["domain"].alias("domain")
        ),
    )


def _longest_first(items: Column, key) -> Column:
    return F.array_sort(items, lambda a, b: F.length(key(b)) - F.length(key(a)))


def _per_line(text: Column, edit) -> Column:
    lines = F.transform(
        F.split(text, _LINE_BREAK), lambda line: let(edit(line), lambda done: strip(collapse_spaces(done, "{2,}")))
    )
    return strip(F.array_join(F.filter(lines, lambda line: line != ""), "\n"))


def _token(url: Column) -> Column:
    return F.concat(F.lit(r"(?U)(^|\s)\Q"), url, F.lit(r"\E(?=\s|$)"))


def display_text(text: Column, kinds: Column) -> Column:
    """Raw links replaced by their targets, dropped links removed, blank space tidied where a link changed."""
    text = or_blank(text)
    swap_list = _longest_first(
        F.filter(kinds, lambda k: (k["kind"] == "external") & (k["raw"] != k["url"])), lambda k: k["raw"]
    )
    gone_links = F.filter(kinds, lambda k: (k["kind"] == "pruned") | k["id"].isNotNull())
    gone_list = _longest_first(
        F.array_distinct(F.flatten(F.transform(gone_links, lambda k: F.array(k["raw"], k["url"])))), lambda u: u
    )

    def swapped(swaps: Column) -> Column:
        def swap(line: Column) -> Column:
            return F.aggregate(
                swaps,
                line,
                lambda acc, k: F.when(
                    F.contains(acc, k["raw"]),
                    F.regexp_replace(
                        acc,
                        _token(k["raw"]),
                        F.concat(F.lit("$1"), F.regexp_replace(k["url"], r"([\\$])", r"\\$1")),
                    ),
                ).otherwise(acc),
            )

        return F.when(F.size(swaps) > 0, _per_line(text, swap)).otherwise(text)

    def cleared(gone: Column) -> Column:
        def drop(line: Column) -> Column:
            return F.aggregate(
                gone,
                line,
                lambda acc, u: F.when(F.contains(acc, u), F.regexp_replace(acc, _token(u), F.lit(" "))).otherwise(acc),
            )

        return let(
            let(swap_list, swapped),
            lambda shown: F.when(F.size(gone) > 0, _per_line(shown, drop)).otherwise(shown),
        )

    return let(gone_list, cleared)
