"""Text columns. Every function takes and returns a Column; whole texts stay inside the JVM."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire import constants as C

# All Unicode white space, as characters for trimming and as a class for patterns. Trimming looks at the ends of
# a text only; a pattern would walk all of it.
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Character references as HTML defines them: decimal, hexadecimal, named.
_ENTITY = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# Plain ASCII texts are common and their class is several times faster.
_ASCII_SPACE = r"[\t-\r\x1c-\x20]"


def let(value: Column, body) -> Column:
    """Bind an expression once for a body that uses it repeatedly (lambda bodies share no subexpressions)."""
    return F.transform(F.array(value), body)[0]


def strip(value: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.btrim(value, F.lit(SPACES))


def rstrip(value: Column) -> Column:
    return F.rtrim(value, F.lit(SPACES))


def or_blank(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def non_blank(value: Column) -> Column:
    """Null for null and for the empty string."""
    return F.when(value != "", value)


def squeeze(value: Column) -> Column:
    """Runs of white space become one blank; edges are trimmed."""
    return let(strip(value), lambda text: collapse_spaces(text, "+"))


def collapse_spaces(text: Column, times: str) -> Column:
    """Runs of white space of the given regex length become one blank."""
    plain = F.octet_length(text) == F.length(text)
    narrow = F.regexp_replace(text, _ASCII_SPACE + times, " ")
    return F.when(plain, narrow).otherwise(F.regexp_replace(text, _SPACE + times, " "))


def sanitize(value: Column) -> Column:
    """Replace byte sequences that are no valid UTF-8 (lone surrogates among them) by U+FFFD."""
    return F.make_valid_utf8(value)


# Names that HTML also reads without a semicolon, longest first: one may start a longer word.
_BARE = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
# Code points that do not stand for themselves: C0 and C1 controls and those that are no characters.
_ODD_CODES = [*range(0xA0), *range(0xFDD0, 0xFDF0), *(p << 16 | low for p in range(17) for low in (0xFFFE, 0xFFFF))]


def _literal_map(pairs: dict[str, str]) -> Column:
    """A map constant; its rows are never built again, as it folds when the plan is made."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def _character(code: Column) -> Column:
    """The character of a valid code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _numeric(body: Column) -> Column:
    """The text of ``#65;`` or ``#x41;``."""
    hexadecimal = F.substring(body, 2, 1).isin("x", "X")
    digits = F.regexp_extract(body, r"^#[xX]?0*([0-9a-fA-F]*)", 1)
    code = F.when(F.length(digits) > 7, F.lit(0x110000)).when(
        hexadecimal, F.conv(F.when(digits == "", "0").otherwise(digits), 16, 10).cast("int")
    ).otherwise(F.when(digits == "", "0").otherwise(digits).cast("int"))
    odd = _literal_map({str(c): html.unescape(f"&#{c};") for c in _ODD_CODES})
    return let(
        code,
        lambda c: F.when((c > 0x10FFFF) | c.between(0xD800, 0xDFFF), F.lit("\ufffd"))
        .when((c < 0xA0) & (c > 0x1F) & (c < 0x7F), F.chr(c))
        .otherwise(F.coalesce(F.try_element_at(odd, c.cast("string")), _character(c))),
    )


def _reference(token: Column) -> Column:
    """The text of one matched reference, ``&`` included; unknown names stay as they are."""
    names = _literal_map(html.entities.html5)
    body = F.substring(token, 2, 40)

    def named(body: Column) -> Column:
        bare = F.regexp_extract(body, "^(" + "|".join(_BARE) + ")", 1)
        start = let(
            bare,
            lambda b: F.when(
                b != "", F.concat(F.try_element_at(names, b), F.substr(body, F.length(b) + 1))
            ).otherwise(F.concat(F.lit("&"), body)),
        )
        return F.coalesce(F.try_element_at(names, body), start)

    # The five usual ones come first: the rest of the table is walked.
    common = F.when(body == "amp;", "&").when(body == "lt;", "<").when(body == "gt;", ">").when(body == "quot;", '"')
    number = _numeric(F.substring(token, 2, 1_000_000_000))
    return common.when(F.substring(body, 1, 1) == "#", number).otherwise(let(body, named))


def unescape_html(value: Column) -> Column:
    """Decode HTML references; a text without ``&`` is left alone."""
    tokens = F.regexp_extract_all(value, F.lit(_ENTITY), F.lit(0))
    pieces = F.split(value, _ENTITY, -1)
    decoded = F.concat(F.transform(tokens, _reference), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(pieces, decoded, lambda a, b: F.concat(a, b)), "")
    return F.when(F.contains(value, F.lit("&")), joined).otherwise(value)


def fixed(value: Column, places: int) -> Column:
    """A double to ``places`` digits by its exact binary value; exact ties go to the even digit.

    The nearest half step ``n`` is a whole number of halves of the last digit. Where it is odd, the side of the tie on
    which the value lies decides: the value's leading and trailing bits are multiplied apart, so nothing is rounded.
    """
    steps = 2 * 10**places

    def text(v: Column) -> Column:
        n = F.rint(v * steps)
        head = v.cast("float").cast("double")
        off = (head * steps - n) + (v - head) * steps
        even = F.rint(n / 4) * 2
        odd = F.when(off > 0, (n + 1) / 2).when(off < 0, (n - 1) / 2).otherwise(even)
        return F.format_string(f"%.{places}f", F.when(n % 2 == 0, n / 2).otherwise(odd) / 10**places)

    shown = F.when(F.abs(value) < 1e9, let(F.abs(value), text))
    sign = F.when(value < 0, "-").otherwise("")
    return F.coalesce(F.concat(sign, shown), F.format_string(f"%.{places}f", value))


def looks_truncated(value: Column) -> Column:
    """Right-trimmed text ends with an ellipsis."""
    kept = rstrip(value)
    return F.coalesce(kept.endswith("…") | kept.endswith("..."), F.lit(False))


def ellipsize(value: Column, limit: int) -> Column:
    """Cut to ``limit`` characters, the last three being dots."""
    cut = lambda v: F.concat(rstrip(F.substring(v, 1, max(0, limit - 3))), F.lit("..."))
    return let(value, lambda v: F.when(F.length(v) <= limit, v).otherwise(cut(v)))


def truncate_context(value: Column, limit: int) -> Column:
    """White space squeezed, then cut to ``limit`` characters.

    What follows the cut does not matter, so a long text is squeezed from its start first and in full only if that
    start turns out too short (long runs of blanks).
    """
    start = lambda v: squeeze(F.substring(v, 1, 2 * limit))
    return let(
        or_blank(value),
        lambda v: let(
            start(v),
            lambda s: ellipsize(F.when((F.length(s) > limit) | (F.length(v) <= 2 * limit), s).otherwise(squeeze(v)), limit),
        ),
    )


def triage_text(content: Column, is_article: Column, title: Column, preview: Column, body: Column) -> Column:
    """Text shown to a scorer: the article where it is clearly richer than the post."""
    parts = F.filter(F.transform(F.array(title, preview, body), lambda p: strip(or_blank(p))), lambda p: p != "")
    whole = F.substring(F.array_join(parts, "\n\n"), 1, 6000)
    has_body = F.coalesce(is_article, F.lit(False)) & (strip(or_blank(body)) != "")
    return let(
        F.struct(strip(or_blank(content)).alias("text"), F.when(has_body, whole).alias("article")),
        lambda s: F.when(
            (s["text"] == "") | (F.length(s["article"]) >= F.length(s["text"]) + 120), F.coalesce(s["article"], s["text"])
        ).otherwise(s["text"]),
    )


def bounded_text(value: Column, max_chars: int) -> Column:
    """Long texts keep their first three quarters and their last quarter of the budget."""

    def cut(text: Column) -> Column:
        if max_chars <= 1000:
            return strip(F.substring(text, 1, max_chars))
        head = int(max_chars * 0.75)
        return F.concat(
            rstrip(F.substring(text, 1, head)),
            F.lit("\n\n[...middle truncated to reduce analysis cost...]\n\n"),
            F.ltrim(F.right(text, F.lit(max_chars - head)), F.lit(SPACES)),
        )

    return let(strip(or_blank(value)), lambda v: F.when(F.length(v) <= max_chars, v).otherwise(cut(v)))


def normalize_cashtags(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)(?<![\w$])\$([A-Za-z][A-Za-z0-9_]*)", "$1")


def equity_context(value: Column) -> Column:
    """Any equity word occurs in the lower-cased text (as a substring)."""
    return let(F.lower(value), lambda v: F.exists(F.array(*[F.lit(k) for k in C.EQUITY_KEYWORDS]), lambda k: F.contains(v, k)))


def page_hint(value: Column) -> Column:
    """Page number named in the text: ``page N`` first, else the N of ``N/M``."""
    named = F.regexp_extract(value, r"(?i)\bpage\s*(\d+)\b", 1)
    ratio = F.regexp_extract(value, r"\b(\d+)\s*/\s*(\d+)\b", 1)
    return F.coalesce(non_blank(named), non_blank(ratio)).try_cast("long")


def overlap_tokens(value: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(value), F.lit("[a-zA-Z]{3,}"), F.lit(0)))


def retweet_parts(content: Column) -> Column:
    """``RT @handle: text`` -> struct(handle, text); null where the text is no such line."""
    content = or_blank(content)
    handle = F.regexp_extract(content, C.RETWEET_PATTERN, 1)
    text = non_blank(strip(F.regexp_extract(content, C.RETWEET_PATTERN, 2)))
    return F.when(
        handle != "", F.struct(handle.alias("handle"), F.when(~looks_truncated(text), text).alias("text"))
    )


def looks_data_text(value: Column) -> Column:
    text = or_blank(value)
    return (
        (text != "")
        & ~text.rlike(C.NOISE_IMAGE_PATTERN)
        & (text.rlike(C.DATA_WORD_PATTERN) | text.rlike(C.DATA_NUMBER_PATTERN))
    )


def event_one_liner(summary: Column, content: Column) -> Column:
    text = F.coalesce(non_blank(summary), non_blank(content), F.lit("Market signal"))
    text = F.replace(strip(text), F.lit("\n"), F.lit(" "))
    return F.when(F.length(text) > 140, F.concat(rstrip(F.substring(text, 1, 137)), F.lit("..."))).otherwise(text)


def needs_hydration(is_retweet: Column, original_id: Column, original_content: Column, content: Column) -> Column:
    """A retweet whose original is missing or cut and would have to be read again."""
    has_original = (or_blank(original_id) != "") & (or_blank(original_content) != "")
    cut_original = looks_truncated(original_content)
    return F.coalesce(is_retweet, F.lit(False)) & F.when(has_original & ~cut_original, False).when(
        cut_original, True
    ).otherwise(looks_truncated(content))


def brief_text(summary: Column, content: Column, width: int = 80) -> Column:
    text = F.coalesce(non_blank(summary), content)
    return F.substring(F.translate(text, "\n", " "), 1, width)
