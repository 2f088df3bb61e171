"""Tolerant JSON columns: decoded once where data enters, typed afterwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire import constants as C
from tidewire.functions.text import fixed, let, non_blank, or_blank, strip
from tidewire.schemas import ACTIONS, ANALYSED_MEDIA, CHART, LINKS, POINTS, TABLE

_EMPTY = "array<string>"


def whole_json(text: Column) -> Column:
    """The text as one JSON value; null where anything stands before or behind it.

    The parser stops behind the first value. Put into a list and into an object, a text that is more than one value
    breaks at least one of the two, or gives a longer list.
    """
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    named = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when((F.size(listed) == 1) & named.isNotNull(), listed[0])


def closed_json(text: Column) -> Column:
    """``whole_json`` of a text that ends where its first bracket closes, as ``read_objects`` gives them: parsed once."""
    return F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$[0]", "variant")


def _strings(value: Column) -> Column:
    """JSON list as strings; null where the text is no list."""
    parsed = whole_json(value)
    is_list = F.schema_of_variant(parsed).startswith("ARRAY")
    return F.when(is_list, F.from_json(value, "array<string>"))


def json_list_or_csv(value: Column) -> Column:
    """JSON list, else comma-separated text; null and empty text give an empty list."""
    csv = F.filter(F.transform(F.split(value, ","), strip), lambda t: t != "")
    return F.when(or_blank(value) == "", F.array().cast(_EMPTY)).otherwise(F.coalesce(_strings(value), csv))


def json_list_or_scalar(value: Column) -> Column:
    """JSON list, a JSON string as a singleton, or the raw text itself as a singleton."""
    scalar = F.try_variant_get(whole_json(value), "$", "string")
    return F.when(or_blank(value) == "", F.array().cast(_EMPTY)).otherwise(
        F.coalesce(_strings(value), F.array(F.coalesce(scalar, value)))
    )


def json_list_strict(value: Column) -> Column:
    return F.coalesce(_strings(value), F.array().cast(_EMPTY))


def json_objects(value: Column, schema: str) -> Column:
    """Objects of a JSON list; ``{"items": [...]}`` is accepted too; other elements are dropped."""
    variant = whole_json(value)
    listed = F.coalesce(
        F.try_variant_get(variant, "$.items", "array<variant>"), F.try_variant_get(variant, "$", "array<variant>")
    )
    objects = F.filter(listed, lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    element = schema.removeprefix("array<").removesuffix(">")
    return F.coalesce(
        F.transform(objects, lambda v: F.from_json(F.to_json(v), element)), F.array().cast(schema)
    )


def json_links(value: Column) -> Column:
    return json_objects(value, LINKS)


def json_media(value: Column) -> Column:
    return json_objects(value, ANALYSED_MEDIA)


def article_points(value: Column, limit: int | None = None) -> Column:
    """Points with text, trimmed, optionally the first ``limit``."""
    points = F.filter(
        F.transform(
            json_objects(value, POINTS),
            lambda p: F.struct(*[strip(or_blank(p[f])).alias(f) for f in ("point", "reasoning", "evidence")]),
        ),
        lambda p: p["point"] != "",
    )
    return points if limit is None else F.slice(points, 1, limit)


def format_confidence(value: Column) -> Column:
    """Numbers to two places without trailing zeros; other text trimmed; null blank."""
    number = value.try_cast("double")
    short = F.regexp_replace(fixed(number, 2), r"\.?0+$", "")
    return F.when(number.isNotNull(), short).otherwise(strip(or_blank(value)))


def article_actions(value: Column, limit: int | None = None) -> Column:
    actions = F.filter(
        F.transform(
            json_objects(value, ACTIONS),
            lambda a: F.struct(
                strip(or_blank(a["action"])).alias("action"),
                strip(or_blank(a["trigger"])).alias("trigger"),
                F.replace(strip(or_blank(a["horizon"])), F.lit("_"), F.lit(" ")).alias("horizon"),
                format_confidence(a["confidence"]).alias("confidence"),
                F.array_join(F.filter(F.transform(a["tickers"], strip), lambda t: t != ""), ", ").alias("tickers"),
            ),
        ),
        lambda a: a["action"] != "",
    )
    actions = F.transform(actions, lambda a: a.withField("tickers", or_blank(a["tickers"])))
    return actions if limit is None else F.slice(actions, 1, limit)


def _container(parsed: Column) -> Column:
    """The value where it is a list or an object, else null."""
    kind = F.schema_of_variant(parsed)
    return F.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), parsed)


def _close(text: Column, body: Column) -> Column:
    """The text, or what starts at its first bracket, parsed; cut lists and objects are closed."""
    trimmed = F.regexp_replace(body, r"\s*,?\s*$", "")
    last_object = F.regexp_extract(body, r"(?s)^(.*\})", 1)
    return F.coalesce(
        _container(whole_json(non_blank(text))),
        _container(whole_json(non_blank(body))),
        # Prose behind a list or an object: what ends at its last bracket.
        _container(whole_json(F.regexp_extract(body, r"(?s)^(\[.*\])", 1))),
        _container(whole_json(F.regexp_extract(body, r"(?s)^(\{.*\})", 1))),
        # Prose with brackets before the results: what starts at the first list of objects.
        _container(whole_json(F.regexp_extract(text, r"(?s)(\[\s*\{.*\])", 1))),
        F.when(body.startswith("["), F.try_parse_json(F.concat(trimmed, F.lit("]")))),
        F.when(
            body.startswith("[") & (last_object != ""), F.try_parse_json(F.concat(last_object, F.lit("]")))
        ),
        F.when(body.startswith("{"), F.try_parse_json(F.concat(trimmed, F.lit("}")))),
    )


def _unfence(text: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n?", ""), r"\n?[ \t]*```[ \t]*$", "")
    return F.when(text.startswith("```"), inner).otherwise(text)


def model_output(value: Column) -> Column:
    """Raw scorer text -> VARIANT: code fences removed, leading prose skipped, a cut array closed; else null."""
    return let(
        strip(or_blank(value)),
        lambda text: let(
            _unfence(text), lambda plain: let(F.regexp_extract(plain, r"(?s)([\[{].*)$", 1), lambda b: _close(plain, b))
        ),
    )


def model_items(value: Column) -> Column:
    """Result objects of a raw scorer text: an ``items`` wrapper is opened, a single object becomes a list."""

    def opened(parsed: Column) -> Column:
        kind = F.schema_of_variant(parsed)
        return (
            F.when(kind.startswith("ARRAY"), F.try_variant_get(parsed, "$", "array<variant>"))
            .when(
                F.try_variant_get(parsed, "$.items", "array<variant>").isNotNull(),
                F.try_variant_get(parsed, "$.items", "array<variant>"),
            )
            .when(kind.startswith("OBJECT"), F.array(parsed))
        )

    objects = let(model_output(value), opened)
    return F.filter(objects, lambda v: F.schema_of_variant(v).startswith("OBJECT"))


def first_object(value: Column) -> Column:
    """Parsed scorer text; of a list, its first element."""

    def pick(parsed: Column) -> Column:
        is_list = F.schema_of_variant(parsed).startswith("ARRAY")
        return F.when(is_list, F.try_variant_get(parsed, "$[0]", "variant")).otherwise(parsed)

    return let(model_output(value), pick)


def has_score(item: Column) -> Column:
    """The item has an id, and its score is a number or missing."""
    stated = F.try_variant_get(item, "$.score", "variant")
    missing = stated.isNull() | (F.schema_of_variant(stated) == "VOID")
    return non_blank(F.try_variant_get(item, "$.id", "string")).isNotNull() & (
        missing | F.try_variant_get(item, "$.score", "double").isNotNull())


def score_item(item: Column) -> Column:
    """One raw result object -> normalised score struct."""

    def get(path: str, kind: str = "string") -> Column:
        return F.try_variant_get(item, f"$.{path}", kind)

    listed = get("categories", "array<string>")
    categories = F.coalesce(
        F.when(F.size(listed) > 0, listed),
        F.when(non_blank(get("categories")).isNotNull() & listed.isNull(), F.array(get("categories"))),
        F.array(F.coalesce(get("category"), F.lit("noise"))),
    )
    surprise = F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.coalesce(get("surprise", "double"), F.lit(0.0)))).cast("int")
    one_of = lambda v, allowed: F.when(v.isin(allowed), v)
    empty = F.array().cast(_EMPTY)
    return F.struct(
        or_blank(get("id")).alias("id"),
        F.coalesce(get("score", "double"), F.lit(0.0)).alias("score"),
        categories.alias("categories"),
        or_blank(get("summary")).alias("summary"),
        F.coalesce(get("tickers", "array<string>"), empty).alias("tickers"),
        surprise.alias("surprise"),
        F.coalesce(get("is_stale_repeat", "boolean"), F.lit(False)).alias("is_stale_repeat"),
        F.coalesce(get("themes", "array<string>"), empty).alias("themes"),
        one_of(get("playbook_trigger"), C.PLAYBOOK_TRIGGERS).alias("playbook_trigger"),
        one_of(get("catalyst"), C.CATALYST_STATUSES).alias("catalyst_status"),
        F.coalesce(one_of(get("direction"), C.DIRECTIONS), F.lit("na")).alias("direction"),
    )


def article_result(raw: Column, text: Column, title: Column, preview: Column) -> Column:
    """Raw article summary -> struct(short_summary, primary_points, actionable_items).

    An empty article, or output that is no object, gives a plain summary and empty lists.
    """
    body = strip(or_blank(text))
    named = F.coalesce(non_blank(preview), non_blank(title))
    fallback = strip(F.coalesce(named, F.substring(body, 1, 400)))
    empty_article = body == ""
    return let(
        F.when(~empty_article, first_object(raw)),
        lambda v: _article_struct(v, F.when(empty_article, strip(or_blank(named))).otherwise(fallback)),
    )


def _field(v: Column, path: str) -> Column:
    return strip(or_blank(F.try_variant_get(v, f"$.{path}", "string")))


def _members(v: Column, path: str) -> Column:
    """Objects of a list member; an empty list where there is none."""
    found = F.try_variant_get(v, f"$.{path}", "array<variant>")
    objects = F.filter(found, lambda m: F.schema_of_variant(m).startswith("OBJECT"))
    return F.coalesce(objects, F.array().cast("array<variant>"))


def _article_struct(v: Column, fallback: Column) -> Column:
    points = F.filter(
        F.transform(
            _members(v, "primary_points"),
            lambda m: F.struct(*[_field(m, f).alias(f) for f in ("point", "reasoning", "evidence")]),
        ),
        lambda p: p["point"] != "",
    )

    def action(m: Column) -> Column:
        confidence = F.coalesce(F.try_variant_get(m, "$.confidence", "double"), F.lit(0.0))
        tickers = F.filter(F.try_variant_get(m, "$.tickers", "array<string>"), lambda t: strip(t) != "")
        return F.struct(
            *[_field(m, f).alias(f) for f in ("action", "trigger", "horizon")],
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"),
            F.coalesce(F.transform(tickers, lambda t: F.upper(t)), F.array().cast(_EMPTY)).alias("tickers"),
        )

    actions = F.filter(F.transform(_members(v, "actionable_items"), action), lambda a: a["action"] != "")
    return F.struct(
        F.coalesce(non_blank(_field(v, "short_summary")), fallback).alias("short_summary"),
        F.slice(points, 1, 6).alias("primary_points"),
        actions.alias("actionable_items"),
    )


MEDIA_RESULT = (
    f"struct<kind:string,short_description:string,prose_text:string,prose_summary:string,chart:{CHART},table:{TABLE}>"
)


def _chart(kind_is: Column | None = None, **values: Column) -> Column:
    blank, empty = F.lit(""), F.array().cast(_EMPTY)
    made = F.struct(
        *[F.coalesce(values.get(f, blank), blank).alias(f) for f in ("type", "description", "insight", "implication")],
        F.coalesce(values.get("tickers", empty), empty).alias("tickers"),
    )
    return made if kind_is is None else F.when(kind_is, made)


def _table(kind_is: Column | None = None, **values: Column) -> Column:
    blank, empty = F.lit(""), F.array().cast(_EMPTY)
    grid = F.array().cast("array<array<string>>")
    made = F.struct(
        F.coalesce(values.get("title", blank), blank).alias("title"),
        F.coalesce(values.get("description", blank), blank).alias("description"),
        F.coalesce(values.get("columns", empty), empty).alias("columns"),
        F.coalesce(values.get("rows", grid), grid).alias("rows"),
        F.coalesce(values.get("summary", blank), blank).alias("summary"),
        F.coalesce(values.get("tickers", empty), empty).alias("tickers"),
    )
    return made if kind_is is None else F.when(kind_is, made)


def media_result(raw: Column) -> Column:
    """Vision output (a direct provider's object) -> media struct with defaults."""

    def build(first: Column) -> Column:
        def get(path: str, kind: str = "string") -> Column:
            return F.try_variant_get(first, f"$.{path}", kind)

        texts = [strip(or_blank(get(f))).alias(f) for f in ("short_description", "prose_text", "prose_summary")]
        chart = _chart(
            **{f: get(f"chart.{f}") for f in ("type", "description", "insight", "implication")},
            tickers=get("chart.tickers", _EMPTY),
        )
        table = _table(
            **{f: get(f"table.{f}") for f in ("title", "description", "summary")},
            columns=get("table.columns", _EMPTY),
            rows=get("table.rows", "array<array<string>>"),
            tickers=get("table.tickers", _EMPTY),
        )
        kind = F.lower(F.coalesce(non_blank(get("kind")), F.lit("other")))
        shaped = F.struct(kind.alias("kind"), *texts, chart.alias("chart"), table.alias("table"))
        return F.when(first.isNotNull(), shaped)

    return let(first_object(raw), build)


def charts_result(kind: Column, title: Column, transcript: Column, insight: Column, tickers: Column) -> Column:
    """Chart-reader output (kind, title, transcript, insight, tickers) -> the same media struct."""
    title, transcript, insight = (strip(or_blank(c)) for c in (title, transcript, insight))
    shown = F.coalesce(non_blank(insight), non_blank(title), transcript)
    return F.struct(
        kind.alias("kind"),
        shown.alias("short_description"),
        transcript.alias("prose_text"),
        insight.alias("prose_summary"),
        _chart(
            kind == "chart",
            description=F.coalesce(non_blank(title), transcript),
            insight=insight,
            tickers=tickers,
        ).alias("chart"),
        _table(
            kind == "table", title=title, description=transcript, summary=insight, tickers=tickers
        ).alias("table"),
    )
