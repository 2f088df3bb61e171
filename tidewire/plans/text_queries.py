"""Text, link and JSON functions over whole tables, and ranked search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire import constants as C
from tidewire.functions import decode, text, urls
from tidewire.operators import feed, search
from tidewire.operators.skew import shared_folder
from tidewire.plans.catalog import query
from tidewire.plans.feed_views import Feed


@query("J1 J2 J3", """
SELECT id, array_to_string(tickers, ',') AS tickers, array_to_string(categories, ',') AS categories,
  array_to_string(themes, ',') AS themes FROM posts""")
def decode_lists(t: Feed) -> DataFrame:
    return t.posts.select(
        "id", decode.json_list_or_csv(F.col("tickers_raw")).alias("tickers"),
        decode.json_list_or_scalar(F.col("categories_raw")).alias("categories"),
        decode.json_list_strict(F.col("themes_raw")).alias("themes"),
    )


@query("J4", """
SELECT id, CASE WHEN n % 6 < 2 THEN 'https://t.co/' || n ELSE '' END AS urls FROM posts""")
def decode_objects(t: Feed) -> DataFrame:
    raw = F.concat(F.lit('{"items":['), F.array_join(F.concat(F.transform("links", lambda k: F.to_json(k)), F.array(F.lit("5"), F.lit('"x"'))), ","), F.lit("]}"))
    rows = t.posts.select("id", decode.json_links(raw).alias("links"))
    return rows.select("id", F.transform("links", lambda k: k["url"]).alias("urls"))


@query("J5 J6", r"""
SELECT doc_id, md5(regexp_replace(source || ' in ' || lang || chr(10) || text, '^\s+|\s+$', '', 'g')) AS point, lang || ' weeks' AS horizon,
  CASE WHEN n_chars % 100 = 0 THEN '0' ELSE regexp_replace(printf('%.2f', (n_chars % 100) / 100.0), '\.?0+$', '') END AS confidence,
  'A, ' || source AS tickers FROM documents""")
def article_sections(t: Feed) -> DataFrame:
    rows = t.table("documents")
    points = F.to_json(F.array(
        F.struct(F.lit("  ").alias("point")),
        F.struct(F.concat(F.lit(" "), "source", F.lit(" in "), "lang", F.lit("\n"), "text").alias("point")),
        F.struct(F.lit("later").alias("point")),
    ))
    actions = F.to_json(F.array(F.struct(
        F.lit(" act ").alias("action"), F.concat("lang", F.lit("_weeks")).alias("horizon"),
        (F.col("n_chars") % 100 / 100).alias("confidence"), F.array(F.lit("A"), F.lit(" "), F.col("source")).alias("tickers"),
    )))
    point = F.get(decode.article_points(points, 1), F.lit(0))
    action = F.get(decode.article_actions(actions), F.lit(0))
    return rows.select(
        "doc_id", F.md5(point["point"]).alias("point"), action["horizon"].alias("horizon"),
        action["confidence"].alias("confidence"), action["tickers"].alias("tickers"),
    )


@query("J9 X13", r"""
, d AS (SELECT doc_id, n_chars, lang, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents)
SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 'said' ELSE regexp_replace(substr(body, 1, 400), '^\s+|\s+$', '', 'g') END AS summary,
  CAST(CASE WHEN n_chars % 2 = 0 THEN 6 ELSE 0 END AS BIGINT) AS points,
  CASE WHEN n_chars % 2 = 0 THEN least(1.0, (n_chars % 30) / 10.0) END AS confidence,
  CASE WHEN n_chars % 2 = 0 THEN upper(lang) END AS tickers, md5(CASE WHEN length(body) <= 2000 THEN body
    ELSE regexp_replace(substr(body, 1, 1500), '\s+$', '') || chr(10) || chr(10) || '[...middle truncated to reduce analysis cost...]'
      || chr(10) || chr(10) || regexp_replace(right(body, 500), '^\s+', '') END) AS bounded FROM d""")
def article_results(t: Feed) -> DataFrame:
    point = F.struct(F.lit("p").alias("point"), F.lit("r").alias("reasoning"))
    raw = F.to_json(F.struct(
        F.lit(" said ").alias("short_summary"), F.array_repeat(point, 8).alias("primary_points"),
        F.array(F.struct(F.lit("act").alias("action"), (F.col("n_chars") % 30 / 10).alias("confidence"),
                         F.array(F.col("lang"), F.lit("")).alias("tickers"))).alias("actionable_items"),
    ))
    raw = F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("```json\n"), raw, F.lit("\n```"))).otherwise("no json")
    rows = t.table("documents").withColumn(
        "r", decode.article_result(raw, F.col("text"), F.lit(""), F.lit(None).cast("string"))
    )
    action = F.get("r.actionable_items", F.lit(0))
    return rows.select(
        "doc_id", F.col("r.short_summary").alias("summary"), F.size("r.primary_points").alias("points"),
        action["confidence"].alias("confidence"), F.array_join(action["tickers"], ",").alias("tickers"),
        F.md5(text.bounded_text(F.col("text"), 2000)).alias("bounded"),
    )


@query("J10", r"""
SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'chart' ELSE 'other' END AS kind,
  md5(regexp_replace(source || ': ' || text, '\s+$', '')) AS prose_text,
  CASE WHEN n_chars % 3 = 0 THEN lang ELSE '' END AS insight, lang AS charts_description, source AS charts_summary FROM documents""")
def media_results(t: Feed) -> DataFrame:
    raw = F.to_json(F.struct(
        F.when(F.col("n_chars") % 3 == 0, "Chart").alias("kind"), F.concat(F.lit("  "), "source", F.lit(": "), "text").alias("prose_text"),
        F.when(F.col("n_chars") % 3 == 0, F.struct(F.col("lang").alias("insight"))).alias("chart"),
    ))
    second = decode.charts_result(
        F.lit("chart"), F.col("lang"), F.lit("transcript"), F.col("source"), F.array(F.lit("T"))
    )
    rows = t.table("documents").select("doc_id", decode.media_result(raw).alias("m"), second.alias("c"))
    return rows.select(
        "doc_id", "m.kind", F.md5("m.prose_text").alias("prose_text"), "m.chart.insight", F.col("c.chart.description").alias("charts_description"),
        F.col("c.prose_summary").alias("charts_summary"),
    )


@query("X1 X3 X15", r"""
SELECT doc_id, regexp_matches(text, '(…|\.\.\.)\s*$') AS cut, length(text) AS size,
  regexp_matches(lower(text), 'earnings|eps|revenue|guidance|beat|miss|upgrade|downgrade|buy|sell|target|pt|q1|q2|q3|q4|quarterly|results|report')
    AS equity FROM documents""")
def text_flags(t: Feed) -> DataFrame:
    c = F.col("text")
    return t.table("documents").select(
        "doc_id", text.looks_truncated(c).alias("cut"), F.length(text.sanitize(c)).alias("size"),
        text.equity_context(c).alias("equity"),
    )


@query("X2", """
SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&lt;', '<'),
  '&amp;', '&')) AS html FROM pages""")
def unescape_html(t: Feed) -> DataFrame:
    return t.table("pages").select("page_id", F.md5(text.unescape_html(F.col("html"))).alias("html"))


@query("X4 X6", rf"""
SELECT page_id, md5(array_to_string(list_sort(list_distinct(list_filter(list_transform(
    regexp_extract_all(html, '{C.URL_PATTERN}'), lambda u: regexp_replace(u, '{C.URL_TRAILING_PUNCTUATION}', '')),
    lambda u: u <> ''))), ' ')) AS html_urls,
  array_to_string(list_distinct_ordered, ' ') AS urls,
  lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS domain,
  lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)
    || regexp_extract(url, '^[^?#]*(\?[^#]+)', 1) AS display_url
FROM (SELECT *, [regexp_replace(url, '[)\],.?!:;]+$', '')] AS list_distinct_ordered FROM pages)""")
def page_urls(t: Feed) -> DataFrame:
    twice = F.concat_ws(" ", F.lit("see"), F.col("url"), F.concat("url", F.lit("),")), F.lit("http:// nothing"))
    return t.table("pages").select(
        "page_id", F.md5(F.array_join(F.array_sort(urls.extract_urls(F.col("html"))), " ")).alias("html_urls"),
        F.array_join(urls.extract_urls(twice), " ").alias("urls"), urls.domain(F.col("url")).alias("domain"),
        urls.display_url(F.col("url")).alias("display_url"),
    )


@query("X5 X10", """
SELECT id, id AS status_id, 'https://x.com/' || author_handle || '/status/' || id AS url FROM posts""")
def status_urls(t: Feed) -> DataFrame:
    url = urls.post_url(F.col("author_handle"), F.col("id"))
    return t.posts.select("id", urls.status_id(url).alias("status_id"), url.alias("url"))


@query("X8 X9", """
SELECT id, CASE WHEN link_id <> id THEN link_id ELSE '' END AS inline,
  CASE WHEN n % 6 = 1 THEN 'https://news.example.com/a/' || (n % 50) ELSE '' END AS external,
  CASE WHEN n % 6 = 1 THEN 'news.example.com' ELSE '' END AS domain,
  md5(CASE WHEN n % 6 = 1 THEN tidy || ' https://news.example.com/a/' || (n % 50) WHEN n % 6 = 0 THEN tidy ELSE content END) AS shown
FROM (SELECT posts.*, content, array_to_string(list_filter(list_transform(string_split_regex(article_text, '\\r\\n|[\\n\\r\\v\\f\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'),
   lambda l: regexp_replace(regexp_replace(l, '\\s{2,}', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), lambda l: l <> ''), chr(10)) AS tidy
  FROM posts JOIN texts USING (n))""".replace("CASE WHEN link_id <> id THEN link_id ELSE '' END", "coalesce(CASE WHEN link_id <> id THEN link_id END, '')"))
def classify_links(t: Feed) -> DataFrame:
    kinds = urls.link_kinds(F.col("id"), F.col("content"), F.col("links"), F.lit(False))
    rows = t.full_posts.withColumn("kinds", kinds)
    external = urls.external_links(F.col("kinds"))
    return rows.select(
        "id", F.array_join(F.transform(urls.inline_links(F.col("kinds")), lambda k: k["id"]), ",").alias("inline"),
        F.array_join(F.transform(external, lambda k: k["url"]), ",").alias("external"),
        F.array_join(F.transform(external, lambda k: k["domain"]), ",").alias("domain"),
        F.md5(urls.display_text(F.col("content"), F.col("kinds"))).alias("shown"),
    )


@query("X7", """
SELECT id, CASE WHEN n % 6 < 2 THEN CASE WHEN n % 5 < 3 THEN 'https://long.example.com/' || (n % 5) ELSE 'https://t.co/s' || (n % 5) END ELSE '' END AS urls
FROM posts""")
def expand_short_urls(t: Feed) -> DataFrame:
    from tidewire.operators.links import expand_short_urls as expand

    short = F.concat(F.lit("https://t.co/s"), F.col("n") % 5)
    link = F.struct(short.alias("url"), F.lit("").alias("expanded_url"), F.lit("").alias("display_url"))
    posts = t.posts.select("id", F.when(F.col("n") % 6 < 2, F.array(link)).otherwise(F.array().cast("array<struct<url:string,expanded_url:string,display_url:string>>")).alias("links"))
    keys = t.table("region").where("r_regionkey < 3")
    url_map = keys.selectExpr("concat('https://t.co/s', r_regionkey) AS url", "concat('https://long.example.com/', r_regionkey) AS target")
    return expand(posts, url_map).select("id", F.transform("links", lambda k: k["expanded_url"]).alias("urls"))


@query("X14", r"""
SELECT event_id, 'buy T' || (event_id % 9) || ' and a$b $$C' AS q FROM events""")
def normalize_cashtags(t: Feed) -> DataFrame:
    raw = F.concat(F.lit("buy $T"), F.col("event_id") % 9, F.lit(" and a$b $$C"))
    return t.table("events").select("event_id", text.normalize_cashtags(raw).alias("q"))


@query("X18 S4", r"""
, said AS (SELECT id, n, is_retweet, author_handle, summary || ' & ' || replace(split_part(content, ' https://t.co/', 1), chr(10), ' / ') AS body
     FROM posts JOIN texts USING (n))
SELECT id, is_retweet OR n % 4 = 1 AS is_retweet,
  CASE WHEN NOT is_retweet AND n % 4 = 1 THEN 'orig' || (n % 3) ELSE author_handle END AS display_author_handle, id AS display_id,
  md5(CASE WHEN n % 4 = 1 AND is_retweet THEN 'RT @orig' || (n % 3) || ': ' ELSE '' END || body) AS display_content FROM said""")
def retweet_display(t: Feed) -> DataFrame:
    none = F.lit(None).cast("string")
    body = F.concat("summary", F.lit(" &amp; "), F.replace(F.split_part("content", F.lit(" https://t.co/"), F.lit(1)), F.lit("\n"), F.lit(" / ")))
    said = F.when(F.col("n") % 4 == 1, F.concat(F.lit("RT @orig"), F.col("n") % 3, F.lit(": "), body)).otherwise(body)
    names = ["original_id", "original_author_handle", "original_author_name", "original_content", "retweeted_by_handle"]
    posts = t.full_posts.withColumn("content", said).withColumns({n: none for n in names})
    shown = feed.retweet_display(posts)
    return shown.select(
        "id", "is_retweet", "display_author_handle", "display_id", F.md5("display_content").alias("display_content")
    )


@query("X11 X17", r"""
, d AS (SELECT doc_id, text, trim(regexp_replace(text, '[\s\x1c-\x1f]+', ' ', 'g')) AS flat FROM documents)
SELECT doc_id, md5(CASE WHEN length(flat) <= 900 THEN flat ELSE rtrim(substr(flat, 1, 897)) || '...' END) AS short,
  len(list_distinct(regexp_extract_all(lower(text), '[a-zA-Z]{3,}'))) AS words FROM d""")
def text_shapes(t: Feed) -> DataFrame:
    c = F.col("text")
    return t.table("documents").select(
        "doc_id", F.md5(text.truncate_context(c, 900)).alias("short"), F.size(text.overlap_tokens(c)).alias("words")
    )


@query("X12", r"""
, p AS (SELECT id, is_article, article_title, article_preview, regexp_replace(content, '^\s+|\s+$', '', 'g') AS said,
   regexp_replace(article_text, '^\s+|\s+$', '', 'g') AS body FROM posts JOIN texts USING (n)),
  a AS (SELECT *, substr(article_title || chr(10) || chr(10) || article_preview || chr(10) || chr(10) || body, 1, 6000) AS art FROM p)
SELECT id, md5(CASE WHEN is_article AND body <> '' AND (said = '' OR length(art) >= length(said) + 120) THEN art ELSE said END) AS text FROM a""")
def triage_text(t: Feed) -> DataFrame:
    columns = [F.col(c) for c in ("content", "is_article", "article_title", "article_preview", "article_text")]
    return t.full_posts.select("id", F.md5(text.triage_text(*columns)).alias("text"))


@query("X16 X19", rf"""
SELECT doc_id, text <> '' AND NOT regexp_matches(text, '{C.NOISE_IMAGE_PATTERN}') AND (regexp_matches(text, '{C.DATA_WORD_PATTERN}')
    OR regexp_matches(text, '{C.DATA_NUMBER_PATTERN}')) AS text_data,
  TRY_CAST(coalesce(nullif(regexp_extract(text, '(?i)\bpage\s*(\d+)\b', 1), ''),
    nullif(regexp_extract(text, '\b(\d+)\s*/\s*(\d+)\b', 1), '')) AS BIGINT) AS text_page,
  CAST(doc_id % 9 AS BIGINT) AS page, (source = 'src1' OR n_chars % 2 = 0) AND lang <> 'de' AS data FROM documents""")
def page_hints(t: Feed) -> DataFrame:
    hint = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("see Page "), F.col("doc_id") % 9)).otherwise(
        F.concat(F.col("doc_id") % 9, F.lit(" / 12"))
    )
    about = F.concat_ws(
        " ", F.lit("note"), F.when(F.col("source") == "src1", "a revenue chart"), F.when(F.col("n_chars") % 2 == 0, "up 5.5% today"),
        F.when(F.col("lang") == "de", "selfie"),
    )
    said = F.col("text")
    return t.table("documents").select(
        "doc_id", text.page_hint(hint).alias("page"), text.looks_data_text(about).alias("data"),
        text.page_hint(said).alias("text_page"), text.looks_data_text(said).alias("text_data"),
    )


@query("X20", r"""
, d AS (SELECT doc_id, replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10), ' ') AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) > 140 THEN regexp_replace(substr(s, 1, 137), '\s+$', '') || '...' ELSE s END AS line FROM d""")
def event_one_liners(t: Feed) -> DataFrame:
    return t.table("documents").select("doc_id", text.event_one_liner(F.lit(""), F.col("text")).alias("line"))


# --- search -----------------------------------------------------------------------------------------------------


def _bm25(terms: list[tuple[str, str]], match: str, filters: str = "TRUE", order: str = "raw", limit: int = 50) -> str:
    """Oracle for terms given as (frequency expression, column alias)."""
    tfs = ", ".join(f"{expr} AS tf{i}" for i, (expr, _) in enumerate(terms))
    dfs = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " ".join(
        f"- (CASE WHEN (docs - df{i} + 0.5) / (df{i} + 0.5) > 1 THEN ln((docs - df{i} + 0.5) / (df{i} + 0.5)) ELSE 1e-6 END)"
        f" * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * size / mean))"
        for i in range(len(terms))
    )
    return f"""
, c AS (SELECT *, len(tc) + len(ts) + len(ta) + len(tt) AS size, {tfs} FROM corpus_tokens),
  st AS (SELECT count(*) AS docs, avg(size) AS mean, {dfs} FROM c)
, h AS (SELECT *, 0.0 {score} AS raw FROM c, st WHERE ({match}) AND {filters} ORDER BY {order}, id LIMIT {limit})
SELECT id, round(raw, 6) AS rank FROM h"""


def _tf(word: str, columns: str = "tc ts ta tt") -> str:
    return "(" + " + ".join(f"len(list_filter({c}, lambda x: x = '{word}'))" for c in columns.split()) + ")"


@query("R1", _bm25([(_tf("the"), ""), (_tf("src7"), "")], "tf0 > 0 AND tf1 > 0"))
def search_all_terms(t: Feed) -> DataFrame:
    index = search.search_index(t.corpus)
    return search.text_search(index, must=[search.Term("The"), search.Term("src7")]).select("id", "rank")


@query("R1", _bm25([(_tf("the"), ""), (_tf("eaux"), "")], "tf0 > 0 OR tf1 > 0", "signal_tier <> 'zz' AND score >= 5 AND "
                   f"{_tf('src3')} = 0", limit=60))
def search_any_not(t: Feed) -> DataFrame:
    index = search.search_index(t.corpus)
    found = search.text_search(
        index, should=[search.Term("the"), search.Term("eaux")], must_not=[search.Term("src3")], min_score=5, limit=60
    )
    return found.select("id", "rank")


@query("R1", _bm25([(_tf("the"), ""), (_tf("eaux"), "")], "tf0 > 0 OR tf1 > 0", "signal_tier <> 'zz' AND score >= 5 AND "
                   f"{_tf('src3')} = 0", limit=60))
def search_top_shelves(t: Feed) -> DataFrame:
    """The same page from the shelves alone that can hold a row of it."""
    found = search.top_search(
        _stored_index(t), t.corpus, should=[search.Term("the"), search.Term("eaux")], must_not=[search.Term("src3")],
        min_score=5, limit=60,
    )
    return found.select("id", "rank")


@query("R1", _bm25([("(" + " + ".join(f"len(list_filter({c}, lambda x: starts_with(x, 'eau')))" for c in "tc ts ta tt".split()) + ")", "")],
                   "tf0 > 0", order="score DESC", limit=40))
def search_prefix(t: Feed) -> DataFrame:
    index = search.search_index(t.corpus)
    return search.text_search(index, must=[search.Term("eau", prefix=True)], order="score", limit=40).select("id", "rank")


@query("R1", _bm25([("len(list_filter(range(1, len(tc)), lambda i: tc[i] = 'of' AND tc[i + 1] = 'the'))", ""), (_tf("src1", "ta"), "")],
                   "tf0 > 0 OR tf1 > 0", order="created_at DESC", limit=80))
def search_phrase_column(t: Feed) -> DataFrame:
    index = search.search_index(t.corpus)
    terms = [search.Term("of the", column="content"), search.Term("src1", column="author_handle")]
    return search.text_search(index, should=terms, order="time", limit=80).select("id", "rank")


def _stored_index(t: Feed) -> str:
    path = f"{shared_folder(t.spark)}/search-{uuid.uuid4().hex}"
    search.write_index(t.corpus, path)
    return path


@query("R1", """
, w AS (
    SELECT id, unnest(tc) AS term, 'content' AS field FROM corpus_tokens
    UNION ALL SELECT id, unnest(ts), 'summary' FROM corpus_tokens
    UNION ALL SELECT id, unnest(ta), 'author_handle' FROM corpus_tokens
    UNION ALL SELECT id, unnest(tt), 'tickers_text' FROM corpus_tokens
), p AS (SELECT term, field, id, count(*) AS n FROM w GROUP BY ALL)
SELECT term, field, count(*) AS posts, sum(n)::BIGINT AS occurrences FROM p GROUP BY ALL""")
def search_stored_postings(t: Feed) -> DataFrame:
    stored = t.spark.read.parquet(f"{_stored_index(t)}/postings")
    return stored.groupBy("term", "field").agg(
        F.count(F.lit(1)).alias("posts"), F.sum(F.size("places")).alias("occurrences"))


@query("R1", _bm25([(_tf("the"), ""), (_tf("eaux"), "")], "tf0 > 0 OR tf1 > 0", "signal_tier <> 'zz' AND score >= 5 AND "
                   f"{_tf('src3')} = 0", limit=60))
def search_stored_any_not(t: Feed) -> DataFrame:
    found = search.stored_search(
        _stored_index(t), t.corpus, should=[search.Term("the"), search.Term("eaux")], must_not=[search.Term("src3")],
        min_score=5, limit=60,
    )
    return found.select("id", "rank")


@query("R1", _bm25([("(" + " + ".join(f"len(list_filter({c}, lambda x: starts_with(x, 'eau')))" for c in "tc ts ta tt".split()) + ")", "")],
                   "tf0 > 0", order="score DESC", limit=40))
def search_stored_prefix(t: Feed) -> DataFrame:
    found = search.stored_search(_stored_index(t), t.corpus, must=[search.Term("eau", prefix=True)], order="score", limit=40)
    return found.select("id", "rank")


@query("R1", _bm25([("len(list_filter(range(1, len(tc)), lambda i: tc[i] = 'of' AND tc[i + 1] = 'the'))", ""), (_tf("src1", "ta"), "")],
                   "tf0 > 0 OR tf1 > 0", order="created_at DESC", limit=80))
def search_stored_phrase(t: Feed) -> DataFrame:
    terms = [search.Term("of the", column="content"), search.Term("src1", column="author_handle")]
    found = search.stored_search(_stored_index(t), t.corpus, should=terms, order="time", limit=80)
    return found.select("id", "rank")
