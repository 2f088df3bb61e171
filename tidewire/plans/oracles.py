"""DuckDB twins of the feed views; every oracle query is appended to these."""

VIEWS = """WITH RECURSIVE
texts AS (
  SELECT e.event_id AS n,
         d.text || CASE WHEN e.event_id % 6 < 2 THEN ' https://t.co/' || e.event_id ELSE '' END AS content,
         d.text AS article_text
  FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)),
raw_posts AS (
  SELECT CAST(event_id AS VARCHAR) AS id, event_id AS n, 'u' || user_id AS author_handle,
         'User ' || user_id AS author_name, event_type || ' note ' || (event_id % 97) AS summary, ts AS created_at,
         CASE WHEN event_id % 10 <> 9 THEN ts + INTERVAL 5 MINUTE END AS processed_at,
         CASE WHEN event_id % 10 <> 9 THEN least(10.0::DOUBLE, floor(value) / 10.0::DOUBLE) END AS score, event_type,
         CASE event_id % 3 WHEN 0 THEN ['T' || (event_id % 7)] WHEN 1 THEN ['T' || (event_id % 7), 'X']
              ELSE []::VARCHAR[] END AS tickers,
         CASE event_type WHEN 'click' THEN ['earnings', 'equities'] WHEN 'view' THEN ['fed_policy']
              WHEN 'purchase' THEN ['crypto'] WHEN 'signup' THEN ['fed_policy', 'rates_fx'] ELSE []::VARCHAR[] END AS categories,
         CASE event_id % 4 WHEN 0 THEN ['ai-capex', 'rates'] WHEN 1 THEN ['rates'] ELSE []::VARCHAR[] END AS themes,
         event_id % 3 AS surprise,
         CASE WHEN event_id % 17 = 0 THEN 'supply_shock' END AS playbook_trigger,
         CASE event_id % 13 WHEN 0 THEN 'resolved' WHEN 1 THEN 'scheduled' END AS catalyst_status,
         CASE event_id % 4 WHEN 0 THEN 'long' WHEN 1 THEN 'short' WHEN 2 THEN 'na' ELSE 'up' END AS direction,
         event_id % 11 = 0 AS bookmarked, event_id % 4 = 0 AS has_quote,
         CASE WHEN event_id % 4 = 0 AND event_id > 0 THEN CAST(event_id // 2 AS VARCHAR) END AS quote_id,
         CASE WHEN event_id % 5 = 0 AND event_id > 7 THEN CAST(event_id - 7 AS VARCHAR) END AS reply_id,
         CASE WHEN event_id % 6 = 0 THEN CAST(event_id // 3 AS VARCHAR) END AS link_id,
         event_id % 7 = 0 AS has_media,
         CASE WHEN event_id % 7 = 0 THEN 'https://pic.example.com/' || (event_id % 100) || '.jpg' END AS media_url,
         event_id % 9 = 0 AS is_article, 'Report ' || (event_id % 30) AS article_title,
         'Preview of ' || event_type AS article_preview, event_id % 8 = 0 AS is_retweet,
         CASE WHEN event_id % 19 = 0 THEN ts END AS signal_emitted_at,
         CASE WHEN event_id % 20 = 0 THEN ts END AS reprocessed_at,
         CASE WHEN event_id % 15 = 0 THEN 'done' END AS analysis,
         CASE WHEN event_id % 21 = 0 THEN 'seen' END AS media_analysis,
         CASE WHEN event_id % 25 = 0 THEN 'short' END AS content_summary,
         CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) END AS included_in_digest
  FROM events),
posts AS (
  SELECT *, CASE WHEN score IS NULL THEN NULL WHEN score >= 8 THEN 'high_signal' WHEN score >= 6 THEN 'market_relevant'
                 WHEN score >= 4 THEN 'news' ELSE 'noise' END AS signal_tier FROM raw_posts),
observations AS (
  SELECT CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE CAST(event_id // 4 AS VARCHAR) END AS id, event_id AS seq,
         'u' || user_id AS author_handle, event_type AS source,
         CASE WHEN event_id % 5 > 1 THEN 'User ' || user_id END AS author_name,
         CASE WHEN event_id % 4 = 0 THEN split_part(article_text, '.', 1) || '...' ELSE article_text END AS content,
         CASE WHEN event_id % 5 > 2 THEN ts END AS created_at, event_id % 4 = 1 AS has_quote,
         CASE WHEN event_id % 4 = 1 THEN CAST(event_id // 2 AS VARCHAR) END AS quote_id,
         CASE WHEN event_id % 5 = 0 THEN CAST(event_id // 5 AS VARCHAR) END AS reply_id,
         CASE WHEN event_id % 5 = 0 THEN 'https://pic.example.com/' || (event_id % 40) || '.jpg' END AS media_url,
         CASE WHEN event_id % 6 < 2 THEN 'https://t.co/' || (event_id % 60) END AS link_url,
         event_id % 9 = 0 AS is_article, CASE WHEN event_id % 9 = 0 THEN repeat('T', event_id % 13) END AS article_title,
         CASE WHEN event_id % 9 = 0 THEN article_text END AS article_text, event_id % 8 < 3 AS is_retweet,
         CASE WHEN event_id % 8 = 1 THEN CAST(event_id // 8 AS VARCHAR) END AS original_id,
         CASE event_id % 8 WHEN 0 THEN 'abc...' WHEN 1 THEN repeat('ab', 1 + event_id % 5) WHEN 2 THEN 'ba' END AS original_content
  FROM events JOIN texts ON texts.n = event_id),
reactions AS (
  SELECT event_id AS reaction_id, CAST(event_id // 2 AS VARCHAR) AS post_id,
         CASE event_type WHEN 'click' THEN '>>' ELSE CASE WHEN event_id % 3 = 0 THEN 'x_author' ELSE '>' END END AS reaction_type,
         'u' || user_id AS target, ts AS created_at
  FROM events WHERE event_type IN ('click', 'view')),
authors AS (
  SELECT 'u' || c_custkey AS handle, 1 + c_custkey % 3 AS tier, lower(c_mktsegment) AS category,
         50.0::DOUBLE + c_custkey % 50 AS weight, c_custkey % 10 = 0 AS muted,
         CASE WHEN c_custkey % 4 <> 0 THEN round(c_acctbal / 1000.0, 1) + 0.0 END AS avg_score,
         CASE WHEN c_custkey % 6 <> 0 THEN TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (c_custkey % 28) END AS last_high_signal_at,
         CASE WHEN c_custkey % 5 <> 0 THEN TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (c_custkey % 600) END AS last_fetched_at
  FROM customer),
author_commands AS (
  SELECT 'u' || user_id AS handle,
         CASE event_type WHEN 'signup' THEN 'upsert' WHEN 'purchase' THEN 'boost' WHEN 'error' THEN 'decay'
              WHEN 'click' THEN 'promote' ELSE CASE WHEN event_id % 50 = 0 THEN 'mute' ELSE 'demote' END END AS command,
         1 + event_id % 4 AS tier, CASE WHEN event_id % 2 = 0 THEN 'Name ' || event_id END AS display_name,
         CASE event_type WHEN 'purchase' THEN floor(value) / 10.0 WHEN 'error' THEN 0.05 END AS amount, event_id AS seq
  FROM events),
usage_attempts AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS attempt_id, l_shipdate AS called_at, l_returnflag AS component,
         CASE WHEN l_partkey % 2 = 0 THEN 'gemini' ELSE 'deepseek' END AS provider,
         CASE l_partkey % 4 WHEN 0 THEN 'gemini-2.5-flash-lite-0925' WHEN 1 THEN 'deepseek-v4-pro'
              WHEN 2 THEN 'Gemini-2.5-Flash ' ELSE 'other-model' END AS model,
         l_discount > 0.01 AS completed, l_discount > 0.01 AND l_linestatus = 'F' AS success,
         CASE WHEN l_discount > 0.01 THEN CAST(l_quantity * 1000 AS BIGINT) END AS input_tokens,
         CASE WHEN l_discount > 0.01 THEN CAST(l_linenumber * 100 AS BIGINT) END AS output_tokens,
         CASE WHEN l_discount > 0.01 THEN CAST(l_partkey % 50 AS BIGINT) END AS reasoning_tokens,
         CASE WHEN l_discount > 0.01 THEN CAST(l_suppkey * 600 AS BIGINT) END AS cached_input_tokens,
         CASE WHEN l_discount > 0.01 THEN CAST(l_quantity * 1000 + l_linenumber * 100 AS BIGINT) END AS total_tokens,
         CASE WHEN l_discount > 0.01 THEN l_tax END AS latency_seconds,
         CASE WHEN l_discount > 0.01 THEN l_extendedprice / 100000 END AS estimated_cost_usd,
         CASE WHEN l_discount > 0.01 AND l_linestatus <> 'F' THEN least(500, 490 + l_linenumber * 5) END AS error_length
  FROM lineitem),
prices(provider, model, pin, pout, pcached) AS (VALUES {prices}),
metric_events AS (
  SELECT CASE event_type WHEN 'click' THEN 'pipeline.clicks' WHEN 'view' THEN 'web.views' ELSE 'scorer.' || event_type END
           || CASE WHEN event_id % 2 = 0 THEN '{{a=x,b=' || (event_id % 3) || '}}' ELSE '' END AS key,
         CASE event_type WHEN 'click' THEN 'pipeline.clicks' WHEN 'view' THEN 'web.views' ELSE 'scorer.' || event_type END AS name,
         CASE event_type WHEN 'click' THEN 'counter' WHEN 'view' THEN 'gauge' ELSE 'histogram' END AS type, value, ts AS tick
  FROM events),
fetch_log AS (
  SELECT 'user/' || o_orderstatus AS endpoint, 'u' || o_custkey AS handle, o_orderdate AS executed_at,
         o_orderkey % 100 AS fetched, o_orderkey % 7 AS new, o_orderkey AS run FROM orders),
media_log AS (
  SELECT 'https://pic.example.com/' || (event_id % 60) || '.jpg' AS media_url,
         CASE WHEN event_id % 3 <> 0 THEN 'result ' || event_id END AS result, event_id % 3 = 0 AS is_hit, ts AS updated_at
  FROM events),
media_cache AS (
  SELECT media_url, arg_max(result, updated_at) FILTER (NOT is_hit) AS result,
         max(updated_at) FILTER (NOT is_hit) AS updated_at, count(*) FILTER (is_hit) AS hits
  FROM media_log GROUP BY media_url HAVING count(*) FILTER (NOT is_hit) > 0),
analyses AS (
  SELECT CAST(event_id // 2 AS VARCHAR) AS id, event_id AS n,
         CASE event_id % 5 WHEN 0 THEN 'high_signal' WHEN 1 THEN 'news' WHEN 2 THEN 'odd' WHEN 3 THEN 'noise' END AS signal_tier,
         ['story ' || (event_id % 23), 'theme ' || event_type] AS narratives,
         CASE WHEN event_id % 3 = 0 THEN ['ZZ', 'T' || (event_id % 5)] ELSE []::VARCHAR[] END AS tickers,
         CASE WHEN event_id % 4 = 0 THEN event_type END AS sentiment, ts AS tick
  FROM events),
instruments AS (
  SELECT 'T' || p_partkey AS ticker,
         CASE p_partkey % 4 WHEN 0 THEN 'owned' WHEN 1 THEN 'peer' WHEN 2 THEN 'watchlist' ELSE 'expression' END AS relationship,
         CASE WHEN p_partkey % 2 = 0 THEN ['rates', lower(p_brand)] ELSE ['ai-capex'] END AS themes, p_partkey AS pos FROM part),
themes AS (
  SELECT CASE n_nationkey WHEN 0 THEN 'ai-capex' WHEN 1 THEN 'rates' ELSE lower(n_name) END AS id,
         CASE WHEN n_nationkey % 5 = 4 THEN 'closed' ELSE 'open' END AS status FROM nation),
catalysts AS (
  SELECT 'cat-' || s_suppkey AS id, DATE '2024-02-01' + CAST(s_suppkey % 20 AS INTEGER) AS date,
         CASE WHEN s_suppkey < 5 THEN 'T' || s_suppkey ELSE 'S' || s_suppkey END AS ticker,
         CASE WHEN s_suppkey = 7 THEN 'ai-capex' ELSE 'q' || s_suppkey END AS theme FROM supplier),
calendar AS (
  SELECT upper(CASE r_regionkey WHEN 0 THEN 'click note 5' WHEN 1 THEN 'view' WHEN 2 THEN 'note 7' ELSE r_name END) AS label,
         CASE r_regionkey WHEN 0 THEN 'fomc' ELSE 'cpi' END AS type, DATE '2024-02-01' + r_regionkey AS date FROM region),
corpus AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, text AS content, 'about ' || source AS summary, source AS author_handle,
         CASE WHEN doc_id % 3 = 0 THEN 'T1 X' ELSE '' END AS tickers_text, lang AS signal_tier,
         CAST(n_chars % 11 AS DOUBLE) AS score, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * doc_id AS created_at FROM documents),
corpus_tokens AS (
  SELECT *, {tok_content} AS tc, {tok_summary} AS ts, {tok_author} AS ta, {tok_tickers} AS tt FROM corpus),
threads AS (
  SELECT conv_id || '-' || turn AS id, CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS reply_id, turn, role,
         CAST(conv_id % 10 AS VARCHAR) AS thread, text AS content FROM conversations),
golden AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, quality * 5.0 AS score_min, 5.0 + quality * 5.0 AS score_max, toxic AS surprise,
         doc_id % 7 = 0 AS stale, CASE doc_id % 5 WHEN 0 THEN 'supply_shock' WHEN 1 THEN 'vol_substitution' END AS trigger,
         CASE WHEN doc_id % 3 = 0 THEN 'resolved' END AS catalyst, 'long' AS direction FROM labels),
golden_results AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, least(10.0, n_chars / 500.0) AS score, n_chars % 2 AS surprise, doc_id % 14 = 0 AS stale,
         CASE doc_id % 10 WHEN 0 THEN 'supply_shock' WHEN 2 THEN 'vol_substitution' WHEN 3 THEN 'ai_victim' END AS trigger,
         CASE WHEN doc_id % 6 = 0 THEN 'resolved' END AS catalyst,
         CASE WHEN doc_id % 4 = 0 THEN 'short' ELSE 'long' END AS direction FROM documents)
"""


def _tokens(column: str) -> str:
    return (
        f"list_filter(string_split_regex(strip_accents(lower({column})), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
    )


def views() -> str:
    from tidewire.constants import MODEL_PRICES

    prices = ", ".join(f"('{p}', '{m}', {i}, {o}, {c})" for p, m, i, o, c in MODEL_PRICES)
    return VIEWS.format(
        prices=prices,
        tok_content=_tokens("content"),
        tok_summary=_tokens("summary"),
        tok_author=_tokens("author_handle"),
        tok_tickers=_tokens("tickers_text"),
    )


def oracle(sql: str) -> str:
    """Full text of one oracle; ``sql`` starts with SELECT or with further views (``, name AS (...) SELECT``)."""
    sql = sql.strip()
    return views() + (sql if sql.startswith(",") else " " + sql)
