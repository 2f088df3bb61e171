"""Schemas of the append logs and of nested values (DDL strings, usable wherever Spark takes a schema)."""

LINK = "struct<url:string,expanded_url:string,display_url:string>"
LINKS = f"array<{LINK}>"
MEDIA_ITEM = "struct<url:string,type:string,source:string,media_id:string>"
MEDIA_ITEMS = f"array<{MEDIA_ITEM}>"

CHART = "struct<type:string,description:string,insight:string,implication:string,tickers:array<string>>"
TABLE = (
    "struct<title:string,description:string,columns:array<string>,rows:array<array<string>>,"
    "summary:string,tickers:array<string>>"
)
ANALYSED_MEDIA_ITEM = (
    "struct<url:string,type:string,source:string,media_id:string,kind:string,alt_text:string,"
    f"short_description:string,prose_text:string,prose_summary:string,chart:{CHART},table:{TABLE}>"
)
ANALYSED_MEDIA = f"array<{ANALYSED_MEDIA_ITEM}>"

POINTS = "array<struct<point:string,reasoning:string,evidence:string>>"
ACTIONS = "array<struct<action:string,trigger:string,horizon:string,confidence:string,tickers:array<string>>>"

POST_OBSERVATION = (
    "id string, author_handle string, author_name string, content string, created_at timestamp, source string, "
    "has_quote boolean, quote_id string, reply_id string, conversation_id string, "
    f"has_media boolean, media_items {MEDIA_ITEMS}, has_link boolean, links {LINKS}, "
    "is_article boolean, article_title string, article_preview string, article_text string, "
    "is_retweet boolean, retweeted_by_handle string, retweeted_by_name string, original_id string, "
    "original_author_handle string, original_author_name string, original_content string, seq long"
)

SCORE_RESULT = (
    "id string, score double, categories array<string>, summary string, tickers array<string>, surprise int, "
    "is_stale_repeat boolean, themes array<string>, playbook_trigger string, catalyst_status string, "
    "direction string"
)

AUTHOR_COMMAND = (
    "handle string, command string, tier int, display_name string, category string, amount double, seq long, "
    "at timestamp"
)

REACTION = "reaction_id long, post_id string, reaction_type string, reason string, target string, created_at timestamp"

FETCH_LOG = "endpoint string, executed_at timestamp, fetched long, new long, params string"

GOLDEN = (
    "id string, handle string, author_context string, text string, source string, expected struct<"
    "score_min:double,score_max:double,surprise:int,is_stale_repeat:boolean,playbook_trigger:string,"
    "catalyst:string,direction:string>"
)

MODEL_PRICE = (
    "provider string, model string, input_per_million double, output_per_million double, "
    "cached_input_per_million double"
)
