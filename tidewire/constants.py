"""These must equal the published contract of the feed, so they are stated as is."""

# Category taxonomy (fixed values).
CATEGORIES = [
    "fed_policy", "inflation", "job_market", "macro_data", "earnings", "equities", "rates_fx", "credit",
    "banks", "consumer_spending", "capex", "commodities", "energy", "metals_mining", "geopolitical",
    "sanctions", "tech_business", "ai_advancement", "crypto", "noise",
]

# Playbook triggers a scorer may return (fixed values).
PLAYBOOK_TRIGGERS = [
    "supply_shock", "supercycle", "vol_substitution", "ai_victim", "event_reset", "dat_mnav", "defensive_break",
]

# Playbook trigger -> name used in signal events (fixed values).
PLAYBOOK_EVENT_NAMES = {
    "supply_shock": "supply_loss",
    "supercycle": "supercycle",
    "vol_substitution": "vol_substitution",
    "ai_victim": "ai_victim",
    "event_reset": "earnings_gap_reset",
    "dat_mnav": "dat_mnav",
    "defensive_break": "expensive_defensive",
}

CATALYST_STATUSES = ["scheduled", "resolved"]
DIRECTIONS = ["long", "short", "na"]
REACTION_TYPES = [">>", ">", "<", "x_author", "x_topic"]
POSITION_RELATIONSHIPS = ["owned", "short", "watchlist", "expression"]

# Strength order of signal tiers (fixed values).
SIGNAL_TIER_RANK = {"noise": 0, "news": 1, "market_relevant": 2, "high_signal": 3}

# Words that make a query about equities (fixed values).
EQUITY_KEYWORDS = [
    "earnings", "eps", "revenue", "guidance", "beat", "miss", "upgrade", "downgrade", "buy", "sell", "target",
    "pt", "q1", "q2", "q3", "q4", "quarterly", "results", "report",
]

# Patterns (fixed values).
URL_PATTERN = r"(?i)https?://[^\s<>()]+"
URL_TRAILING_PUNCTUATION = r"[)\],.?!:;]+$"
STATUS_URL_PATTERN = (
    r"(?i)https?://(?:www\.)?(?:mobile\.)?(?:x|twitter)\.com/(?:i/(?:web/)?|[^/]+/)?status/(\d+)(?:\?[^\s]+)?"
)
SHORTENER_DOMAINS = ["t.co"]
RETWEET_PATTERN = r"^\s*RT\s+@([A-Za-z0-9_]{1,15}):\s*(.+)$"
THEME_PATTERN = r"^[a-z0-9-]{3,40}$"
TICKER_PATTERN = r"^[A-Z0-9][A-Z0-9./-]{0,15}$"
DATA_WORD_PATTERN = (
    r"\b(chart|graph|table|capex|revenue|margin|growth|yoy|qoq|forecast|projection|run[-\s]?rate|backlog|roi"
    r"|ebitda|eps)\b"
)
DATA_NUMBER_PATTERN = r"(\$|\b\d+(\.\d+)?%|\b\d+(\.\d+)?\s?(b|m|bn|mn|trillion|billion|million)\b)"
NOISE_IMAGE_PATTERN = r"\b(meme|reaction image|shitpost|joke|selfie|portrait)\b"

# Prices in USD per million tokens: provider, model, input, output, cached input (fixed values).
MODEL_PRICES = [
    ("deepseek", "deepseek-v4-flash", 0.14, 0.28, 0.0028),
    ("deepseek", "deepseek-v4-pro", 0.435, 0.87, 0.003625),
    ("gemini", "gemini-2.5-flash", 0.30, 2.50, 0.03),
    ("gemini", "gemini-2.5-flash-lite", 0.10, 0.40, 0.01),
    ("gemini", "gemini-2.5-flash-lite-preview-09-2025", 0.10, 0.40, 0.01),
    ("gemini", "gemini-2.5-pro", 1.25, 10.00, 0.125),
    ("gemini", "gemini-3-flash-preview", 0.50, 3.00, 0.05),
    ("gemini", "gemini-3.1-flash-lite-preview", 0.25, 1.50, 0.025),
    ("gemini", "gemini-3.1-pro-preview", 2.00, 12.00, 0.20),
    ("gemini", "gemini-3.6-flash", 1.50, 7.50, 0.15),
    ("gemini", "gemini-3.7-flash", 0.75, 3.75, 0.075),
]
