"""Names, lists, formats and constants that results depend on."""

from __future__ import annotations

# --- export files and their columns (fixed values) --------------------------

EXPORT_FILES = {
    "posts": "gm_posts.csv",
    "comments": "gm_comments.csv",
    "combined": "gm_posts_with_comments.csv",
}

POST_COLUMNS = [
    "run_id", "downloaded_at", "source_tool", "category", "time_filter",
    "id", "subreddit", "title", "author", "score", "comment_count",
    "created_at", "post_type", "content_source", "selftext",
    "outbound_url", "domain", "permalink", "content",
]

COMMENT_COLUMNS = [
    "run_id", "downloaded_at", "post_id", "post_subreddit", "post_title",
    "post_permalink", "comment_rank", "comment_id", "author", "score",
    "body", "reply_count", "comment_permalink",
]

COMBINED_COLUMNS = [
    "run_id", "downloaded_at", "source_tool", "category", "time_filter",
    "post_id", "post_subreddit", "post_title", "post_author", "post_score",
    "post_comment_count", "post_created_at", "post_type",
    "post_content_source", "post_content", "post_selftext",
    "post_outbound_url", "post_domain", "post_permalink", "comment_rank",
    "comment_id", "comment_author", "comment_score", "comment_body",
    "comment_reply_count", "comment_permalink",
]

# --- feed formats (fixed values) --------------------------------------------

SITE_ROOT = "https://www.reddit.com"
SOURCE_TOOL = "redditwarp"
LISTING = "new"
DELETED_AUTHOR = "[deleted]"
POST_TYPES = {"LinkPost": "link", "TextPost": "text", "GalleryPost": "gallery"}
RUN_ID_FORMAT = "%Y%m%dT%H%M%SZ"

# --- label domains (fixed values) -------------------------------------------

BRANDS = ["Chevy", "GMC", "Cadillac", "Buick", "GM", "unknown"]
UNSPECIFIC_BRANDS = ["unknown", "GM"]
POWERTRAINS = ["EV", "ICE", "PHEV", "unknown"]
SENTIMENTS = ["positive", "negative", "neutral", "mixed"]

PAIN_THEMES = [
    "transmission", "reliability", "dealer_service", "pricing",
    "infotainment", "battery_range", "charging", "build_quality", "recall",
    "warranty", "performance", "comfort", "other",
]

DELIGHT_THEMES = [
    "performance", "comfort", "value", "technology", "design", "safety",
    "dealer_service", "reliability", "other",
]

# Widths of label text columns in stores that have such, and label constants (fixed values).
LABEL_WIDTHS = {"brand": 50, "model": 100, "powertrain": 20, "sentiment": 20}
CONFIDENCE_DEFAULT = 0.5
MIN_LABEL_TEXT = 10
LABEL_WORKERS = 8
LABEL_RETRIES = 2

# Planning rates of the labelling estimate (fixed values).
LABEL_RATES = {
    "prompt_tokens_per_item": 700,
    "completion_tokens_per_item": 120,
    "usd_per_1m_input_tokens": 0.15,
    "usd_per_1m_output_tokens": 0.60,
    "seconds_per_item_serial": 2.0,
}

# --- retrieval, activity and run status (fixed values) ------------------------

TOP_K = 5
CHUNK_COMMENTS = 5
EMBED_BATCH = 50
CONTEXT_SEPARATOR = "\n\n---\n\n"

SAMPLE_LIMIT = 100
WINDOW_DAYS = 30
MIN_FULL_SAMPLE = 30
MIN_SPAN_DAYS = 1 / 24

STALE_SECONDS = 120
TERMINAL_STATES = ["done", "failed", "interrupted"]

PREVIEW_POST_COLUMNS = [
    "created_at", "subreddit", "title", "author", "score", "comment_count",
    "content_source", "content", "permalink",
]
PREVIEW_COMBINED_COLUMNS = [
    "post_created_at", "post_subreddit", "post_title", "post_score",
    "post_comment_count", "comment_rank", "comment_score", "comment_body",
    "post_permalink",
]
PREVIEW_ROWS = 200
DETAIL_ROWS = 100
APP_ZONE = "America/Detroit"
