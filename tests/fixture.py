"""Twenty posts with labels, and small exports, as literals.

The twenty rows are fixed values: the golden answers of the reports are stated for
these numbers, so they have to be the same.
"""

from __future__ import annotations

from datetime import datetime

from forumlens import schemas

# number, community, author, brand, model, powertrain, pain theme, delight theme, sentiment, confidence
ROWS = [
    (1, "Silverado", "user_alice", "GM", "Silverado", "ICE", "transmission", None, "negative", 0.95),
    (2, "Silverado", "user_bob", "GM", "Silverado", "ICE", "reliability", None, "negative", 0.92),
    (3, "Silverado", "user_alice", "GM", "Silverado", "ICE", "infotainment", None, "negative", 0.88),
    (4, "Silverado", "[deleted]", "GM", "Silverado", "ICE", "reliability", None, "negative", 0.80),
    (5, "GMC", "user_carol", "GMC", "Sierra", "ICE", "reliability", None, "negative", 0.91),
    (6, "GMC", "user_dave", "GMC", "Sierra", "ICE", "dealer_service", None, "negative", 0.89),
    (7, "GMC", "user_eve", "GMC", "Sierra", "ICE", None, "reliability", "positive", 0.94),
    (8, "GMC", "user_frank", "GMC", "Sierra", "ICE", None, "comfort", "positive", 0.90),
    (9, "Chevy", "user_grace", "Chevy", "Silverado", "ICE", "transmission", None, "negative", 0.93),
    (10, "Chevy", "user_henry", "Chevy", "Silverado", "ICE", "transmission", None, "negative", 0.95),
    (11, "Chevy", "user_iris", "Chevy", "Silverado", "ICE", "transmission", None, "negative", 0.90),
    (12, "Chevy", "user_jack", "Chevy", "Silverado", "ICE", "reliability", None, "negative", 0.87),
    (13, "Chevy", "user_kate", "Chevy", "Silverado", "ICE", "reliability", None, "negative", 0.85),
    (14, "Chevy", "user_leo", "Chevy", "Silverado", "ICE", "dealer_service", None, "negative", 0.88),
    (15, "Chevrolet", "user_mia", "Chevy", "Bolt", "EV", "battery_range", None, "negative", 0.92),
    (16, "Chevrolet", "user_noah", "Chevy", "Bolt", "EV", "charging", None, "negative", 0.91),
    (17, "Chevrolet", "user_olivia", "Chevy", "Bolt", "EV", "build_quality", None, "negative", 0.89),
    (18, "Silverado", "user_peter", "GM", "Silverado", "ICE", "reliability", None, "negative", 0.86),
    (19, "Silverado", "user_quinn", "GM", "Silverado", "ICE", "reliability", None, "negative", 0.84),
    (20, "GMC", "user_rachel", "GMC", "Sierra", "ICE", None, None, "neutral", 0.70),
]


def evidence(spark):
    return spark.createDataFrame([
        (f"post_{n:03}", "post", "run1", community, f"{n:03}", "", author, datetime(2024, 1, n, 10),
         f"Title {n}", f"A text about post number {n}", f"https://forum.example/{n:03}", n)
        for n, community, author, *_ in ROWS
    ], schemas.EVIDENCE)


def labels(spark):
    return spark.createDataFrame([
        (f"post_{n:03}", brand, model, power, pain is not None, pain, delight is not None, delight, felt, sure)
        for n, _, _, brand, model, power, pain, delight, felt, sure in ROWS
    ], schemas.LABELS)


def combined_row(post, comment="", rank="", title="T", **more):
    row = {
        "run_id": "r1", "downloaded_at": "2024-02-01T00:00:00+00:00", "source_tool": "x", "category": "new",
        "time_filter": "", "post_id": post, "post_subreddit": "Chevy", "post_title": title,
        "post_author": "ann", "post_score": "5", "post_comment_count": "2",
        "post_created_at": "2024-01-01T10:00:00+00:00", "post_type": "text", "post_content_source": "selftext",
        "post_content": "body", "post_selftext": "body", "post_outbound_url": "", "post_domain": "",
        "post_permalink": f"https://forum.example/{post}/", "comment_rank": rank, "comment_id": comment,
        "comment_author": "bob" if comment else "", "comment_score": "1" if comment else "",
        "comment_body": f"says {comment}" if comment else "", "comment_reply_count": "",
        "comment_permalink": f"https://forum.example/{post}/{comment}/" if comment else "",
    }
    return {**row, **more}


def frame(spark, rows):
    """A frame of text columns in the order of the first row."""
    names = list(rows[0])
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def values(df, *columns):
    """Rows as tuples, in order of the frame."""
    return [tuple(r[c] for c in (columns or df.columns)) for r in df.collect()]
