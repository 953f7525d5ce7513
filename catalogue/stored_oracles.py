"""SQL of the queries in ``stored.py``."""

from __future__ import annotations

from catalogue.oracles import COMBINED, COUNT, EVIDENCE, JOINED, LABELS, LETTER, LETTER_NORM, LOADS, MONDAY, ORACLES, POSTS, RUNS

ISO = ("strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({0}) % 1000000 = 0 THEN '' "
       "ELSE '.' || strftime({0}, '%f') END || '+00:00'")
PROMPTS = EVIDENCE + """,
asked AS (
    SELECT evidence_id, length('r/' || coalesce(subreddit, '') || chr(10) || 'Title: ' || coalesce(title, '')
                               || chr(10) || chr(10) || coalesce(text, '')) AS n
    FROM evidence_units WHERE length(coalesce(text, '')) > 10
)"""

STORED_ORACLES: dict[str, str] = {
    "delta_label_upsert": ORACLES["label_upsert"],
    "delta_merge": ORACLES["cumulative_merge"],
    "delta_merge_stats": ORACLES["merge_stats"],
    "delta_load_ignore": ORACLES["insert_or_ignore"],
    "delta_load_update": ORACLES["evidence_update"],
    "rollup_pain_authors": ORACLES["unique_pain_authors"],
    "rollup_authors_by_brand": f"""WITH {EVIDENCE + LABELS + JOINED}
        SELECT brand, count(DISTINCT author) AS unique_authors FROM joined
        WHERE source_type = 'post' AND author <> '[deleted]' GROUP BY brand""",
    "label_run_labels": f"""WITH {PROMPTS}
        SELECT evidence_id, CASE WHEN n % 2 = 1 THEN 'Chevy' ELSE 'GMC' END AS brand, 'unknown' AS model,
               'unknown' AS powertrain, n % 3 = 0 AS is_pain_point, CAST(NULL AS VARCHAR) AS pain_theme,
               FALSE AS is_delight, CAST(NULL AS VARCHAR) AS delight_theme, 'neutral' AS sentiment,
               CAST(0.75 AS FLOAT) AS confidence
        FROM asked WHERE n % 11 <> 0""",
    "label_run_failures": f"""WITH {PROMPTS}
        SELECT evidence_id, 'RuntimeError: refused' AS error FROM asked WHERE n % 11 = 0""",
    "export_scan_bad_lines": """
        SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type
        FROM events WHERE event_type <> 'error'""",
    "export_count_bad_lines": """
        SELECT count(*) FILTER (WHERE event_type <> 'error') AS rows, count(*) FILTER (WHERE event_type = 'error') AS bad
        FROM events""",
    "export_kinds": f"""WITH {COMBINED}
        SELECT 'combined' AS kind, 'combined' AS mode, count(*) AS rows FROM combined
        UNION ALL SELECT 'comments', 'combined', count(*) FROM combined WHERE comment_id <> ''
        UNION ALL SELECT 'posts', 'split', count(*) FROM posts""",
    "run_records": f"""WITH {RUNS}
        SELECT run_id, {ISO.format('min(created_at)')} AS started_at,
               {ISO.format('max(created_at)')} AS completed_at,
               count(DISTINCT subreddit) AS communities, count(*) AS new_posts
        FROM evidence_units WHERE run_id IS NOT NULL GROUP BY run_id""",
    "run_records_latest": f"""WITH {RUNS}
        SELECT run_id, {ISO.format('max(created_at)')} AS completed_at
        FROM evidence_units WHERE run_id IS NOT NULL GROUP BY run_id ORDER BY 2 DESC, 1 DESC LIMIT 1""",
    "community_list": """
        SELECT DISTINCT upper(source[1]) || lower(source[2:]) AS community FROM documents""",
    "stored_index": f"""
        SELECT CAST(doc_id AS VARCHAR) AS post_id, round({LETTER_NORM}, 4) AS norm,
               {', '.join(f"round(CAST(CAST(CASE WHEN {LETTER_NORM} = 0 THEN 0 ELSE {LETTER.format(c)} / {LETTER_NORM} END AS FLOAT) AS DOUBLE), 4) AS v_{c}" for c in 'aeio')}
        FROM documents""",
    "retrieve_located_topk": ORACLES["retrieve_topk"],
    "retrieve_located_all": ORACLES["retrieve_all"],
    "stream_ingest_seeded": """
        SELECT DISTINCT upper(event_type) AS subreddit, CAST(user_id AS VARCHAR) AS id FROM events
        EXCEPT SELECT upper(event_type), CAST(user_id AS VARCHAR) FROM events WHERE ts < TIMESTAMP '2024-01-08'""",
    "stream_labelled_trend": f"""
        SELECT {MONDAY.format('ts')} AS week,
               {COUNT.format("event_type = 'error' AND user_id % 8 <= 5")} AS pain_points,
               {COUNT.format("event_type = 'purchase' AND user_id % 8 <= 5")} AS delights,
               {COUNT.format("user_id % 8 <= 5")} AS labeled
        FROM events WHERE ts IS NOT NULL GROUP BY week""",
}
