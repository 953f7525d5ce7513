"""The registered queries again, as SQL for DuckDB over the same tables."""

from __future__ import annotations

from forumlens.functions.columns import WHITESPACE

DOWNLOADED = "2024-02-01T00:00:00+00:00"
SPACE = "'" + WHITESPACE + "'"

RUN_OF = "'run_' || strftime(date_trunc('week', {0}), '%Y%m%d')"
MONDAY = "CAST(date_trunc('week', {0}) AS TIMESTAMP)"

# --- bindings -------------------------------------------------------------------

DATED = """
dated AS (
    SELECT d.*, e.ts, e.user_id, e.event_type, e.value,
           CASE WHEN e.event_type IN ('click', 'view') THEN 'comment' ELSE 'post' END AS source_type,
           CASE WHEN e.event_type IN ('click', 'view') THEN 'comment' ELSE 'post' END
               || '_' || CAST(d.doc_id AS VARCHAR) AS evidence_id
    FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id * 5
)"""
EVIDENCE = DATED + f""",
evidence_units AS (
    SELECT evidence_id, source_type, {RUN_OF.format('ts')} AS run_id, source AS subreddit,
           CAST(doc_id AS VARCHAR) AS post_id,
           CASE WHEN source_type = 'comment' THEN CAST(doc_id AS VARCHAR) ELSE '' END AS comment_id,
           CASE WHEN value < 10 THEN '[deleted]' ELSE 'user_' || CAST(user_id AS VARCHAR) END AS author,
           ts AS created_at, source || ' ' || CAST(doc_id AS VARCHAR) AS title, text,
           'https://forum.example/' || CAST(doc_id AS VARCHAR) AS permalink,
           CAST(n_chars AS INTEGER) AS score
    FROM dated
)"""
LABELS = """,
evidence_labels AS (
    SELECT d.evidence_id,
           CASE d.lang WHEN 'en' THEN 'Chevy' WHEN 'de' THEN 'GMC' WHEN 'fr' THEN 'GM' ELSE 'unknown' END AS brand,
           d.source AS model,
           CASE WHEN d.event_type = 'click' THEN 'EV' WHEN d.event_type = 'signup' THEN 'PHEV'
                WHEN d.event_type IN ('view', 'purchase') THEN 'ICE' ELSE 'unknown' END AS powertrain,
           l.toxic = 1 AS is_pain_point,
           CASE WHEN l.toxic = 1 THEN d.event_type END AS pain_theme,
           l.quality = 1 AS is_delight,
           CASE WHEN l.quality = 1 THEN d.event_type END AS delight_theme,
           CASE WHEN l.toxic = 1 AND l.quality = 1 THEN 'mixed' WHEN l.toxic = 1 THEN 'negative'
                WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment,
           CAST(least(d.value / 100.0, 1.0) AS FLOAT) AS confidence
    FROM labels l JOIN dated d USING (doc_id)
)"""
JOINED = ",\njoined AS (SELECT e.*, l.* EXCLUDE (evidence_id) FROM evidence_units e JOIN evidence_labels l USING (evidence_id))"
OUTER = """,
joined AS (
    SELECT e.*, l.* EXCLUDE (evidence_id), l.evidence_id IS NOT NULL AS is_labelled
    FROM evidence_units e LEFT JOIN evidence_labels l USING (evidence_id)
)"""
POSTS = f"""
roots AS (
    SELECT c.*, e.ts, e.user_id FROM conversations c LEFT JOIN events e ON e.event_id = c.conv_id * 100
    WHERE c.turn = 0
),
posts AS (
    SELECT {RUN_OF.format('ts')} AS run_id, '{DOWNLOADED}' AS downloaded_at, 'export' AS source_tool,
           'new' AS category, '' AS time_filter, CAST(conv_id AS VARCHAR) AS id, role AS subreddit,
           ' Conversation ' || CAST(conv_id AS VARCHAR) || chr(10) AS title,
           'user_' || CAST(user_id AS VARCHAR) AS author,
           CAST(length(text) AS VARCHAR) || '.5' AS score, '' AS comment_count, ts,
           strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS created_at, 'text' AS post_type,
           CASE WHEN role = 'system' THEN 'content' ELSE 'selftext' END AS content_source,
           CASE WHEN role = 'system' THEN '' ELSE text END AS selftext, '' AS outbound_url, '' AS domain,
           'https://forum.example/c/' || CAST(conv_id AS VARCHAR) || '/' AS permalink, text AS content
    FROM roots
),
comments AS (
    SELECT p.run_id, p.downloaded_at, p.id AS post_id, p.subreddit AS post_subreddit,
           p.title AS post_title, p.permalink AS post_permalink, CAST(c.turn AS VARCHAR) AS comment_rank,
           p.id || '_' || CAST(c.turn AS VARCHAR) AS comment_id, c.role AS author,
           CASE WHEN c.role = 'user' THEN 'n/a' ELSE CAST(length(c.text) AS VARCHAR) END AS score,
           c.text AS body, '0' AS reply_count,
           p.permalink || CAST(c.turn AS VARCHAR) || '/' AS comment_permalink
    FROM conversations c JOIN posts p ON p.id = CAST(c.conv_id AS VARCHAR) WHERE c.turn > 0
)"""
COMBINED = POSTS + """,
combined AS (
    SELECT p.run_id, p.downloaded_at, p.source_tool, p.category, p.time_filter, p.id AS post_id,
           p.subreddit AS post_subreddit, p.title AS post_title, p.author AS post_author,
           p.score AS post_score, p.comment_count AS post_comment_count, p.created_at AS post_created_at,
           p.post_type, p.content_source AS post_content_source, p.content AS post_content,
           p.selftext AS post_selftext, p.outbound_url AS post_outbound_url, p.domain AS post_domain,
           p.permalink AS post_permalink, coalesce(c.comment_rank, '') AS comment_rank,
           coalesce(c.comment_id, '') AS comment_id, coalesce(c.author, '') AS comment_author,
           coalesce(c.score, '') AS comment_score, coalesce(c.body, '') AS comment_body,
           coalesce(c.reply_count, '') AS comment_reply_count,
           coalesce(c.comment_permalink, '') AS comment_permalink
    FROM posts p LEFT JOIN comments c ON c.post_id = p.id
)"""
THREAD_EVIDENCE = """
SELECT 'post_' || id AS evidence_id, 'post' AS source_type, run_id, subreddit, id AS post_id,
       '' AS comment_id, author, ts AS created_at, title,
       coalesce(nullif(selftext, ''), nullif(content, ''), '') AS text, permalink,
       TRY_CAST(score AS INTEGER) AS score
FROM posts
UNION ALL
SELECT 'comment_' || c.comment_id, 'comment', c.run_id, c.post_subreddit, c.post_id, c.comment_id,
       c.author, {time}, c.post_title, c.body, c.comment_permalink, TRY_CAST(c.score AS INTEGER)
FROM comments c JOIN posts p ON p.id = c.post_id"""
CHUNKS = POSTS + f""",
placed AS (
    SELECT post_id, trim(body, {SPACE}) AS said,
           row_number() OVER (PARTITION BY post_id ORDER BY CAST(comment_rank AS INTEGER), comment_id) AS place
    FROM comments WHERE trim(body, {SPACE}) <> ''
),
told AS (
    SELECT post_id, string_agg('Comment ' || CAST(place AS VARCHAR) || ': ' || said, chr(10) ORDER BY place) AS lines
    FROM placed WHERE place <= 5 GROUP BY post_id
),
chunks AS (
    SELECT p.id AS post_id, p.subreddit, p.author, p.created_at, trim(p.title, {SPACE}) AS title,
           concat_ws(chr(10), 'Title: ' || trim(p.title, {SPACE}),
                     CASE WHEN trim({{body}}, {SPACE}) <> '' THEN 'Post: ' || trim({{body}}, {SPACE}) END,
                     t.lines) AS text, p.permalink, p.score
    FROM posts p LEFT JOIN told t ON t.post_id = p.id
)"""
SPLIT_CHUNKS = CHUNKS.format(body="p.selftext")
QUESTIONS = """
questions AS (
    SELECT CAST(label AS BIGINT) AS question_id, arg_min(embedding, vec_id) AS vector
    FROM embeddings GROUP BY label
)"""
NEAREST = """,
scored AS (
    SELECT q.question_id, v.vec_id,
           round(list_cosine_similarity(CAST(q.vector AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
    FROM questions q CROSS JOIN {vectors} v
),
nearest AS (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, {tie}) AS rank FROM scored
    QUALIFY rank <= 5
)"""
RETRIEVED = DATED + """,
chunks AS (
    SELECT CAST(doc_id AS VARCHAR) AS post_id, source AS subreddit,
           source || ' ' || CAST(doc_id AS VARCHAR) AS title, 'https://forum.example/' || CAST(doc_id AS VARCHAR) AS permalink, text
    FROM documents
),""" + QUESTIONS + """,
vectors AS (SELECT * FROM embeddings)""" + NEAREST.format(vectors="vectors", tie="CAST(vec_id AS VARCHAR)") + """,
retrieved AS (
    SELECT n.question_id, n.rank, c.* FROM nearest n JOIN chunks c ON c.post_id = CAST(n.vec_id AS VARCHAR)
)"""
DOC_FEED = DATED + """,
feed AS (
    SELECT source AS subreddit, CAST(doc_id AS VARCHAR) AS id, source || ' ' || CAST(doc_id AS VARCHAR) AS title,
           'user_' || CAST(user_id AS VARCHAR) AS author, CAST(n_chars AS VARCHAR) AS score, ts,
           strftime(ts, '%Y-%m-%dT%H:%M:%S')
               || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END
               || '+00:00' AS created_at,
           'https://www.reddit.com/p/' || CAST(doc_id AS VARCHAR) AS permalink, text AS body
    FROM dated
),
known AS (
    SELECT lower(d.source) AS group_key, CAST(l.doc_id AS VARCHAR) AS post_id
    FROM labels l JOIN documents d USING (doc_id)
)"""
WINDOW = "ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-12 12:00:00'"
FRESH = DOC_FEED + f""",
fresh AS (
    SELECT * FROM feed WHERE {WINDOW}
      AND NOT EXISTS (SELECT 1 FROM known k WHERE k.group_key = lower(feed.subreddit) AND k.post_id = feed.id)
)"""
PAGES = f"""
thread AS (
    SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place,
           CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS id,
           CASE WHEN role = 'assistant' THEN '[deleted]' ELSE role END AS author,
           text AS body, CAST(length(text) AS VARCHAR) AS score
    FROM conversations WHERE turn > 0
),
linked AS (
    SELECT p.page_id, p.url, c.role, coalesce(c.text, '') AS body,
           CASE WHEN contains(p.url, '#') THEN p.url WHEN starts_with(p.url, 'https://blog.') THEN p.url || '/' ELSE p.url END AS target,
           CASE WHEN starts_with(p.url, 'https://blog.') THEN p.url
                ELSE 'https://www.reddit.com/p/' || CAST(p.page_id AS VARCHAR) || '/' END AS permalink,
           CASE WHEN c.role IS NOT NULL OR starts_with(p.url, 'https://blog.') THEN 'text'
                WHEN contains(p.url, '#') THEN 'gallery' WHEN ends_with(p.url, '.html') THEN 'link'
                ELSE 'unknown' END AS post_type,
           (SELECT count(*) FROM thread t WHERE t.conv_id = p.page_id) AS n_comments
    FROM pages p LEFT JOIN conversations c ON c.conv_id = p.page_id AND c.turn = 0
),
worded AS (
    SELECT *, coalesce(nullif(trim(body, {SPACE}), ''), CASE WHEN post_type = 'text'
                  THEN trim(coalesce(nullif(body, ''), target), {SPACE}) END, '') AS selftext,
           CASE WHEN rtrim(target, '/') = rtrim(permalink, '/') THEN '' ELSE target END AS outbound_url,
           trim(coalesce(nullif(body, ''), target), {SPACE}) AS whole
    FROM linked
),
submitted AS (
    SELECT *, CASE WHEN selftext <> '' THEN 'selftext' WHEN outbound_url <> '' THEN 'outbound_url'
                   WHEN whole <> '' THEN 'content' ELSE '' END AS content_source,
           coalesce(nullif(selftext, ''), nullif(outbound_url, ''), whole) AS content
    FROM worded
)"""
RUNS = EVIDENCE + """,
counted AS (
    SELECT run_id, subreddit, count(*) AS n, count(*) FILTER (WHERE source_type = 'comment') AS c
    FROM evidence_units WHERE run_id IS NOT NULL GROUP BY ALL
)"""
LOADS = EVIDENCE + """,
stored AS (SELECT * FROM evidence_units WHERE run_id IS NULL OR run_id <= 'run_20240108'),
incoming AS (
    SELECT * REPLACE (title || ' v2' AS title) FROM evidence_units WHERE run_id >= 'run_20240108'
)"""
CRAWLS = COMBINED + """,
both_crawls AS (
    SELECT 0 AS batch, *, '' AS note FROM combined WHERE coalesce(TRY_CAST(comment_rank AS INTEGER), 0) <= 4
    UNION ALL
    SELECT 1, * REPLACE (trim(post_title) || ' (edited)' AS post_title), 'second crawl'
    FROM combined WHERE coalesce(TRY_CAST(comment_rank AS INTEGER), 0) >= 3
),
crawls AS (SELECT *, coalesce(nullif(comment_id, ''), 'post:' || post_id) AS key FROM both_crawls)"""
FILTERED = EVIDENCE + LABELS + OUTER + """,
chosen AS (
    SELECT * FROM joined
    WHERE brand IN ('Chevy', 'GMC') AND source_type IN ('post', 'comment')
      AND CAST(created_at AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-14'
      AND (NOT is_labelled OR CAST(confidence AS DOUBLE) >= 0.35)
      AND (title ILIKE '%the%' OR text ILIKE '%the%')
)"""
SUMMARY_OF = """
SELECT {slice} CAST(sum(n) AS BIGINT) AS rows,
       array_to_string(list_sort(list_distinct(flatten(list(runs)))), ',') AS run_ids,
       coalesce(string_agg(CASE WHEN community <> '' THEN community || '=' || CAST(n AS VARCHAR) END, ','
                  ORDER BY community || '=' || CAST(n AS VARCHAR)), '') AS subreddits,
       coalesce(min(first), '') AS earliest_timestamp, coalesce(max(last), '') AS latest_timestamp
FROM per_community {group}"""
ACTIVITY = """
WITH sample AS (
    SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC NULLS LAST, event_id) AS place
    FROM events QUALIFY place <= {limit}
),
stats AS (
    SELECT event_type, count(*) AS n, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL {window} DAY) AS inside,
           max(ts) AS latest, min(ts) AS oldest
    FROM sample GROUP BY event_type
),
spans AS (
    SELECT *, CASE WHEN n >= 2 THEN greatest(
                 CAST(epoch_us(latest) - epoch_us(oldest) AS DOUBLE) / 86400000000.0, 1.0 / 24) END AS span
    FROM stats
)
SELECT 'r/' || event_type AS subreddit, CAST(NULL AS BIGINT) AS subscriber_count, n AS sample_posts,
       CAST({window} AS BIGINT) AS window_days, inside AS posts_in_window, round(span, 1) AS sample_span_days,
       round(CASE WHEN n >= {limit} AND span < {window} THEN n / span ELSE inside / {window}.0 END, 1) AS avg_daily_posts_est,
       CASE WHEN n >= {limit} AND span < {window} THEN 'latest_' || CAST(n AS VARCHAR) || '_posts/sample_span_days'
            ELSE 'posts_last_{window}d/window_days' END AS avg_method,
       strftime(latest, '%Y-%m-%dT%H:%M:%S')
           || CASE WHEN strftime(latest, '%f') = '000000' THEN '' ELSE '.' || strftime(latest, '%f') END
           || '+00:00' AS latest_post_at,
       strftime(oldest, '%Y-%m-%dT%H:%M:%S')
           || CASE WHEN strftime(oldest, '%f') = '000000' THEN '' ELSE '.' || strftime(oldest, '%f') END
           || '+00:00' AS oldest_sample_at,
       'ok' AS status, '' AS error
FROM spans"""
COUNT = "CAST(count(*) FILTER (WHERE {0}) AS BIGINT)"
RATE = "coalesce(round(100.0::DOUBLE * count(*) FILTER (WHERE {0}) / nullif({1}, 0), 1), 0.0::DOUBLE)"


def _words(words: list[str]) -> str:
    return "regexp_matches(words, '(^|[^a-z0-9])(" + "|".join(words) + ")([^a-z0-9]|$)')"


def _label_rules() -> str:
    bad, good = _words(["on", "un", "ein"]), _words(["in", "ou", "con"])
    return f"""WITH {EVIDENCE},
worded AS (SELECT evidence_id, lower(title || ' ' || text) AS words FROM evidence_units),
found AS (
    SELECT evidence_id, words, {bad} AS bad, {good} AS good,
           CASE WHEN {_words(['der', 'und', 'die'])} THEN 'GMC' WHEN {_words(['les', 'la', 'de'])} THEN 'Cadillac'
                WHEN {_words(['the', 'and'])} THEN 'Chevy' ELSE 'unknown' END AS brand
    FROM worded
)
SELECT evidence_id, brand,
       CASE {' '.join(f"WHEN {_words([m.lower()])} THEN '{m}'" for m in
            ['Silverado', 'Equinox', 'Tahoe', 'Sierra', 'Blazer', 'Escalade', 'Corvette', 'Camaro', 'Bolt', 'Lyriq'])}
            ELSE 'unknown' END AS model,
       CASE WHEN {_words(['el', 'los'])} THEN 'EV' WHEN {_words(['elle', 'une'])} THEN 'PHEV'
            WHEN brand <> 'unknown' THEN 'ICE' ELSE 'unknown' END AS powertrain,
       bad AS is_pain_point,
       CASE WHEN bad THEN CASE WHEN {_words(['re', 'were'])} THEN 'recall' WHEN {_words(['est'])} THEN 'pricing'
            ELSE 'other' END END AS pain_theme,
       good AND NOT bad AS is_delight,
       CASE WHEN good AND NOT bad THEN CASE WHEN {_words(['en'])} THEN 'value' WHEN {_words(['it'])} THEN 'design'
            ELSE 'other' END END AS delight_theme,
       CASE WHEN bad AND good THEN 'mixed' WHEN bad THEN 'negative' WHEN good THEN 'positive' ELSE 'neutral' END AS sentiment,
       CAST(CASE WHEN brand <> 'unknown' THEN 0.9 ELSE 0.1 END AS FLOAT) AS confidence
FROM found"""


def _charts(ctes: str, source: str, limit: int, dated: bool) -> str:
    def part(chart: str, series: str, name: str, value: str, where: str) -> str:
        return (f"SELECT '{chart}' AS chart, {series} AS series, {name} AS name, {COUNT.format(value)} AS value "
                f"FROM {source} WHERE {where} GROUP BY ALL")

    def themes(kind: str, flag: str) -> str:
        return "(" + part(f"{kind}_themes", "'rows'", f"{kind}_theme", "TRUE", f"{flag} AND {kind}_theme IS NOT NULL") \
            + f" ORDER BY value DESC, name LIMIT {limit})"

    week, power, brand = "strftime(date_trunc('week', created_at), '%Y-%m-%d')", "powertrain", "brand"
    powered, branded = "powertrain IN ('EV', 'ICE', 'PHEV')", "brand NOT IN ('unknown', 'GM')"
    weekly = (("pain_points", "is_pain_point"), ("delights", "is_delight"), ("labeled", "is_labelled")) if dated else ()
    return f"WITH {ctes}\n" + "\nUNION ALL\n".join([
        part("sentiment", "'rows'", "sentiment", "TRUE", "sentiment IS NOT NULL"),
        themes("pain", "is_pain_point"), themes("delight", "is_delight"),
        part("powertrain", "'pain'", power, "is_pain_point", powered),
        part("powertrain", "'delight'", power, "is_delight", powered),
        part("brand_sentiment", "sentiment", brand, "TRUE", branded),
        *[part("trend", f"'{series}'", week, flag, "created_at IS NOT NULL") for series, flag in weekly],
    ])


LETTER = "(length(text) - length(replace(text, '{0}', '')))"
LETTER_NORM = "sqrt(" + " + ".join(f"{LETTER.format(c)} ** 2" for c in "aeio") + ")"

ORACLES: dict[str, str] = {
    # --- loading and merging ---
    "evidence_from_combined": f"WITH {POSTS} {THREAD_EVIDENCE.format(time='p.ts')}",
    "evidence_from_split": f"""WITH {POSTS}
        {THREAD_EVIDENCE.format(time="coalesce(p.ts, TIMESTAMP '2024-02-01 00:00:00')")}""",
    "input_counts": f"""WITH {COMBINED}
        SELECT count(DISTINCT nullif(post_id, '')) AS posts, count(DISTINCT nullif(comment_id, '')) AS comments
        FROM combined""",
    "evidence_store_counts": f"""WITH {POSTS}
        SELECT (SELECT count(*) FROM posts) AS posts, (SELECT count(*) FROM comments) AS comments,
               (SELECT count(*) FROM labels JOIN documents USING (doc_id)) AS labels""",
    "evidence_by_source": f"""WITH {EVIDENCE}
        SELECT source_type, count(*) AS evidence_units FROM evidence_units GROUP BY source_type""",
    "insert_or_ignore": f"""WITH {LOADS}
        SELECT * FROM stored UNION ALL
        SELECT * FROM incoming WHERE evidence_id NOT IN (SELECT evidence_id FROM stored)""",
    "evidence_update": f"""WITH {LOADS}
        SELECT * FROM incoming UNION ALL
        SELECT * FROM stored WHERE evidence_id NOT IN (SELECT evidence_id FROM incoming)""",
    "cumulative_merge": f"""WITH {CRAWLS}
        SELECT * EXCLUDE (batch, key) REPLACE (coalesce(run_id, '') AS run_id, coalesce(post_author, '') AS post_author,
                   coalesce(post_created_at, '') AS post_created_at) FROM crawls
        QUALIFY row_number() OVER (PARTITION BY key ORDER BY batch DESC) = 1""",
    "merge_stats": f"""WITH {CRAWLS}
        SELECT 'combined' AS kind, count(*) FILTER (WHERE batch = 0) AS existing_rows,
               count(*) FILTER (WHERE batch = 1) AS incoming_rows, count(DISTINCT key) AS stored_rows,
               count(*) - count(DISTINCT key) AS duplicate_rows_removed FROM crawls""",
    "upload_profile": f"""WITH {COMBINED}
        SELECT 'combined' AS kind, CAST(26 AS BIGINT) AS columns, count(*) AS rows,
               count(DISTINCT post_id) AS distinct_posts, count(DISTINCT nullif(comment_id, '')) AS distinct_comments,
               count(post_id) - count(DISTINCT post_id) AS repeated_post_rows,
               count(nullif(comment_id, '')) - count(DISTINCT nullif(comment_id, '')) AS duplicate_comment_ids
        FROM combined""",
    # --- report and dashboard ---
    "headline_summary": f"""WITH {EVIDENCE + LABELS}
        SELECT (SELECT count(*) FROM evidence_units) AS total, count(*) AS labeled,
               {RATE.format('is_pain_point', 'count(*)')} AS pain_pct,
               {RATE.format('is_delight', 'count(*)')} AS delight_pct FROM evidence_labels""",
    "dashboard_summary_filtered": f"""WITH {FILTERED}
        SELECT count(DISTINCT evidence_id) AS evidence_units,
               count(DISTINCT CASE WHEN is_labelled THEN evidence_id END) AS labeled,
               {COUNT.format('is_pain_point')} AS pain_points, {COUNT.format('is_delight')} AS delights,
               count(DISTINCT CASE WHEN is_pain_point THEN author END) AS pain_authors,
               {RATE.format('is_pain_point', 'count(*) FILTER (WHERE is_labelled)')} AS pain_rate,
               {RATE.format('is_delight', 'count(*) FILTER (WHERE is_labelled)')} AS delight_rate FROM chosen""",
    "dashboard_charts": _charts(EVIDENCE + LABELS + OUTER, "joined", 12, True),
    "report_numbers": _charts(DATED + LABELS, "evidence_labels", 10, False),
    "sentiment_distribution": f"""WITH {DATED + LABELS}
        SELECT sentiment, count(*) AS cnt FROM evidence_labels GROUP BY sentiment""",
    "top_pain_themes": f"""WITH {EVIDENCE + LABELS + JOINED}
        SELECT pain_theme, count(*) AS cnt FROM joined WHERE is_pain_point AND pain_theme IS NOT NULL
        GROUP BY pain_theme ORDER BY cnt DESC, pain_theme LIMIT 10""",
    "top_delight_themes": f"""WITH {EVIDENCE + LABELS + JOINED}
        SELECT delight_theme, count(*) AS cnt FROM joined WHERE is_delight AND delight_theme IS NOT NULL
        GROUP BY delight_theme ORDER BY cnt DESC, delight_theme LIMIT 3""",
    "brand_sentiment": f"""WITH {EVIDENCE + LABELS + JOINED}
        SELECT brand, sentiment, count(*) AS cnt FROM joined WHERE brand NOT IN ('unknown', 'GM')
        GROUP BY brand, sentiment""",
    "brand_sentiment_pivot": f"""WITH {EVIDENCE + LABELS + JOINED}
        SELECT brand, {', '.join(f"count(*) FILTER (WHERE sentiment = '{s}') AS {s}" for s in
                                 ('positive', 'negative', 'neutral', 'mixed'))}
        FROM joined WHERE brand NOT IN ('unknown', 'GM') GROUP BY brand""",
    "powertrain_pain_delight": f"""WITH {EVIDENCE + LABELS + JOINED}
        SELECT powertrain, {COUNT.format('is_pain_point')} AS pain, {COUNT.format('is_delight')} AS delight
        FROM joined WHERE powertrain IN ('EV', 'ICE', 'PHEV') GROUP BY powertrain""",
    "weekly_trend": f"""WITH {EVIDENCE + LABELS + OUTER}
        SELECT {MONDAY.format('created_at')} AS week, {COUNT.format('is_pain_point')} AS pain_points,
               {COUNT.format('is_delight')} AS delights, {COUNT.format('is_labelled')} AS labeled
        FROM joined WHERE created_at IS NOT NULL GROUP BY week""",
    "unique_pain_authors": f"""WITH {EVIDENCE + LABELS + JOINED}
        SELECT count(DISTINCT author) AS unique_authors FROM joined
        WHERE is_pain_point AND author <> '[deleted]'""",
    "brand_negative_share": f"""WITH {EVIDENCE + LABELS + JOINED}
        SELECT {RATE.format("sentiment = 'negative'", 'count(*)')} AS negative_pct FROM joined WHERE brand = 'GMC'""",
    "brand_top3_themes": f"""WITH {EVIDENCE + LABELS + JOINED}
        SELECT pain_theme, count(*) AS cnt FROM joined
        WHERE brand = 'Chevy' AND is_pain_point AND pain_theme IS NOT NULL
        GROUP BY pain_theme ORDER BY cnt DESC, pain_theme LIMIT 3""",
    "powertrain_pain": f"""WITH {EVIDENCE + LABELS + JOINED}
        SELECT powertrain, count(*) AS cnt FROM joined
        WHERE is_pain_point AND powertrain IN ('EV', 'ICE', 'PHEV') GROUP BY powertrain""",
    "filter_choices": f"""WITH {EVIDENCE + LABELS + OUTER}
        SELECT DISTINCT brand AS value FROM joined WHERE brand IS NOT NULL AND brand <> '' AND brand <> 'unknown'""",
    "evidence_date_bounds": f"""WITH {EVIDENCE}
        SELECT min(CAST(created_at AS DATE)) AS min_date, max(CAST(created_at AS DATE)) AS max_date FROM evidence_units""",
    "evidence_detail": f"""WITH {EVIDENCE + LABELS + OUTER}
        SELECT created_at, source_type, subreddit, brand, model, sentiment, is_pain_point, pain_theme, title, permalink
        FROM joined ORDER BY created_at DESC NULLS LAST, evidence_id LIMIT 100""",
    "community_counts": f"""WITH {EVIDENCE}
        SELECT subreddit, count(*) AS posts FROM evidence_units WHERE subreddit <> '' GROUP BY subreddit""",
    "post_date_range": f"""WITH {POSTS}
        SELECT coalesce(strftime(min(ts), '%Y-%m-%d') || ' to ' || strftime(max(ts), '%Y-%m-%d'), '-') AS date_range
        FROM posts""",
    "local_day_window": f"""WITH {EVIDENCE}
        SELECT evidence_id, created_at FROM evidence_units
        WHERE created_at BETWEEN TIMESTAMP '2024-01-05 05:00:00' AND TIMESTAMP '2024-01-11 04:59:59'""",
    "evidence_preview": f"""WITH {EVIDENCE}
        SELECT strftime(created_at, '%Y-%m-%d %H:%M') AS created_at, subreddit, title, author, score, text AS content, permalink
        FROM evidence_units ORDER BY evidence_units.created_at DESC NULLS LAST, evidence_id LIMIT 200""",
    "combined_preview": f"""WITH {COMBINED}
        SELECT strftime(p.ts, '%Y-%m-%d %H:%M') AS post_created_at, post_subreddit, post_title, post_score,
               post_comment_count, comment_rank, comment_score, comment_body, post_permalink
        FROM combined c JOIN posts p ON p.id = c.post_id
        ORDER BY p.ts DESC NULLS LAST, post_id || '/' || comment_id LIMIT 200""",
    "guarded_query": f"""WITH {EVIDENCE + LABELS},
        felt AS (
            SELECT l.brand, EXTRACT(DAY FROM e.created_at) AS day, l.is_pain_point
            FROM evidence_units e JOIN evidence_labels l ON e.evidence_id = l.evidence_id
            WHERE e.author <> '[deleted]' AND e.title <> '--'
        )
        SELECT brand, CAST(day AS INT) AS day, COUNT(*) AS n, COUNT(CASE WHEN is_pain_point THEN 1 END) AS pain
        FROM felt GROUP BY brand, day""",
    # --- labelling ---
    "label_queue": f"""WITH {EVIDENCE + LABELS}
        SELECT evidence_id, subreddit, title, text, created_at FROM evidence_units
        WHERE length(coalesce(text, '')) > 10 AND evidence_id NOT IN (SELECT evidence_id FROM evidence_labels)""",
    "label_queue_oldest": f"""WITH {EVIDENCE + LABELS}
        SELECT evidence_id, subreddit, title, text, created_at FROM evidence_units
        WHERE length(coalesce(text, '')) > 10 AND source_type = 'post'
          AND evidence_id NOT IN (SELECT evidence_id FROM evidence_labels)
        ORDER BY created_at NULLS LAST, evidence_id LIMIT 50""",
    "label_estimate": f"""WITH {EVIDENCE + LABELS},
        queue AS (
            SELECT count(*) AS n FROM evidence_units WHERE length(coalesce(text, '')) > 10
              AND evidence_id NOT IN (SELECT evidence_id FROM evidence_labels)
        )
        SELECT n AS pending, CAST(n AS DOUBLE) AS calls, CAST(n * 700 AS DOUBLE) AS input_tokens,
               CAST(n * 120 AS DOUBLE) AS output_tokens,
               CAST(n * 700 AS DOUBLE) / 1000000 * 0.15::DOUBLE + CAST(n * 120 AS DOUBLE) / 1000000 * 0.60::DOUBLE AS estimated_cost_usd,
               CAST(n AS DOUBLE) * 2.0::DOUBLE / 8 / 60 AS estimated_minutes FROM queue""",
    "label_progress": f"""WITH {EVIDENCE + LABELS},
        counts AS (SELECT (SELECT count(*) FROM evidence_units) AS evidence, (SELECT count(*) FROM evidence_labels) AS labels)
        SELECT *, CASE WHEN labels = 0 THEN 'missing' WHEN labels < evidence THEN 'partial' ELSE 'done' END AS state
        FROM counts""",
    "label_prompt": f"""WITH {EVIDENCE}
        SELECT evidence_id, 'r/' || subreddit || chr(10) || 'Title: ' || title || chr(10) || chr(10)
               || text AS prompt FROM evidence_units""",
    "label_rules": _label_rules(),
    "label_answers": """
        SELECT CAST(event_id AS VARCHAR) AS evidence_id,
               CASE WHEN good AND event_type <> 'view' THEN event_type WHEN good THEN 'unknown' END AS brand,
               CASE WHEN good THEN 'unknown' END AS model, CASE WHEN good THEN 'unknown' END AS powertrain,
               CASE WHEN good THEN event_type <> 'view' END AS is_pain_point, CAST(NULL AS VARCHAR) AS pain_theme,
               CASE WHEN good THEN FALSE END AS is_delight, CAST(NULL AS VARCHAR) AS delight_theme,
               CASE WHEN good THEN 'neutral' END AS sentiment,
               CAST(CASE WHEN good AND event_type = 'view' THEN 0.5 WHEN good THEN least(1.0, greatest(0.0, value)) END AS FLOAT) AS confidence,
               CASE WHEN good THEN '' WHEN late THEN 'timeout' ELSE 'answer is no JSON object' END AS error
        FROM (SELECT *, event_type = 'signup' AND value < 5 AS late,
                     event_type IN ('view', 'signup', 'purchase') AND NOT (event_type = 'signup' AND value < 5) AS good
              FROM events)""",
    "label_upsert": f"""WITH {EVIDENCE + LABELS}
        SELECT * REPLACE (CASE WHEN is_pain_point THEN 'mixed' ELSE sentiment END AS sentiment,
                          CASE WHEN is_pain_point THEN CAST(1 AS FLOAT) ELSE confidence END AS confidence)
        FROM evidence_labels
        UNION ALL
        SELECT evidence_id, 'unknown', 'unknown', 'unknown', FALSE, NULL, FALSE, NULL, 'neutral', CAST(0.5 AS FLOAT)
        FROM evidence_units WHERE length(coalesce(text, '')) > 10
          AND evidence_id NOT IN (SELECT evidence_id FROM evidence_labels)""",
    "clear_labels": f"""WITH {EVIDENCE + LABELS}
        SELECT * FROM evidence_labels WHERE evidence_id NOT IN (
            SELECT evidence_id FROM evidence_units WHERE source_type = 'comment')""",
    # --- collection and runs ---
    "incremental_collect": f"""WITH {FRESH}
        SELECT '20240201T000000Z' AS run_id, '{DOWNLOADED}' AS downloaded_at, 'redditwarp' AS source_tool,
               'new' AS category, '' AS time_filter, id, subreddit, title, author, score, '0' AS comment_count,
               created_at, 'text' AS post_type, 'selftext' AS content_source,
               coalesce(nullif(trim(body, {SPACE}), ''), permalink) AS selftext, '' AS outbound_url, '' AS domain,
               permalink, coalesce(nullif(trim(body, {SPACE}), ''), permalink) AS content FROM fresh""",
    "collect_summary": f"""WITH {FRESH},
        audit AS (
            SELECT subreddit, count(*) AS inspected_posts, {COUNT.format(WINDOW)} AS eligible_posts,
                   {COUNT.format("ts < TIMESTAMP '2024-01-03 00:00:00'")} AS older_than_start_posts,
                   {COUNT.format("ts > TIMESTAMP '2024-01-12 12:00:00'")} AS newer_than_end_posts
            FROM feed GROUP BY subreddit
        ),
        found AS (SELECT subreddit, count(*) AS n FROM fresh GROUP BY subreddit)
        SELECT a.subreddit, 'completed' AS status, '' AS error, inspected_posts, eligible_posts, older_than_start_posts,
               newer_than_end_posts, coalesce(n, 0) AS new_posts, CAST(0 AS BIGINT) AS comments,
               coalesce(n, 0) AS combined_rows
        FROM audit a LEFT JOIN found f USING (subreddit)""",
    "collect_audit": f"""WITH {DOC_FEED}
        SELECT subreddit, count(*) AS inspected_posts, {COUNT.format(WINDOW)} AS eligible_posts,
               {COUNT.format("ts < TIMESTAMP '2024-01-03 00:00:00'")} AS older_than_start_posts,
               {COUNT.format("ts > TIMESTAMP '2024-01-12 12:00:00'")} AS newer_than_end_posts
        FROM feed GROUP BY subreddit""",
    "seen_ids": f"""WITH {DOC_FEED}
        SELECT lower(subreddit) AS group_key, id AS post_id FROM feed UNION SELECT * FROM known""",
    "newest_listing": f"""WITH {DOC_FEED}
        SELECT subreddit, id, created_at FROM feed
        QUALIFY row_number() OVER (PARTITION BY lower(subreddit) ORDER BY ts DESC NULLS LAST, id) <= 100""",
    "normalise_submissions": f"""WITH {PAGES}
        SELECT '20240201T000000Z' AS run_id, '{DOWNLOADED}' AS downloaded_at, 'redditwarp' AS source_tool,
               'new' AS category, '' AS time_filter, CAST(page_id AS VARCHAR) AS id, coalesce(role, 'pages') AS subreddit,
               'Page ' || CAST(page_id AS VARCHAR) AS title, coalesce(role, '[deleted]') AS author,
               CAST(length(url) AS VARCHAR) AS score, CAST(n_comments AS VARCHAR) AS comment_count,
               '2024-01-05T09:00:00.250000+00:00' AS created_at, post_type, content_source, selftext, outbound_url,
               regexp_extract(target, '^https?://([^/?#]*)', 1) AS domain, permalink, content FROM submitted""",
    "normalise_comments": f"""WITH {PAGES}
        SELECT '20240201T000000Z' AS run_id, '{DOWNLOADED}' AS downloaded_at, CAST(s.page_id AS VARCHAR) AS post_id,
               coalesce(s.role, 'pages') AS post_subreddit, 'Page ' || CAST(s.page_id AS VARCHAR) AS post_title,
               s.permalink AS post_permalink, CAST(t.place AS VARCHAR) AS comment_rank, t.id AS comment_id, t.author,
               t.score, t.body, '0' AS reply_count, rtrim(s.permalink, '/') || '/' || t.id || '/' AS comment_permalink
        FROM submitted s JOIN thread t ON t.conv_id = s.page_id""",
    "normalise_combined": f"""WITH {PAGES}
        SELECT CAST(s.page_id AS VARCHAR) AS post_id, s.content AS post_content,
               coalesce(CAST(t.place AS VARCHAR), '') AS comment_rank, coalesce(t.id, '') AS comment_id,
               coalesce(t.author, '') AS comment_author, coalesce(t.body, '') AS comment_body,
               coalesce(rtrim(s.permalink, '/') || '/' || t.id || '/', '') AS comment_permalink
        FROM submitted s LEFT JOIN thread t ON t.conv_id = s.page_id""",
    "denormalise_posts_comments": f"WITH {COMBINED} SELECT * FROM combined",
    "run_split_comparison": f"""WITH {EVIDENCE},
        sliced AS (
            SELECT *, strftime(created_at, '%Y-%m-%dT%H:%M:%S')
                || CASE WHEN strftime(created_at, '%f') = '000000' THEN '' ELSE '.' || strftime(created_at, '%f') END
                || '+00:00' AS moment,
                CASE WHEN run_id = 'run_20240108' THEN 'new' ELSE 'historical' END AS own FROM evidence_units
        ),
        both_slices AS (SELECT own AS slice, * FROM sliced UNION ALL SELECT 'total', * FROM sliced),
        per_community AS (
            SELECT slice, subreddit AS community, count(*) AS n, min(moment) AS first, max(moment) AS last,
                   list(DISTINCT run_id) FILTER (WHERE run_id IS NOT NULL) AS runs
            FROM both_slices GROUP BY ALL
        ) {SUMMARY_OF.format(slice='slice,', group='GROUP BY slice')}""",
    "comparison_bundle": f"""WITH {EVIDENCE},
        sliced AS (
            SELECT *, strftime(created_at, '%Y-%m-%dT%H:%M:%S')
                || CASE WHEN strftime(created_at, '%f') = '000000' THEN '' ELSE '.' || strftime(created_at, '%f') END
                || '+00:00' AS moment,
                CASE WHEN run_id = 'run_20240108' THEN 'new' ELSE 'historical' END AS own FROM evidence_units
        ),
        both_slices AS (SELECT own AS slice, * FROM sliced UNION ALL SELECT 'total', * FROM sliced)
        SELECT 'posts' AS frame, slice, subreddit AS community, count(*) AS rows, min(moment) AS earliest_timestamp,
               max(moment) AS latest_timestamp FROM both_slices WHERE subreddit <> '' GROUP BY slice, subreddit""",
    "capped_collection": f"""WITH {DOC_FEED}
        SELECT subreddit, id, created_at FROM feed
        QUALIFY row_number() OVER (PARTITION BY lower(subreddit) ORDER BY ts DESC NULLS LAST, id) <= 20""",
    "dry_run_with_failures": f"""WITH {DOC_FEED}
        SELECT subreddit, 'dry_run' AS status, '' AS error, count(*) AS inspected_posts,
               {COUNT.format(WINDOW)} AS new_posts, 0::BIGINT AS comments
        FROM feed WHERE subreddit NOT IN ('src1', 'src2') GROUP BY subreddit
        UNION ALL SELECT DISTINCT subreddit, 'failed', 'not found', 0::BIGINT, 0::BIGINT, 0::BIGINT
        FROM feed WHERE subreddit IN ('src1', 'src2')""",
    "run_split_rows": f"""WITH {EVIDENCE}
        SELECT evidence_id, run_id, CASE WHEN run_id = 'run_20240108' THEN 'new' ELSE 'historical' END AS slice
        FROM evidence_units""",
    "frame_summary": f"""WITH {COMBINED},
        per_community AS (
            SELECT post_subreddit AS community, count(*) AS n, min(downloaded_at) AS first, max(downloaded_at) AS last,
                   list(DISTINCT run_id) FILTER (WHERE run_id IS NOT NULL) AS runs
            FROM combined GROUP BY ALL
        ) {SUMMARY_OF.format(slice='', group='')}""",
    "run_table": f"""WITH {RUNS}
        SELECT run_id, subreddit, 'completed' AS status, n AS inspected,
               CASE WHEN c > 0 THEN n - c ELSE n END AS in_date_range, n AS new_posts, c AS comments, n + c AS combined_rows
        FROM counted""",
    "run_totals": f"""WITH {RUNS}
        SELECT run_id, CAST(sum(n) AS BIGINT) AS total_new, CAST(sum(n + c) AS BIGINT) AS total_rows
        FROM counted GROUP BY run_id""",
    "latest_run_summary": f"""WITH {EVIDENCE},
        ends AS (
            SELECT run_id, min(created_at) AS started, max(created_at) AS ended FROM evidence_units
            WHERE run_id IS NOT NULL GROUP BY run_id
        )
        SELECT run_id, strftime(started, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS started_at,
               strftime(ended, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS completed_at
        FROM ends ORDER BY ended DESC, run_id DESC LIMIT 1""",
    "run_metrics": f"""WITH {COMBINED}
        SELECT (SELECT count(*) FROM posts WHERE run_id = 'run_20240108') AS latest_posts,
               (SELECT count(*) FROM comments WHERE run_id = 'run_20240108') AS latest_comments,
               (SELECT count(*) FROM combined WHERE run_id = 'run_20240108') AS latest_combined_rows,
               (SELECT count(*) FROM posts) AS stored_posts, (SELECT count(*) FROM comments) AS stored_comments""",
    "activity_screen": ACTIVITY.format(limit=100, window=30),
    "activity_screen_large_sample": ACTIVITY.format(limit=1500, window=45),
    # --- chunks and retrieval ---
    "build_chunks": f"WITH {SPLIT_CHUNKS} SELECT * FROM chunks",
    "build_chunks_combined": f"""WITH {CHUNKS.format(body="coalesce(nullif(p.selftext, ''), p.content)")} SELECT * FROM chunks""",
    "retrieve_topk": f"""WITH {QUESTIONS + NEAREST.format(vectors='embeddings', tie='vec_id')}
        SELECT question_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM nearest""",
    "retrieve_all": f"""WITH questions AS (SELECT vec_id AS question_id, embedding AS vector FROM embeddings)
        {NEAREST.format(vectors='embeddings', tie='vec_id')}
        SELECT question_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM nearest""",
    "retrieve_context": f"""WITH {RETRIEVED}
        SELECT question_id, string_agg('[r/' || subreddit || ' | ' || post_id || ' | ' || permalink || ']' || chr(10) || text,
               chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
        FROM retrieved GROUP BY question_id""",
    "retrieve_sources": f"""WITH {RETRIEVED}
        SELECT question_id, CAST(rank AS INTEGER) AS rank, subreddit, post_id, permalink, title FROM retrieved""",
    "embed_index": f"""
        SELECT doc_id, round({LETTER_NORM}, 4) AS norm,
               {', '.join(f"round(CAST(CAST(CASE WHEN {LETTER_NORM} = 0 THEN 0 ELSE {LETTER.format(c)} / {LETTER_NORM} END AS FLOAT) AS DOUBLE), 4) AS v_{c}" for c in 'aeio')}
        FROM documents""",
    "embed_hash": f"""WITH {SPLIT_CHUNKS},
        words AS (
            SELECT post_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM chunks
        ),
        counted AS (
            SELECT post_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 256 AS bucket, count(*) AS n
            FROM words WHERE word <> '' GROUP BY ALL
        )
        SELECT post_id, CAST(bucket AS INTEGER) AS bucket,
               round(n / sqrt(sum(n * n) OVER (PARTITION BY post_id)), 3) AS weight FROM counted""",
    # --- exports as files ---
    "export_scan": f"""WITH {POSTS}
        SELECT id, subreddit, title, score, coalesce(selftext, '') AS selftext, coalesce(content, '') AS content FROM posts""",
    "export_scan_mixed_headers": """
        SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type,
               CASE WHEN event_type NOT IN ('click', 'view') THEN CAST(user_id * 2 AS VARCHAR) END AS twice FROM events""",
    # --- streams and status ---
    "stream_ingest_dedupe": """
        SELECT DISTINCT event_type || '_' || CAST(user_id AS VARCHAR) AS evidence_id, event_type AS subreddit,
               CAST(user_id AS VARCHAR) AS post_id FROM events""",
    "stream_ingest_within": """
        SELECT DISTINCT event_type || '_' || CAST(user_id AS VARCHAR) AS evidence_id, event_type AS subreddit,
               CAST(user_id AS VARCHAR) AS post_id FROM events""",
    "stream_evidence_load": """
        SELECT 'post_' || CAST(doc_id AS VARCHAR) AS evidence_id, source AS subreddit, text FROM documents""",
    "stream_label_log": """
        SELECT 'user_' || CAST(user_id AS VARCHAR) AS evidence_id, event_type AS sentiment FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "stream_weekly_trend": f"""
        SELECT {MONDAY.format('ts')} AS week, {COUNT.format("event_type = 'error'")} AS pain_points,
               {COUNT.format("event_type = 'purchase'")} AS delights, count(*) AS labeled
        FROM events GROUP BY week""",
    "status_latest": """
        SELECT 'user_' || CAST(user_id AS VARCHAR) AS kind, event_id AS job_id,
               CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'pending'
                    ELSE 'running' END AS state, ts AS started_at, event_type NOT IN ('error', 'purchase') AS active
        FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "status_stale": """
        SELECT event_id AS job_id,
               CASE WHEN event_type IN ('click', 'view') AND ts < TIMESTAMP '2024-01-30 11:58:00' THEN 'interrupted'
                    WHEN event_type IN ('click', 'view') THEN 'running' WHEN event_type = 'error' THEN 'failed'
                    WHEN event_type = 'purchase' THEN 'done' ELSE 'pending' END AS state,
               CASE WHEN event_type IN ('click', 'view') AND ts < TIMESTAMP '2024-01-30 11:58:00'
                    THEN TIMESTAMP '2024-01-30 12:00:00' ELSE ts END AS updated_at
        FROM events""",
    "status_list": """
        SELECT event_id AS job_id,
               CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'pending'
                    ELSE 'running' END AS state, ts AS started_at, 'user_' || CAST(user_id AS VARCHAR) AS kind
        FROM events""",
}
