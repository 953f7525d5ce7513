"""The same results in SQL, where SQL can say them.

Trained models, tokenizers and the packing plan have no SQL form; their queries
are held against brute force in the tests.
"""

from __future__ import annotations

from forumlens.llm import lines
from forumlens.llm.licenses import CONTAINED, TEMPLATES

WORD = r"[^\x20\x09-\x0D]+"
#: Lower-cases A-Z and nothing else.
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_LICENSE_WORDS = (
    "list_filter(list_transform(regexp_split_to_array(lower({}), '[^a-z0-9.]+'), lambda w: rtrim(w, '.')), lambda w: w <> '')")
_THREE = "list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"
_TEMPLATES = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES.items())

LICENSES = f"""
WITH t AS (
    SELECT DISTINCT license, unnest({_THREE}) AS g
    FROM (SELECT license, {_LICENSE_WORDS.format('text')} AS w FROM (VALUES {_TEMPLATES}) v(license, text))
), sized AS (SELECT license, count(*) AS shingles FROM t GROUP BY license),
d AS (
    SELECT rid, doc_id, unnest(list_distinct({_THREE})) AS g
    FROM (
        SELECT row_number() OVER () AS rid, doc_id, {_LICENSE_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL
    ) WHERE len(w) >= 3
)
SELECT doc_id, license, CAST(shared AS INTEGER) AS shared, CAST(shingles AS INTEGER) AS shingles
FROM (SELECT rid, doc_id, license, count(*) AS shared FROM d JOIN t USING (g) GROUP BY ALL) JOIN sized USING (license)
WHERE 100 * shared >= {CONTAINED} * shingles
"""

CHATS = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
    SELECT *, len('<turn ') + len(replace(replace(replace(role, '\', '\s'), '<', '\l'), '>', '\g')) + 2
        + len(replace(replace(text, '\', '\s'), '<', '\l')) + len('.</turn>.') AS chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

QUALITY_RULES = f"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, '') AS host, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
    FROM documents
), w AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
three AS (
    SELECT rid, pos, word AS a, lead(word) OVER nxt AS b, lead(word, 2) OVER nxt AS c FROM w
    WINDOW nxt AS (PARTITION BY rid ORDER BY pos)
), twice AS (
    SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM three WHERE c IS NOT NULL) WHERE n > 1
), repeated AS (
    SELECT rid, count(DISTINCT pos + j) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) s(j) GROUP BY rid
), l AS (
    SELECT rid, doc_id, host, line, array_to_string(regexp_extract_all({LOWER.format('line')}, '{WORD}'), ' ') AS normal,
        len(regexp_extract_all(line, '{WORD}')) AS words
    FROM (SELECT rid, doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '{WORD}')
), dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY rid),
common AS (
    SELECT host, normal FROM l GROUP BY host, normal HAVING count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INTEGER)) > {lines.LINE_DOCS}
), gone AS (SELECT rid, sum(words) AS gone FROM l JOIN common USING (host, normal) GROUP BY rid),
m AS (
    SELECT doc_id, len(w)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        (len(w) - coalesce(gone, 0))::BIGINT AS kept_words
    FROM d LEFT JOIN dup USING (rid) LEFT JOIN repeated USING (rid) LEFT JOIN gone USING (rid)
), f AS (SELECT *, n_words < {lines.LEAST_WORDS} OR 100 * n_repeat_words > {lines.REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND kept_words >= {lines.KEPT_WORDS} AND 100 * kept_words >= {lines.KEPT_PERCENT} * n_words AS kept FROM f
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g
    FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (
    SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT y, root FROM reach JOIN ways ON x = id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT id AS doc_id, min(root) AS component_id FROM reach GROUP BY id) LEFT JOIN n USING (doc_id)
"""

TOP_K = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT query_id, rank, vec_id, score FROM (
    SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score,
        CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, v.e) DESC, v.vec_id) AS INTEGER) AS rank
    FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
) WHERE rank <= 10
"""

ORACLES: dict[str, str] = {
    "op1_license_scan": LICENSES,
    "op4_chat_format": CHATS,
    "op5_quality_rules": QUALITY_RULES,
    "op9_minhash_near_dedup": NEAR_DUPLICATES,
    "op10_exact_topk": TOP_K,
}
