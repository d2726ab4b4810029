"""DuckDB SQL of the queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


def _escaped(text: str) -> str:
    """The chat template's escape, by plain replacements."""
    out = rf"replace({text}, '\', '\\')"
    for c in ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"):
        out = rf"replace({out}, '{c}', '{c[0]}\-{c[1:]}')"
    return out


CHAT = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length({_escaped('role')}) + length({_escaped('text')}) + 23) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DECONTAMINATE = f"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_low('text')}, '{_WORD}') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({_low('text')}, '{_WORD}') AS w FROM benchmark),
bg AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
  SELECT item_id, w, least(13, len(w)) AS n, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bg),
dg AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT r, dg.n, i, item_id FROM dg JOIN bg ON dg.n = bg.n AND dg.g = bg.g),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT r, coalesce(CAST(item_id AS VARCHAR), '') AS s FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM dw LEFT JOIN pos ON pos.r = dw.r LEFT JOIN items ON items.r = dw.r
"""

NGRAM_JOIN = rf"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all({_low('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM dw WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT edge.a, reach.c FROM reach JOIN edge ON edge.b = reach.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.c AS component_id FROM documents d LEFT JOIN size ON size.doc_id = d.doc_id JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT body, min(page_id) AS first_id, count(*) AS k FROM p WHERE n >= 100 GROUP BY body)
SELECT p.page_id, n AS payload_bytes, sha256(p.body) AS payload_digest,
  CASE WHEN k > 1 AND first_id IS DISTINCT FROM page_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k > 1 AND first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to, true AS intact
FROM p LEFT JOIN g ON p.body = g.body AND p.n >= 100
"""
