"""Memories: glossary, translation memory, characters, states, events, facts, relations, audit."""

from __future__ import annotations

from lexloom.operators import story
from lexloom.plans import dialect

dialect.VIEWS |= {
    # A conversation is a story: turns are its clock, roles its characters, texts its scenes.
    "states": """SELECT conv_id, role AS character_id, turn AS order_index, turn DIV 2 AS chapter, CASE WHEN (conv_id + turn) % 5 = 0 THEN 'deceased' ELSE 'alive' END AS status,
      CASE (conv_id + turn) % 3 WHEN 0 THEN 'house' WHEN 1 THEN 'road' ELSE 'town' END AS location, conv_id % 4 = 0 AS inferred, conv_id % 11 = 0 AS flashback FROM conversations WHERE role IS NOT NULL""",
    "story_events": "SELECT event_id, user_id AS story, event_id % 50 AS narrative_order, CASE WHEN event_id % 7 = 0 THEN event_id % 50 - 3 ELSE event_id % 50 END AS chronological_order, CASE WHEN value > 50 THEN 'major' ELSE 'minor' END AS significance, event_type FROM events",
    "facts": "SELECT doc_id AS fact_id, source AS category, lang AS subject, CASE WHEN doc_id % 3 = 0 THEN 'never ' ELSE 'always ' END || source || ' house road' AS statement, doc_id % 5 = 0 AS locked, doc_id % 4 = 0 AS inferred, doc_id % 10 AS seq FROM documents",
    "relations": "SELECT l_orderkey AS rel_id, l_partkey % 40 AS src, l_suppkey % 40 AS tgt, CASE l_linenumber % 3 WHEN 0 THEN 'friend' WHEN 1 THEN 'enemy' ELSE 'sibling' END AS rel_type, l_orderkey % 10 AS chapter, l_linenumber AS seq, l_returnflag = 'R' AS inferred FROM lineitem",
    "aliases": "SELECT term_id, term, target_term, kind, locked, EXPLODE(CONCAT_OF(ARR(term), aliases)) AS alias FROM glossary",
    "names": "SELECT character_id, name, gender, EXPLODE(CONCAT_OF(ARR(name), aliases)) AS alias FROM characters",
    "audit": "SELECT event_id, user_id AS entry_id, event_type AS field, CAST(value AS STRING) AS new_value, ts FROM events",
}

# The SQL of fact_compliance has patterns of its own, as the method has them.
_W, _NW, _S = "[\\p{L}\\p{N}_]", "[^\\p{L}\\p{N}_]", "[\\t\\n\\x0B\\f\\r \\x1C-\\x1F\\x{85}\\p{Z}]"
_CHOSEN = "(locked OR NOT (SELECT coalesce(bool_or(locked), false) FROM facts))"
ENTRIES = {
    "glossary_match": ("All places of terms and aliases in pairs.", "SELECT doc_id, id AS term_id, word AS alias, EXPLODE(starts) AS at FROM hits WHERE side = 's' AND what IN ('term', 'alias')", "SELECT doc_id, id AS term_id, word AS alias, EXPLODE(starts) AS \"at\" FROM hits WHERE side = 's' AND what IN ('term', 'alias')"),
    "glossary_verify_locked": ("Locked terms of a source whose translation is absent, with their places.", "SELECT h.doc_id, g.term_id, g.term, g.target_term, CAST(sum(h.n) AS BIGINT) AS places FROM hits h JOIN glossary g ON g.term_id = h.id AND g.locked LEFT JOIN (SELECT DISTINCT doc_id, id FROM hits WHERE side = 't' AND what = 'target') t ON t.doc_id = h.doc_id AND t.id = h.id WHERE h.side = 's' AND h.what IN ('term', 'alias') AND t.id IS NULL GROUP BY h.doc_id, g.term_id, g.term, g.target_term"),
    "glossary_lookup": ("Words of documents looked up as term, else as alias.", "SELECT d.lang, coalesce(g.term_id, a.term_id) AS term_id, count(*) AS n FROM (SELECT lang, EXPLODE(SPLIT(lower(text), ' ')) AS w FROM documents) d LEFT JOIN glossary g ON lower(g.term) = w LEFT JOIN (SELECT alias, min(term_id) AS term_id FROM aliases WHERE alias <> term GROUP BY alias) a ON lower(a.alias) = w WHERE coalesce(g.term_id, a.term_id) IS NOT NULL GROUP BY d.lang, coalesce(g.term_id, a.term_id)"),
    "tm_verify_locked": ("Locked entries in a document whose translation is not there.", "SELECT h.doc_id, h.tm_id FROM tm_hits h JOIN tm t ON t.tm_id = h.tm_id AND t.locked WHERE NOT h.kept"),
    "tm_conflicts": ("Entries rejected and yet locked.", "SELECT tm_id, status FROM tm WHERE locked AND status = 'rejected'"),
    "tm_update": ("Field differences of entries that are not locked.", "SELECT tm_id, 'target_term' AS field, md5(target_term) AS old_md5, md5(source_term) AS new_md5 FROM tm WHERE NOT locked AND target_term <> source_term"),
    "character_upsert": ("Observed names against the characters known: new ones are added, known ones get the new nickname unless another character bears it.", "SELECT m.name, CASE WHEN n.character_id IS NULL THEN 'added' WHEN m.ids > 1 THEN 'conflict' ELSE 'merged' END AS outcome, m.seen FROM (SELECT k.name, k.seen, count(DISTINCT n.character_id) AS ids FROM (SELECT lower(word) AS name, CAST(sum(n) AS BIGINT) AS seen FROM hits WHERE side = 's' AND what IN ('name', 'nick', 'term') GROUP BY lower(word)) k LEFT JOIN names n ON lower(n.alias) = k.name GROUP BY k.name, k.seen) m LEFT JOIN (SELECT lower(alias) AS alias, min(character_id) AS character_id FROM names GROUP BY lower(alias)) n ON n.alias = m.name"),
    "character_find_alias": ("Ids by nickname or name.", "SELECT DISTINCT doc_id, id AS character_id FROM hits WHERE side = 's' AND what IN ('name', 'nick')"),
    "character_alias_conflicts": ("Aliases of more than one character.", "SELECT lower(alias) AS alias, count(DISTINCT character_id) AS n FROM names GROUP BY lower(alias) HAVING count(DISTINCT character_id) > 1"),
    "character_update": ("Fields of characters that differ.", "SELECT character_id, 'gender' AS field, gender AS old_value, 'unknown' AS new_value FROM characters WHERE gender <> 'unknown' UNION ALL SELECT character_id, 'name', name, upper(name) FROM characters WHERE name <> upper(name)"),
    "cross_memory_conflict": ("Terms that two memories translate differently.", "SELECT a.term_id, b.term_id AS other_id, a.alias, CASE WHEN a.locked OR b.locked THEN 'high' ELSE 'low' END AS severity FROM aliases a JOIN aliases b ON lower(a.alias) = lower(b.alias) AND a.target_term <> b.target_term AND a.term_id < b.term_id UNION ALL SELECT a.term_id, b.term_id, a.term, 'same' FROM glossary a JOIN glossary b ON a.target_term = b.target_term AND a.term_id < b.term_id"),
    "verify_all_locked": ("Locked violations of glossary and memory by kind.", "SELECT 'glossary' AS kind, count(*) AS n FROM hits h JOIN glossary g ON g.term_id = h.id AND g.locked LEFT JOIN (SELECT DISTINCT doc_id, id FROM hits WHERE side = 't' AND what = 'target') t ON t.doc_id = h.doc_id AND t.id = h.id WHERE h.side = 's' AND h.what IN ('term', 'alias') AND t.id IS NULL UNION ALL SELECT 'tm', count(*) FROM tm_hits h JOIN tm t ON t.tm_id = h.tm_id AND t.locked WHERE NOT h.kept"),
    "detect_all_conflicts": ("All conflicts of the memories, by kind.", "SELECT 'glossary' AS kind, CAST(a.term_id AS STRING) AS id FROM aliases a JOIN glossary g ON lower(a.alias) = lower(g.term) AND a.term_id <> g.term_id UNION ALL SELECT 'tm', CAST(tm_id AS STRING) FROM tm WHERE locked AND status = 'rejected' UNION ALL SELECT 'character', lower(alias) FROM names GROUP BY lower(alias) HAVING count(DISTINCT character_id) > 1"),
    "audit_history": ("An entry's changes, newest first.", "SELECT entry_id, field, event_id, CAST(row_number() OVER (PARTITION BY entry_id ORDER BY ts DESC, event_id DESC) AS INT) AS pos FROM audit WHERE field = 'purchase'"),
    "story_summary": ("Latest summary of each chapter.", "SELECT conv_id, chapter, max(order_index) AS latest, count(*) AS n FROM states GROUP BY conv_id, chapter"),
    "state_asof": ("Each character's latest state at every turn of the story.", "SELECT conv_id, order_index, character_id, status, location FROM (SELECT g.conv_id, g.turn AS order_index, g.character_id, last_value(s.status, true) OVER w AS status, last_value(s.location, true) OVER w AS location FROM (SELECT t.conv_id, t.turn, c.character_id FROM (SELECT DISTINCT conv_id, turn FROM conversations) t JOIN (SELECT DISTINCT conv_id, character_id FROM states) c ON c.conv_id = t.conv_id) g LEFT JOIN states s ON s.conv_id = g.conv_id AND s.order_index = g.turn AND s.character_id = g.character_id WINDOW w AS (PARTITION BY g.conv_id, g.character_id ORDER BY g.turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) x WHERE status IS NOT NULL", "SELECT conv_id, order_index, character_id, status, location FROM (SELECT t.conv_id, t.turn AS order_index, s.character_id, s.status, s.location, row_number() OVER (PARTITION BY t.conv_id, t.turn, s.character_id ORDER BY s.order_index DESC) AS rn FROM (SELECT DISTINCT conv_id, turn FROM conversations) t JOIN states s ON s.conv_id = t.conv_id AND s.order_index <= t.turn) x WHERE rn = 1"),
    "state_scene": ("A character's state in the chapter, else the one before.", "SELECT conv_id, chapter, character_id, coalesce(exact, before) AS order_index FROM (SELECT c.conv_id, c.chapter, r.character_id, max(CASE WHEN s.chapter = c.chapter THEN s.order_index END) AS exact, max(CASE WHEN s.chapter < c.chapter THEN s.order_index END) AS before FROM (SELECT DISTINCT conv_id, chapter FROM states) c JOIN (SELECT DISTINCT conv_id, character_id FROM states) r ON r.conv_id = c.conv_id JOIN states s ON s.conv_id = c.conv_id AND s.character_id = r.character_id AND s.chapter <= c.chapter GROUP BY c.conv_id, c.chapter, r.character_id) x"),
    "state_record": ("Latest state of each place and status.", "SELECT conv_id, character_id, location, status, max(order_index) AS order_index FROM states GROUP BY conv_id, character_id, location, status"),
    "story_get_states": ("Explicit states of a character, in order.", "SELECT conv_id, character_id, order_index, status, CAST(row_number() OVER (PARTITION BY conv_id, character_id ORDER BY order_index) AS INT) AS pos FROM states WHERE NOT inferred"),
    "relation_contradiction": ("Pairs that are friends and enemies in one chapter.", "SELECT least(src, tgt) AS a, greatest(src, tgt) AS b, chapter FROM relations WHERE src <> tgt GROUP BY least(src, tgt), greatest(src, tgt), chapter HAVING count(DISTINCT CASE WHEN rel_type IN ('friend', 'enemy') THEN rel_type END) > 1"),
    "events_two_clocks": ("Events by narrative and by chronological order.", "SELECT event_id, story, CAST(row_number() OVER (PARTITION BY story ORDER BY narrative_order, event_id) AS INT) AS narrative_pos, CAST(row_number() OVER (PARTITION BY story ORDER BY chronological_order, event_id) AS INT) AS chronological_pos FROM story_events"),
    "story_record_event": ("Events whose chronological order defaults to the narrative one.", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN chronological_order END, narrative_order) AS chronological_order FROM story_events"),
    "timeline_jump": ("Major events that go back in time.", "SELECT event_id, story, prev, chronological_order FROM (SELECT event_id, story, significance, chronological_order, lag(chronological_order) OVER (PARTITION BY story ORDER BY narrative_order, event_id) AS prev FROM story_events) x WHERE prev > chronological_order AND significance = 'major'"),
    "story_record_fact": ("Facts with their number of repetitions.", "SELECT statement, min(fact_id) AS fact_id, count(*) AS occurrences FROM facts GROUP BY statement"),
    "story_lock_fact": ("Facts with one locked.", "SELECT fact_id, CASE WHEN fact_id = 7 THEN true ELSE locked END AS locked FROM facts"),
    "story_record_xref": ("References by source.", "SELECT l_orderkey AS src, count(*) AS n FROM lineitem GROUP BY l_orderkey"),
    "scene_snapshot": ("Facts of a scene: explicit ones of its subject first, then general ones, then inferred ones, five at most.", "SELECT subject, fact_id, tier, pos FROM (SELECT s.subject, f.fact_id, CASE WHEN f.subject = s.subject AND NOT f.inferred THEN 1 WHEN f.category = 'src0' AND NOT f.inferred THEN 2 ELSE 3 END AS tier, CAST(row_number() OVER (PARTITION BY s.subject ORDER BY CASE WHEN f.subject = s.subject AND NOT f.inferred THEN 1 WHEN f.category = 'src0' AND NOT f.inferred THEN 2 ELSE 3 END, f.fact_id) AS INT) AS pos FROM (SELECT DISTINCT lang AS subject FROM documents) s JOIN facts f ON f.subject = s.subject OR f.category = 'src0') x WHERE pos <= 5"),
    "continuity_dead_acting": ("Turns in which a character acts after its death, with the latest one.", "SELECT conv_id, character_id, died_at, order_index AS acts_at FROM (SELECT conv_id, character_id, order_index, status, max(CASE WHEN status = 'deceased' THEN order_index END) OVER (PARTITION BY conv_id, character_id ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS died_at FROM states) x WHERE status = 'alive' AND died_at IS NOT NULL", "SELECT a.conv_id, a.character_id, max(d.order_index) AS died_at, a.order_index AS acts_at FROM states a JOIN states d ON d.conv_id = a.conv_id AND d.character_id = a.character_id AND d.order_index < a.order_index AND d.status = 'deceased' WHERE a.status = 'alive' GROUP BY a.conv_id, a.character_id, a.order_index"),
    "state_contradiction": ("Dead, then alive, without a flashback.", "SELECT conv_id, character_id, order_index, next_status FROM (SELECT conv_id, character_id, order_index, status, flashback, lead(status) OVER (PARTITION BY conv_id, character_id ORDER BY order_index) AS next_status FROM states) x WHERE status = 'deceased' AND next_status = 'alive' AND NOT flashback"),
    "fact_contradiction": ("Facts of a subject and category with opposite polarity.", "SELECT subject, category, count(*) AS n, sum(CASE WHEN contains(statement, 'never') THEN 1 ELSE 0 END) AS negative FROM facts GROUP BY subject, category HAVING count(DISTINCT contains(statement, 'never')) > 1"),
    # counted by word on either side before the join: a word of all statements and most texts would make their product
    "fact_compliance": ("Words that negative facts restrict and a segment states, with no negation right before them or one word before: of the locked facts, or of all if none is locked.", f"SELECT f.category, CAST(sum(f.n * p.n) AS BIGINT) AS n FROM (SELECT category, w, count(*) AS n FROM (SELECT category, EXPLODE({story.restricted('statement')}) AS w FROM facts WHERE {_CHOSEN}) x GROUP BY category, w) f JOIN (SELECT w, count(*) AS n FROM (SELECT DISTINCT doc_id, EXPLODE({story.stated('source')}) AS w FROM pairs) z GROUP BY w) p ON p.w = f.w GROUP BY f.category", f"WITH restricted AS (SELECT fact_id, category, EXPLODE(FILTER(regexp_extract_all(lower(statement), R'{_W}{{4,}}', 0), w -> w NOT IN ('não', 'pode', 'deve', 'proibido', 'nunca', 'cannot', 'never', 'impossível', 'regra', 'universo', 'fora', 'para', 'sobre'))) AS w FROM facts WHERE RLIKE(lower(statement), R'não|proibido|nunca|cannot|never|impossível') AND {_CHOSEN}) SELECT f.category, count(*) AS n FROM restricted f JOIN (SELECT DISTINCT p.doc_id, k.w FROM (SELECT doc_id, lower(source) AS low FROM pairs) p JOIN (SELECT DISTINCT w FROM restricted) k ON CASE WHEN contains(p.low, k.w) THEN RLIKE(p.low, concat(R'(^|{_NW})', k.w, R'($|{_NW})')) AND NOT RLIKE(p.low, concat(R'(^|{_NW})(não|nunca|jamais|proibido|impossível de|not|never|no){_S}+({_W}+{_S}+)?', k.w, R'($|{_NW})')) ELSE false END) p ON p.w = f.w GROUP BY f.category"),
    "audit_append": ("Audit rows numbered in the order of their entry.", "SELECT event_id, entry_id, CAST(row_number() OVER (PARTITION BY entry_id ORDER BY ts, event_id) AS INT) AS revision FROM audit"),
    "revision_append": ("Revisions with an id made of their content.", "SELECT doc_id, substr(sha256(source_head || '|' || target_head), 1, 16) AS revision_id FROM pairs"),
    "event_log": ("Project events by type.", "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY event_type"),
    "source_integrity": ("Stored hashes that still hold.", "SELECT doc_id, sha256(text) AS sha, length(text) = n_chars AS intact FROM documents"),
    "qa_fix_history": ("Fixes of a user by time, then insertion.", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS pos FROM events WHERE event_type = 'click'"),
    "alerts_filter": ("Alerts shown of all, by severity.", "SELECT significance, count(*) AS shown, max(total) AS total FROM story_events CROSS JOIN (SELECT count(*) AS total FROM story_events) t GROUP BY significance", "SELECT significance, count(*) AS shown, (SELECT count(*) FROM story_events) AS total FROM story_events GROUP BY significance"),
    "promote_entities": ("Entities that become locked terms.", "SELECT name AS term, name AS target_term, true AS locked FROM characters WHERE gender <> 'unknown'"),
    "load_document_tree": ("Units of each document in order, as one list.", "SELECT doc_id, count(*) AS n, md5(LISTAGG[line; '|'; line_no]) AS tree_md5 FROM lines GROUP BY doc_id"),
    "progress_eta": ("Mean of the last 15 durations times what remains, from five samples on.", "SELECT user_id, event_id, n, round(mean * (total - n), 6) AS eta FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS mean, count(*) OVER (PARTITION BY user_id) AS total FROM events) x WHERE n >= 5"),
    "save_get_context": ("Context items as rows, kinds as columns.", "SELECT doc_id, max(CASE WHEN kind = 'title' THEN term END) AS title, max(CASE WHEN kind = 'place' THEN term END) AS place, count(*) AS n FROM (SELECT p.doc_id, g.kind, g.term FROM pairs p JOIN glossary g ON contains(p.source_head, g.term)) x GROUP BY doc_id"),
}
ENTRIES = {k: tuple(x.replace("sha256(", "SHA256(") for x in e) for k, e in ENTRIES.items()}
QUERIES, ORACLES = dialect.register(ENTRIES)
