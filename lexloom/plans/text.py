"""Text normalisation, structure, segmentation and analysis of documents."""

from __future__ import annotations

from lexloom.plans import dialect
from lexloom.plans.fixtures import values

#: Lines in front of each document that bring what the driver's texts lack.
HEAD = [
    (-12, "CHAPTER IV: The Road"), (-11, ""), (-10, "* * *"), (-9, "- Who is there? said Holmes"), (-8, "1.2 Second part of it"), (-7, '"Run!" he cried, and Mr. Baker said "stop".'),
    (-6, "Title Case Line"), (-5, "SECTION IX"), (-4, "the inter-"), (-3, "national and well-"), (-2, "known road ended “here”.  "), (-1, "Dr. Watson's sister, Mary Ann, met Captain Nemo of Baker Street​."),
]
# Scene breaks, key words of headings, prefixes that keep their hyphen, abbreviations, honorifics, speech verbs.
SCENES = ("* * *", "***", "---", "###", "§ § §", "§§§", "• • •")
NUMBERED, NAMED = ("CHAPTER", "CAPÍTULO", "PART", "PARTE", "BOOK", "LIVRO"), ("PROLOGUE", "EPILOGUE", "PRÓLOGO", "EPÍLOGO")
_TITLE = r"(\s*[-:.]\s*.*)?$"  # a mark and the title behind it, or nothing
CHAPTERS = (f"^({'|'.join(NUMBERED)})\\s+[0-9IVXLCDM]+{_TITLE}", f"^({'|'.join(NAMED)}){_TITLE}")
PREFIXES = ("anti", "all", "co", "cross", "ex", "half", "mid", "non", "post", "pre", "pro", "quasi", "re", "self", "sub", "super", "ultra", "well", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
ABBREVIATIONS = ("mr.", "mrs.", "ms.", "dr.", "prof.", "capt.", "col.", "gen.", "lt.", "st.", "sr.", "jr.", "vs.", "etc.", "i.e.", "e.g.", "no.", "vol.", "p.", "pp.")
HONORIFICS = ("Mr.", "Mrs.", "Miss", "Ms.", "Dr.", "Doctor", "Prof.", "Professor", "Lord", "Lady", "Sir", "Dame", "Count", "Countess", "Duke", "Duchess", "Baron", "Baroness", "King", "Queen", "Prince", "Princess", "Captain", "Colonel", "Major", "General", "Inspector", "Detective", "Father", "Brother", "Sister", "Master")
SPEECH = ("said", "asked", "replied", "cried", "whispered")


def in_list(words) -> str:
    """A SQL list of strings."""
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_TRIM = r"RXR({x}, R'^\s+|\s+$', '' RXR)"
_CHAPTER = "(" + " OR ".join(f"RLIKE({{x}}, R'{c}')" for c in CHAPTERS) + ")"
_HON = "|".join(h.replace(".", r"\.") for h in HONORIFICS)
_VERBS = "|".join(SPEECH)
_ABBR = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
# Sentences: a mark goes behind each end that no abbreviation, initial or lower-case letter vetoes.
_SENT = rf"""FILTER(MAP(SPLIT(RXR(RXR(RXR({{x}}, R'((?:^|[^\p{{{{L}}}}.])(?:{_ABBR.title()}|{_ABBR}|[\p{{{{L}}}}]\.))(\s+)', concat(R'$1', chr(2)) RXR), R'([.!?]["”’)]?)\s+([^a-z\x02])', concat(R'$1', chr(1), R'$2') RXR), chr(2), ' ' RXR), chr(1)), s -> {_TRIM.format(x='s')}), s -> s <> '')"""

dialect.VIEWS |= {
    "head_lines": f"SELECT k, head FROM {values(HEAD, 'k, head')} h",
    "book": "SELECT d.doc_id, d.lang, d.source, h.k AS line_no, h.head AS line FROM documents d CROSS JOIN head_lines h WHERE d.text IS NOT NULL UNION ALL SELECT doc_id, lang, source, line_no, line FROM lines",
    "trimmed": f"SELECT doc_id, lang, source, line_no, line, {_TRIM.format(x='line')} AS t FROM book",
    "flagged": f"SELECT doc_id, lang, source, line_no, t, {_CHAPTER.format(x='t')} AS is_chapter, t IN {in_list(SCENES)} OR RLIKE(t, R'^(\\*\\s*){{3,}}$') AS is_scene, t = '' AS is_blank, RLIKE(t, R'^[-—–]\\s') AS is_dash FROM trimmed",
    "islands": "SELECT doc_id, lang, line_no, t, is_chapter, is_scene, is_blank, is_dash, sum(CASE WHEN is_chapter THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS chapter, sum(CASE WHEN is_chapter OR is_scene OR is_blank OR is_dash THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM flagged",
    "blocks": "SELECT doc_id, lang, CAST(chapter AS BIGINT) AS chapter, CAST(block AS BIGINT) AS block, min(line_no) AS first_line, max(line_no) AS last_line, LISTAGG[t; ' '; line_no] AS text FROM islands WHERE NOT is_blank AND NOT is_scene GROUP BY doc_id, lang, chapter, block",
    "words": r"SELECT doc_id, lang, source, EXPLODE(regexp_extract_all(lower(text), R'[\p{L}]{3,}', 0)) AS w FROM documents",
    "mentions": rf"SELECT doc_id, lang, line_no, EXPLODE(regexp_extract_all(line, R'(?:{_HON}) [A-Z][a-z]+(?: [A-Z][a-z]+)?', 0)) AS name, 'honorific' AS pattern, 0.95e0 AS confidence FROM book",
    "groups_of": "SELECT source, count(DISTINCT doc_id) AS total FROM documents WHERE text IS NOT NULL GROUP BY source",
    "repeated": "SELECT x.source, x.k, x.n FROM (SELECT source, lower(line) AS k, count(DISTINCT doc_id) AS n FROM lines WHERE length(line) <= 100 AND line <> '' GROUP BY source, lower(line)) x JOIN groups_of g ON g.source IS NOT DISTINCT FROM x.source WHERE x.n >= greatest(2, CAST(floor(0.6e0 * g.total) AS BIGINT))",
    "capitals": r"SELECT doc_id, lang, line_no, EXPLODE(regexp_extract_all(line, R'[A-Z][a-z]+(?: [A-Z][a-z]+){1,2}', 0)) AS name FROM book",
}

ENTRIES = {
    "norm_control_strip": ("Texts without control and invisible characters.", r"SELECT doc_id, line_no, md5(RXR(line, R'[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{200b}-\x{200f}\x{feff}]', '' RXR)) AS h FROM book"),
    "norm_special_spaces": ("Unicode blanks as blanks, none at line ends.", r"SELECT doc_id, line_no, md5(RXR(RXR(line, R'[\x{00a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]', ' ' RXR), R'[ \t]+$', '' RXR)) AS h FROM book"),
    "norm_quotes": ("Straight quotes.", "SELECT doc_id, line_no, translate(line, '“”‘’', '\"\"''''') AS line FROM book"),
    "norm_offsets": ("One block that maps a whole text.", "SELECT doc_id, 0 AS start_at, length(text) AS end_at FROM documents"),
    "dehyphenate": ("Words joined across line ends, compounds kept.", rf"SELECT doc_id, RXR(RXR(RXR(t, R'((?:^|[^\p{{L}}])(?:{'|'.join(PREFIXES)}))-\s*\n\s*', concat(R'$1', chr(3)) RXR), R'([\p{{L}}]{{2,}})-\s*\n\s*([\p{{L}}]{{2,}})', R'$1$2' RXR), chr(3), '-' RXR) AS t FROM (SELECT doc_id, LISTAGG[line; chr(10); line_no] AS t FROM book GROUP BY doc_id) x"),
    "slugify": ("Lines as lower-case slugs.", r"SELECT doc_id, line_no, RXR(RXR(lower(translate(line, 'áàâãäéèêëíìîïóòôõöúùûüçñ', 'aaaaaeeeeiiiiooooouuuucn')), R'[^a-z0-9_\s\-]', '' RXR), R'[\s\-]+', '_' RXR) AS slug FROM book"),
    "content_hash": ("Hash of a text with blanks collapsed.", r"SELECT doc_id, substr(SHA256(RXR(RXR(text, R'\s+', ' ' RXR), R'^ | $', '' RXR)), 1, 16) AS h FROM documents"),
    "id_generators": ("Hierarchical ids with leading zeros.", "SELECT doc_id, line_no, concat('doc_', lpad(CAST(doc_id AS STRING), 8, '0'), '_ln_', lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS STRING), 5, '0')) AS id FROM lines"),
    "scene_break": ("Lines that break scenes.", "SELECT doc_id, line_no, t FROM flagged WHERE is_scene"),
    "chapter_heading": ("Lines that begin chapters.", "SELECT doc_id, line_no, t FROM flagged WHERE is_chapter AND length(t) <= 120"),
    "section_heading": ("Lines that head sections, with their level.", rf"SELECT doc_id, line_no, level FROM (SELECT doc_id, line_no, CASE WHEN t = '' OR length(t) > 80 OR RLIKE(t, R'[.!?:;—\-]$') THEN 0 WHEN RLIKE(lower(t), R'^(section|seção)\s+[0-9ivxlcdm]+') THEN 2 WHEN RLIKE(t, R'^[0-9]+\.[0-9]+(\.[0-9]+)?\s+[A-Za-z]') THEN 3 WHEN SIZE(SPLIT(t, ' ')) <= 6 AND upper(t) = t AND lower(t) <> t AND length(t) < 50 THEN 2 WHEN SIZE(SPLIT(t, ' ')) <= 6 AND SIZE(FILTER(SPLIT(t, ' '), w -> length(w) > 3 AND upper(substr(w, 1, 1)) <> substr(w, 1, 1))) = 0 THEN 3 ELSE 0 END AS level FROM flagged) x WHERE level > 0"),
    "reconstruct_paragraphs": ("Soft-wrapped lines as blocks with their line range.", "SELECT doc_id, block, first_line, last_line, md5(text) AS h FROM blocks"),
    "structure_blocks": ("Blocks with the chapter they are in.", "SELECT doc_id, chapter, count(*) AS n, min(first_line) AS first_line FROM blocks GROUP BY doc_id, chapter"),
    "dialogue_detect": ("Lines of dialogue, with their mark.", "SELECT doc_id, line_no, CASE WHEN RLIKE(t, R'^[-—–]') THEN 'dash' WHEN RLIKE(t, R'^[\"“‘«]') THEN 'quote' ELSE 'inner' END AS marker FROM flagged WHERE RLIKE(t, R'^[-—–]') OR RLIKE(t, R'^[\"“‘«]') OR length(t) - length(replace(t, '\"', '')) >= 2 OR (contains(t, '“') AND contains(t, '”'))"),
    "dialogue_identify_parser": ("Lines that are dialogue as a whole.", "SELECT doc_id, line_no FROM flagged WHERE RLIKE(t, R'^[-—–]\\s*.+') OR RLIKE(t, R'^[\"“].*[\"”]$')"),
    "speaker_hint": ("Who speaks, by verb and name.", rf"SELECT doc_id, line_no, speaker FROM (SELECT doc_id, line_no, coalesce(nullif(regexp_extract(t, R'(?:{_VERBS})\s+([A-Z][a-z]+)', 1), ''), nullif(regexp_extract(t, R'([A-Z][a-z]+)\s+(?:{_VERBS})', 1), '')) AS speaker FROM flagged) x WHERE speaker IS NOT NULL AND lower(speaker) NOT IN ('he', 'she', 'they', 'it', 'ele', 'ela', 'eles')"),
    "sentence_split": ("Sentences of blocks.", "SELECT doc_id, block, SIZE(s) AS n, md5(array_to_string(s, '|')) AS h FROM (SELECT doc_id, block, " + _SENT.format(x="text") + " AS s FROM blocks) x"),
    "verify_no_loss": ("Documents whose lines, joined, are the text.", "SELECT d.doc_id, d.text = b.t AS same FROM documents d JOIN (SELECT doc_id, LISTAGG[line; chr(10); line_no] AS t FROM lines GROUP BY doc_id) b ON b.doc_id = d.doc_id"),
    "repetition_detect": ("Lines in max(2, 0.6 of the documents) of a source or more.", "SELECT source, md5(k) AS h, n AS groups FROM repeated"),
    "repetition_filter": ("Lines of documents without the repeated ones.", "SELECT l.doc_id, count(*) AS n FROM lines l LEFT JOIN repeated r ON r.source IS NOT DISTINCT FROM l.source AND r.k = lower(l.line) WHERE r.k IS NULL GROUP BY l.doc_id"),
    "reading_sequence": ("Units of several kinds in one order.", "SELECT doc_id, line_no, CASE WHEN is_chapter THEN 'heading' WHEN is_dash THEN 'dialogue' ELSE 'paragraph' END AS kind, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INT) AS pos FROM flagged WHERE NOT is_blank"),
    "word_count": ("Words of blocks by chapter.", "SELECT doc_id, chapter, CAST(sum(SIZE(FILTER(SPLIT(text, ' '), w -> w <> ''))) AS BIGINT) AS n FROM blocks GROUP BY doc_id, chapter"),
    "src_txt": ("Chapters and paragraphs of plain texts.", "SELECT doc_id, chapter, block, first_line, length(text) AS n FROM blocks"),
    "src_detect_format": ("Formats by the first bytes.", "SELECT page_id, CASE WHEN RLIKE(lower(substr(html, 1, 4096)), R'<!doctype html|<html') THEN 'html' WHEN substr(html, 1, 4) = '%PDF' THEN 'pdf' ELSE 'txt' END AS format FROM pages"),
    "src_inspect": ("Size and kind of each file.", "SELECT page_id, octet_length(encode(coalesce(html, ''), 'utf-8')) AS bytes, length(RXR(html, R'\\s', '' RXR)) >= 40 AS textual FROM pages"),
    "src_validate": ("Inputs of an allowed size.", "SELECT page_id FROM pages WHERE length(html) BETWEEN 1 AND 104857600"),
    "src_file_sha256": ("Hash of each file.", "SELECT page_id, SHA256(html) AS sha FROM pages"),
    "sanitize_html": ("Pages without scripts, styles and comments.", r"SELECT page_id, md5(RXR(html, R'(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '' RXR)) AS h FROM pages"),
    "src_markdown": ("Headings, images and footnotes of marked lines.", r"SELECT doc_id, line_no, length(regexp_extract(m, R'^(#{1,6})\s', 1)) AS level, regexp_extract(m, R'!\[([^\]]*)\]\(', 1) AS image, regexp_extract(m, R'^\[\^([0-9]+)\]:', 1) AS note FROM (SELECT doc_id, line_no, CASE CAST(line_no AS BIGINT) % 3 WHEN 0 THEN concat('## ', line) WHEN 1 THEN concat('![alt](', line, ')') ELSE concat('[^', CAST(line_no AS STRING), ']: ', line) END AS m FROM lines) x"),
    "ner_honorific": ("Titles with names.", "SELECT lang, name, count(*) AS n, max(confidence) AS confidence FROM mentions GROUP BY lang, name"),
    "ner_multiword": ("Runs of capitalised words.", "SELECT lang, name, count(*) AS n FROM capitals GROUP BY lang, name"),
    "ner_possessive": ("Names in the possessive.", r"SELECT lang, name, count(*) AS n FROM (SELECT lang, EXPLODE(regexp_extract_all(line, R'([A-Z][a-z]+)\x27s', 1)) AS name FROM book) x GROUP BY lang, name"),
    "ner_speech": ("Names beside speech verbs.", rf"SELECT lang, name, count(*) AS n FROM (SELECT lang, EXPLODE(CONCAT_OF(regexp_extract_all(line, R'([A-Z][a-z]+)\s+(?:{_VERBS})', 1), regexp_extract_all(line, R'(?:{_VERBS})\s+([A-Z][a-z]+)', 1))) AS name FROM book) x GROUP BY lang, name"),
    "ner_span_containment": ("Runs of capitals inside a title's span are left out.", "SELECT c.lang, c.name, count(*) AS n FROM capitals c LEFT JOIN mentions m ON m.doc_id = c.doc_id AND m.line_no = c.line_no AND contains(m.name, c.name) WHERE m.name IS NULL GROUP BY c.lang, c.name"),
    "snippet_window": ("Forty characters around a name.", "SELECT doc_id, line_no, substr(line, greatest(1, STRPOS(line, name) - 40), 80) AS snippet FROM (SELECT m.doc_id, m.line_no, m.name, b.line FROM mentions m JOIN book b ON b.doc_id = m.doc_id AND b.line_no = m.line_no) x"),
    "alias_canonical": ("Names of two words or more, with how often they occur.", "SELECT name, count(*) AS n, min(doc_id) AS first_doc FROM capitals WHERE SIZE(SPLIT(name, ' ')) >= 2 GROUP BY name HAVING count(*) >= 2"),
    "alias_resolve": ("Single words as the one name they are part of.", "SELECT part, min(name) AS canonical, CASE WHEN count(DISTINCT name) = 1 THEN 0.85e0 ELSE 0.5e0 END AS confidence FROM (SELECT name, EXPLODE(SPLIT(name, ' ')) AS part FROM (SELECT DISTINCT name FROM capitals) c) x GROUP BY part"),
    "entity_occurrence_stats": ("How often and where first each entity occurs.", "SELECT name, count(*) AS n, min(doc_id) AS first_doc FROM mentions GROUP BY name"),
    "entity_summary": ("Thirty most frequent entities.", "SELECT name, n, pos FROM (SELECT name, n, CAST(row_number() OVER (ORDER BY n DESC, name) AS INT) AS pos FROM (SELECT name, count(*) AS n FROM capitals GROUP BY name) c) x WHERE pos <= 30"),
    "style_evidence_sample": ("First five lines of dialogue of each language.", "SELECT lang, doc_id, line_no, pos FROM (SELECT lang, doc_id, line_no, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id, line_no) AS INT) AS pos FROM flagged WHERE is_dash) x WHERE pos <= 5"),
    "recurrent_concepts": ("Entities that occur twice or more.", "SELECT name, count(*) AS n FROM capitals GROUP BY name HAVING count(*) >= 2"),
    "characters_per_chapter": ("Names in each chapter.", "SELECT doc_id DIV 10 AS chapter, LISTAGG[name; ','; name] AS names FROM (SELECT DISTINCT doc_id DIV 10 * 10 AS doc_id, name FROM mentions) x GROUP BY doc_id DIV 10"),
    "sink_safe_name": ("Names safe for files.", r"SELECT doc_id, line_no, substr(RXR(RXR(RXR(line, R'[<>:\x22/\\|?*\x00-\x1f]', '' RXR), R'\s+', '_' RXR), R'\.\.+', '.' RXR), 1, 120) AS name FROM book"),
    "stitch_segments": ("Parts of a paragraph joined in order.", "SELECT doc_id, block DIV 3 AS paragraph, md5(LISTAGG[text; ' '; block]) AS h FROM blocks GROUP BY doc_id, block DIV 3"),
    "export_inline_format": ("Bold and italic marks as tags.", r"SELECT doc_id, line_no, RXR(RXR(replace(replace(replace(m, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), R'\*\*([^*]+)\*\*', R'<b>$1</b>' RXR), R'\*([^*]+)\*', R'<i>$1</i>' RXR) AS html FROM (SELECT doc_id, line_no, concat('**', line, '** *x* <y>') AS m FROM lines WHERE line <> '' AND NOT contains(line, '*')) x"),
}
QUERIES, ORACLES = dialect.register(ENTRIES)
