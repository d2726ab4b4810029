"""Derived inputs, from the driver tables, that queries and their SQL build alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import consistency, matching, ranking
from lexloom.session import materialise, table

#: Sentence pairs with and without defects; row k goes with the documents whose id leaves k.
PAIRS = [
    ("In 1887 he paid $50 for 10 miles, not 15%.", "Em 1887 ele pagou $50 por 10 milhas, não 15%."),
    ("In 1887 he paid $50 for 12 miles.", "Em 1878 ele pagou 5 dólares por 10 milhas."),
    ("She came on October 14 and left in May.", "Ela veio em 14 de outubro e partiu em maio."),
    ("She came on October 14 and left in May.", "Ela veio em 15 de outubro e partiu em junho."),
    ("The 3rd of August was cold, 5 feet of snow.", "Fazia frio, 5 feet de neve."),
    ("About 20 percent, or 3.5%, of £40 was lost.", "Cerca de 20 por cento, ou 3,5 %, de 40 libras se perdeu."),
    ("About 20 percent, or 3.5%, of £40 was lost.", "Cerca de 30%, ou 4%, de 41 libras se perdeu."),
    ("See https://example.org/a and write to Ann@Mail.org now.", "Veja https://example.org/a e escreva para ann@mail.org agora."),
    ("See https://example.org/a and write to ann@mail.org now.", "Veja https://example.org/b e escreva agora."),
    ("He never came [1] (Smith, 1999).", "Ele nunca veio [1] (Smith, 1999)."),
    ("He never came [1] and [^2] (Smith, 1999).", "Ele veio [1]."),
    ("He came home.", "Ele não veio para casa."),
    ("One day. Two men. Three dogs. A long road lay ahead of them all.", "Um dia dois homens, cara."),
    ("A very long sentence that says many things about the weather.", "Curto."),
    ("Sherlock Holmes met the Count at Baker Street.", "Sherlock Holms encontrou o conde na rua dela."),
    ("Doctor Watson smiled and the Count laughed aloud.", "O homem sorriu e o Count riu muito alto. O homem sorriu e o Count riu muito alto."),
    ("\"Where are you?\" he whispered, furious.", "\"Onde você está?\" ele disse, chateado."),
    ("She said that he was alive and furious.", "Ele disse que ela estava morto e irritada."),
    ("Actually he pretended to be a parent of the boy.", "Atualmente ele pretendia ser parente do menino."),
    ("They walked (slowly) to the old house.", "Eles caminharam (devagar para a casa de"),
]


def pair_table(spark: SparkSession) -> DataFrame:
    """PAIRS as rows (k, source_head, target_head)."""
    return spark.createDataFrame([(k, s, t) for k, (s, t) in enumerate(PAIRS)], "k long, source_head string, target_head string")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, chapter, seq, source, target): a pair in front of each document's text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").where("text IS NOT NULL")
    joined = docs.join(F.broadcast(pair_table(spark)), F.pmod("doc_id", F.lit(len(PAIRS))) == F.col("k"))
    return joined.select(
        "doc_id", "lang", F.floor(F.col("doc_id") / 10).alias("chapter"), F.pmod("doc_id", F.lit(10)).alias("seq"),
        F.concat("source_head", F.lit("\n"), "text").alias("source"), F.concat("target_head", F.lit("\n"), "text").alias("target"), "source_head", "target_head",
    )


def lit(s: str) -> str:
    """A SQL string."""
    return "'" + s.replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    """A SQL table of constant rows."""
    body = ", ".join("(" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({columns}))"


PAIRS_SQL = f"""pairs AS (
  SELECT doc_id, lang, CAST(floor(doc_id / 10) AS BIGINT) AS chapter, doc_id % 10 AS seq, concat(source_head, chr(10), text) AS source, concat(target_head, chr(10), text) AS target, source_head, target_head
  FROM documents JOIN {values([(k, s, t) for k, (s, t) in enumerate(PAIRS)], "k, source_head, target_head")} p ON doc_id % {len(PAIRS)} = k WHERE text IS NOT NULL)"""

#: A glossary: term, translation, kind, locked, aliases.
GLOSSARY = [
    (1, "Count", "Conde", "title", True, "Earl"),
    (2, "Baker Street", "Baker Street", "place", True, ""),
    (3, "the", "o", "term", False, "and"),
    (4, "der", "o", "term", True, "die"),
    (5, "house", "casa", "term", True, "home"),
    (6, "Earl", "Conde", "title", False, ""),
    (7, "que", "que", "term", False, "de"),
]
GLOSSARY_COLUMNS = "term_id, term, target_term, kind, locked, aliases"


def glossary(spark: SparkSession) -> DataFrame:
    """GLOSSARY as rows; aliases as an array."""
    df = spark.createDataFrame(GLOSSARY, "term_id int, term string, target_term string, kind string, locked boolean, aliases string")
    return df.withColumn("aliases", F.expr("filter(split(aliases, '[|]'), x -> x <> '')"))


GLOSSARY_SQL = f"glossary AS (SELECT term_id, term, target_term, kind, locked, list_filter(string_split(aliases, '|'), lambda x: x <> '') AS aliases FROM {values(GLOSSARY, GLOSSARY_COLUMNS)})"

#: Characters: id, name, aliases, gender.
CHARACTERS = [(1, "Sherlock Holmes", "Holmes|Sherlock", "male"), (2, "Doctor Watson", "Watson", "male"), (3, "Ann", "Annie", "female"), (4, "Holmes", "", "unknown")]
CHARACTER_COLUMNS = "character_id, name, aliases, gender"


def characters(spark: SparkSession) -> DataFrame:
    """CHARACTERS as rows; aliases as an array."""
    df = spark.createDataFrame(CHARACTERS, "character_id int, name string, aliases string, gender string")
    return df.withColumn("aliases", F.expr("filter(split(aliases, '[|]'), x -> x <> '')"))


CHARACTERS_SQL = f"characters AS (SELECT character_id, name, list_filter(string_split(aliases, '|'), lambda x: x <> '') AS aliases, gender FROM {values(CHARACTERS, CHARACTER_COLUMNS)})"

#: Every word of the dictionaries and what it is: a term, its alias or translation, a name or a nickname.
WORDS = [(w, i, x) for i, term, target, _, _, aliases in GLOSSARY for w, x in (("term", term), ("target", target), *(("alias", a) for a in aliases.split("|") if a))]
WORDS += [(w, i, x) for i, name, aliases, _ in CHARACTERS for w, x in (("name", name), *(("nick", a) for a in aliases.split("|") if a))]


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, chapter, seq, side, what, id, word, n, starts): the dictionaries' words in both sides of the pairs, in one scan."""
    side = F.explode(F.array(F.struct(F.lit("s").alias("side"), F.col("source").alias("text")), F.struct(F.lit("t").alias("side"), F.col("target").alias("text")))).alias("x")
    sides = pairs(spark, sf_dir).select("doc_id", "chapter", "seq", side).select("doc_id", "chapter", "seq", "x.side", "x.text")
    words = spark.createDataFrame(WORDS, "what string, id int, term string")
    found = matching.find_terms(sides, words, keys=("doc_id", "chapter", "seq", "side"), term_keys=("what", "id"))
    return found.select("doc_id", "chapter", "seq", "side", "what", "id", F.col("term").alias("word"), F.size("starts").cast("long").alias("n"), "starts")


# Places: a text is split at a word; what stands before and behind each piece's end must be no word's inside.
_INNER = "[\\p{L}\\p{N}_]"
HITS_SQL = f"""hits AS (
  SELECT doc_id, chapter, seq, side, what, id, word, CAST(len(starts) AS BIGINT) AS n, starts FROM (
    SELECT doc_id, chapter, seq, side, what, id, word, list_filter(list_transform(generate_series(1, len(parts) - 1), lambda k: CAST(list_sum(list_transform(parts[1:k], lambda p: length(p))) + (k - 1) * length(word) AS BIGINT)),
      lambda spot: NOT regexp_matches(substr(low, spot + length(word) + 1, 1), '{_INNER}') AND (spot = 0 OR NOT regexp_matches(substr(low, greatest(spot, 1), 1), '{_INNER}'))) AS starts FROM (
      SELECT doc_id, chapter, seq, side, what, id, word, low, string_split(low, lower(word)) AS parts FROM (
        SELECT doc_id, chapter, seq, 's' AS side, lower(source) AS low FROM pairs UNION ALL SELECT doc_id, chapter, seq, 't', lower(target) FROM pairs) x, {values(WORDS, "what, id, word")} w WHERE contains(low, lower(word))) y) z
  WHERE len(starts) > 0)"""


def tm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A translation memory of the benchmark's texts: every third is kept as it is, the others get a mark in front."""
    items = table(spark, sf_dir, "benchmark")
    target = F.when(F.col("item_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("pt "), "text"))
    status = F.when(F.col("item_id") % 4 == 0, "rejected").otherwise("approved")
    return items.select(F.col("item_id").alias("tm_id"), F.col("text").alias("source_term"), target.alias("target_term"), (F.col("item_id") % 2 == 0).alias("locked"), ((F.col("item_id") % 10) / F.lit(10.0)).alias("confidence"), status.alias("status"), (F.col("item_id") % 6).alias("occurrences"))


TM_SQL = "tm AS (SELECT item_id AS tm_id, text AS source_term, CASE WHEN item_id % 3 = 0 THEN text ELSE concat('pt ', text) END AS target_term, item_id % 2 = 0 AS locked, (item_id % 10) / 10e0 AS confidence, CASE WHEN item_id % 4 = 0 THEN 'rejected' ELSE 'approved' END AS status, item_id % 6 AS occurrences FROM benchmark)"


def tm_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tm_id, kept): memory entries whose source a document holds, and whether it holds the translation as well."""
    entries = tm(spark, sf_dir)
    both = entries.select("tm_id", F.explode(F.array(F.struct(F.lit(False).alias("kept"), F.col("source_term").alias("term")), F.struct(F.lit(True).alias("kept"), F.col("target_term").alias("term")))).alias("x")).select("tm_id", "x.kept", "x.term")
    found = matching.find_terms(table(spark, sf_dir, "documents").select("doc_id", "text"), both, term_keys=("tm_id", "kept"))
    by_entry = found.groupBy("doc_id", "tm_id").agg(F.max("kept").alias("kept"), F.min("kept").alias("only"))
    return by_entry.where(~F.col("only")).select("doc_id", "tm_id", "kept")


def _whole(text: str, term: str) -> str:
    return f"CASE WHEN contains(lower({text}), lower({term})) THEN regexp_matches(lower({text}), concat('(^|[^\\p{{L}}\\p{{N}}_])\\Q', lower({term}), '\\E($|[^\\p{{L}}\\p{{N}}_])')) ELSE false END"


TM_HITS_SQL = f"tm_hits AS (SELECT doc_id, tm_id, {_whole('text', 'target_term')} AS kept FROM documents, tm WHERE {_whole('text', 'source_term')})"

def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, chapter, term_id, term, target_term, kind, locked, variant): how each segment renders each glossary term it holds."""
    found = hits(spark, sf_dir)
    there = found.where("side = 't' AND what IN ('target', 'alias')").groupBy("doc_id", F.col("id").alias("term_id")).agg(F.max(F.col("what") == "target").alias("has_target"), F.collect_set(F.when(F.col("what") == "alias", F.col("word"))).alias("aliases"))
    terms = found.where("side = 's' AND what = 'term'").select("doc_id", "chapter", F.col("id").alias("term_id"))
    rows = terms.join(F.broadcast(glossary(spark).drop("aliases")), "term_id").join(there, ["doc_id", "term_id"], "left")
    rows = rows.withColumns({"has_target": F.coalesce("has_target", F.lit(False)), "aliases": F.coalesce("aliases", F.array().cast("array<string>"))})
    return consistency.variants(rows.join(pairs(spark, sf_dir).select("doc_id", "target"), "doc_id"))


_W = "[\\p{L}\\p{N}_]"
_NW = "[^\\p{L}\\p{N}_]"
RENDERED_SQL = f"""rendered AS (
  SELECT doc_id, chapter, term_id, term, target_term, kind, locked, CASE WHEN kept THEN target_term WHEN alias IS NOT NULL THEN alias WHEN a <> '' THEN a WHEN b <> '' THEN b ELSE array_to_string(list_filter(regexp_split_to_array(regexp_replace(target, '^[—"“\\s]+', ''), '\\s+'), lambda w: w <> '')[1:4], ' ') END AS variant FROM (
    SELECT p.doc_id, p.chapter, g.term_id, g.term, g.target_term, g.kind, g.locked, p.target, EXISTS (SELECT 1 FROM hits t WHERE t.doc_id = p.doc_id AND t.id = g.term_id AND t.side = 't' AND t.what = 'target') AS kept,
      (SELECT min(t.word) FROM hits t WHERE t.doc_id = p.doc_id AND t.id = g.term_id AND t.side = 't' AND t.what = 'alias') AS alias,
      CASE WHEN contains(g.target_term, ' ') THEN regexp_extract(p.target, concat('(?i)(?:^|{_NW})({_W}+\\s+\\Q', substr(g.target_term, strpos(g.target_term, ' ') + 1), '\\E)(?:$|{_NW})'), 1) ELSE '' END AS a,
      CASE WHEN contains(g.target_term, ' ') THEN regexp_extract(p.target, concat('(?i)(?:^|{_NW})(\\Q', split_part(g.target_term, ' ', 1), '\\E\\s+{_W}+)(?:$|{_NW})'), 1) ELSE '' END AS b
    FROM pairs p JOIN (SELECT DISTINCT doc_id, id FROM hits WHERE side = 's' AND what = 'term') h ON h.doc_id = p.doc_id JOIN glossary g ON g.term_id = h.id) x)"""

_CANDIDATES = "SELECT doc_id, 1 AS cand, source, target FROM pairs UNION ALL SELECT doc_id, 2, source, source FROM pairs UNION ALL SELECT doc_id, 3, source, concat(target, ' ', target) FROM pairs UNION ALL SELECT doc_id, 4, source, substr(target, 1, 15) FROM pairs WHERE doc_id % 2 = 0"


def candidate_target() -> F.Column:
    """The text of candidate `cand`: the target, the source, the target twice, a piece of it."""
    return F.when(F.col("cand") == 1, F.col("target")).when(F.col("cand") == 2, F.col("source")).when(F.col("cand") == 3, F.concat("target", F.lit(" "), "target")).otherwise(F.substring("target", 1, 15))


def _spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files are fewer."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, "doc_id")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, cand, source, target, size): each pair's candidates, with the length of their text."""
    rows = _spread(pairs(spark, sf_dir).select("doc_id", "source", "target")).select("doc_id", "source", "target", F.explode(F.expr("sequence(1, IF(doc_id % 2 = 0, 4, 3))")).alias("cand"))
    return rows.select("doc_id", "cand", "source", candidate_target().alias("target")).withColumn("size", F.length("target"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidates with the seven scores and final_score. What the sources hold is found once and written."""
    words = spark.createDataFrame(WORDS, "what string, id int, term string").where("what IN ('term', 'alias', 'name', 'nick')")
    sources = _spread(pairs(spark, sf_dir).select("doc_id", "source"))
    found, _ = materialise(matching.find_terms(sources, words, text="source", term_keys=("what", "id")).select("doc_id", "what", "id"), "source_hits")
    locked = glossary(spark).where("locked").select("term_id", "term", "target_term")
    terms = found.where("what IN ('term', 'alias')").select("doc_id", F.col("id").alias("term_id")).distinct().join(F.broadcast(locked), "term_id").select("doc_id", "term", "target_term")
    memory, _ = materialise(tm_hits(spark, sf_dir).join(tm(spark, sf_dir).where("locked").select("tm_id", "target_term"), "tm_id").select("doc_id", "target_term"), "memory_hits")
    names = found.where("what IN ('name', 'nick')").select("doc_id", F.col("id").alias("character_id")).distinct().join(F.broadcast(characters(spark).select("character_id", "name")), "character_id").select("doc_id", "name")
    return ranking.score(candidates(spark, sf_dir), terms, memory, names)


def _has(text: str, term: str) -> str:
    return f"(CASE WHEN contains(lower({text}), lower({term})) THEN regexp_matches(lower({text}), concat('(^|{_NW})\\Q', lower({term}), '\\E($|{_NW})')) ELSE false END)"


_CUT = "greatest(0e0, least(1e0, {0}))"
SCORED_SQL = f"""cands AS ({_CANDIDATES}), split AS (SELECT *, list_filter(regexp_split_to_array(lower(target), '\\s+'), lambda w: w <> '') AS w, regexp_extract_all(lower(target), '{_W}+') AS words, list_distinct(list_filter(regexp_extract_all(source, '{_W}+'), lambda x: regexp_matches(x, '^[0-9]+$'))) AS sn, list_filter(regexp_extract_all(target, '{_W}+'), lambda x: regexp_matches(x, '^[0-9]+$')) AS tn, trim(target, chr(32) || chr(9) || chr(10) || chr(13)) AS tt FROM cands),
  own_terms AS (SELECT DISTINCT h.doc_id, g.term, g.target_term FROM hits h JOIN glossary g ON g.term_id = h.id AND g.locked WHERE h.side = 's' AND h.what IN ('term', 'alias')),
  of_terms AS (SELECT c.doc_id, c.cand, sum(0.4 * CASE WHEN wants AND NOT held THEN 1 ELSE 0 END + 0.35 * CASE WHEN NOT wants AND held THEN 1 ELSE 0 END) AS loss FROM (SELECT c.doc_id, c.cand, x.wants, {_has('c.target', 'x.t')} AS held FROM cands c JOIN (SELECT DISTINCT doc_id, true AS wants, lower(target_term) AS t FROM own_terms UNION ALL SELECT DISTINCT doc_id, false, lower(term) FROM own_terms WHERE lower(term) <> lower(target_term)) x ON x.doc_id = c.doc_id) c GROUP BY ALL),
  of_tm AS (SELECT c.doc_id, c.cand, sum(CASE WHEN {_has('c.target', 'm.t')} THEN 0 ELSE 0.2 END) AS loss FROM cands c JOIN (SELECT DISTINCT doc_id, lower(target_term) AS t FROM tm_hits JOIN tm USING (tm_id) WHERE locked) m ON m.doc_id = c.doc_id GROUP BY ALL),
  of_names AS (SELECT doc_id, cand, sum(CASE WHEN there > 0 AND there < n THEN 0.15 ELSE 0 END) AS loss FROM (SELECT c.doc_id, c.cand, len(p) AS n, len(list_filter(p, lambda x: contains(lower(c.target), x))) AS there FROM cands c JOIN (SELECT DISTINCT h.doc_id, k.character_id, list_filter(string_split(lower(name), ' '), lambda x: length(x) > 2) AS p FROM hits h JOIN characters k ON k.character_id = h.id WHERE h.side = 's' AND h.what IN ('name', 'nick') AND contains(k.name, ' ')) y ON y.doc_id = c.doc_id) z GROUP BY ALL),
  scored0 AS (SELECT s.doc_id, s.cand, source, target,
    CASE WHEN source = '' THEN 1e0 ELSE {_CUT.format("1 - CASE WHEN length(target) < 0.4 * greatest(1, length(source)) THEN 0.4 WHEN length(target) > 2.5 * greatest(1, length(source)) THEN 0.3 ELSE 0 END - least(0.3, 0.15 * len(list_filter(sn, lambda x: NOT list_contains(tn, x)))) - CASE WHEN contains(source, chr(63)) AND NOT contains(target, chr(63)) THEN 0.1 ELSE 0 END - CASE WHEN contains(source, '!') AND NOT contains(target, '!') THEN 0.1 ELSE 0 END - least(0.4, 0.15 * len(list_filter(list_distinct(words), lambda x: x IN ('the', 'and', 'with', 'from', 'that', 'this', 'because'))))")} END AS fidelity,
    CASE WHEN len(w) = 0 THEN 0e0 ELSE {_CUT.format("1 - 0.25 * len(list_filter(generate_series(1, len(w) - 1), lambda i: w[i] = w[i + 1] AND length(w[i]) > 1)) - CASE WHEN len(list_filter(generate_series(1, len(w) - 3), lambda i: w[i] = w[i + 2] AND w[i + 1] = w[i + 3])) > 0 THEN 0.35 ELSE 0 END - CASE WHEN regexp_matches(target, ',@s*,|@.@s*@.@s*@.') THEN 0.15 ELSE 0 END".replace('@', chr(92)))} END AS naturalness,
    {_CUT.format("1 - coalesce(t.loss, 0)")} AS terminology, {_CUT.format("1 - coalesce(m.loss, 0)")} AS consistency, {_CUT.format("1 - coalesce(n.loss, 0)")} AS character_score,
    {_CUT.format("1 - CASE WHEN substr(tt, 1, 1) IN (chr(34), chr(39)) THEN 0.15 ELSE 0 END + CASE WHEN substr(tt, 1, 1) = '—' OR substr(tt, 1, 2) = '- ' THEN 0.05 ELSE 0 END")} AS style,
    CASE WHEN tt = '' THEN 0e0 ELSE {_CUT.format("1 - CASE WHEN regexp_matches(tt, '( de| com| em| para| por| sob| sobre|,)$') THEN 0.3 ELSE 0 END - CASE WHEN len(string_split(target, '(')) <> len(string_split(target, ')')) THEN 0.2 ELSE 0 END - CASE WHEN len(string_split(target, '[')) <> len(string_split(target, ']')) THEN 0.2 ELSE 0 END")} END AS fluency
    FROM split s LEFT JOIN of_terms t ON t.doc_id = s.doc_id AND t.cand = s.cand LEFT JOIN of_tm m ON m.doc_id = s.doc_id AND m.cand = s.cand LEFT JOIN of_names n ON n.doc_id = s.doc_id AND n.cand = s.cand),
  scored AS (SELECT *, round(0.25 * fidelity + 0.15 * naturalness + 0.2 * terminology + 0.15 * consistency + 0.1 * character_score + 0.08 * style + 0.07 * fluency, 6) AS final_score FROM scored0)"""

LINES_SQL = """lines AS (
  SELECT doc_id, lang, source, CAST(i AS INTEGER) AS line_no, l[i] AS line FROM (
    SELECT doc_id, lang, source, string_split(text, chr(10)) AS l, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL))"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, line_no, line) of documents, line_no from 1."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).select("doc_id", "lang", "source", (F.col("p") + 1).alias("line_no"), "line")
