"""Queries of context retrieval, with SQL of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.regex import WORD
from lexloom.operators import context as ctx
from lexloom.plans import fixtures as fx
from lexloom.plans.fixtures import CHARACTERS_SQL, GLOSSARY_SQL, HITS_SQL, PAIRS_SQL, TM_HITS_SQL, TM_SQL
from lexloom.session import table


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs' sources as segments of chapters."""
    return fx.pairs(spark, sf_dir).where("source IS NOT NULL").select("doc_id", "chapter", "seq", F.col("source").alias("text"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact of each document."""
    polarity = F.when(F.col("doc_id") % 3 == 0, "never ").otherwise("always ")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fact_id"), F.concat(polarity, F.coalesce("source", F.lit("")), F.lit(" house road")).alias("statement"), (F.col("doc_id") % 500 == 0).alias("locked"))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored glossary terms of every segment."""
    hits = fx.hits(spark, sf_dir).where("side = 's' AND what IN ('term', 'alias')").select("doc_id", "chapter", "seq", F.col("id").alias("term_id")).distinct()
    return ctx.scored_terms(hits, fx.glossary(spark), ctx.BALANCED.before)


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of every segment: 0.98 by name, 0.92 by a nickname."""
    hits = fx.hits(spark, sf_dir).where("side = 's' AND what IN ('name', 'nick') AND length(word) >= 2")
    return hits.groupBy("doc_id", "chapter", "seq", F.col("id").alias("character_id")).agg(F.max(F.when(F.col("what") == "name", 0.98).otherwise(0.92)).alias("score"))


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored memory entries of every segment, of confidence 0.5 or more."""
    entries = fx.tm(spark, sf_dir).where("confidence >= 0.5").select("tm_id", "locked", "confidence", "source_term")
    rows = fx.tm_hits(spark, sf_dir).join(entries, "tm_id").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    whole = F.lower(F.trim("source_term")) == F.lower(F.trim("text"))
    score = F.when(F.col("locked"), 1.0).when(whole, 0.98).otherwise(F.least(F.lit(0.95), 0.70 + 0.25 * F.col("confidence")))
    return rows.select("doc_id", "tm_id", "locked", F.round(score, 6).alias("score"))


def items(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    """The contexts of all segments under a strategy."""
    return ctx.retrieve(segments(spark, sf_dir), ctx.STRATEGIES[strategy], terms=terms(spark, sf_dir), mentions=named(spark, sf_dir), tm=memory(spark, sf_dir), facts=facts(spark, sf_dir))


def _strategy(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return items(spark, sf_dir, name).groupBy("doc_id", "category").agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("score"), F.sum("tokens").alias("tokens"))

    query.__doc__ = f"Items, mean score and tokens by category under the strategy {name}."
    return query


def ctx_budget_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a balanced context of 800 tokens keeps of its passages, facts and neighbours."""
    pruned = ctx.prune(items(spark, sf_dir, "balanced"))
    return pruned.where(F.col("category").isin(*ctx.GIVEN_UP)).select("doc_id", "category", "item_id", "tokens", "kept")


def ctx_repro_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of each balanced context after the budget."""
    return ctx.fingerprint(ctx.prune(items(spark, sf_dir, "balanced")).where("kept"))


def ctx_compact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of the characters and terms of each segment."""
    people = named(spark, sf_dir).join(F.broadcast(fx.characters(spark)), "character_id").select("doc_id", F.lit(1).alias("k"), F.col("name").alias("word"))
    words = terms(spark, sf_dir).join(F.broadcast(fx.glossary(spark).drop("locked")), "term_id").select("doc_id", F.lit(2).alias("k"), F.concat_ws(" -> ", "term", "target_term").alias("word"))
    lists = people.unionByName(words).groupBy("doc_id", "k").agg(F.array_join(F.sort_array(F.collect_set("word")), ", ").alias("words"))
    line = F.concat(F.lit("["), F.when(F.col("k") == 1, "Personagens: ").otherwise("Glossário: "), "words", F.lit("]"))
    return lists.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", line.alias("line")))), lambda x: x["line"]), " ").alias("summary"))


def ctx_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two segments before and the one behind, with their tokens."""
    return ctx.neighbours(segments(spark, sf_dir), 2, 1).select("doc_id", "category", "item_id", "place", "tokens")


def ctx_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters in a segment: by name, else by nickname."""
    return named(spark, sf_dir).select("doc_id", "character_id", "score")


def ctx_pronoun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that a pronoun may stand for, from the two segments before."""
    return ctx.pronoun_referents(segments(spark, sf_dir), named(spark, sf_dir).select("chapter", "seq", "character_id"), fx.characters(spark), ctx.BALANCED.before)


def ctx_glossary_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a segment, scored by lock and by their use in the segments before."""
    return terms(spark, sf_dir)


def ctx_tm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory entries by lock, equality and confidence."""
    return memory(spark, sf_dir).select("doc_id", "tm_id", "score")


def ctx_relevant_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five facts that are locked or share a word with the segment."""
    return ctx.relevant_facts(segments(spark, sf_dir), facts(spark, sf_dir), 5).select("doc_id", "item_id", "score", "place")


def ctx_similar_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most similar earlier segments of the chapter."""
    return ctx.similar_passages(segments(spark, sf_dir), 0.15, 3).select("doc_id", "item_id", "score", "shared")


def ctx_semantic_dense_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six most similar from 0.10 on."""
    return ctx.similar_passages(segments(spark, sf_dir), 0.10, 6).select("doc_id", "item_id", "score")


def ctx_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content words of each text."""
    words = segments(spark, sf_dir).select("doc_id", ctx.content_words(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("tokens"), F.size(F.array_distinct("w")).cast("long").alias("types")).where("tokens > 0")


QUERIES = {f"ctx_{k}": _strategy(k) for k in ("balanced", "minimal", "story_heavy")} | {"ctx_semantic_dense": ctx_semantic_dense_passages}
QUERIES |= {f.__name__: f for f in (ctx_budget_prune, ctx_repro_hash, ctx_compact_summary, ctx_neighbours, ctx_alias, ctx_pronoun, ctx_glossary_score, ctx_tm_score, ctx_relevant_fact, ctx_similar_passages, ctx_tokenize)}


_STOP = "(" + ", ".join(f"'{w}'" for w in ctx.STOPWORDS) + ")"
_SEG = f"WITH {PAIRS_SQL}, seg AS (SELECT doc_id, chapter, seq, source AS text, CAST(CASE WHEN length(source) = 0 THEN 0 ELSE greatest(1, length(source) // 4) END AS BIGINT) AS tokens FROM pairs WHERE source IS NOT NULL)"
_HITS = f"{GLOSSARY_SQL}, {CHARACTERS_SQL}, {HITS_SQL}"
_TERMS = f"""{_HITS}, of_terms AS (SELECT DISTINCT doc_id, chapter, seq, id FROM hits WHERE side = 's' AND what IN ('term', 'alias')),
  terms AS (SELECT doc_id, id AS term_id, locked, round(CASE WHEN locked THEN 1 ELSE least(0.95, 0.75 + 0.05 * (SELECT count(*) FROM of_terms b WHERE b.chapter = a.chapter AND b.id = a.id AND b.seq BETWEEN a.seq - 2 AND a.seq - 1)) END, 6) AS score FROM of_terms a JOIN glossary ON term_id = id),
  named AS (SELECT doc_id, chapter, seq, id AS character_id, CASE WHEN bool_or(what = 'name') THEN 0.98 ELSE 0.92 END AS score FROM hits WHERE side = 's' AND what IN ('name', 'nick') AND length(word) >= 2 GROUP BY ALL)"""
_TM = f"""{TM_SQL}, {TM_HITS_SQL}, of_tm AS (SELECT h.doc_id, h.tm_id, locked, round(CASE WHEN locked THEN 1 WHEN lower(trim(source_term)) = lower(trim(text)) THEN 0.98 ELSE least(0.95, 0.7 + 0.25 * confidence) END, 6) AS score FROM tm_hits h JOIN tm USING (tm_id) JOIN documents d ON d.doc_id = h.doc_id WHERE confidence >= 0.5)"""
_NEAR = """near AS (SELECT a.doc_id, CASE WHEN b.seq < a.seq THEN 'preceding' ELSE 'succeeding' END AS category, CAST(b.doc_id AS VARCHAR) AS item_id, CASE WHEN b.seq < a.seq THEN 0.9 ELSE 0.5 END AS score, b.tokens, false AS locked, b.pos - a.pos AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY seq, doc_id) AS pos FROM seg) a JOIN (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY seq, doc_id) AS pos FROM seg) b ON a.chapter = b.chapter AND b.pos BETWEEN a.pos - 2 AND a.pos + 1 AND b.pos <> a.pos)"""
_SIMILAR = f"""tf AS (SELECT doc_id, chapter, seq, w, count(*) AS c FROM (SELECT doc_id, chapter, seq, unnest(regexp_extract_all(lower(text), '{WORD}{{3,}}')) AS w FROM seg) WHERE w NOT IN {_STOP} GROUP BY ALL), size AS (SELECT doc_id, sqrt(sum(c * c)) AS s FROM tf GROUP BY doc_id),
  cosine AS (SELECT a.doc_id, b.doc_id AS other, round(sum(a.c * b.c) / (max(x.s) * max(y.s)), 9) AS score, count(*) AS shared FROM tf a JOIN tf b ON a.w = b.w AND a.chapter = b.chapter AND b.seq < a.seq JOIN size x ON x.doc_id = a.doc_id JOIN size y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id),
  passages AS (SELECT c.doc_id, other, c.score, shared, tokens, row_number() OVER (PARTITION BY c.doc_id ORDER BY c.score DESC, other) AS place FROM cosine c JOIN seg s ON s.doc_id = other)"""
_FACTS = f"""facts AS (SELECT doc_id AS fact_id, concat(CASE WHEN doc_id % 3 = 0 THEN 'never ' ELSE 'always ' END, coalesce(source, ''), ' house road') AS statement, doc_id % 500 = 0 AS locked FROM documents),
  fact_words AS (SELECT *, list_filter(string_split(lower(statement), ' '), lambda w: length(w) > 4) AS fw FROM facts), seg_words AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '{WORD}{{5,}}')) AS sw FROM seg),
  of_facts AS (SELECT doc_id, fact_id, statement, locked, row_number() OVER (PARTITION BY doc_id ORDER BY fact_id) AS place FROM seg_words JOIN fact_words ON locked OR list_has_any(sw, fw))"""


def _items(before: int, n_terms: int, only_locked: bool, passages: int, least: float, tm: int, n_facts: int, characters: int) -> str:
    top = lambda source, kind, item, locked, most, where="true": f"SELECT doc_id, '{kind}' AS category, CAST({item} AS VARCHAR) AS item_id, score, 0 AS tokens, {locked} AS locked, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, {item}) AS place FROM {source} WHERE {where}) WHERE place <= {most}"
    parts = [f"SELECT * FROM near WHERE place BETWEEN {-before} AND -1", top("terms", "glossary", "term_id", "locked", n_terms, "locked" if only_locked else "true"), top("named", "character", "character_id", "false", characters)]
    if tm:
        parts.append(top("of_tm", "tm", "tm_id", "locked", tm))
    if passages:
        parts.append(f"SELECT doc_id, 'semantic', CAST(other AS VARCHAR), round(score, 3), tokens, false, place FROM passages WHERE score >= {least} AND place <= {passages}")
    if n_facts:
        parts.append(f"SELECT doc_id, 'fact', CAST(fact_id AS VARCHAR), CASE WHEN locked THEN 0.95 ELSE 0.75 END, greatest(1, length(statement) // 4), locked, place FROM of_facts WHERE place <= {n_facts}")
    return "items AS (" + " UNION ALL ".join(parts) + ")"


_ALL = f"{_SEG}, {_TERMS}, {_TM}, {_NEAR}, {_SIMILAR}, {_FACTS}, "
_BALANCED = _ALL + _items(2, 10, False, 3, 0.15, 5, 5, 6)
_BY = " SELECT doc_id, category, count(*) AS n, round(avg(score), 5) AS score, CAST(sum(tokens) AS BIGINT) AS tokens FROM items GROUP BY doc_id, category"
_PRUNED = _BALANCED + """, ordered AS (SELECT *, CASE WHEN locked OR category = 'preceding' AND place = -1 THEN NULL WHEN category = 'semantic' THEN 1 WHEN category = 'fact' THEN 2 WHEN category = 'succeeding' THEN 3 WHEN category = 'preceding' THEN 4 END AS rank, CASE WHEN category = 'preceding' THEN place ELSE -place END AS within FROM items),
  pruned AS (SELECT *, rank IS NULL OR (SELECT sum(tokens) FROM items i WHERE i.doc_id = o.doc_id) - coalesce((SELECT sum(b.tokens) FROM ordered b WHERE b.doc_id = o.doc_id AND (b.rank < o.rank OR b.rank = o.rank AND b.within < o.within)), 0) <= 800 AS kept FROM ordered o)"""
_P = {g: "'" + "', '".join(w.split()) + "'" for g, w in ctx.PRONOUNS.items()}
ORACLES = {
    "ctx_balanced": _BALANCED + _BY,
    "ctx_minimal": _ALL + _items(1, 1 << 30, True, 0, 0, 0, 0, 1 << 30) + _BY,
    "ctx_story_heavy": _ALL + _items(2, 10, False, 3, 0.15, 5, 10, 6) + _BY,
    "ctx_semantic_dense": f"{_SEG}, {_SIMILAR} SELECT doc_id, CAST(other AS VARCHAR) AS item_id, round(score, 3) AS score FROM passages WHERE score >= 0.1 AND place <= 6",
    "ctx_similar_passages": f"{_SEG}, {_SIMILAR} SELECT doc_id, CAST(other AS VARCHAR) AS item_id, round(score, 3) AS score, shared FROM passages WHERE score >= 0.15 AND place <= 3",
    "ctx_budget_prune": _PRUNED + " SELECT doc_id, category, item_id, CAST(tokens AS BIGINT) AS tokens, kept FROM pruned WHERE category IN ('semantic', 'fact', 'succeeding', 'preceding')",
    "ctx_repro_hash": _PRUNED + ", one AS (SELECT doc_id, concat(category, '|', item_id, '|', CAST(CAST(round(score, 4) AS DECIMAL(6, 4)) AS VARCHAR)) AS x FROM pruned WHERE kept) SELECT doc_id, substr(sha256(string_agg(x, ';' ORDER BY x)), 1, 16) AS h FROM one GROUP BY doc_id",
    "ctx_compact_summary": f"{_SEG}, {_TERMS}, words AS (SELECT DISTINCT doc_id, 1 AS k, name AS w FROM named JOIN characters USING (character_id) UNION ALL SELECT DISTINCT doc_id, 2, concat(term, ' -> ', target_term) FROM terms JOIN glossary USING (term_id)), per AS (SELECT doc_id, k, concat('[', CASE k WHEN 1 THEN 'Personagens: ' ELSE 'Glossário: ' END, string_agg(w, ', ' ORDER BY w), ']') AS line FROM words GROUP BY doc_id, k) SELECT doc_id, string_agg(line, ' ' ORDER BY k) AS summary FROM per GROUP BY doc_id",
    "ctx_neighbours": f"{_SEG}, {_NEAR} SELECT doc_id, category, item_id, place, tokens FROM near",
    "ctx_alias": f"{_SEG}, {_TERMS} SELECT doc_id, character_id, CAST(score AS DOUBLE) AS score FROM named",
    "ctx_pronoun": f"{_SEG}, {_TERMS}, said AS (SELECT doc_id, chapter, seq, regexp_extract_all(lower(text), '{WORD}+') AS w FROM seg) SELECT a.doc_id, n.character_id, CAST(round(greatest(0.65, 0.95 - 0.1 * (min(a.seq - n.seq) - 1)), 6) AS DOUBLE) AS score FROM said a JOIN named n ON n.chapter = a.chapter AND n.seq BETWEEN a.seq - 2 AND a.seq - 1 JOIN characters c ON c.character_id = n.character_id WHERE list_has_any(w, [{_P['neutral']}]) OR list_has_any(w, [{_P['male']}]) AND gender <> 'female' OR list_has_any(w, [{_P['female']}]) AND gender <> 'male' GROUP BY a.doc_id, n.character_id",
    "ctx_glossary_score": f"{_SEG}, {_TERMS} SELECT doc_id, term_id, locked, CAST(score AS DOUBLE) AS score FROM terms",
    "ctx_tm_score": f"WITH {_TM} SELECT doc_id, tm_id, CAST(score AS DOUBLE) AS score FROM of_tm",
    "ctx_relevant_fact": f"{_SEG}, {_FACTS} SELECT doc_id, CAST(fact_id AS VARCHAR) AS item_id, CAST(CASE WHEN locked THEN 0.95 ELSE 0.75 END AS DOUBLE) AS score, place FROM of_facts WHERE place <= 5",
    "ctx_tokenize": f"{_SEG}, {_SIMILAR} SELECT doc_id, CAST(sum(c) AS BIGINT) AS tokens, count(*) AS types FROM tf GROUP BY doc_id",
}
