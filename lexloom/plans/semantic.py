"""Queries of the semantic checks, with SQL of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.regex import NON_WORD, WORD, any_of
from lexloom.operators import semantic as sem
from lexloom.plans.fixtures import PAIRS_SQL, lit, pairs, values
from lexloom.session import table

#: The level of formality that sem_register checks against.
FORMAL = "muito formal"


def _evaluated(spark: SparkSession, sf_dir: str, formality: str | None = None) -> DataFrame:
    return sem.evaluate(pairs(spark, sf_dir), formality=formality)


def _issues(check: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _evaluated(spark, sf_dir, FORMAL).select("doc_id", F.explode("issues").alias("i"))
        return rows.where(F.col("i.check").isin(*check.split("|"))).select("doc_id", "i.check", "i.severity", "i.found", "i.fix")

    query.__doc__ = f"Issues of the kinds {check}."
    return query


def sem_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair's similarity, and whether it is too small."""
    rows = _evaluated(spark, sf_dir)
    return rows.select("doc_id", F.round("embedding", 5).alias("similarity"), F.exists("issues", lambda x: x["check"] == "semantic_divergence").alias("divergent"))


def sem_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the texts: the entries that are not zero."""
    rows = sem.encode(table(spark, sf_dir, "documents").where("text IS NOT NULL")).select("doc_id", F.posexplode("vector").alias("place", "weight"))
    return rows.where("weight > 0").select("doc_id", "place", F.round("weight", 6).alias("weight"))


def sem_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six signals, their weighted score and whether the pair passes."""
    signals = [F.round(k, 4).alias(k) for k in sem.WEIGHTS if k != "embedding"]
    return _evaluated(spark, sf_dir).select("doc_id", *signals, F.round("overall", 3).alias("overall"), "passed")


def qa_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that pass the semantic checks and their issues, by chapter."""
    rows = _evaluated(spark, sf_dir)
    return rows.groupBy("chapter").agg(F.sum(F.col("passed").cast("long")).alias("passed"), F.count("*").alias("n"), F.sum(F.size("issues")).alias("issues"))


CHECKS = {
    "sem_omission_addition": "semantic_omission|semantic_addition", "sem_antonym": "meaning_reversal", "sem_polarity": "polarity_inversion", "sem_subject": "subject_shift",
    "sem_intensity": "intensity_loss", "sem_false_friend": "problematic_literal_translation", "sem_register": "relationship_shift",
}
QUERIES = {k: _issues(c) for k, c in CHECKS.items()} | {f.__name__: f for f in (sem_divergence, sem_encode, sem_overall, qa_unified)}


# The same in DuckDB: sides as rows, tables of words joined, bins counted.
_ANCHORS = values([(k, w) for k, (en, pt) in enumerate(sem.ANCHORS.items()) for w in (en, *pt.split())], "k, w")
_W = lambda t, p: f"regexp_matches({t}, concat({lit(f'(?:^|{NON_WORD})(?:')}, {p}, {lit(f')(?:$|{NON_WORD})')}))"
_TABLES = {
    "friends": values([(k, en, any_of([en]), pt, fix) for k, (en, (pt, fix)) in enumerate(sem.FALSE_FRIENDS.items())], "k, en, whole, pt, fix"),
    "strong": values([(k, en, any_of([en]), pt, fix) for k, (en, (pt, fix)) in enumerate(sem.INTENSITY.items())], "k, en, whole, pt, fix"),
    "opposites": values([(k, a, b) for k, (a, b) in enumerate(sem.ANTONYMS)], "k, en, pt"),
    "informal": values(list(enumerate(sem.INFORMAL)), "k, w"),
}
_VECTOR = f"""
  bins AS (SELECT id, place, count(*) * 1.0 AS v FROM (SELECT id, unicode(unnest(regexp_extract_all(low, '(?s:.)'))) % {sem.BINS} AS place FROM sides) GROUP BY id, place),
  anchors AS (SELECT DISTINCT id, {sem.BINS} + k AS place, {sem.ANCHOR_WEIGHT} AS v FROM (SELECT id, unnest(regexp_extract_all(low, '{WORD}+')) AS word FROM sides) JOIN {_ANCHORS} a ON word = w),
  raw AS (SELECT * FROM bins UNION ALL SELECT * FROM anchors), unit AS (SELECT id, place, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM raw)"""
_SAY = lambda t, p: f"regexp_extract({t}, {lit(p)}, 1)"
_EN = rf"(?:^|{NON_WORD})([A-Z][a-z]+)\s+(?:{sem.SPEECH_EN})(?:$|{NON_WORD})"
_PT1, _PT2 = rf"(?:^|{NON_WORD})([A-Z][a-z]+)\s+(?:{sem.SPEECH_PT})(?:$|{NON_WORD})", rf"(?:^|{NON_WORD})(?:{sem.SPEECH_PT})\s+([A-Z][a-z]+)(?:$|{NON_WORD})"


def _listed(name: str, words, check: str) -> str:
    return f"SELECT doc_id, '{check}' AS check, 'suggested_fix' AS severity, min_by(en, k) AS found, min_by(fix, k) AS fix FROM (SELECT * FROM trimmed WHERE regexp_matches(low, {lit(any_of(words))})) x, {_TABLES[name]} f WHERE contains(low, en) AND regexp_matches(low, whole) AND {_W('pt_low', 'pt')} GROUP BY doc_id"


_FOUND = f"""
  trimmed AS (SELECT *, lower(s) AS low, lower(t) AS pt_low FROM (SELECT doc_id, chapter, regexp_replace(source, '^\\s+|\\s+$', '', 'g') AS s, regexp_replace(target, '^\\s+|\\s+$', '', 'g') AS t FROM pairs)),
  counted AS (SELECT *, len(regexp_extract_all(s, '{WORD}{{3,}}')) AS n, len(regexp_extract_all(t, '{WORD}{{3,}}')) AS m, len(regexp_extract_all(s, '\\S+')) AS words FROM trimmed),
  agents AS (SELECT doc_id, lower({_SAY('s', _EN)}) AS a, lower(CASE WHEN {_SAY('t', _PT1)} <> '' THEN {_SAY('t', _PT1)} ELSE {_SAY('t', _PT2)} END) AS b, low, pt_low FROM trimmed),
  reversals AS (SELECT doc_id, min_by(en, k) AS en FROM (SELECT * FROM trimmed WHERE {_W('pt_low', lit('|'.join(b for _, b in sem.ANTONYMS)))}) x, {_TABLES['opposites']} o WHERE {_W('low', 'en')} AND {_W('pt_low', 'pt')} GROUP BY doc_id),
  found AS NOT MATERIALIZED (
    SELECT doc_id, CASE WHEN m < 0.4 * n THEN 'semantic_omission' ELSE 'semantic_addition' END AS check, 'review_required' AS severity, concat(m, '/', n) AS found, NULL AS fix FROM counted WHERE n >= 6 AND m < 0.4 * n OR n >= 4 AND m > 2.2 * n
    UNION ALL SELECT doc_id, 'meaning_reversal', 'review_required', regexp_extract(low, concat({lit(f'(?:^|{NON_WORD})(')}, en, {lit(f')(?:$|{NON_WORD})')}), 1), NULL FROM reversals JOIN trimmed USING (doc_id)
    UNION ALL SELECT doc_id, 'polarity_inversion', 'review_required', substr(s, 1, 50), NULL FROM counted WHERE words <= 15 AND {_W('low', lit(sem.NEGATED_EN))} <> {_W('pt_low', lit(sem.NEGATED_PT))} AND doc_id NOT IN (SELECT doc_id FROM reversals)
    UNION ALL SELECT doc_id, 'subject_shift', 'review_required', b, a FROM agents WHERE a <> '' AND b <> '' AND NOT starts_with(a, b) AND NOT starts_with(b, a)
    UNION ALL SELECT doc_id, 'subject_shift', 'review_required', regexp_extract(low, '^[a-z]+'), CASE WHEN starts_with(pt_low, 'ela') THEN 'ele' ELSE 'ela' END FROM agents
      WHERE NOT (a <> '' AND b <> '' AND NOT starts_with(a, b) AND NOT starts_with(b, a)) AND (regexp_matches(low, {lit(f'^he($|{NON_WORD})')}) AND regexp_matches(pt_low, {lit(f'^ela($|{NON_WORD})')}) OR regexp_matches(low, {lit(f'^she($|{NON_WORD})')}) AND regexp_matches(pt_low, {lit(f'^ele($|{NON_WORD})')}))
    UNION ALL {_listed('strong', sem.INTENSITY, 'intensity_loss')} UNION ALL {_listed('friends', sem.FALSE_FRIENDS, 'problematic_literal_translation')}
    UNION ALL SELECT doc_id, 'relationship_shift', 'review_required', min_by(w, k), NULL FROM trimmed, {_TABLES['informal']} w WHERE contains(pt_low, w) AND {_W('pt_low', 'w')} GROUP BY doc_id)"""
_SIMILAR = f"""
  sides AS (SELECT concat(doc_id, 's') AS id, low FROM trimmed UNION ALL SELECT concat(doc_id, 't'), pt_low FROM trimmed),{_VECTOR},
  near AS (SELECT p.doc_id, p.chapter, coalesce(least(1, sum(a.v * b.v)), 0) AS similarity, max(p.words) AS words FROM counted p LEFT JOIN unit a ON a.id = concat(p.doc_id, 's') LEFT JOIN unit b ON b.id = concat(p.doc_id, 't') AND b.place = a.place GROUP BY p.doc_id, p.chapter)"""
_SIGNALS = """
  signals AS (SELECT n.doc_id, n.chapter, similarity, CASE WHEN similarity < 0.55 AND words > 3 THEN 1 ELSE 0 END AS far, coalesce(min(CASE "check" WHEN 'semantic_omission' THEN 0.4 WHEN 'semantic_addition' THEN 0.5 END), 1) AS content, coalesce(min(CASE "check" WHEN 'meaning_reversal' THEN 0.2 WHEN 'polarity_inversion' THEN 0.3 END), 1) AS polarity,
    coalesce(min(CASE WHEN "check" = 'subject_shift' THEN CASE WHEN found IN ('he', 'she') THEN 0.4 ELSE 0.3 END END), 1) AS subject, coalesce(min(CASE "check" WHEN 'intensity_loss' THEN 0.6 END), 1) AS intensity, coalesce(min(CASE "check" WHEN 'problematic_literal_translation' THEN 0.5 END), 1) AS literal, count(*) FILTER ("check" IS NOT NULL) AS issues,
    count(*) FILTER (severity = 'review_required') AS blocking FROM near n LEFT JOIN (SELECT * FROM found WHERE "check" <> 'relationship_shift') f ON f.doc_id = n.doc_id GROUP BY ALL),
  judged AS (SELECT *, round(0.25 * similarity + 0.2 * subject + 0.2 * polarity + 0.15 * content + 0.1 * intensity + 0.1 * literal, 4) AS score FROM signals)"""
_START = f"WITH {PAIRS_SQL},{_FOUND}"
ORACLES = {k: f'{_START} SELECT doc_id, "check", severity, found, fix FROM found WHERE "check" IN ({', '.join(map(lit, c.split("|")))})' for k, c in CHECKS.items()}
ORACLES |= {
    "sem_divergence": f"{_START},{_SIMILAR} SELECT doc_id, round(similarity, 5) AS similarity, similarity < 0.55 AND words > 3 AS divergent FROM near",
    "sem_encode": f"WITH sides AS (SELECT doc_id AS id, lower(text) AS low FROM documents WHERE text IS NOT NULL),{_VECTOR} SELECT id AS doc_id, place, round(v, 6) AS weight FROM unit",
    "sem_overall": f"{_START},{_SIMILAR},{_SIGNALS} SELECT doc_id, CAST(content AS DOUBLE) AS content, CAST(polarity AS DOUBLE) AS polarity, CAST(subject AS DOUBLE) AS subject, CAST(intensity AS DOUBLE) AS intensity, CAST(literal AS DOUBLE) AS literal, round(score, 3) AS overall, score >= 0.7 AND blocking + far = 0 AS passed FROM judged",
    "qa_unified": f"{_START},{_SIMILAR},{_SIGNALS} SELECT chapter, CAST(sum(CASE WHEN score >= 0.7 AND blocking + far = 0 THEN 1 ELSE 0 END) AS BIGINT) AS passed, count(*) AS n, CAST(sum(issues + far) AS BIGINT) AS issues FROM judged GROUP BY chapter",
}
