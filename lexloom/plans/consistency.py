"""Queries of safe fixes and their undoing, and of back-translation, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.regex import NON_WORD, WORD
from lexloom.operators import backtranslation as bt
from lexloom.operators import consistency as cons
from lexloom.plans import dialect, misc
from lexloom.plans.fixtures import lit, pairs, rendered
from lexloom.session import materialise


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What makes the renderings of locked terms in conflict the same."""
    rows, _ = materialise(rendered(spark, sf_dir), "rendered")
    safe = cons.conflicts(rows).where("locked").select("term_id")
    return rows.join(F.broadcast(safe), "term_id").where("variant <> target_term").select("doc_id", F.col("term_id").alias("step"), F.col("variant").alias("old"), F.col("target_term").alias("new"))


def _fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cons.apply_fixes(pairs(spark, sf_dir).select("doc_id", "target"), changes(spark, sf_dir))


def cons_apply_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that safe fixes change, before and after."""
    return _fixed(spark, sf_dir).join(pairs(spark, sf_dir).select("doc_id", "target"), "doc_id").select("doc_id", F.md5("target").alias("old_md5"), F.md5("fixed").alias("new_md5"))


def cons_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same targets after their fixes are undone from the audits."""
    return cons.rollback(_fixed(spark, sf_dir)).select("doc_id", F.md5("restored").alias("restored_md5"))


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.verify(misc.translate(pairs(spark, sf_dir).select("doc_id", "source", "target"), "reverse", "target").withColumnRenamed("translated", "back"))


def bt_token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of the words of source and back-translation."""
    return _verified(spark, sf_dir).select("doc_id", F.round("f1", 6).alias("f1"))


def bt_chrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 of the character n-grams of one to four, all in one count."""
    return _verified(spark, sf_dir).select("doc_id", F.round("chrf", 6).alias("chrf"))


def bt_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negation, subject and length of back-translations."""
    return _verified(spark, sf_dir).select("doc_id", "negation_kept", "subject_kept", "short", "issue")


QUERIES = {f.__name__: f for f in (cons_apply_safe, cons_rollback, bt_token_f1, bt_chrf, bt_verify)}

_OLD, _NEW = "split_part(c, chr(1), 1)", "split_part(c, chr(1), 2)"
_REPLACE = f"""CASE WHEN regexp_matches(t, concat('(?is)(^|{NON_WORD})\\Q', {_OLD}, '\\E($|{NON_WORD})')) THEN regexp_replace(t, concat('(?is)^(.*?(?:^|{NON_WORD}))\\Q', {_OLD}, '\\E($|{NON_WORD})'), concat('\\1', {_NEW}, '\\2'))
  WHEN {_OLD} <> '' AND strpos(lower(t), lower({_OLD})) > 0 THEN concat(substr(t, 1, strpos(lower(t), lower({_OLD})) - 1), {_NEW}, substr(t, strpos(lower(t), lower({_OLD})) + length({_OLD}))) ELSE t END"""
_FIXED = f"""SELECT doc_id, target, list_reduce(list_concat([target], todo), lambda t, c: {_REPLACE}) AS fixed FROM (
  SELECT p.doc_id, any_value(p.target) AS target, list(concat(r.variant, chr(1), r.target_term) ORDER BY r.term_id) AS todo FROM pairs p JOIN rendered r ON r.doc_id = p.doc_id
  WHERE lower(trim(r.variant)) <> lower(trim(r.target_term)) AND r.term_id IN (SELECT term_id FROM rendered WHERE locked GROUP BY term_id HAVING count(DISTINCT variant) > 1) GROUP BY p.doc_id) x"""
_BACK = " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in misc.Reverse.words.items())
_SIDES = f"""SELECT doc_id, regexp_replace(source, '^\\s+|\\s+$', '', 'g') AS s, regexp_replace(array_to_string(list_transform(regexp_extract_all(target, '[A-Za-z]+|[^A-Za-z]+'), lambda x: CASE lower(x) {_BACK} ELSE x END), ''), '^\\s+|\\s+$', '', 'g') AS b FROM pairs"""


def _counts(what: str) -> str:
    return f"SELECT doc_id, sum(least(a, b)) AS common, sum(a) AS n, sum(b) AS m FROM (SELECT doc_id, g, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM (SELECT doc_id, 0 AS side, unnest({what.replace("{0}", 's')}) AS g FROM low UNION ALL SELECT doc_id, 1, unnest({what.replace("{0}", 'b')}) FROM low) GROUP BY doc_id, g) GROUP BY doc_id"


_GRAMS = "list_concat(" + ", ".join(f"list_transform(generate_series(1, length({{0}}) - {n - 1}), lambda i: substr({{0}}, i, {n}))" for n in range(1, 5)) + ")"
_LOW = f"low AS (SELECT doc_id, lower(s) AS s, lower(b) AS b FROM ({_SIDES}))"
_NEG = f"'(?:^|{NON_WORD})(?:{bt.NEGATED})(?:$|{NON_WORD})'".replace("\\\\", "\\")
_AGENT = "CASE " + " ".join(f"WHEN contains({{0}}, '{a}') THEN '{a}'" for a in bt.AGENTS) + " END"
_FIRST = f"regexp_extract({{0}}, '^[,.]*({WORD}+)[,.]*(?:\\s|$)', 1)"
_VERIFY = f"""SELECT doc_id, regexp_matches(s, {_NEG}) = regexp_matches(b, {_NEG}) AS negation_kept, NOT coalesce({_FIRST.replace("{0}", 's')} = 'he' AND {_FIRST.replace("{0}", 'b')} = 'she' OR {_FIRST.replace("{0}", 's')} = 'she' AND {_FIRST.replace("{0}", 'b')} = 'he', false) AND coalesce({_AGENT.replace("{0}", 's')} = {_AGENT.replace("{0}", 'b')}, true) AS subject_kept,
  len(regexp_extract_all(s, '\\S+')) >= 6 AND len(regexp_extract_all(b, '\\S+')) < 0.45 * len(regexp_extract_all(s, '\\S+')) AS short FROM low"""


def _with(sql: str, more: str = "") -> str:
    names = [n for n in dialect.used(sql + more) if n in dialect._CTES]
    ctes = [dialect._CTES[n] for n in names]
    return f"WITH {', '.join([*ctes, more] if more else ctes)} {sql}"


ORACLES = {
    "cons_apply_safe": _with(f"SELECT doc_id, md5(target) AS old_md5, md5(fixed) AS new_md5 FROM ({_FIXED}) WHERE fixed <> target"),
    "cons_rollback": _with(f"SELECT doc_id, md5(target) AS restored_md5 FROM ({_FIXED}) WHERE fixed <> target"),
    "bt_token_f1": _with(f"SELECT l.doc_id, round(coalesce(2 * common / (n + m), 0), 6) AS f1 FROM low l LEFT JOIN ({_counts(f'regexp_extract_all({{0}}, {lit(WORD + chr(43))})')}) c ON c.doc_id = l.doc_id", _LOW),
    "bt_chrf": _with(f"SELECT l.doc_id, round(CASE WHEN s = '' OR b = '' THEN 0 WHEN s = b THEN 1 WHEN common > 0 THEN 5 * (common / m) * (common / n) / (4 * (common / m) + common / n) ELSE 0 END, 6) AS chrf FROM low l LEFT JOIN ({_counts(_GRAMS)}) c ON c.doc_id = l.doc_id", _LOW),
    "bt_verify": _with(f"SELECT *, NOT negation_kept OR NOT subject_kept OR short AS issue FROM ({_VERIFY})", _LOW),
}
