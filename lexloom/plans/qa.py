"""Queries of the deterministic checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.regex import NON_WORD, WORD, any_of
from lexloom.operators import dictionaries as d
from lexloom.operators import qa
from lexloom.plans.fixtures import GLOSSARY_SQL, CHARACTERS_SQL, PAIRS_SQL, characters, glossary, lit, pairs, values



#: Checks that compare sizes: every fourth target is cut, doubled or runs on without a full stop.
SIZES = ("qa_structure", "qa_omission_dup")


def _rows(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir)
    if name not in SIZES:
        return rows
    t, k = F.col("target"), F.col("doc_id") % 4
    on = F.regexp_replace(F.substring(t, F.lit(1), F.floor(F.length(t) / 2).cast("int")), "[.!?]+", ",")
    return rows.withColumn("target", F.when(k == 1, F.substring(t, F.lit(1), F.floor(F.length(t) / 5).cast("int"))).when(k == 2, F.concat(t, F.lit(". "), t)).when(k == 3, on).otherwise(t))


def _simple(name, check):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return check(_rows(name, spark, sf_dir))

    query.__doc__ = check.__doc__
    return query


def qa_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the target lacks."""
    return qa.names(pairs(spark, sf_dir), characters(spark))


def qa_locked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locked terms that the target violates."""
    return qa.locked_terms(pairs(spark, sf_dir), glossary(spark))


CHECKS = {"qa_numbers": qa.numbers, "qa_years": qa.years, "qa_dates": qa.dates, "qa_months": qa.months, "qa_percent": qa.percents, "qa_currency": qa.currencies, "qa_measure": qa.measures, "qa_urls_emails": qa.links, "qa_footnotes": qa.footnotes, "qa_citations": qa.citations, "qa_polarity": qa.polarity, "qa_structure": qa.structure, "qa_omission_dup": qa.omission}


def qa_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of each pair over all checks that need no dictionary table."""
    return qa.report(pairs(spark, sf_dir), [c(_rows(k, spark, sf_dir)) for k, c in CHECKS.items()])


def qa_apply_safe_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets after the safe fixes, with what each step changed."""
    return qa.apply_safe_fixes(pairs(spark, sf_dir)).where(F.size("audits") > 0).select("doc_id", F.md5("fixed").alias("fixed_md5"), F.size("audits").alias("n_audits"))


QUERIES = {k: _simple(k, c) for k, c in CHECKS.items()} | {f.__name__: f for f in (qa_names, qa_locked_terms, qa_report, qa_apply_safe_fixes)}


def _issue(check: str, severity: str, found: str, fix: str, source: str) -> str:
    return f"SELECT doc_id, {lit(check)} AS check, {lit(severity)} AS severity, {found} AS found, {fix} AS fix FROM ({source})"


def _ex(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {lit(pattern)}, {group})"


def _nums(text: str) -> str:
    return f"list_filter({_ex(text, qa.NUMBER)}, lambda x: regexp_matches(x, '^[0-9]+([.,][0-9]+)*$'))"


def _years(text: str) -> str:
    return f"list_filter({_ex(text, WORD + '+')}, lambda x: regexp_matches(x, {lit('^' + qa.YEAR + '$')}))"


_SENT = r"list_filter(list_transform(string_split(regexp_replace({t}, '[.!?]+', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_NO = rf"(?:^|{NON_WORD})no\s+[\p{{L}}\p{{N}}_]"
_NEG_EN = f"(regexp_matches(lower(source), {lit(any_of(d.NEGATIONS_EN))}) OR regexp_matches(lower(source), {lit(_NO)}))"
_NEG_PT = f"regexp_matches(lower(target), {lit(any_of(d.NEGATIONS_PT))})"
_MONTHS = values(list(d.MONTHS.items()), "en, pt")
_UNITS = values(list(d.UNITS.items()), "en, pt")
_M = "|".join(d.MONTHS)
_EDGE = f"regexp_replace(lower(target), {lit(NON_WORD)}, ' ', 'g')"


def _has(text: str, term: str) -> str:
    quoted = f"regexp_replace(lower({term}), '([^\\p{{L}}\\p{{N}}_\\s])', '\\\\\\1', 'g')"
    return f"regexp_matches(lower({text}), concat({lit('(?:^|' + NON_WORD + ')(?:')}, {quoted}, {lit(')(?:$|' + NON_WORD + ')')}))"


BODY = {
    "qa_numbers": _issue("number_mismatch", qa.REVIEW, "found", "found", f"SELECT doc_id, unnest(list_filter({_nums('source')}, lambda x: NOT list_contains(list_transform({_nums('target')}, lambda y: regexp_replace(y, '[.,]', '', 'g')), regexp_replace(x, '[.,]', '', 'g')))) AS found FROM pairs"),
    "qa_years": _issue("date_mismatch", qa.REVIEW, "found", "found", f"SELECT DISTINCT doc_id, found FROM (SELECT doc_id, target, unnest({_years('source')}) AS found FROM pairs) WHERE NOT list_contains({_years('target')}, found)"),
    "qa_dates": _issue("date_mismatch", qa.REVIEW, "found", "fix", f"""
      SELECT doc_id, found, day || ' de ' || pt AS fix, target FROM (
        SELECT doc_id, target, found, regexp_extract(found, '[0-9]+') AS day, CASE WHEN regexp_matches(found, '^[a-z]') THEN regexp_extract(found, '^[a-z]+') ELSE regexp_extract(found, '[a-z]+$') END AS mon FROM (
          SELECT doc_id, target, unnest(list_concat({_ex('lower(source)', rf'(?:{_M})\s+[0-9]{{1,2}}')}, {_ex('lower(source)', rf'[0-9]{{1,2}}(?:st|nd|rd|th)?\s+of\s+(?:{_M})')})) AS found FROM pairs)) JOIN {_MONTHS} m ON mon = en
      WHERE NOT contains(concat(' ', {_EDGE}, ' '), concat(' ', day, ' de ', pt, ' '))"""),
    "qa_months": _issue("date_mismatch", qa.REVIEW, "en", "pt", f"SELECT doc_id, en, pt FROM pairs, {_MONTHS} m WHERE {_has('source', 'en')} AND NOT {_has('target', 'pt')}"),
    "qa_percent": _issue("percentage_mismatch", qa.REVIEW, "found", "concat(replace(found, '.', ','), '%')", f"SELECT doc_id, unnest(list_filter({_ex('lower(source)', qa.PERCENT, 1)}, lambda x: NOT list_contains({_ex('lower(target)', qa.PERCENT_PT, 1)}, x) AND NOT list_contains({_ex('lower(target)', qa.PERCENT_PT, 1)}, replace(x, '.', ',')))) AS found FROM pairs")
    + " UNION ALL " + _issue("percentage_mismatch", qa.SAFE, "found", r"regexp_replace(found, '\s+', '', 'g')", f"SELECT doc_id, unnest({_ex('target', r'[0-9]+\s+%')}) AS found FROM pairs"),
    "qa_currency": " UNION ALL ".join(
        _issue("currency_mismatch", qa.REVIEW, f"concat('{s}', a)", f"concat('{s}', a)", f"SELECT doc_id, target, a FROM (SELECT doc_id, target, unnest({_ex('source', '[' + s + r']\s*([0-9]+(?:[.,][0-9]+)?)', 1)}) AS a FROM pairs) WHERE " + (f"NOT contains(target, '{s}')" if s == "¥" else f"NOT (contains(target, concat('{s}', a)) OR contains(target, concat('{s} ', a)) OR contains(lower(target), concat(a, ' {w}')))"))
        for s, w in d.CURRENCIES.items()
    ),
    "qa_measure": f"""SELECT doc_id, 'measurement_mismatch' AS check, CASE WHEN contains(w, concat(' ', v, ' ', en)) THEN 'safe_fix' ELSE 'suggested_fix' END AS severity, concat_ws(' ', v, en) AS found, concat_ws(' ', v, pt) AS fix FROM (
      SELECT doc_id, en, pt, concat(' ', regexp_replace(lower(target), '[^\\p{{L}}\\p{{N}}_.,]+', ' ', 'g'), ' ') AS w, unnest(regexp_extract_all(lower(source), concat('([0-9]+(?:[.,][0-9]+)?)\\s+', en, {lit('(?:$|' + NON_WORD + ')')}), 1)) AS v FROM pairs, {_UNITS} u)
      WHERE contains(w, concat(' ', v, ' ', en)) OR NOT contains(w, concat(' ', v, ' ', pt))""",
    "qa_urls_emails": _issue("url_mismatch", qa.SAFE, "found", "found", f"SELECT doc_id, unnest(list_filter({_ex('source', qa.URL)}, lambda x: NOT contains(target, x))) AS found FROM pairs UNION ALL SELECT doc_id, unnest(list_filter({_ex('source', qa.EMAIL)}, lambda x: NOT contains(lower(target), lower(x)))) AS found FROM pairs"),
    "qa_footnotes": _issue("footnote_mismatch", qa.REVIEW, "found", "found", f"SELECT doc_id, unnest(list_filter({_ex('source', r'\[\^?[0-9]+\]')}, lambda x: NOT list_contains({_ex('target', r'\[\^?[0-9]+\]')}, x))) AS found FROM pairs"),
    "qa_citations": _issue("reference_mismatch", qa.REVIEW, "found", "found", f"SELECT doc_id, unnest(list_filter({_ex('source', r'\([A-Z][a-z]+,\s*[0-9]{4}\)')}, lambda x: NOT contains(target, x))) AS found FROM pairs"),
    "qa_polarity": f"SELECT doc_id, 'polarity_mismatch' AS check, 'review_required' AS severity, CASE WHEN {_NEG_EN} THEN 'source' ELSE 'target' END AS found, CAST(NULL AS VARCHAR) AS fix FROM pairs WHERE {_NEG_EN} <> {_NEG_PT}",
    "qa_structure": f"SELECT doc_id, 'structural_count_mismatch' AS check, 'review_required' AS severity, CAST(len({_SENT.format(t='source')}) AS VARCHAR) AS found, CAST(NULL AS VARCHAR) AS fix FROM pairs WHERE len({_SENT.format(t='source')}) >= 3 AND len({_SENT.format(t='target')}) = 1 AND length(target) < 0.6 * length(source)",
    "qa_omission_dup": f"""SELECT doc_id, 'omission_detected' AS check, 'review_required' AS severity, CAST(NULL AS VARCHAR) AS found, CAST(NULL AS VARCHAR) AS fix FROM pairs WHERE length(source) > 40 AND length(target) < 0.35 * length(source)
      UNION ALL SELECT doc_id, 'duplication_detected', 'suggested_fix', s[i], NULL FROM (SELECT doc_id, s, unnest(generate_series(1, len(s) - 1)) AS i FROM (SELECT doc_id, list_transform({_SENT.format(t='target')}, lambda x: lower(x)) AS s FROM pairs)) WHERE s[i] = s[i + 1] AND length(s[i]) >= 15""",
    "qa_names": """SELECT doc_id, 'proper_name_inconsistency' AS check, CASE WHEN near <> '' THEN 'suggested_fix' ELSE 'review_required' END AS severity, near AS found, name AS fix FROM (
      SELECT doc_id, target, name, regexp_extract(lower(target), concat(string_split(lower(name), ' ')[1], '\\s+[a-z]{3,}')) AS near FROM pairs, characters
      WHERE length(name) >= 3 AND HAS_NAME AND NOT contains(lower(target), lower(name))) WHERE near <> '' OR NOT contains(lower(target), string_split(lower(name), ' ')[-1])""",
    "qa_locked_terms": f"""SELECT doc_id, 'locked_term_violation' AS check, CASE WHEN left_in THEN 'safe_fix' ELSE 'review_required' END AS severity, term AS found, target_term AS fix FROM (
      SELECT doc_id, term, target_term, {_has('target', 'term')} AND lower(term) <> lower(target_term) AS left_in, {_has('target', 'target_term')} AS there FROM pairs, glossary WHERE locked AND {_has('source', 'term')}) WHERE left_in OR NOT there""",
}
BODY |= {k: BODY[k].replace("FROM pairs", "FROM sizes") for k in SIZES}
BODY["qa_names"] = BODY["qa_names"].replace("HAS_NAME", _has("source", "name"))
_WITH = f"WITH {PAIRS_SQL}, sizes AS (SELECT doc_id, source, CASE doc_id % 4 WHEN 1 THEN substr(target, 1, length(target) // 5) WHEN 2 THEN concat(target, '. ', target) WHEN 3 THEN regexp_replace(substr(target, 1, length(target) // 2), '[.!?]+', ',', 'g') ELSE target END AS target FROM pairs), {GLOSSARY_SQL}, {CHARACTERS_SQL} "
ORACLES = {k: _WITH + v for k, v in BODY.items()}
_EVERY = " UNION ALL ".join(f"SELECT doc_id, severity FROM ({BODY[k]})" for k in CHECKS)
ORACLES["qa_report"] = _WITH + f"SELECT p.doc_id, coalesce(n, 0) AS n_issues, coalesce(s, 0) AS n_safe, n IS NULL AS passed FROM pairs p LEFT JOIN (SELECT doc_id, count(*) AS n, CAST(sum(CASE WHEN severity = 'safe_fix' THEN 1 ELSE 0 END) AS BIGINT) AS s FROM ({_EVERY}) GROUP BY doc_id) i ON p.doc_id = i.doc_id"


def _fixes() -> str:
    """Safe fixes step by step: each step's text is a column of its own."""
    steps = [(r"([0-9])\s+%", r"\1%")] + [(rf"([0-9])\s+{e}($|[^\p{{L}}])", rf"\1 {p}\2") for e, p in d.UNITS.items()]
    sql = "SELECT doc_id, target AS t0 FROM pairs"
    for k, (pattern, new) in enumerate(steps, 1):
        sql = f"SELECT *, regexp_replace(t{k - 1}, {lit(pattern)}, {lit(new)}, 'g') AS t{k} FROM ({sql})"
    changed = " + ".join(f"CASE WHEN t{k} <> t{k - 1} THEN 1 ELSE 0 END" for k in range(1, len(steps) + 1))
    return f"SELECT doc_id, md5(t{len(steps)}) AS fixed_md5, {changed} AS n_audits FROM ({sql}) WHERE {changed} > 0"


ORACLES["qa_apply_safe_fixes"] = f"WITH {PAIRS_SQL} " + _fixes()
