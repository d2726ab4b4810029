"""Deterministic checks of sentence pairs.

Each takes rows with source and target and returns an issue for each finding: the keys, check, severity, found, fix.
Checks are projections and generators over one row, so they neither shuffle nor collect; severities are
safe_fix, suggested_fix and review_required.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.regex import NON_WORD, any_of, extract, has_term, has_word
from lexloom.operators import dictionaries as d
from lexloom.operators import matching

KEYS = ("doc_id",)
REVIEW, SAFE, SUGGESTED = "review_required", "safe_fix", "suggested_fix"
NUMBER = r"[\p{L}\p{N}_]+(?:[.,][0-9]+)*"
YEAR = "(?:1[7-9][0-9][0-9]|20[0-2][0-9])"
URL = r"(?:https?://|www\.)[^\s)\]]+"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"


def issues(df: DataFrame, check: str, severity: str | Column, found: Column, fix: Column, keys=KEYS) -> DataFrame:
    """An issue of each element of the array `found`; fix is an expression over the column `found`."""
    rows = df.select(*keys, "source", "target", F.explode(found).alias("found"))
    return rows.select(*keys, F.lit(check).alias("check"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), "found", fix.alias("fix"))


def dictionary_join(df: DataFrame, terms: DataFrame, text: str, term: str, most_bytes: int = matching.MOST_BYTES) -> DataFrame:
    """Rows of df with each term that their text holds as whole words, in either case.

    By matching.find_terms(): one pass of an automaton for a dictionary of at most most_bytes bytes, a join on tokens beyond it.
    """
    others = tuple(c for c in terms.columns if c != term)
    return matching.find_terms(df, terms, text, tuple(df.columns), others, term, most_bytes=most_bytes).withColumnRenamed("term", term).drop("starts")


def _numbers(text: str) -> Column:
    return F.filter(extract(F.col(text), NUMBER), lambda x: x.rlike(r"^[0-9]+(?:[.,][0-9]+)*$"))


def numbers(df: DataFrame, keys=KEYS) -> DataFrame:
    """Numbers of the source that the target lacks, separators aside; each occurrence counts."""
    plain = F.transform(_numbers("target"), lambda x: F.regexp_replace(x, "[.,]", ""))
    lost = F.filter(_numbers("source"), lambda x: ~F.array_contains(plain, F.regexp_replace(x, "[.,]", "")))
    return issues(df, "number_mismatch", REVIEW, lost, F.col("found"), keys)


def _years(text: str) -> Column:
    return F.filter(extract(F.col(text), r"[\p{L}\p{N}_]+"), lambda x: x.rlike(f"^{YEAR}$"))


def years(df: DataFrame, keys=KEYS) -> DataFrame:
    """Years of the source that the target lacks."""
    return issues(df, "date_mismatch", REVIEW, F.array_except(_years("source"), _years("target")), F.col("found"), keys)


def dates(df: DataFrame, keys=KEYS) -> DataFrame:
    """English dates (month day, day of month) whose Portuguese form the target lacks."""
    months = "|".join(d.MONTHS)
    text = F.lower("source")
    first = F.transform(extract(text, rf"(?:{months})\s+[0-9]{{1,2}}"), lambda x: F.struct(F.regexp_extract(x, "^[a-z]+", 0).alias("m"), F.regexp_extract(x, "[0-9]+$", 0).alias("d"), x.alias("s")))
    second = F.transform(extract(text, rf"[0-9]{{1,2}}(?:st|nd|rd|th)?\s+of\s+(?:{months})"), lambda x: F.struct(F.regexp_extract(x, "[a-z]+$", 0).alias("m"), F.regexp_extract(x, "^[0-9]+", 0).alias("d"), x.alias("s")))
    table = F.create_map(*[F.lit(x) for pair in d.MONTHS.items() for x in pair])
    rows = df.select(*keys, "target", F.explode(F.concat(first, second)).alias("x")).withColumn("fix", F.concat("x.d", F.lit(" de "), table[F.col("x.m")]))
    lost = ~F.concat(F.lit(" "), F.regexp_replace(F.lower("target"), NON_WORD, " "), F.lit(" ")).contains(F.concat(F.lit(" "), "fix", F.lit(" ")))
    return rows.where(lost).select(*keys, F.lit("date_mismatch").alias("check"), F.lit(REVIEW).alias("severity"), F.col("x.s").alias("found"), "fix")


def months(df: DataFrame, keys=KEYS) -> DataFrame:
    """Months of the source that the target lacks."""
    table = F.array(*[F.struct(F.lit(e).alias("en"), F.lit(p).alias("pt"), F.lit(any_of([e])).alias("a"), F.lit(any_of([p])).alias("b")) for e, p in d.MONTHS.items()])
    rows = df.select(*keys, F.lower("source").alias("s"), F.lower("target").alias("t"), F.explode(table).alias("m"))
    rows = rows.where(F.col("s").contains(F.col("m.en")) & F.rlike("s", F.col("m.a")) & ~F.rlike("t", F.col("m.b")))
    return rows.select(*keys, F.lit("date_mismatch").alias("check"), F.lit(REVIEW).alias("severity"), F.col("m.en").alias("found"), F.col("m.pt").alias("fix"))


PERCENT = r"([0-9]+(?:[.,][0-9]+)?)\s*(?:%|percent)"
PERCENT_PT = r"([0-9]+(?:[.,][0-9]+)?)\s*(?:%|por\s*cento)"


def percents(df: DataFrame, keys=KEYS) -> DataFrame:
    """Percentages that the target lacks (point or comma), and spaces in front of its percent signs."""
    there = extract(F.lower("target"), PERCENT_PT, 1)
    lost = F.filter(extract(F.lower("source"), PERCENT, 1), lambda x: ~F.array_contains(there, x) & ~F.array_contains(there, F.replace(x, F.lit("."), F.lit(","))))
    missing = issues(df, "percentage_mismatch", REVIEW, lost, F.concat(F.replace("found", F.lit("."), F.lit(",")), F.lit("%")), keys)
    spaced = issues(df, "percentage_mismatch", SAFE, extract(F.col("target"), r"[0-9]+\s+%"), F.regexp_replace("found", r"\s+", ""), keys)
    return missing.unionByName(spaced)


def currencies(df: DataFrame, keys=KEYS) -> DataFrame:
    """Amounts of money that the target has neither with the sign nor with the word."""
    parts = []
    for sign, word in d.CURRENCIES.items():
        amounts = extract(F.col("source"), rf"[{sign}]\s*([0-9]+(?:[.,][0-9]+)?)", 1)
        target = F.col("target")
        if sign == "¥":
            lost = F.filter(amounts, lambda x: ~target.contains("¥"))
        else:
            lost = F.filter(amounts, _no_amount(target, sign, word))
        parts.append(F.transform(lost, _prefixed(sign)))
    return issues(df, "currency_mismatch", REVIEW, F.concat(*parts), F.col("found"), keys)


def _no_amount(target: Column, sign: str, word: str):
    return lambda x: ~(target.contains(F.concat(F.lit(sign), x)) | target.contains(F.concat(F.lit(sign + " "), x)) | F.lower(target).contains(F.concat(x, F.lit(" " + word))))


def _prefixed(sign: str):
    return lambda x: F.concat(F.lit(sign), x)


def measures(df: DataFrame, keys=KEYS) -> DataFrame:
    """Measures left in English (safe), or missing (suggested)."""
    table = F.array(*[F.struct(F.lit(e).alias("en"), F.lit(p).alias("pt"), F.lit(rf"([0-9]+(?:[.,][0-9]+)?)\s+{e}(?:$|{NON_WORD})").alias("a")) for e, p in d.UNITS.items()])
    rows = df.select(*keys, F.lower("source").alias("s"), F.lower("target").alias("t"), F.explode(table).alias("u"))
    rows = rows.where(F.col("s").contains(F.col("u.en")))  # a plain search before a pattern of a column
    rows = rows.select("*", F.explode(F.regexp_extract_all("s", "u.a", F.lit(1))).alias("value"))
    words = F.concat(F.lit(" "), F.regexp_replace("t", r"[^\p{L}\p{N}_.,]+", " "), F.lit(" "))
    left = words.contains(F.concat(F.lit(" "), "value", F.lit(" "), "u.en"))
    there = words.contains(F.concat(F.lit(" "), "value", F.lit(" "), "u.pt"))
    rows = rows.withColumn("severity", F.when(left, SAFE).when(~there, SUGGESTED)).where("severity IS NOT NULL")
    return rows.select(*keys, F.lit("measurement_mismatch").alias("check"), "severity", F.concat_ws(" ", "value", "u.en").alias("found"), F.concat_ws(" ", "value", "u.pt").alias("fix"))


def names(df: DataFrame, people: DataFrame, keys=KEYS) -> DataFrame:
    """Names of the source, as whole words, that the target lacks: near forms are suggested, missing surnames reviewed."""
    t, n = F.lower("target"), F.lower("name")
    rows = dictionary_join(df.select(*keys, "source", "target"), people.where(F.length("name") >= 3).select("name"), "source", "name").where(~t.contains(n))
    last = F.element_at(F.split(n, " "), -1)
    near = F.expr("regexp_extract(lower(target), concat(split(lower(name), ' ')[0], '\\\\s+[a-z]{3,}'), 0)")
    rows = rows.withColumn("near", near).withColumn("severity", F.when(F.col("near") != "", SUGGESTED).when(~t.contains(last), REVIEW)).where("severity IS NOT NULL")
    return rows.select(*keys, F.lit("proper_name_inconsistency").alias("check"), "severity", F.col("near").alias("found"), F.col("name").alias("fix"))


def links(df: DataFrame, keys=KEYS) -> DataFrame:
    """Links that the target lacks, and addresses that it lacks in either case."""
    target = F.col("target")
    urls = F.filter(extract(F.col("source"), URL), lambda x: ~target.contains(x))
    mails = F.filter(extract(F.col("source"), EMAIL), lambda x: ~F.lower(target).contains(F.lower(x)))
    return issues(df, "url_mismatch", SAFE, F.concat(urls, mails), F.col("found"), keys)


def footnotes(df: DataFrame, keys=KEYS) -> DataFrame:
    """Footnote marks that the target lacks."""
    mark = r"\[\^?[0-9]+\]"
    there = extract(F.col("target"), mark)
    return issues(df, "footnote_mismatch", REVIEW, F.filter(extract(F.col("source"), mark), lambda x: ~F.array_contains(there, x)), F.col("found"), keys)


def citations(df: DataFrame, keys=KEYS) -> DataFrame:
    """Citations (Name, year) that the target lacks."""
    target = F.col("target")
    return issues(df, "reference_mismatch", REVIEW, F.filter(extract(F.col("source"), r"\([A-Z][a-z]+,\s*[0-9]{4}\)"), lambda x: ~target.contains(x)), F.col("found"), keys)


def locked_terms(df: DataFrame, terms: DataFrame, keys=KEYS) -> DataFrame:
    """Locked terms left in the source's language (safe) or missing in the target (review)."""
    rows = dictionary_join(df.select(*keys, "source", "target"), terms.where("locked").select("term", "target_term"), "source", "term")
    left = F.lower("target").contains(F.lower("term")) & has_term(F.col("target"), F.col("term")) & (F.lower("term") != F.lower("target_term"))
    rows = rows.withColumn("severity", F.when(left, SAFE).when(~has_term(F.col("target"), F.col("target_term")), REVIEW)).where("severity IS NOT NULL")
    return rows.select(*keys, F.lit("locked_term_violation").alias("check"), "severity", F.col("term").alias("found"), F.col("target_term").alias("fix"))


def polarity(df: DataFrame, keys=KEYS) -> DataFrame:
    """Negation on one side only."""
    en = has_word(F.col("source"), d.NEGATIONS_EN) | F.lower("source").rlike(rf"(?:^|{NON_WORD})no\s+[\p{{L}}\p{{N}}_]")
    pt = has_word(F.col("target"), d.NEGATIONS_PT)
    rows = df.where(en != pt)
    return rows.select(*keys, F.lit("polarity_mismatch").alias("check"), F.lit(REVIEW).alias("severity"), F.when(en, "source").otherwise("target").alias("found"), F.lit(None).cast("string").alias("fix"))


def sentences(text: str) -> Column:
    """Sentences by closing marks, trimmed."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, "[.!?]+", "\x01"), "\x01", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def structure(df: DataFrame, keys=KEYS) -> DataFrame:
    """Three sentences or more that became one of less than 0.6 of the length."""
    n, m = F.size(sentences("source")), F.size(sentences("target"))
    rows = df.where((n >= 3) & (m == 1) & (F.length("target") < 0.6 * F.length("source")))
    return rows.select(*keys, F.lit("structural_count_mismatch").alias("check"), F.lit(REVIEW).alias("severity"), n.cast("string").alias("found"), F.lit(None).cast("string").alias("fix"))


def omission(df: DataFrame, keys=KEYS) -> DataFrame:
    """Targets under 0.35 of a source over 40 characters, and neighbouring equal sentences of 15 characters or more."""
    none = F.lit(None).cast("string")
    short = df.where((F.length("source") > 40) & (F.length("target") < 0.35 * F.length("source"))).select(*keys, F.lit("omission_detected").alias("check"), F.lit(REVIEW).alias("severity"), none.alias("found"), none.alias("fix"))
    s = F.col("_s")
    twice = F.filter(F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.when((F.element_at(s, i) == F.element_at(s, i + 1)) & (F.length(F.element_at(s, i)) >= 15), F.element_at(s, i))), lambda x: x.isNotNull())
    rows = df.withColumn("_s", F.transform(sentences("target"), F.lower)).where(F.size("_s") > 1)
    double = issues(rows, "duplication_detected", SUGGESTED, twice, none, keys)
    return short.unionByName(double)


def report(df: DataFrame, found: list[DataFrame], keys=KEYS) -> DataFrame:
    """Number of issues of each pair, and whether it passed."""
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    counts = every.groupBy(*keys).agg(F.count("*").alias("n_issues"), F.sum(F.when(F.col("severity") == SAFE, 1).otherwise(0)).alias("n_safe"))
    out = df.select(*keys).join(counts, list(keys), "left")
    return out.select(*keys, F.coalesce("n_issues", F.lit(0)).alias("n_issues"), F.coalesce("n_safe", F.lit(0)).alias("n_safe"), F.col("n_issues").isNull().alias("passed"))


def apply_safe_fixes(df: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, fixed, audits): safe fixes of percent signs and units in order, each with text before and after."""
    steps = [(r"([0-9])\s+%", "$1%")] + [(rf"([0-9])\s+{e}($|[^\p{{L}}])", rf"$1 {p}$2") for e, p in d.UNITS.items()]
    text, audits = F.col("target"), []
    for pattern, new in steps:
        after = F.regexp_replace(text, pattern, new)
        audits.append(F.when(after != text, F.struct(F.lit(pattern).alias("rule"), F.length(text).alias("before"), F.length(after).alias("after"))))
        text = after
    return df.select(*keys, text.alias("fixed"), F.filter(F.array(*audits), lambda x: x.isNotNull()).alias("audits"))
