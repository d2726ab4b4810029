"""Context retrieval: what a segment's translation should know, as rows, chosen by a strategy and cut to a budget.

A context is a long table: (doc_id, category, item_id, score, tokens, locked, place), place being the order within the category. A
strategy is a set of caps on the categories; the budget is a running sum in the order in which items are given up.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions.regex import WORD

# Words that carry no topic.
STOPWORDS_EN = "a an the in on at to for with by from about into through during before after above below and or but if while that which as is was were be been being have has had do does did of it its this"
STOPWORDS_PT = "a o os as um uma uns umas de do da dos das em no na nos nas por pelo pela pelos pelas com e ou mas que se para como ao aos à às seu sua seus suas meu minha foi era estava são ser ter havia"
STOPWORDS = tuple(sorted(set(f"{STOPWORDS_EN} {STOPWORDS_PT}".split())))
# Pronouns by the gender they stand for.
PRONOUNS = {"male": "he him his himself ele dele nele", "female": "she her hers herself ela dela nela", "neutral": "it its they them their theirs themselves eles elas deles delas"}
#: In this order items are given up when a context is over its budget; other categories have no tokens.
GIVEN_UP = ("semantic", "fact", "succeeding", "preceding")


@dataclass(frozen=True)
class Config:
    """Budget and caps of a strategy; a cap of 0 leaves the category out."""

    max_tokens: int = 800
    before: int = 2
    after: int = 0
    min_similarity: float = 0.15
    passages: int = 3
    terms: int = 10
    tm: int = 5
    characters: int = 6
    facts: int = 5
    locked_terms_only: bool = False


BALANCED = Config()
STRATEGIES = {
    "balanced": BALANCED,
    "minimal": replace(BALANCED, before=1, passages=0, tm=0, facts=0, terms=1 << 30, characters=1 << 30, locked_terms_only=True),
    "story_heavy": replace(BALANCED, facts=10),
    "semantic_dense": replace(BALANCED, passages=6, min_similarity=0.10),
}


def tokens_of(text: Column) -> Column:
    """Estimated tokens: one for four characters, one at least, none for no text."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("long")


def content_words(text: Column) -> Column:
    """Words of three characters or more that carry a topic."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD + "{3,}"), 0), lambda w: ~w.isin(*STOPWORDS))


def neighbours(segments: DataFrame, before: int, after: int) -> DataFrame:
    """Items of the segments just before and behind in the chapter. segments: (doc_id, chapter, seq, text)."""
    order = W.partitionBy("chapter").orderBy("seq", "doc_id")
    rows = segments.select("doc_id", "chapter", "seq", tokens_of(F.col("text")).alias("tokens"))
    found = {}
    for k in [*range(-before, 0), *range(1, after + 1)]:
        kind, score = ("preceding", 0.90) if k < 0 else ("succeeding", 0.50)
        found[f"x{k}"] = F.struct(F.lit(kind).alias("category"), F.lag("doc_id", -k).over(order).alias("id"), F.lit(score).alias("score"), F.lag("tokens", -k).over(order).alias("tokens"), F.lit(k).alias("place"))
    items = rows.withColumns(found).select("doc_id", F.explode(F.array(*[f"`{x}`" for x in found])).alias("x")).where("x.id IS NOT NULL")
    return items.select("doc_id", "x.category", F.col("x.id").cast("string").alias("item_id"), "x.score", "x.tokens", F.lit(False).alias("locked"), F.col("x.place").cast("long").alias("place"))


def similar_passages(segments: DataFrame, least: float, most: int) -> DataFrame:
    """The most similar earlier segments of the chapter by cosine of their content words."""
    words = segments.select("doc_id", "chapter", "seq", F.explode(content_words(F.col("text"))).alias("w")).groupBy("doc_id", "chapter", "seq", "w").agg(F.count("*").alias("tf"))
    norms = words.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    a, b = words.alias("a"), words.select(F.col("doc_id").alias("other"), "chapter", F.col("seq").alias("earlier"), "w", F.col("tf").alias("tf2"))
    dots = a.join(b, ["chapter", "w"]).where("earlier < seq").groupBy("doc_id", "other").agg(F.sum(F.col("tf") * F.col("tf2")).alias("dot"), F.count("*").alias("shared"))
    scored = dots.join(norms, "doc_id").join(norms.select(F.col("doc_id").alias("other"), F.col("norm").alias("norm2")), "other").withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("norm2")), 9))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "other"))
    best = scored.where(F.col("score") >= least).withColumn("place", place).where(F.col("place") <= most)
    texts = segments.select(F.col("doc_id").alias("other"), tokens_of(F.col("text")).alias("tokens"))
    return best.join(texts, "other").select("doc_id", F.lit("semantic").alias("category"), F.col("other").cast("string").alias("item_id"), F.round("score", 3).alias("score"), "tokens", F.lit(False).alias("locked"), F.col("place").cast("long").alias("place"), "shared")


def relevant_facts(segments: DataFrame, facts: DataFrame, most: int) -> DataFrame:
    """The first facts that are locked or share a word of five letters with the segment, `most` for each. facts: (fact_id, statement, locked).

    Only the first `most` locked facts, and the first `most` with a given word, can be among a segment's first; so a word
    that every fact has meets `most` of them, not all.
    """
    locked = facts.where("locked").orderBy("fact_id").limit(most).select("fact_id", "locked", "statement")
    words = facts.select("fact_id", "locked", "statement", F.explode(F.array_distinct(F.filter(F.split(F.lower("statement"), r"\s+"), lambda w: F.length(w) > 4))).alias("w"))
    first = words.withColumn("r", F.row_number().over(W.partitionBy("w").orderBy("fact_id"))).where(F.col("r") <= most).drop("r")
    own = segments.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD + "{5,}"), 0))).alias("w"))
    met = own.join(first, "w").drop("w").unionByName(segments.select("doc_id").crossJoin(F.broadcast(locked)))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("fact_id"))
    rows = met.groupBy("doc_id", "fact_id").agg(F.max("locked").alias("locked"), F.max("statement").alias("statement")).withColumn("place", place).where(F.col("place") <= most)
    return rows.select("doc_id", F.lit("fact").alias("category"), F.col("fact_id").cast("string").alias("item_id"), F.when(F.col("locked"), 0.95).otherwise(0.75).alias("score"), tokens_of(F.col("statement")).alias("tokens"), "locked", F.col("place").cast("long").alias("place"))


def scored_terms(hits: DataFrame, glossary: DataFrame, before: int) -> DataFrame:
    """(doc_id, term_id, locked, score) of a segment's terms: 1 if locked, else by how many of the segments before have the term as well.

    hits: (doc_id, chapter, seq, term_id), one row a segment and term.
    """
    earlier = hits.select("chapter", "term_id", F.explode(F.sequence(F.col("seq") + 1, F.col("seq") + before)).alias("seq")).groupBy("chapter", "term_id", "seq").agg(F.count("*").alias("freq"))
    rows = hits.join(earlier, ["chapter", "term_id", "seq"], "left").join(F.broadcast(glossary.select("term_id", "locked")), "term_id")
    score = F.when(F.col("locked"), 1.0).otherwise(F.least(F.lit(0.95), 0.75 + 0.05 * F.coalesce("freq", F.lit(0))))
    return rows.select("doc_id", "term_id", "locked", F.round(score, 6).alias("score"))


def pronoun_referents(segments: DataFrame, mentions: DataFrame, characters: DataFrame, before: int) -> DataFrame:
    """(doc_id, character_id, score): for a segment with a pronoun the characters of its gender named in the segments before, the nearest mention first.

    mentions: (chapter, seq, character_id); a character is joined to the segments behind its mention, `before` at most.
    """
    low = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD + "+"), 0))
    marked = segments.select("doc_id", "chapter", "seq", *[F.arrays_overlap(low, F.array(*map(F.lit, own.split()))).alias(g) for g, own in PRONOUNS.items()])
    near = mentions.select("chapter", "character_id", F.explode(F.sequence(F.lit(1), F.lit(before))).alias("back"), (F.col("seq") + F.col("back")).alias("seq"))
    near = near.groupBy("chapter", "character_id", "seq").agg(F.min("back").alias("back")).join(F.broadcast(characters.select("character_id", "gender")), "character_id")
    rows = marked.join(near, ["chapter", "seq"])
    fits = F.col("neutral") | (F.col("male") & F.col("gender").isin("male", "unknown", "neutral")) | (F.col("female") & F.col("gender").isin("female", "unknown", "neutral"))
    return rows.where(fits).select("doc_id", "character_id", F.round(F.greatest(F.lit(0.65), 0.95 - 0.10 * (F.col("back") - 1)), 6).alias("score"))


def capped(rows: DataFrame, category: str, item: str, most: int) -> DataFrame:
    """Items of scored rows (doc_id, item, score[, locked]), the best `most` of each segment, ties by item."""
    locked = F.col("locked") if "locked" in rows.columns else F.lit(False)
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), item))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("doc_id", F.lit(category).alias("category"), F.col(item).cast("string").alias("item_id"), "score", F.lit(0).cast("long").alias("tokens"), locked.alias("locked"), F.col("place").cast("long").alias("place"))


def retrieve(segments: DataFrame, config: Config, *, terms: DataFrame, mentions: DataFrame, tm: DataFrame, facts: DataFrame) -> DataFrame:
    """Items of every segment under a strategy's caps.

    terms: scored_terms(); mentions: (doc_id, character_id, score); tm: (doc_id, tm_id, score, locked); facts: (fact_id, statement, locked).
    """
    columns = ["doc_id", "category", "item_id", "score", "tokens", "locked", "place"]
    terms = terms.where("locked") if config.locked_terms_only else terms
    parts = [neighbours(segments, config.before, config.after), capped(terms, "glossary", "term_id", config.terms), capped(mentions, "character", "character_id", config.characters)]
    if config.tm:
        parts.append(capped(tm, "tm", "tm_id", config.tm))
    if config.passages:
        parts.append(similar_passages(segments, config.min_similarity, config.passages))
    if config.facts:
        parts.append(relevant_facts(segments, facts, config.facts))
    out = parts[0].select(*columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(*columns))
    return out


def prune(items: DataFrame, max_tokens: int = BALANCED.max_tokens) -> DataFrame:
    """items with `kept`: passages go first (the least similar), then facts that are not locked, later segments, earlier segments but the nearest.

    An item is given up if the context is still over the budget after all that go before it.
    """
    segment = W.partitionBy("doc_id")
    nearest = (F.col("category") == "preceding") & (F.col("place") == -1)
    can_go = F.col("category").isin(*GIVEN_UP) & ~F.col("locked") & ~nearest
    rank = F.when(can_go, F.array_position(F.array(*map(F.lit, GIVEN_UP)), F.col("category")))
    within = F.when(F.col("category") == "preceding", F.col("place")).otherwise(-F.col("place"))  # the farthest earlier segment, the last of the others
    rows = items.withColumns({"_rank": rank, "_within": within, "_total": F.sum("tokens").over(segment)})
    gone = F.coalesce(F.sum(F.when(F.col("_rank").isNotNull(), F.col("tokens"))).over(segment.orderBy(F.col("_rank").asc_nulls_last(), "_within", "item_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_over", F.col("_total") - gone > max_tokens)
    return rows.withColumn("kept", F.col("_rank").isNull() | ~F.col("_over")).drop("_rank", "_within", "_total", "_over")


def fingerprint(items: DataFrame) -> DataFrame:
    """(doc_id, h): 16 digits of the hash of a context's items in canonical order."""
    one = F.concat_ws("|", "category", "item_id", F.round("score", 4).cast("decimal(6,4)").cast("string"))
    return items.groupBy("doc_id").agg(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list(one)), ";"), 256), 1, 16).alias("h"))
