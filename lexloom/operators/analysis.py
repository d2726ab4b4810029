"""Analysis of a book's people and voice: relations between known people, gender by evidence, narrator and tense.

All of it is column expressions and equi-joins. A null text has no words; people without evidence stay unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Nouns of relations, titles in front of a name, forms of pronouns and verbs, titles and first names of one gender.
RELATIONS = ("mother", "father", "brother", "sister", "wife", "husband", "son", "daughter", "uncle", "aunt", "cousin", "friend", "assistant", "servant", "partner", "mãe", "pai", "irmão", "irmã", "esposa", "marido", "filho", "filha", "tio", "tia", "primo", "prima", "amigo", "amiga", "assistente", "servo", "serva", "sócio", "sócia")
TITLES = ("Lady", "Lord", "Sir", "Dame", "Dr.", "Doctor", "Mr.", "Mrs.", "Miss", "Ms.", "Prof.", "Professor", "Inspector")
FIRST_PERSON = ("i", "me", "my", "mine", "myself", "we", "us", "our", "ours", "ourselves")
THIRD_PERSON = ("he", "him", "his", "himself", "she", "her", "hers", "herself", "they", "them", "their", "theirs")
PAST = ("was", "were", "had", "said", "looked", "went", "walked", "came", "saw", "thought", "asked", "replied", "took", "felt")
PRESENT = ("is", "are", "has", "says", "looks", "goes", "walks", "comes", "sees", "thinks", "asks", "replies", "takes", "feels")
TITLES_OF = {"masculine": ("mr", "sir", "lord", "king", "prince", "duke", "baron", "count"), "feminine": ("mrs", "miss", "ms", "lady", "queen", "princess", "duchess", "dame")}
PRONOUNS_OF = {"masculine": ("he", "him", "his"), "feminine": ("she", "her", "hers")}
NAMES_OF = {
    "masculine": ("john", "sherlock", "arthur", "robert", "jack", "william", "james", "george", "charles", "thomas", "edward", "henry", "joão", "pedro", "lucas", "carlos"),
    "feminine": ("margaret", "mary", "elizabeth", "sarah", "jane", "emma", "alice", "maria", "ana", "helena"),
}
NEUTRAL_TITLES = ("dr", "doctor", "mr", "mrs", "miss", "ms", "prof", "professor", "inspector")

_WORD = r"[\p{L}\p{N}_]"
_TITLE = "(?:" + "|".join(t.replace(".", r"\.") for t in TITLES) + ")"
_NAME = r"[A-ZÀ-Ý][a-zA-ZÀ-ÿ]+(?:\s+[A-ZÀ-Ý][a-zA-ZÀ-ÿ]+)?"
_TITLED = rf"(?:{_TITLE}\s+)?{_NAME}"
_NOUN = "|".join(RELATIONS)
#: (pattern, group of the relative, group of the other); the noun is group 2.
PATTERNS = (
    (rf"(?<!{_WORD})({_NAME})'s\s+((?iu:{_NOUN}))\s*,?\s+({_TITLED})(?!{_WORD})", 3, 1),
    (rf"(?<!{_WORD})({_TITLED})\s*,?\s+(?iu:(?:(?:the|a|o)\s+)?(?:[a-zà-ÿ]+\s+)?)((?iu:{_NOUN}))\s+(?iu:of|de|da|do)\s+({_TITLED})(?!{_WORD})", 1, 3),
)


def _words(text: str | Column, words: tuple[str, ...]) -> Column:
    """How often any of the words stands in a text, in either case."""
    return F.regexp_count(text, F.lit(rf"(?iu)(?<!{_WORD})(?:{'|'.join(words)})(?!{_WORD})")).cast("long")


def _resolved(names: DataFrame, people: DataFrame) -> DataFrame:
    """names (raw) with person_id and name of the person meant: by the whole name or alias, without its title, else by a word of it, the last first.

    Of people that share an alias the one with the largest id is meant.
    """
    known = people.select("person_id", "name", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("key"))
    known = known.groupBy(F.lower("key").alias("key")).agg(F.max_by(F.struct("person_id", "name"), "person_id").alias("p"))
    bare = F.trim(F.regexp_replace("raw", rf"^(?iu){_TITLE}\s+", ""))
    keys = F.concat(F.array(F.lower("raw"), F.lower(bare)), F.reverse(F.split(F.lower("raw"), r"\s+")))
    asked = names.select("raw", F.posexplode(keys).alias("rank", "key"))
    return asked.join(known, "key").groupBy("raw").agg(F.min_by("p", "rank").alias("p")).select("raw", "p.person_id", "p.name")


def relations(df: DataFrame, people: DataFrame, text: str = "line", keys: tuple[str, ...] = ("doc_id", "line_no")) -> DataFrame:
    """(keys, source_id, source_name, target_id, target_name, relation, confidence, evidence): who is whose relative.

    people (person_id, name, aliases array). `A's mother B` and `B, the old mother of A` both say that B is mother_of A. Names
    that no person has, and a person related to themself, give no row. Evidence is the place with 20 characters on each side.
    """
    found = None
    for pattern, relative, other in PATTERNS:
        at = df.select(*keys, F.col(text).alias("_text"), F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("_hit"))
        place = F.instr("_text", F.col("_hit"))
        start = F.greatest(F.lit(1), place - 20)
        rows = at.select(
            *keys, F.trim(F.regexp_extract("_hit", pattern, relative)).alias("source"), F.lower(F.regexp_extract("_hit", pattern, 2)).alias("noun"),
            F.trim(F.regexp_extract("_hit", pattern, other)).alias("target"), F.trim(F.substring("_text", start, place - start + F.length("_hit") + 20)).alias("evidence"),
        )
        found = rows if found is None else found.unionByName(rows)
    names = _resolved(found.select(F.explode(F.array("source", "target")).alias("raw")).distinct(), people)
    first = names.select(F.col("raw").alias("source"), F.col("person_id").alias("source_id"), F.col("name").alias("source_name"))
    second = names.select(F.col("raw").alias("target"), F.col("person_id").alias("target_id"), F.col("name").alias("target_name"))
    both = found.join(first, "source").join(second, "target").where("source_id <> target_id")
    return both.select(*keys, "source_id", "source_name", "target_id", "target_name", F.concat("noun", F.lit("_of")).alias("relation"), F.lit(0.9).alias("confidence"), "evidence")


def _one_of(value: Column, lists: dict[str, tuple[str, ...]]) -> Column:
    return F.when(value.isin(*lists["masculine"]), "masculine").when(value.isin(*lists["feminine"]), "feminine")


def gender(mentions: DataFrame, order: tuple[str, ...] = ("doc_id", "line_no")) -> DataFrame:
    """mentions (name, title, snippet, order columns) -> (name, gender, confidence, evidence): one row a name.

    By the first title of one gender (0.95), else by pronouns if all mentions have those of one gender only (0.85), else by the
    first name (0.85), else unknown (0). Evidence names the rule.
    """
    by_title = _one_of(F.replace(F.lower("title"), F.lit("."), F.lit("")), TITLES_OF)
    place = F.struct(*order)
    seen = {g: F.max((_words("snippet", w) > 0).cast("int")) for g, w in PRONOUNS_OF.items()}
    known = mentions.groupBy("name").agg(
        F.min_by(by_title, F.when(by_title.isNotNull(), place)).alias("_title"), seen["masculine"].alias("_he"), seen["feminine"].alias("_she"))
    first = F.try_element_at(F.filter(F.split(F.lower("name"), r"\s+"), lambda w: ~F.replace(w, F.lit("."), F.lit("")).isin(*NEUTRAL_TITLES)), F.lit(1))
    by_pronoun = F.when((F.col("_he") == 1) & (F.col("_she") == 0), "masculine").when((F.col("_he") == 0) & (F.col("_she") == 1), "feminine")
    chosen = known.withColumns({"_pronoun": by_pronoun, "_first": _one_of(first, NAMES_OF)})
    rule = F.when(F.col("_title").isNotNull(), "title").when(F.col("_pronoun").isNotNull(), "pronoun").when(F.col("_first").isNotNull(), "first name").otherwise("none")
    found = F.coalesce("_title", "_pronoun", "_first", F.lit("unknown"))
    return chosen.select("name", found.alias("gender"), F.when(rule == "title", 0.95).when(rule == "none", 0.0).otherwise(0.85).alias("confidence"), rule.alias("evidence"))


def _share(part: Column, rest: Column) -> Column:
    return F.round(F.least(F.lit(0.95), F.lit(0.6) + part / (part + rest + F.lit(1)) * F.lit(0.35)), 6)


def narrator(df: DataFrame, text: str = "text") -> DataFrame:
    """df with first_person, third_person (counts), narrator (first or third) and its confidence; a null text counts nothing."""
    body = F.coalesce(F.col(text), F.lit(""))
    counted = df.withColumns({"first_person": _words(body, FIRST_PERSON), "third_person": _words(body, THIRD_PERSON)})
    first = F.col("first_person") > F.col("third_person") * F.lit(0.7)
    a, b = F.col("first_person"), F.col("third_person")
    return counted.withColumns({"narrator": F.when(first, "first").otherwise("third"), "narrator_confidence": F.when(first, _share(a, b)).otherwise(_share(b, a))})


def tense(df: DataFrame, text: str = "text") -> DataFrame:
    """df with past, present (counts), tense and its confidence; past where both are as frequent."""
    body = F.coalesce(F.col(text), F.lit(""))
    counted = df.withColumns({"past": _words(body, PAST), "present": _words(body, PRESENT)})
    a, b = F.col("past"), F.col("present")
    return counted.withColumns({"tense": F.when(a >= b, "past").otherwise("present"), "tense_confidence": F.when(a >= b, _share(a, b)).otherwise(_share(b, a))})
