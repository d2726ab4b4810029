"""Semantic checks of sentence pairs: six signals, their weighted score and issues.

`evaluate` is one projection over rows with source and target; nothing is shuffled. An encoder is a function of two
string columns that gives their similarity; the default counts characters and anchor words.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.regex import NON_WORD, WORD, any_of
from lexloom.operators.qa import REVIEW, SUGGESTED
from lexloom.session import ship_package

# Anchor words and their Portuguese forms, in the order of their places in the vector.
ANCHORS = {
    "doctor": "doutor médico dr", "sat": "sentou sentado", "fireplace": "lareira", "listening": "ouvindo escutando", "carefully": "atentamente cuidado", "detective": "detetive investigador",
    "examined": "examinou analisou inspecionou", "footprint": "pegada rastro", "glass": "lente vidro lupa", "thief": "ladrão gatuno", "hasty": "precipitado apressado", "said": "disse afirmou falou",
    "asked": "perguntou indagou", "telegram": "telegrama mensagem", "urgent": "urgente", "sapphire": "safira joia", "train": "trem comboio", "arrived": "chegou", "rain": "chuva", "thunder": "trovão trovões",
    "trembling": "tremendo trêmula", "vanished": "desapareceu sumiu", "midnight": "meia-noite", "safe": "cofre seguro", "lock": "fechadura tranca", "witness": "testemunha", "confirmed": "confirmou",
    "statement": "declaração depoimento", "furious": "furioso enfurecido", "terrified": "aterrorizado apavorado", "excruciating": "excruciante insuportável", "overjoyed": "radiante alegre",
}
BINS, ANCHOR_WEIGHT = 32, 3.0
# False friends with the forms that give them away and what is meant.
FALSE_FRIENDS = {
    "actually": ("atualmente", "na verdade / realmente"), "eventually": ("eventualmente", "com o tempo / no final das contas / por fim"), "parents": ("parentes", "pais"),
    "realize": ("realiz(?:ar|ou|aram|am|o|ava|avam)", "perceber / dar-se conta"), "realized": ("realiz(?:ou|ara|aram|ava)", "percebeu / deu-se conta"),
    "push": ("pux(?:ar|ou|aram|a|am|ava)", "empurrar"), "pushed": ("pux(?:ou|ara|aram|ava)", "empurrou"), "compromise": ("compromet(?:er|eu|eram|e|em|ia)", "entrar em acordo / transigir"),
    "prejudice": ("prejuízo", "preconceito"), "fabric": ("fábrica", "tecido"), "novel": ("novela", "romance"), "legend": ("legenda", "lenda"), "exquisite": ("esquisit[ao]s?", "refinado / primoroso / sublime"),
    "pretend": ("pretend(?:er|eu|eram|e|em|ia)", "fingir"), "pretended": ("pretend(?:eu|era|eram|ia)", "fingiu"), "intend": ("entend(?:er|eu|eram|e|em|ia)", "pretender / tencionar"), "collar": ("colar", "colarinho / coleira"),
}
# Strong words, the forms that weaken them, and what is meant.
INTENSITY = {
    "furious": ("chatead[ao]s?|aborrecid[ao]s?|irritad[ao]s?|pouco contente", "furioso / enfurecido"), "enraged": ("chatead[ao]s?|aborrecid[ao]s?|descontente", "enfurecido / colérico"),
    "terrified": ("preocupad[ao]s?|receos[ao]s?|com um pouco de medo|tímid[ao]s?", "aterrorizado / apavorado"), "petrified": ("preocupad[ao]s?|inquiet[ao]s?", "petrificado / paralisado de terror"),
    "excruciating": ("desconfortáve(?:l|is)|incômod[ao]s?|chat[ao]s?|leve dor", "excruciante / insuportável / atroz"), "unbearable": ("desagradáve(?:l|is)|incômod[ao]s?", "insuportável / intolerável"),
    "overjoyed": ("satisfeit[ao]s?|contente|ok", "radiante / em êxtase / jubiloso"), "devastated": ("triste|chatead[ao]s?", "devastado / desolado"), "ecstatic": ("alegre|contente", "em êxtase / extasiado"),
    "masterpiece": ("bom trabalho|trabalho legal|peça boa", "obra-prima"), "horrific": ("ruim|desagradáve(?:l|is)", "horripilante / terrível"),
}
# Words and their opposites.
ANTONYMS = (
    ("alive|living", "morto|faleceu|morreu|sem vida"), ("dead|deceased", "vivo|sobreviveu|com vida"), ("accepted|agreed|approved", "recusou|rejeitou|negou|desaprovou"), ("rejected|refused|denied", "aceitou|concordou|aprovou"),
    ("guilty", "inocente|sem culpa"), ("innocent", "culpado"), ("open|opened", "fechado|fechou|trancou"), ("closed|locked", "aberto|abriu"), ("friend|ally", "inimigo|adversário"), ("enemy|foe", "amigo|aliado"),
    ("love|loved", "odiou|odeia|detestou"), ("hate|hated", "amou|ama|adorou"), ("success|victory", "fracasso|derrota|perda"), ("failure|defeat", "sucesso|vitória"),
)
# Negations of this check, verbs of speech, informal words, weights.
NEGATED_EN, NEGATED_PT = r"not|never|neither|no\s+one|nobody|nothing", "não|nunca|jamais|ninguém|nada|nem"
SPEECH_EN, SPEECH_PT = "said|asked|replied|demanded|whispered", "disse|perguntou|respondeu|indagou|sussurrou"
INFORMAL = ("cara", "mano", "tipo assim", "né")
WEIGHTS = {"embedding": 0.25, "subject": 0.20, "polarity": 0.20, "content": 0.15, "intensity": 0.10, "literal": 0.10}
PASS, DIVERGENT = 0.70, 0.55

Encoder = Callable[[Column, Column], Column]
_ISSUE = "array<struct<check:string,severity:string,found:string,fix:string>>"


def whole(pattern: str) -> str:
    """The pattern as whole words, its match as group 1."""
    return f"(?:^|{NON_WORD})({pattern})(?:$|{NON_WORD})"


def vector(text: str) -> np.ndarray:
    """Characters of the lower-cased text by code modulo BINS, then the anchors that it holds, of unit length."""
    import re

    low = text.lower()
    out = np.zeros(BINS + len(ANCHORS))
    out[:BINS] = np.bincount(np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32) % BINS, minlength=BINS)
    words = set(re.findall(r"\w+", low))
    for k, (en, pt) in enumerate(ANCHORS.items()):
        out[BINS + k] = ANCHOR_WEIGHT * (en in words or not words.isdisjoint(pt.split()))
    size = np.linalg.norm(out)
    return out / size if size else out


def default_encoder(a: Column, b: Column) -> Column:
    """Cosine of both texts' vectors; 0 for a blank text."""

    @F.pandas_udf("double")
    def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([float(min(1.0, vector(s) @ vector(t))) if s and t and s.strip() and t.strip() else 0.0 for s, t in zip(x, y, strict=True)])

    return cosine(a, b)


def encode(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `vector`: the default encoder's vector of a text; null for a null text."""
    ship_package(df.sparkSession)

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else vector(s).tolist() for s in x])

    return df.withColumn("vector", run(F.col(text)))


def _issue(check: str, severity: str, found: Column, fix: Column | None = None) -> Column:
    return F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), found.cast("string").alias("found"), (F.lit(None) if fix is None else fix).cast("string").alias("fix"))


def _first(rows) -> Column:
    return reduce(lambda a, b: F.coalesce(a, b), rows)


def _listed(src: Column, tgt: Column, table: dict[str, tuple[str, str]], check: str) -> Column:
    """The first entry, in order, whose word the source has and of whose forms the target has one."""
    some = src.rlike(any_of(table))
    one = (F.when(src.rlike(any_of([en])) & tgt.rlike(whole(pt)), _issue(check, SUGGESTED, F.lit(en), F.lit(fix))) for en, (pt, fix) in table.items())
    return F.when(some, _first(one))


def content_words(text: Column) -> Column:
    """Words of three characters or more."""
    return F.size(F.regexp_extract_all(text, F.lit(WORD + "{3,}"), 0))


def _tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), 0))


def evaluate(df: DataFrame, encoder: Encoder = default_encoder, formality: str | None = None) -> DataFrame:
    """df with the six signals, overall, issues and passed.

    An empty source passes with 1 everywhere. Review-required issues block; formality is the style's level, for the register.
    """
    ship_package(df.sparkSession)
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    rows = df.withColumns({"_s": strip("source"), "_t": strip("target")}).withColumn("embedding", encoder(F.col("_s"), F.col("_t")))
    s, t, low, pt = F.col("_s"), F.col("_t"), F.lower("_s"), F.lower("_t")
    n, m = content_words(s), content_words(t)
    omitted = F.when((n >= 6) & (m < 0.4 * n), _issue("semantic_omission", REVIEW, F.concat_ws("/", m, n)))
    added = F.when((n >= 4) & (m > 2.2 * n), _issue("semantic_addition", REVIEW, F.concat_ws("/", m, n)))
    content = F.coalesce(omitted, added)
    reversed_ = _first(F.when(low.rlike(whole(a)) & pt.rlike(whole(b)), _issue("meaning_reversal", REVIEW, F.regexp_extract(low, whole(a), 1))) for a, b in ANTONYMS)
    negated = low.rlike(whole(NEGATED_EN)) != pt.rlike(whole(NEGATED_PT))
    inverted = F.when((_tokens(low) <= 15) & negated, _issue("polarity_inversion", REVIEW, F.substring(s, 1, 50)))
    polarity = F.coalesce(reversed_, inverted)
    name = "([A-Z][a-z]+)"
    agent = F.lower(F.regexp_extract(s, rf"(?:^|{NON_WORD}){name}\s+(?:{SPEECH_EN})(?:$|{NON_WORD})", 1))
    before = F.regexp_extract(t, rf"(?:^|{NON_WORD}){name}\s+(?:{SPEECH_PT})(?:$|{NON_WORD})", 1)
    behind = F.regexp_extract(t, rf"(?:^|{NON_WORD})(?:{SPEECH_PT})\s+{name}(?:$|{NON_WORD})", 1)
    other = F.lower(F.when(before != "", before).otherwise(behind))
    moved = F.when((agent != "") & (other != "") & ~agent.startswith(other) & ~other.startswith(agent), _issue("subject_shift", REVIEW, other, agent))
    start = lambda c, w: c.rlike(f"^{w}($|{NON_WORD})")
    he = F.when(start(low, "he") & start(pt, "ela"), _issue("subject_shift", REVIEW, F.lit("he"), F.lit("ele")))
    she = F.when(start(low, "she") & start(pt, "ele"), _issue("subject_shift", REVIEW, F.lit("she"), F.lit("ela")))
    weak = _listed(low, pt, INTENSITY, "intensity_loss")
    false = _listed(low, pt, FALSE_FRIENDS, "problematic_literal_translation")
    far = F.when((F.col("embedding") < DIVERGENT) & (_tokens(s) > 3), _issue("semantic_divergence", REVIEW, F.round("embedding", 2)))
    register = F.lit(None).cast("struct<check:string,severity:string,found:string,fix:string>")
    if formality and "formal" in formality.lower():
        register = _first(F.when(pt.rlike(any_of([w])), _issue("relationship_shift", REVIEW, F.lit(w))) for w in INFORMAL)
    found = {"_c": content, "_p": polarity, "_j": F.coalesce(moved, he, she), "_i": weak, "_l": false, "_d": far, "_r": register}
    rows = rows.withColumns(found)
    c, p, j = F.col("_c"), F.col("_p"), F.col("_j")
    empty = s == ""
    rows = rows.withColumns(
        {
            "embedding": F.when(empty, 1.0).otherwise(F.col("embedding")),
            "content": F.when(empty | c.isNull(), 1.0).when(c["check"] == "semantic_omission", 0.4).otherwise(0.5),
            "polarity": F.when(empty | p.isNull(), 1.0).when(p["check"] == "meaning_reversal", 0.2).otherwise(0.3),
            "subject": F.when(empty | j.isNull(), 1.0).when(j["found"].isin("he", "she"), 0.4).otherwise(0.3),
            "intensity": F.when(empty | F.col("_i").isNull(), 1.0).otherwise(0.6),
            "literal": F.when(empty | F.col("_l").isNull(), 1.0).otherwise(0.5),
            "issues": F.when(empty, F.array().cast(_ISSUE)).otherwise(F.filter(F.array("_d", "_c", "_p", "_j", "_i", "_l", "_r"), lambda x: x.isNotNull())),
        }
    )
    score = reduce(lambda a, b: a + b, (F.lit(w) * F.col(k) for k, w in WEIGHTS.items()))
    rows = rows.withColumn("overall", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4))
    return rows.withColumn("passed", (F.col("overall") >= PASS) & ~F.exists("issues", lambda x: x["severity"] == REVIEW)).drop("_s", "_t", *found)
