"""Toxicity: a convolutional text classifier trained in numpy.

Words become the sum of two hashed embeddings, of the word and of its first bytes. Filters of widths 1, 2 and 3 slide over
the whole text; each filter's largest response is a feature of a logistic output. Max pooling sends gradients to
one place a filter and text only, so a training step costs little more than a forward pass.

Thresholds are calibrated by language. The language is a guess from the text's own function words (no table column is
an input, neither of a score nor of a cut); for each, the raw score that separates the rows kept from fitting best is moved to THRESHOLD,
by a shift of the logit, so one cut holds for all and scores stay ordered within a language.

Fitting takes every usable labelled row with its whole text. A Bloom filter of the labels' ids drops most other rows where they lie,
and the labels come to the rows' ids, so texts are moved once, as buckets of 4 bytes a word, at any size: rows are dealt to shards by a hash
of id and text, and what the filter let through without a label goes there. In each of EPOCHS rounds every shard goes once through its rows from the same weights, on the executors, and the results are averaged: dense
weights over all shards, an embedding over the shards that moved it. One row in HELD, by a hash of its text, is kept from fitting; the cuts
come from counts of all of these, by steps of 1 / STEPS of a logit. The driver holds weights and counts, no texts, and nothing
depends on how the tables are stored. Scoring reads whole texts. Cases: null and empty texts have no words and get a score
from the output's bias alone, never above 0.5 of the threshold; without labels of both kinds every score is 0;
labels that contradict one another count as toxic; null labels and ids are left out of fitting; repeated rows get
equal scores; an empty table gives none; docs' own columns named score or predicted are replaced by score() and kept
by reject().
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import textvec as tv
from lexloom.llm.rows import carried
from lexloom.session import materialise, remove, ship_package

THRESHOLD = 0.7
SHARD_ROWS = 4000
SHARD_WORDS = 8_000_000
HELD = 5
FILTER_BITS = 1 << 28
STEPS = 256
BUCKETS = 1 << 15
DIM = 12
FILTERS = 8
WIDTHS = (1, 2, 3)
PREFIX = 5
EPOCHS = 8
_PAD = WIDTHS[-1] - 1
_SLICE_WORDS = 1 << 18
_BLOCK = 1 << 12  # embeddings that are averaged in one place

# Frequent function words that tell languages apart; a text's language is the one with the most of them.
FUNCTION_WORDS = {
    "en": "the of and to is that it for was with by this are from",
    "de": "der die und den von zu das mit sich auf ist nicht ein dem",
    "fr": "le les et des du une pour est qui dans sur pas avec au",
    "es": "el los las y del por con su una es al lo más pero",
    "pt": "o os uma não em com ao do da dos mas foi são pelo",
    "it": "il che di è per non della gli sono nel alla anche più",
    "nl": "het een van niet dat met voor zijn op aan ook maar bij",
    "sv": "och att det som på är för av med till inte var han",
    "pl": "i w na z się nie to jest do że jak ale po",
}
GROUPS = ("other", *FUNCTION_WORDS)


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice of texts: word and prefix buckets with padding behind each text, where each text begins, its language group."""
    low = tv.LOWER[data]
    starts, ends = tv.word_spans(low, tv.ALNUM)
    firsts = tv.words_per_text(starts, bounds)
    word = (tv.word_hashes(low, starts, ends) % np.uint64(BUCKETS)).astype(np.int32)
    prefix = (tv.word_hashes(low, starts, np.minimum(ends, starts + PREFIX)) % np.uint64(BUCKETS)).astype(np.int32) + BUCKETS
    counts = np.diff(firsts)
    padded = _padded(word, prefix, counts)
    table = np.zeros((counts.size, len(GROUPS)), dtype=np.int32)
    groups = _word_groups()[word]
    known = np.flatnonzero(groups)
    np.add.at(table, (np.searchsorted(firsts, known, side="right") - 1, groups[known]), 1)
    return *padded, table.argmax(axis=1)


def _padded(word: np.ndarray, prefix: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of texts of so many words with padding behind each text, and where each text begins."""
    begin = np.cumsum(counts) - counts + _PAD * np.arange(counts.size)
    place = np.arange(word.size) + _PAD * np.repeat(np.arange(counts.size), counts)
    both = np.full((2, word.size + _PAD * counts.size), 2 * BUCKETS, dtype=np.int32)
    both[0, place], both[1, place] = word, prefix
    return both[0], both[1], begin


@cache
def _word_groups() -> np.ndarray:
    """Language group by a word's bucket; 0 where it is no function word."""
    out = np.zeros(BUCKETS, dtype=np.int8)
    for group, words in enumerate(FUNCTION_WORDS.values(), 1):
        data = np.frombuffer(f"{words} ".encode(), dtype=np.uint8)
        starts, ends = tv.word_spans(data, tv.ALNUM)
        out[(tv.word_hashes(data, starts, ends) % np.uint64(BUCKETS)).astype(np.int64)] = group
    return out


@dataclass
class Model:
    """Weights. embed has a last row of zeros, for padding."""

    embed: np.ndarray
    conv: list[np.ndarray]  # of each width: (width, DIM, FILTERS)
    offset: np.ndarray
    out: np.ndarray
    bias: float
    cuts: dict[int, float] = field(default_factory=dict)  # logit by language group
    trained: bool = True

    def responses(self, word: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Embedded words, and each width's filter responses at each word."""
        x = self.embed[word] + self.embed[prefix]
        found = []
        parts = x @ np.concatenate([w.transpose(1, 0, 2).reshape(DIM, -1) for w in self.conv], axis=1)
        at = 0
        for w in self.conv:
            h = parts[:, at : at + FILTERS].copy()
            for k in range(1, len(w)):
                h[:-k] += parts[k:, at + k * FILTERS : at + (k + 1) * FILTERS]
            at += len(w) * FILTERS
            h[word == 2 * BUCKETS] = -1e9  # padding begins no window
            found.append(h)
        return x, found

    def features(self, responses: list[np.ndarray], begin: np.ndarray) -> np.ndarray:
        """Pooled features of texts that begin there."""
        pooled = np.concatenate([np.maximum.reduceat(h, begin, axis=0) for h in responses], axis=1)
        return np.maximum(pooled + self.offset, 0)

    def logits(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw logits and language groups of a slice of texts."""
        word, prefix, begin, group = tokens(data, bounds)
        _, responses = self.responses(word, prefix)
        return self.features(responses, begin) @ self.out + self.bias, group

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Calibrated scores."""
        if not self.trained:
            return np.zeros(bounds.size - 1)
        raw, group = self.logits(data, bounds)
        cut = np.array([self.cuts.get(g, 0.0) for g in range(len(GROUPS))])[group]
        return 1 / (1 + np.exp(-np.clip(raw - cut + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def new_model(seed: int = 7) -> Model:
    """Small random weights."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.02, (2 * BUCKETS + 1, DIM)).astype(np.float32)
    embed[-1] = 0
    conv = [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    n = FILTERS * len(WIDTHS)
    return Model(embed, conv, np.zeros(n, np.float32), np.abs(rng.normal(0, 0.3, n)).astype(np.float32) * np.where(np.arange(n) % 4 == 3, -1, 1).astype(np.float32), -1.0)


class _Adam:
    def __init__(self, shape, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0, rate

    def step(self, value, grad):
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.99 * self.v + 0.01 * grad * grad
        return value - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-6)


@dataclass
class _State:
    """What fitting moves: the model, the rates' moments of its dense weights, the squares of its embeddings' gradients."""

    model: Model
    dense: list[_Adam]
    squares: np.ndarray

    def vector(self) -> np.ndarray:
        """Dense weights and their moments."""
        m = self.model
        parts = [*m.conv, m.offset, m.out, m.bias] + [x for d in self.dense for x in (d.m, d.v)]
        return np.concatenate([np.ravel(x) for x in parts]).astype(np.float32)

    def take(self, vector: np.ndarray, t: int) -> None:
        """Sets what vector() gives."""
        at = 0

        def part(like):
            nonlocal at
            at += np.size(like)
            return vector[at - np.size(like) : at].reshape(np.shape(like)).astype(np.float32)

        m = self.model
        m.conv = [part(w) for w in m.conv]
        m.offset, m.out, m.bias = part(m.offset), part(m.out), float(part(m.bias))
        for d in self.dense:
            d.m, d.v, d.t = part(d.m), part(d.v), t


def _new_state(seed: int) -> _State:
    model = new_model(seed)
    dense = [_Adam(w.shape, 0.01) for w in model.conv] + [_Adam(model.offset.shape, 0.01), _Adam(model.out.shape, 0.01), _Adam((), 0.01)]
    return _State(model, dense, np.zeros(model.embed.shape[0], dtype=np.float32))


def _balance(labels: np.ndarray, share: float) -> np.ndarray:
    """Weights that make both labels count alike; share: the part of rows with label 1."""
    return np.where(labels == 1, 0.5 / max(1e-9, share), 0.5 / max(1e-9, 1 - share))


def _epoch(state: _State, rows: list, labels: np.ndarray, balance: np.ndarray, order: np.ndarray) -> None:
    """Once through the rows, in this order."""
    for at in range(0, order.size, 32):
        some = order[at : at + 32]
        _step(state.model, [rows[i] for i in some], labels[some], balance[some], state.dense, state.squares)


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """A model of these texts, in this process. weights: rows that a row stands for, used for the cuts.

    A fifth of the rows, dealt by position, is kept from fitting and sets the cuts.
    """
    state, rng = _new_state(seed), np.random.default_rng(seed)
    held = np.arange(len(texts)) % HELD == 0
    rows, langs = [], []
    for _, data, bounds in tv.text_slices(pa.array(texts, pa.string())):
        word, prefix, begin, lang = tokens(data, bounds)
        edges = np.append(begin, word.size)
        rows += [(word[a:b], prefix[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        langs.append(lang)
    train = np.flatnonzero(~held)
    balance = _balance(labels, labels[train].mean())
    for _ in range(epochs):
        rng.shuffle(train)
        _epoch(state, rows, labels, balance, train)
    kept = np.flatnonzero(held)
    _calibrate(state.model, _raw(state.model, [rows[i] for i in kept]), np.concatenate(langs)[kept], labels[kept], weights[kept])
    return state.model


def _forward(model: Model, rows: list) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
    """(features, responses, where rows begin, their sizes) of consecutive rows, about _SLICE_WORDS words at a time."""
    sizes = np.array([r[0].size for r in rows])
    ends = np.cumsum(sizes)
    first = 0
    while first < len(rows):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + _SLICE_WORDS, side="right")))
        word, prefix = (np.concatenate([r[k] for r in rows[first:last]]) for k in (0, 1))
        begin = ends[first:last] - sizes[first:last] - (ends[first] - sizes[first])
        _, responses = model.responses(word, prefix)
        yield model.features(responses, begin), responses, begin, sizes[first:last]
        first = last


def _raw(model: Model, rows: list) -> np.ndarray:
    """Raw logits of rows."""
    return np.concatenate([f @ model.out + model.bias for f, *_ in _forward(model, rows)] or [np.zeros(0)])


def _step(model: Model, rows, y, balance, dense, squares) -> None:
    word, prefix = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    feats, spots, at = [], [[] for _ in model.conv], 0
    for found, responses, begin, sizes in _forward(model, rows):
        feats.append(found)
        for own, h in zip(spots, responses, strict=True):
            own += [h[a : a + n].argmax(axis=0) + a + at for a, n in zip(begin, sizes, strict=True)]
        at += int(sizes.sum())
    feats = np.concatenate(feats)
    p = 1 / (1 + np.exp(-np.clip(feats @ model.out + model.bias, -30, 30)))
    slope = ((p - y) * balance / len(rows)).astype(np.float32)
    into = slope[:, None] * model.out * (feats > 0)
    spots = [np.stack(own) for own in spots]
    ids, grads = [], []
    new = []
    for j, (w, spot) in enumerate(zip(model.conv, spots, strict=True)):
        g = into[:, j * FILTERS : (j + 1) * FILTERS]
        dw = np.zeros_like(w)
        for k in range(len(w)):
            where = np.minimum(spot + k, word.size - 1)
            dw[k] = np.einsum("bf,bfd->df", g, model.embed[word[where]] + model.embed[prefix[where]])
            dx = g[:, :, None] * w[k].T[None]
            for bucket in (word, prefix):
                ids.append(bucket[where].ravel())
                grads.append(dx.reshape(-1, DIM))
        new.append(dense[j].step(w, dw + 1e-4 * w))
    model.conv = new
    model.offset = dense[-3].step(model.offset, into.sum(axis=0))
    model.out = dense[-2].step(model.out, feats.T @ slope + 1e-3 * model.out)
    model.bias = float(dense[-1].step(np.float32(model.bias), slope.sum()))
    ids, grads = np.concatenate(ids), np.concatenate(grads)
    use = (ids < 2 * BUCKETS) & (np.abs(grads).max(axis=1) > 0)
    unique, place = np.unique(ids[use], return_inverse=True)
    total = np.zeros((unique.size, DIM), dtype=np.float32)
    np.add.at(total, place, grads[use])
    squares[unique] += (total * total).mean(axis=1)
    model.embed[unique] -= 0.1 * total / (np.sqrt(squares[unique])[:, None] + 1e-6)


def best_cut(raw: np.ndarray, y: np.ndarray, weights: np.ndarray) -> float:
    """The logit that separates labels with the best F1; the middle of the gap it lies in."""
    order = np.argsort(-raw, kind="stable")
    r, t, w = raw[order], y[order], weights[order]
    hit, false = np.cumsum(w * t), np.cumsum(w * (1 - t))
    f1 = 2 * hit / (hit + false + (w * t).sum())
    f1[:-1][r[:-1] == r[1:]] = -1
    best = int(f1.argmax())
    below = r[best + 1] if best + 1 < r.size else r[best] - 1
    return float((r[best] + below) / 2)


def _calibrate(model: Model, raw: np.ndarray, groups: np.ndarray, y: np.ndarray, weights: np.ndarray) -> None:
    """Sets the cuts from raw logits that were kept from fitting; weights: rows that an entry stands for."""
    hit, false = weights * y, weights * (1 - y)
    every = best_cut(raw, y, weights) if hit.sum() > 0 and false.sum() > 0 else 0.0
    floor = model.bias  # the logit of a text without words
    for g in range(len(GROUPS)):
        own = groups == g
        few = min(hit[own].sum(), false[own].sum()) < 10
        model.cuts[g] = max(every if few else best_cut(raw[own], y[own], weights[own]), floor + 0.5)


def crc_mod(id_col: str, n: int) -> F.Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def train(docs: DataFrame, labels: DataFrame, usable: F.Column, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> Model:
    """A model of all labelled rows. usable: a condition on labels' rows."""
    spark = docs.sparkSession
    ship_package(spark)
    kind = docs.schema[id_col].dataType
    known = labels.where(usable & F.col(label_col).isin(0, 1)).select(F.col(id_col).try_cast(kind).alias("id"), F.col(label_col).cast("int").alias("y"))
    known, known_at = materialise(known.where("id IS NOT NULL").groupBy("id").agg(F.max("y").alias("y")), "toxicity_labels")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("id").alias("key"), F.xxhash64(F.col("id").cast("string"), "text").alias("h"), (F.pmod(F.xxhash64("text"), F.lit(HELD)) == 0).alias("held"), "text")
    sent = spark.sparkContext.broadcast(_id_filter(known))
    schema = rows.select("id", "h", "held", *(F.lit(None).cast(t).alias(c) for c, t in (("lang", "int"), ("n", "long"), ("word", "binary"), ("prefix", "binary")))).schema
    rows, rows_at = materialise(rows.mapInArrow(lambda batches: _tokenised(batches, sent.value), schema), "toxicity_rows")
    sent.destroy()
    labelled, labelled_at = materialise(rows.select("id", "h", "held", "n").join(known, "id"), "toxicity_labelled")
    remove(spark, known_at)
    n, words, hit, n_fit, hit_fit = labelled.agg(F.count("*"), F.sum("n"), F.sum("y"), F.count(F.when(~F.col("held"), 1)), F.sum(F.when(~F.col("held"), F.col("y")))).first()
    if n < 10 or hit in (0, n):
        remove(spark, rows_at)
        remove(spark, labelled_at)
        return Model(np.zeros((1, DIM)), [], np.zeros(0), np.zeros(0), 0.0, trained=False)
    count = max(1, -(-n // SHARD_ROWS), -(-words // SHARD_WORDS))
    shard = F.pmod("h", F.lit(count)).cast("int").alias("shard")
    dealt, marks = (x.repartitionById(count, "shard").groupBy("shard") for x in (rows.select("*", shard), labelled.select("id", "y", shard)))
    shards, shards_at = materialise(dealt.cogroup(marks).applyInArrow(_packed, _SHARD), "toxicity_shards")
    remove(spark, rows_at)
    remove(spark, labelled_at)
    state = _new_state(7)
    for k in range(EPOCHS):
        _average(state, _round(shards, state, (hit_fit or 0) / max(1, n_fit), k))
    _calibrate(state.model, *_held_counts(shards, state.model))
    remove(spark, shards_at)
    return state.model


_SHARD = "shard int, held binary, y binary, lang binary, n binary, word binary, prefix binary"
_MOVED = "block int, shard int, n long, t long, ids binary, moved binary"


def _id_filter(known: DataFrame) -> np.ndarray:
    """Words of a Bloom filter of ids: two bits an id, about 16 bits an id or more up to FILTER_BITS in all; a denser one lets more rows through."""
    bits = min(FILTER_BITS, max(64, 1 << (16 * known.count()).bit_length()))
    key = F.xxhash64("id")
    places = known.select(F.explode(F.array(*(k.bitwiseAND(F.lit(bits - 1)) for k in (key, F.shiftrightunsigned(key, 32))))).alias("at"))
    found = places.groupBy(F.expr("CAST(at DIV 64 AS INT)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at % 64 AS INT)))").alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where a filter may hold the id of such a hash; true for all ids it was made from."""
    own = keys.view(np.uint64)
    ok = np.ones(own.size, dtype=bool)
    for k in (own, own >> np.uint64(32)):
        at = k & np.uint64(words.size * 64 - 1)
        ok &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return ok


def _tokenised(batches: Iterator[pa.RecordBatch], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The words, as buckets of 16 bits, of the texts whose id the filter may hold."""
    for batch in batches:
        batch = batch.filter(pa.array(_may_hold(ids, batch.column("key").to_numpy())))
        for first, data, bounds in tv.text_slices(batch.column("text")):
            word, prefix, begin, lang = tokens(data, bounds)
            part = batch.slice(first, begin.size)
            edges = np.append(begin, word.size)
            counts = np.diff(edges) - _PAD
            cells = [[x[a : a + n].astype("<u2").tobytes() for a, n in zip(begin, counts, strict=True)] for x in (word, prefix - BUCKETS)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "h", "held")), pa.array(lang.astype(np.int32)), pa.array(counts.astype(np.int64)), *(pa.array(c, pa.binary()) for c in cells)], names=["id", "h", "held", "lang", "n", "word", "prefix"])


def _packed(rows: pa.Table, known: pa.Table) -> pa.Table:
    """A shard's labelled rows as one row, in an order that does not depend on how they came. known: (id, y) of these."""
    at = pc.index_in(rows.column("id"), value_set=known.column("id").combine_chunks())
    rows = rows.append_column("y", known.column("y").take(at)).filter(pc.is_valid(at)).sort_by([("h", "ascending"), ("n", "ascending"), ("y", "ascending")])
    numbers = [rows.column(c).to_numpy().astype(t).tobytes() for c, t in (("held", "u1"), ("y", "u1"), ("lang", "u1"), ("n", "<i8"))]
    cells = [b"".join(rows.column(c).to_pylist()) for c in ("word", "prefix")]
    return pa.table([rows.column("shard").slice(0, 1), *(pa.array([x] * min(1, rows.num_rows), pa.binary()) for x in (*numbers, *cells))], names=["shard", "held", "y", "lang", "n", "word", "prefix"])


def _unpacked(shard: dict, held: bool) -> tuple[list, np.ndarray, np.ndarray]:
    """(rows, labels, language groups) of a shard that are kept from fitting, or that are not."""
    own = {c: np.frombuffer(shard[c], t) for c, t in (("held", "u1"), ("y", "u1"), ("lang", "u1"), ("n", "<i8"), ("word", "<u2"), ("prefix", "<u2"))}
    word, prefix, begin = _padded(own["word"], own["prefix"].astype(np.int32) + BUCKETS, own["n"])
    use = np.flatnonzero(own["held"] == held)
    return [(word[a:b], prefix[a:b]) for a, b in zip(begin[use], begin[use] + own["n"][use] + _PAD, strict=True)], own["y"][use].astype(np.float32), own["lang"][use]


def _round(shards: DataFrame, state: _State, share: float, number: int) -> list:
    """How an epoch of each shard moves the weights, on the average. Rows by block of embeddings; -1 has the dense weights."""
    spark = shards.sparkSession
    sent = spark.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard = batch.slice(k, 1).to_pylist()[0]
                rows, y, _ = _unpacked(shard, False)
                if rows:
                    own = deepcopy(sent.value)
                    _epoch(own, rows, y, _balance(y, share), np.random.default_rng([7, number, shard["shard"]]).permutation(len(rows)))
                    yield _moved(sent.value, own, shard["shard"], len(rows))

    moved, at = materialise(shards.mapInArrow(run, _MOVED).groupBy("block").applyInArrow(_mean, _MOVED), "toxicity_round")
    found = moved.collect()
    remove(spark, at)
    sent.destroy()
    return found


def _moved(before: _State, after: _State, shard: int, n: int) -> pa.RecordBatch:
    ids = np.flatnonzero(after.squares != before.squares)
    change = np.concatenate([after.model.embed[ids] - before.model.embed[ids], (after.squares[ids] - before.squares[ids])[:, None]], axis=1)
    blocks = np.unique(ids // _BLOCK)
    cells = [(-1, b"", after.vector().tobytes())] + [(int(b), ids[ids // _BLOCK == b].astype("<i4").tobytes(), change[ids // _BLOCK == b].tobytes()) for b in blocks]
    rows = [{"block": b, "shard": shard, "n": n, "t": after.dense[0].t, "ids": i, "moved": x} for b, i, x in cells]
    return pa.RecordBatch.from_pylist(rows, pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("t", pa.int64()), ("ids", pa.binary()), ("moved", pa.binary())]))


def _mean(rows: pa.Table) -> pa.Table:
    """The mean of the dense weights by rows, or of each embedding over the shards that moved it."""
    rows = rows.sort_by("shard")
    each = rows.to_pylist()
    n, t = sum(r["n"] for r in each), max(r["t"] for r in each)
    if each[0]["block"] < 0:
        ids, mean = b"", sum(np.frombuffer(r["moved"], np.float32).astype(np.float64) * (r["n"] / n) for r in each)
    else:
        total, times = np.zeros((_BLOCK, DIM + 1)), np.zeros(_BLOCK)
        for r in each:
            at = np.frombuffer(r["ids"], "<i4") % _BLOCK
            total[at] += np.frombuffer(r["moved"], np.float32).reshape(-1, DIM + 1)
            times[at] += 1
        at = np.flatnonzero(times)
        ids, mean = (at + each[0]["block"] * _BLOCK).astype("<i4").tobytes(), total[at] / times[at][:, None]
    one = {"block": each[0]["block"], "shard": -1, "n": n, "t": t, "ids": ids, "moved": mean.astype(np.float32).tobytes()}
    return pa.Table.from_pylist([one], rows.schema)


def _average(state: _State, moved: list) -> None:
    for r in moved:
        values = np.frombuffer(bytes(r["moved"]), np.float32)
        if r["block"] < 0:
            state.take(values, r["t"])
        else:
            ids, change = np.frombuffer(bytes(r["ids"]), "<i4"), values.reshape(-1, DIM + 1)
            state.model.embed[ids] += change[:, :DIM]
            state.squares[ids] += change[:, DIM]


def _held_counts(shards: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(raw logit, language group, label, rows) of all rows that were kept from fitting, counted by steps of the logit."""
    sent = shards.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, y, lang = _unpacked(batch.slice(k, 1).to_pylist()[0], True)
                step = np.round(np.clip(_raw(sent.value, rows), -60, 60) * STEPS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (step, lang, y)], names=["step", "lang", "y"])

    found = shards.mapInArrow(run, "step int, lang int, y int").groupBy("step", "lang", "y").agg(F.count("*").alias("n")).toArrow()
    sent.destroy()
    step, lang, y, n = (found.column(c).to_numpy() for c in ("step", "lang", "y", "n"))
    return step / STEPS, lang, y.astype(np.float64), n.astype(np.float64)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (score of THRESHOLD or more). No shuffle."""
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)
    base = docs.drop("score", "predicted")
    at = base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.scores(data, bounds) for _, data, bounds in tv.text_slices(batch.column(at))]
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    schema = base.limit(0).withColumns({"score": F.lit(None).cast("double"), "predicted": F.lit(None).cast("int")}).schema
    return base.mapInArrow(run, schema)


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with all their columns unchanged."""
    rows, back = carried(docs, text_col)
    return back(score(rows, model).where("predicted = 0"))
