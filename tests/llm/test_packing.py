import random
import struct
import unicodedata
import zlib
from collections import Counter
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import packing as pk


def optimum(items, capacity):
    items = tuple(sorted(items, reverse=True))

    @cache
    def best(i, rests):
        if i == len(items):
            return 0
        n, tried = 1 + best(i + 1, tuple(sorted((*rests, capacity - items[i])))), set()
        for k, r in enumerate(rests):
            if r >= items[i] and r not in tried:
                tried.add(r)
                n = min(n, best(i + 1, tuple(sorted((*rests[:k], r - items[i], *rests[k + 1 :])))))
        return n

    return best(0, ())


def spread(patterns):
    return Counter(n for p, k in patterns for n in p for _ in range(k))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_keeps_the_optimum(items):
    fixed, rest = pk.reduce_dominated(dict(Counter(items)), 20)
    left = [n for n, c in rest.items() for _ in range(c)]
    assert spread(fixed) + Counter(left) == Counter(items)
    assert sum(k for _, k in fixed) + optimum(left, 20) == optimum(items, 20)


def one_by_one(items, capacity):
    bins = []
    for n in sorted(items, reverse=True):
        fits = [k for k, r in enumerate(bins) if r >= n]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_bulk_is_best_fit_decreasing(items):
    got = pk.best_fit(dict(Counter(items)), 30)
    assert spread(got) == Counter(items)
    assert sorted(30 - sum(p) for p, k in got for _ in range(k)) == one_by_one(items, 30)


def test_places():
    places = pk.Places([((5, 5, 2), 2), ((5,), 1), ((2, 2), 3)])
    fives = [places.place(5, r) for r in range(5)]
    twos = [places.place(2, r) for r in range(8)]
    assert fives == [(0, 0), (0, 5), (1, 0), (1, 5), (2, 0)]
    assert twos == [(0, 10), (1, 10), (3, 0), (3, 2), (4, 0), (4, 2), (5, 0), (5, 2)]


TEXTS = ["", "Hello, World's 3 IDs!", "ÉCOLE déjà vu…", "é combining", "ΣΑΣ İi", "<|endoftext|> x", "日本語 テスト 한국어", "a\x1c b\x85c d", "don't WE'LL ''s 'S", "😀😀 x²½", "​ zero­width"]


def test_tokenizer_is_the_tokenizer():
    from tokenizers import Tokenizer

    own, plain = pk.WordTokenizer(pk.default_tokenizer(), cache_words=5), Tokenizer.from_file(pk.default_tokenizer())
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("aB'sé ßÑ\n9.-!ǅﬁ") for _ in range(60)) for _ in range(300)]
    for t in texts:
        ids = plain.encode(t, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids)}I", own.encode(t))) == ids, t


@pytest.mark.parametrize("rows", [[], [(1, t, "clash") for t in TEXTS] + [(1, "dup", "c"), (1, "dup", "c"), (2, None, "c"), (None, "word " * 9000, "c")] + [(k, "same words here", "c") for k in range(3000)]])
def test_query(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    got = pk.pack_documents(df).collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(pk.default_tokenizer())
    want = Counter()
    for i, t, _ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            own = ids[k : k + 4096]
            want[i, k // 4096, k, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 4096) + 1


def test_every_code_point():
    """The ids of each code point in a word, between words and beside a digit are the tokenizer's own."""
    own = pk.WordTokenizer(pk.default_tokenizer())
    rare = lambda c: 0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4 or c >= 0xE000  # noqa: E731  long runs of one class, of which edges and a part are tried
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (not rare(c) or c % 16 in (0, 15) or 0x1E000 <= c < 0x20000 or 0xF900 <= c < 0x10000 or unicodedata.category(chr(c)) != unicodedata.category(chr(c - 1)) or unicodedata.category(chr(c)) != unicodedata.category(chr(min(c + 1, 0x10FFFF))))]
    texts = [f"a{chr(c)}b {chr(c)}1" for c in points]
    wrong = []
    for at in range(0, len(texts), 20_000):
        some = texts[at : at + 20_000]
        for text, e in zip(some, own.words.tokenizer.encode_batch(some, add_special_tokens=False), strict=True):
            if own.encode(text) != struct.pack(f"<{len(e.ids)}I", *e.ids):
                wrong.append(text)
    assert not wrong
