"""Personal data: base rules, and a semi-Markov conditional random field that adds spans.

Text is cut in atoms (runs of letters, runs of digits, single other characters). A region is a line's run of
blank-separated chunks that each hold a digit or an at sign; outside regions no candidate exists. Within a region the
model scores whole segments of up to MAX_ATOMS atoms: shape, number of digits, grouping, checksum, neighbours. A
segmentation's score is the sum over its segments and over neighbouring types; bounded-entity dynamic
programming finds the best one (Viterbi) and, in training, all expectations (forward-backward in logs).

Spans of the base rules are pinned: they are in the result as the rules give them, their atoms are outside every
other candidate, and the dynamic program decides about the rest. A candidate must be admissible for its type (for a
card: 13 to 19 digits and the checksum; for an address: parts of at most 255; and so on).

Training data are regions of a bounded sample of documents (`sample` rows of up to `max_chars` characters, by a hash
of id and text; regions of up to MAX_REGION atoms, of which `most` are used) with the base rules' spans as truth, and copies of them: phones without the country prefix and cards with
other separators as further truth; broken checksums and parts over 255 as counterexamples.

Cases: null and empty texts have no spans; texts are scanned whole, in time that grows with their length and not with
its square; equal rows give equal spans; without any training region (an empty table) only the base rules act; null
ids pass through; docs' own columns named base or pii are replaced.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import ship_package

# The kinds and base rules.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

MAX_ATOMS = 22
SAMPLE = 1500
MAX_CHARS = 20_000
EPOCHS = 4
#: Atoms of a region that is fitted on.
MAX_REGION = 60
_FEATURES = 1 << 12
_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|[\s\S]")
_CHUNK = re.compile(r"\S+")
_TRIGGER = re.compile("[0-9@]")


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _octets(match: str) -> bool:
    return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the base rules, by kind as listed, then start."""
    out: list[tuple[str, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _LOCAL:
            left -= 1
        host = _HOST.match(text, at + 1) if left < at else None
        done = at + 1  # a local part holds no @
        if host:
            out.append(("email", left, host.end()))
            done = host.end()
        at = text.find("@", done)
    if not _TRIGGER.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0])]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    return out + [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]


def regions(text: str) -> list[tuple[int, int]]:
    """Runs of chunks with a trigger, with single blanks between them."""
    out: list[tuple[int, int]] = []
    if not _TRIGGER.search(text):
        return out
    for m in _CHUNK.finditer(text):
        if _TRIGGER.search(m[0]):
            if out and text[out[-1][1] : m.start()] == " ":
                out[-1] = (out[-1][0], m.end())
            else:
                out.append((m.start(), m.end()))
    return out


def admissible(s: str) -> list[int]:
    """Types (1 and up, as KINDS) that a segment can have."""
    found, digits = [], _digits(s)
    if s.count("@") == 1:
        local, _, host = s.partition("@")
        if local and set(local) <= _LOCAL and _HOST.fullmatch(host):
            found.append(1)
    if digits and not re.search(r"[^0-9 ().+/-]", s):
        if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s) and _octets(s):
            found.append(2)
        if 13 <= len(digits) <= 19 and re.fullmatch(r"[0-9](?:[ .-]?[0-9])+", s) and luhn(digits):
            found.append(3)
        if 8 <= len(digits) <= 15 and re.fullmatch(r"(?:\+|\()?[0-9][0-9 ().-]*[0-9]", s) and re.search("[ ()-]", s) and s.count("(") == s.count(")"):
            found.append(4)
    return found


def _shape(s: str) -> str:
    return re.sub("[0-9]+", lambda m: f"9{min(len(m[0]), 9)}", re.sub(r"[^\W\d_]+", "a", s))


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % _FEATURES


def features(s: str, before: str, after: str) -> list[int]:
    """Slots of a whole segment's features."""
    digits = _digits(s)
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    marks = "".join(sorted(set(re.sub(r"[^\W_]", "", s))))
    names = ("bias", f"shape {_shape(s)}", f"digits {len(digits)}", f"groups {groups}", f"marks {marks}", f"first {s[0] if not s[0].isalnum() else 'x'}", f"luhn {luhn(digits)} {len(digits) >= 13}", f"before {_near(before)}", f"after {_near(after)}", f"longest {max(groups, default=0)}")
    return [_slot(n) for n in names]


def _near(c: str) -> str:
    return "" if not c else "9" if c.isdigit() else "a" if c.isalpha() else c


@dataclass
class Region:
    """Candidates of a region: for each end position the (begin, types, feature slots), and what is pinned."""

    size: int
    starts: list[int]  # character of each atom, and the end
    by_end: list[list[tuple[int, list[int], list[int]]]]
    plain: list[list[int]]  # feature slots of each atom outside entities


_NUMBER_MARKS = frozenset(" ().+/-")


def region_of(text: str, a: int, b: int, pinned: list[tuple[int, int]]) -> Region:
    """The candidates in text[a:b] that touch nothing pinned. pinned: in order of their starts."""
    atoms = [(a + m.start(), m[0]) for m in _ATOM.finditer(text[a:b])]
    starts = [p for p, _ in atoms] + [b]
    size = len(atoms)
    edges = [0] * (size + 1)  # +1 where a pinned span begins to cover atoms, -1 behind it
    for x, y in pinned:
        first, last = max(0, bisect.bisect_right(starts, x) - 1), min(size, bisect.bisect_left(starts, y))
        if last > first:
            edges[first] += 1
            edges[last] -= 1
    taken = [n > 0 for n in accumulate(edges[:size])]
    by_end: list[list] = [[] for _ in range(size + 1)]
    for i, (p, s) in enumerate(atoms):
        if not (s[0].isalnum() or s in "+(") or taken[i] or (i and atoms[i - 1][1][-1].isalnum()):
            continue
        number = mail = ip = True  # what the characters so far allow
        digits = ats = dots = 0
        for j in range(i + 1, min(size, i + MAX_ATOMS) + 1):
            if taken[j - 1]:
                break
            own = atoms[j - 1][1]
            if "0" <= own[0] <= "9":
                digits += len(own)
            else:
                number = number and own in _NUMBER_MARKS
                ip, dots = ip and own == ".", dots + (own == ".")
                ats += own == "@"
                mail = mail and (own == "@" or (own.isascii() and own[0] in _LOCAL))
            if not (number and digits <= 19 or ip and dots <= 3 or mail and ats <= 1):
                break
            if not own[-1].isalnum() or (j < size and atoms[j][1][0].isalnum()) or not (number and digits >= 8 or ip and dots == 3 or mail and ats == 1):
                continue
            found = text[p : starts[j]]
            if kinds := admissible(found):
                by_end[j].append((i, kinds, features(found, text[p - 1 : p] if p else "", text[starts[j] : starts[j] + 1])))
    plain = [[_slot(f"plain {_shape(s)}")] for _, s in atoms] if any(by_end) else []
    return Region(size, starts, by_end, plain)


class Model:
    """Weights of a segment's features by type (0: no entity) and of type pairs."""

    def __init__(self):
        self.w = np.zeros((len(KINDS) + 1, _FEATURES))
        self.t = np.zeros((len(KINDS) + 1, len(KINDS) + 1))
        self.trained = False

    def segments(self, r: Region, j: int) -> Iterator[tuple[int, int, list[int], float]]:
        """(begin, type, slots, score) of the segments that end at j."""
        yield j - 1, 0, r.plain[j - 1], float(self.w[0, r.plain[j - 1]].sum())
        for i, kinds, slots in r.by_end[j]:
            for k in kinds:
                yield i, k, slots, float(self.w[k, slots].sum())

    def decode(self, r: Region) -> list[tuple[int, int, int]]:
        """The best segmentation's entities: (type, first character, end). Ties: no entity, then the listed order.

        An atom that no candidate covers is outside entities in every segmentation, so the program runs over each
        stretch of covered atoms and the atom behind it alone.
        """
        out: list[tuple[int, int, int]] = []
        j, reach = 0, 0
        begins: dict[int, int] = {}
        for e, segs in enumerate(r.by_end):
            for i, _, _ in segs:
                begins[i] = max(e, begins.get(i, 0))
        for i in sorted(begins):
            if i <= reach and reach:
                reach = max(reach, begins[i])
                continue
            if reach:
                out += self._stretch(r, j, reach)
            j, reach = i, begins[i]
        return out + (self._stretch(r, j, reach) if reach else [])

    def _stretch(self, r: Region, a: int, b: int) -> list[tuple[int, int, int]]:
        """decode() of the atoms a to b; what stands before and behind is outside entities."""
        k, end = len(KINDS) + 1, min(r.size, b + 1)
        best = np.full((end - a + 1, k), -np.inf)
        best[0, 0] = 0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for j in range(a + 1, end + 1):
            for i, y, _, s in self.segments(r, j):
                into = best[i - a] + self.t[:, y] if i else np.where(np.arange(k) == 0, best[0], -np.inf)
                p = int(into.argmax())
                if into[p] + s > best[j - a, y]:
                    best[j - a, y] = into[p] + s
                    back[j, y] = (i, p)
        j, y, out = end, int(best[end - a].argmax()) if end == b else 0, []
        while j > a:
            i, p = back[j, y]
            if y:
                out.append((y, r.starts[i], r.starts[j]))
            j, y = i, p
        return out[::-1]

    def gradient(self, r: Region, gold: set[tuple[int, int, int]]) -> tuple[float, dict, np.ndarray]:
        """Log-likelihood of a segmentation (its entities: type, begin, end in atoms), and the gradients."""
        k = len(KINDS) + 1
        segs = [[]] + [list(self.segments(r, j)) for j in range(1, r.size + 1)]
        alpha, beta = np.full((r.size + 1, k), -np.inf), np.full((r.size + 1, k), -np.inf)
        alpha[0, 0] = 0
        for j in range(1, r.size + 1):
            for i, y, _, s in segs[j]:
                alpha[j, y] = np.logaddexp(alpha[j, y], s + (np.logaddexp.reduce(alpha[i] + self.t[:, y]) if i else 0.0))
        total = np.logaddexp.reduce(alpha[r.size])
        beta[r.size] = 0
        dw: dict[tuple[int, int], float] = {}
        dt, gold_score, last = np.zeros((k, k)), 0.0, 0
        truth = {(i, j): y for y, i, j in gold}
        inside = {x for _, i, j in gold for x in range(i, j)}
        path = sorted([(i, j, y) for (i, j), y in truth.items()] + [(x, x + 1, 0) for x in range(r.size) if x not in inside])
        on_path = set(path)
        for j in range(r.size, 0, -1):
            for i, y, slots, s in segs[j]:
                out = s + beta[j, y]
                if i:
                    link = alpha[i] + self.t[:, y] + out - total
                    p = np.exp(link)
                    dt[:, y] -= p
                    beta[i] = np.logaddexp(beta[i], self.t[:, y] + out)
                    share = p.sum()
                else:
                    share = np.exp(out - total)
                share = ((i, j, y) in on_path) - share
                for f in slots:
                    dw[y, f] = dw.get((y, f), 0.0) + share
        for i, j, y in path:
            slots = next(s for b, z, s, _ in segs[j] if (b, z) == (i, y))
            gold_score += float(self.w[y, slots].sum()) + (self.t[last, y] if i else 0.0)
            if i:
                dt[last, y] += 1
            last = y
        return gold_score - total, dw, dt


def truth_of(text: str, r: Region, spans: list[tuple[str, int, int]]) -> set[tuple[int, int, int]]:
    """Spans as entities in atoms, leftmost first without overlap; those that are no candidate are left out."""
    place = {c: i for i, c in enumerate(r.starts)}
    out, end = set(), 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        i, j, y = place.get(a), place.get(b), KINDS.index(kind) + 1
        if i is not None and j is not None and i >= end and any(i == c and y in ks for c, ks, _ in r.by_end[j]):
            out.add((y, i, j))
            end = j
    return out


def examples(text: str) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """A text's regions as texts with their base spans, and changed copies of them."""
    spans = base_spans(text)
    for a, b in regions(text):
        own = text[a:b]
        inside = [(k, x - a, y - a) for k, x, y in spans if a <= x and y <= b]
        yield own, inside
        for k, x, y in inside:
            s = own[x:y]
            if k == "phone" and (m := re.match(r"\+[0-9]{1,3}[ -]?(?=[(0-9])", s)) and 4 in admissible(s[m.end() :]):
                yield s[m.end() :], [("phone", 0, len(s) - m.end())]
            if k == "card":
                d = _digits(s)
                for sep in " -.":
                    v = sep.join(d[i : i + 4] for i in range(0, len(d), 4))
                    yield v, [("card", 0, len(v))]
                yield d[:-1] + str((int(d[-1]) + 1) % 10), []
            if k == "ip":
                yield "300" + s[s.index(".") :], []


def fit(texts: list[str], epochs: int = EPOCHS, seed: int = 5, most: int = 3000) -> Model:
    """Maximises the regions' log-likelihood by AdaGrad; at most `most` regions."""
    model, rng = Model(), np.random.default_rng(seed)
    rows = []
    for text in texts:
        for own, spans in examples(text):
            r = region_of(own, 0, len(own), [])
            if r.size <= MAX_REGION and any(r.by_end):
                rows.append((r, truth_of(own, r, spans)))
    rows = [rows[i] for i in rng.permutation(len(rows))[:most]]
    gw, gt = np.full(model.w.shape, 1e-3), np.full(model.t.shape, 1e-3)
    for _ in range(epochs if rows else 0):
        for i in rng.permutation(len(rows)).tolist():
            _, dw, dt = model.gradient(*rows[i])
            for at, g in dw.items():
                gw[at] += g * g
                model.w[at] += 0.3 * g / np.sqrt(gw[at])
            gt += dt * dt
            model.t += 0.3 * dt / np.sqrt(gt)
    model.trained = bool(rows)
    return model


def find(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans; both by kind as listed, then start."""
    base = base_spans(text)
    added = []
    if model.trained:
        pinned = sorted((a, b) for _, a, b in base)
        first = 0  # spans before `first` end before every region to come
        for a, b in regions(text):
            while first < len(pinned) and pinned[first][1] <= a:
                first += 1
            last = first
            while last < len(pinned) and pinned[last][0] < b:
                last += 1
            near = [(x, y) for x, y in pinned[first:last] if y > a]
            if len(near) == 1 and near[0][0] <= a + 1 and near[0][1] >= b - 1:
                continue
            r = region_of(text, a, b, near)
            if r.plain:
                added += [(KINDS[y - 1], x, z) for y, x, z in model.decode(r)]
    order = lambda s: (KINDS.index(s[0]), s[1], s[2])
    return base, sorted(base + added, key=order)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, max_chars: int = MAX_CHARS) -> Model:
    """Fits on at most `sample` distinct texts, about, that hold a digit or an at sign, chosen by a hash of id and text."""
    some = docs.where((F.length(text_col) <= max_chars) & F.col(text_col).rlike("[0-9@]")).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))
    n = some.count()
    span = 1_000_003
    dice = F.pmod(F.xxhash64("id", "t", F.lit("pii")), F.lit(span))
    chosen = some.withColumn("dice", dice).where(F.col("dice") < int(span * min(1.0, sample / max(1, n))))
    rows = chosen.orderBy("dice", "id").limit(sample + sample // 10).select("t").collect()
    return fit(sorted({r["t"] for r in rows}))


def find_pii(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with `base` and `pii`: the spans of the base rules, and all spans. No shuffle."""
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)
    kept = docs.drop("base", "pii")
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                both = [find(t or "", held.value) for t in part.column(at).to_pylist()]
                cols = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x[w]] for x in both], _SPANS) for w in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*part.schema.names, "base", "pii"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    return kept.mapInArrow(run, kept.limit(0).withColumns({"base": F.lit(None).cast(kind), "pii": F.lit(None).cast(kind)}).schema)


def digest(found: DataFrame) -> DataFrame:
    """find_pii()'s rows with counts of the base spans, base_sha256 and spans."""

    def join(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = {f"n_{k}": (F.size("base") - F.size(F.array_remove("base.kind", k))).cast("long") for k in KINDS}
    return found.withColumns(counts | {"base_sha256": F.sha2(join("base"), 256), "spans": join("pii")}).drop("base", "pii")
