"""Secret scans: all rules as one automaton, one pass over each text's bytes.

The combined automaton finds where matches of any rule are first complete. Only texts with such a place are looked at again, rule by
rule, with two small automata for the exact leftmost-longest matches. Then each rule's condition applies: a
match that fails it is dropped and not tried again. (Bounds on a length are conditions, not repeat counts: a count of a
class in which the rule can begin anew would multiply the states of the subset construction.) Spans are code points, end exclusive.

Cases: null and empty texts have no spans; texts of any length are scanned whole; kinds may overlap one another;
equal spans of two kinds are both reported; repeated rows give equal spans; an empty table gives none; null ids pass
through; redact() returns docs' own columns, whatever their names, find_secrets() replaces one named secrets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import automaton as am
from lexloom.llm import textvec as tv
from lexloom.llm.rows import carried
from lexloom.session import ship_package


@dataclass(frozen=True)
class Rule:
    """least: characters of the match, or of what follows `behind` in it (a pattern that a match begins with)."""

    kind: str
    pattern: str
    fold: bool = False
    least: int = 1
    behind: str = ""


_KEYWORD = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
# The base rules, then those that the method adds.
BASE = (
    Rule("assign", _KEYWORD + "[A-Za-z0-9+/_.=\\-]+", True, 8, _KEYWORD),
    Rule("access", "AKIA[A-Z0-9]+", least=16),
    Rule("hex", "[0-9a-f]{32,}", least=32),  # a whole run of such characters or none of it, so the bound can be in the rule
)
ADDED = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9\\-]+", least=15),
    Rule("google", "AIza[A-Za-z0-9_\\-]+", least=39),
    Rule("jwt", "eyJ[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]+", least=30),
    Rule("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("stripe", "[sr]k_(live|test)_[A-Za-z0-9]+", least=24),
)
RULES = BASE + ADDED
MARK = "[SECRET]"


class Scanner:
    """The compiled rules; built once a process."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        plain = [(r.pattern, r.fold) for r in rules]
        self.all = am.compile_rules(plain, shortest=True)
        self.forward = [am.compile_rules([p], search=False) for p in plain]
        self.backward = [am.compile_rules([p], backward=True) for p in plain]
        self.behind = [am.compile_rules([(r.behind, r.fold)], search=False) if r.behind else None for r in rules]

    def _length(self, k: int, match: bytes) -> int:
        """What the rule's bound counts."""
        head = self.behind[k]
        if head is None:
            return len(match)
        state, used = 0, 0
        for i, b in enumerate(match):
            state = head.rows[state][b]
            if state == head.dead:
                break
            if head.masks[state]:
                used = i + 1
        return len(match) - used

    def spans(self, data: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """By text the (rule, start, end) of its matches, by start, then rule; texts without any are left out."""
        at, masks = am.accepting_positions(self.all, data)
        found: dict[int, int] = {}
        for text, mask in zip((np.searchsorted(bounds, at - 1, side="right") - 1).tolist(), masks.tolist(), strict=True):
            found[text] = found.get(text, 0) | mask
        out = {}
        for text, mask in found.items():
            raw = data[bounds[text] : bounds[text + 1] - 1].tobytes()
            spans = [
                (k, a, b)
                for k, r in enumerate(self.rules)
                if mask >> k & 1
                for a, b in am.leftmost_longest(self.forward[k], self.backward[k], raw)
                if self._length(k, raw[a:b]) >= r.least
            ]
            if spans:
                out[text] = sorted(_code_points(raw, spans), key=lambda s: (s[1], s[0]))
        return out


def _code_points(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if raw.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)])
    return [(k, int(before[a]), int(before[b])) for k, a, b in spans]


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """This process's scanner of these rules."""
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with `secrets`: the spans of each text, by start, then kind as listed. No shuffle."""
    ship_package(docs.sparkSession)
    base = docs.drop("secrets")
    at = base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        for batch in batches:
            rows: list[list[dict]] = []
            for _, data, bounds in tv.text_slices(batch.column(at)):
                found = scan.spans(data, bounds)
                rows += [[{"kind": rules[k].kind, "start": a, "end": b} for k, a, b in found.get(i, ())] for i in range(bounds.size - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _SPANS)], names=[*batch.schema.names, "secrets"])

    schema = base.limit(0).withColumn("secrets", F.lit(None).cast("array<struct<kind:string,start:long,end:long>>")).schema
    return base.mapInArrow(run, schema)


def digest(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """find_secrets()'s rows with counts of the base kinds, base_sha256 and spans."""
    names = [r.kind for r in base]

    def join(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    own = F.filter("secrets", lambda s: s["kind"].isin(*names))
    counts = {f"n_{k}": (F.size("secrets") - F.size(F.array_remove("secrets.kind", k))).cast("long") for k in names}
    return found.withColumns(counts | {"base_sha256": F.sha2(join(own), 256), "spans": join(F.col("secrets"))}).drop("secrets")


def redact(docs: DataFrame, text_col: str = "text", mark: str = MARK, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every secret in the text replaced by a mark; overlapping spans by one. Other texts, and all other columns, are unchanged."""
    rows, back = carried(docs, text_col)
    text = F.col("text")
    merged = F.aggregate(
        "secrets",
        F.array().cast("array<struct<start:long,end:long>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] < F.element_at(acc, -1)["end"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    last = F.lit(0).cast("long")
    pieces = F.aggregate(
        merged,
        F.struct(F.lit("").alias("out"), last.alias("at")),
        lambda acc, s: F.struct(F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mark)).alias("out"), s["end"].alias("at")),
    )
    clean = F.concat(pieces["out"], F.substring(text, pieces["at"].cast("int") + 1, F.length(text)))
    return back(find_secrets(rows, "text", rules).withColumn("text", F.when(F.size("secrets") > 0, clean).otherwise(text)))
