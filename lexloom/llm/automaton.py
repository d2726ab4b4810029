"""Regular expressions as one minimal deterministic automaton over bytes.

`compile_rules` parses each rule, builds one nondeterministic automaton of all (Thompson), makes it deterministic by
subset construction with a self-loop at the start (a search automaton), and minimises it by Hopcroft's
partition refinement. The result is arrays: next state by state and byte, and a bit mask of the rules that a
state accepts. Syntax: literals, escapes, classes, groups, |, *, +, ?, {m}, {m,}, {m,n}; bytes, ASCII only.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import cached_property

import numpy as np

_ESCAPES = {"n": 10, "r": 13, "t": 9, "f": 12, "v": 11}
_CLASSES = {"d": range(48, 58), "w": [*range(48, 58), *range(65, 91), 95, *range(97, 123)], "s": [9, 10, 11, 12, 13, 32]}


class _Parser:
    """Syntax tree of a rule: ('set', frozenset), ('cat', [..]), ('alt', [..]), ('rep', node, least, most or None)."""

    def __init__(self, rule: str, fold: bool):
        self.s, self.i, self.fold = rule, 0, fold

    def parse(self):
        node = self.alternatives()
        if self.i != len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} in {self.s!r}")
        return node

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def alternatives(self):
        found = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            found.append(self.sequence())
        return found[0] if len(found) == 1 else ("alt", found)

    def sequence(self):
        found = []
        while self.peek() not in ("", "|", ")"):
            found.append(self.repeated())
        return ("cat", found)

    def repeated(self):
        node = self.atom()
        while (c := self.peek()) and c in "*+?{":
            self.i += 1
            if c == "{":
                end = self.s.index("}", self.i)
                low, comma, high = self.s[self.i : end].partition(",")
                self.i = end + 1
                node = ("rep", node, int(low), (int(high) if high else None) if comma else int(low))
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def atom(self):
        c = self.peek()
        self.i += 1
        if c == "(":
            node = self.alternatives()
            if self.peek() != ")":
                raise ValueError(f"unclosed group in {self.s!r}")
            self.i += 1
            return node
        if c == "[":
            return ("set", self.char_class())
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        return ("set", self.folded(self.escape() if c == "\\" else {ord(c)}))

    def escape(self) -> set[int]:
        c = self.peek()
        self.i += 1
        if c == "x":
            self.i += 2
            return {int(self.s[self.i - 2 : self.i], 16)}
        if c in _CLASSES:
            return set(_CLASSES[c])
        return {_ESCAPES.get(c, ord(c))}

    def char_class(self) -> frozenset[int]:
        negated = self.peek() == "^"
        self.i += negated
        found: set[int] = set()
        first = True
        while first or self.peek() != "]":
            first = False
            c = self.peek()
            self.i += 1
            one = self.escape() if c == "\\" else {ord(c)}
            if self.peek() == "-" and self.s[self.i + 1 : self.i + 2] not in ("]", "") and len(one) == 1:
                self.i += 1
                c = self.peek()
                self.i += 1
                (last,) = self.escape() if c == "\\" else {ord(c)}
                one = set(range(min(one), last + 1))
            found |= one
        self.i += 1
        found = set(self.folded(found))
        return frozenset(range(256)) - found if negated else frozenset(found)

    def folded(self, of) -> frozenset[int]:
        if not self.fold:
            return frozenset(of)
        both = set(of)
        for b in of:
            if 65 <= b < 91:
                both.add(b + 32)
            elif 97 <= b < 123:
                both.add(b - 32)
        return frozenset(both)


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.empty) - 1

    def build(self, node, at: int) -> int:
        """Adds node from state `at`; the state behind it."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.step[here := self.state()] = (node[1], end)
            self.empty[at].append(here)
            return end
        if kind == "cat":
            for x in node[1]:
                at = self.build(x, at)
            return at
        if kind == "alt":
            end = self.state()
            for x in node[1]:
                self.empty[self.build(x, self._from(at))].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            at = self.build(inner, at)
        if high is None:
            loop = self._from(at)
            self.empty[self.build(inner, loop)].append(loop)
            end = self.state()
            self.empty[loop].append(end)
            return end
        end = self.state()
        self.empty[at].append(end)
        for _ in range(high - low):
            at = self.build(inner, self._from(at))
            self.empty[at].append(end)
        return end

    def _from(self, at: int) -> int:
        self.empty[at].append(s := self.state())
        return s

    def closure(self, states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """next[state, byte]; accepts[state]: bit k for rule k. State 0 is the start."""

    next: np.ndarray
    accepts: np.ndarray
    dead: int  # the state that nothing leaves and that accepts nothing, or -1

    @cached_property
    def rows(self) -> list[list[int]]:
        """next as lists, for single steps."""
        return self.next.tolist()

    @cached_property
    def masks(self) -> list[int]:
        """accepts as a list."""
        return self.accepts.tolist()


def _determine(nfa: _Nfa, start: list[int], ends: dict[int, int], search: bool) -> tuple[list[list[int]], list[int]]:
    """Subset construction. ends: rule by final state; search: begin anew at each byte."""
    root = nfa.closure(start)
    number, todo, table, masks = {root: 0}, [root], [], []
    while len(table) < len(todo):
        now = todo[len(table)]
        moves: dict[int, set[int]] = defaultdict(set)
        for s in now:
            if nfa.step[s]:
                on, to = nfa.step[s]
                for b in on:
                    moves[b].add(to)
        row, known = [], {}
        for b in range(256):
            key = frozenset(moves.get(b, ()))
            if key not in known:
                target = nfa.closure(key) | (root if search else frozenset())
                if target not in number:
                    number[target] = len(todo)
                    todo.append(target)
                known[key] = number[target]
            row.append(known[key])
        table.append(row)
        masks.append(sum({1 << ends[s] for s in now if s in ends}))
    return table, masks


def _minimise(table: list[list[int]], masks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hopcroft: splits blocks of states until all states of a block go to the same blocks."""
    n = len(table)
    back: list[dict[int, set[int]]] = [defaultdict(set) for _ in range(256)]
    for s, row in enumerate(table):
        for b, t in enumerate(row):
            back[b][t].add(s)
    distinct = [b for b in range(256) if b == 0 or back[b] != back[b - 1]]
    groups: dict[int, set[int]] = defaultdict(set)
    for s in range(n):
        groups[masks[s]].add(s)
    blocks = list(groups.values())
    of = {s: k for k, g in enumerate(blocks) for s in g}
    todo = set(range(len(blocks)))
    while todo:
        splitter = set(blocks[todo.pop()])
        for b in distinct:
            into = set().union(*(back[b].get(t, ()) for t in splitter))
            touched: dict[int, set[int]] = defaultdict(set)
            for s in into:
                touched[of[s]].add(s)
            for k, part in touched.items():
                if len(part) == len(blocks[k]):
                    continue
                rest = blocks[k] - part
                small, large = (part, rest) if len(part) <= len(rest) else (rest, part)
                blocks[k] = large
                blocks.append(small)
                for s in small:
                    of[s] = len(blocks) - 1
                todo.add(len(blocks) - 1)
                if k in todo:
                    todo.add(k)
    order = [of[0], *(k for k in range(len(blocks)) if k != of[0])]
    place = {k: i for i, k in enumerate(order)}
    one = [next(iter(blocks[k])) for k in order]
    nxt = np.array([[place[of[t]] for t in table[s]] for s in one], dtype=np.int32)
    return nxt, np.array([masks[s] for s in one], dtype=np.int64)


def _reverse(node):
    kind = node[0]
    if kind == "cat":
        return ("cat", [_reverse(x) for x in reversed(node[1])])
    if kind == "alt":
        return ("alt", [_reverse(x) for x in node[1]])
    return ("rep", _reverse(node[1]), *node[2:]) if kind == "rep" else node


def _shortest(node):
    """A language whose words begin every word of node's: an open repeat at the end stops at its least count."""
    kind = node[0]
    if kind == "cat" and node[1]:
        return ("cat", [*node[1][:-1], _shortest(node[1][-1])])
    if kind == "rep" and node[2] > 0:
        return ("rep", node[1], node[2], node[2])
    return node


def compile_rules(rules: list[tuple[str, bool]], search: bool = True, backward: bool = False, shortest: bool = False) -> Automaton:
    """The minimal automaton of all rules (pattern, either case).

    search: a match may begin at any byte. shortest: accept where a match is first complete, not where it may go on;
    the same texts are accepted, and there is no state for being inside the open end of several rules at once.
    """
    nfa, ends, starts = _Nfa(), {}, []
    for k, (rule, fold) in enumerate(rules):
        tree = _Parser(rule, fold).parse()
        tree = _shortest(tree) if shortest else tree
        starts.append(at := nfa.state())
        ends[nfa.build(_reverse(tree) if backward else tree, at)] = k
    nxt, accepts = _minimise(*_determine(nfa, starts, ends, search))
    still = np.flatnonzero((nxt == np.arange(nxt.shape[0])[:, None]).all(axis=1) & (accepts == 0))
    return Automaton(nxt, accepts, int(still[0]) if still.size else -1)


def accepting_positions(a: Automaton, data: np.ndarray, lane: int = 512, few: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Positions behind which the automaton accepts, and the masks, ascending: one pass over the bytes.

    The bytes are cut in lanes that all step at once. A lane first assumes the start state; lanes whose true entry
    state (the exit state of the lane before) differs run again until none does, so the result is that of one
    pass from left to right.
    """
    n = data.size
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n <= few:  # too little for lanes to pay
        return _one_by_one(a, data)
    lanes = -(-n // lane)
    grid = np.zeros(lanes * lane, dtype=np.uint8)
    grid[:n] = data
    grid = grid.reshape(lanes, lane)
    flat, accept = a.next.astype(np.int32).ravel(), a.accepts != 0
    entry = np.zeros(lanes, dtype=np.int32)
    leave = np.zeros(lanes, dtype=np.int32)
    todo = np.arange(lanes)
    rounds = np.zeros(lanes, dtype=np.int32)  # the last round of a lane counts
    marks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    turn = 0
    while todo.size:
        turn += 1
        rounds[todo] = turn
        columns = np.ascontiguousarray(grid[todo].T).astype(np.int32)
        state = entry[todo]
        for k in range(lane):
            state = flat[(state << 8) + columns[k]]
            hit = np.flatnonzero(accept[state])
            if hit.size:
                marks.append((todo[hit], np.full(hit.size, turn, np.int32), np.stack([todo[hit] * lane + k + 1, a.accepts[state[hit]]])))
        leave[todo] = state
        true = np.concatenate([[0], leave[:-1]]).astype(np.int32)
        todo = np.flatnonzero(true != entry)
        entry = true
    if marks:
        which, when = np.concatenate([m[0] for m in marks]), np.concatenate([m[1] for m in marks])
        both = np.concatenate([m[2] for m in marks], axis=1)[:, rounds[which] == when]
        both = both[:, both[0] <= n]
        both = both[:, np.argsort(both[0], kind="stable")]
        return both[0], both[1]
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


def _one_by_one(a: Automaton, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, masks = a.rows, a.masks
    state, at, found = 0, [], []
    for i, b in enumerate(data.tolist()):
        state = rows[state][b]
        if masks[state]:
            at.append(i + 1)
            found.append(masks[state])
    return np.array(at, dtype=np.int64), np.array(found, dtype=np.int64)


def leftmost_longest(forward: Automaton, backward: Automaton, data: bytes) -> list[tuple[int, int]]:
    """Matches of one rule, leftmost first, each as long as it can be, without overlap.

    backward (a search automaton of the reversed rule) marks where a match can begin; forward runs from there.
    """
    ends, _ = accepting_positions(backward, np.frombuffer(data, dtype=np.uint8)[::-1])
    out, at = [], 0
    for start in (len(data) - ends[::-1]).tolist():
        if start < at:
            continue
        state, end = 0, -1
        for i in range(start, len(data)):
            state = forward.rows[state][data[i]]
            if state == forward.dead:
                break
            if forward.masks[state]:
                end = i + 1
        if end > start:
            out.append((start, end))
            at = end
    return out
