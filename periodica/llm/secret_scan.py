"""Secret scans with one combined deterministic automaton.

Rules are regular expressions over bytes. Each is parsed to an NFA; all rules together, with a loop on
the start state, become one DFA by subset construction, which partition refinement minimises and stores
as a flat transition array over byte classes. One pass over a text's bytes runs that array. Where it
meets an accepting state, the rule's small anchored automata (the reversed one from the end, the forward
one from the start) give the exact leftmost-longest span. Automata are compiled once on the driver and
travel with the task; their size depends on the rules alone.

Rules: the three base kinds, then token formats with a fixed prefix. A rule may ask a least length of its
last run (`tail`) or of the whole match (`least`): matches that fail it are dropped, as spans they
have covered stay covered.

Edge cases: null and empty texts have no spans; offsets are code points, end exclusive; an invalid
byte sequence can't occur in a Spark string; repeated rows each get their own result; spans of one start come in
the order of the kinds; an empty table gives no rows; a very long text takes time in proportion to
its bytes, however many secrets it holds; other columns keep their names in
`redact` and are not read in `find_secrets`.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import as_bytes, id_text, own


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # of the whole match
    tail: str = ""  # characters of the last run,
    tail_least: int = 0  # which must be so long


# The three base kinds of the contract, and public token formats.
BASE = (
    Rule("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", tail="assign", tail_least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}", least=24),
)
MORE = (
    Rule("hub", r"gh[opusr]_[A-Za-z0-9]+", least=40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE


class Nfa:
    """Thompson's construction; an edge is (byte set or None, state)."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset | None, int]]] = []

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def link(self, a: int, b: int, on: frozenset | None = None) -> None:
        self.edges[a].append((on, b))

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for on, b in self.edges[todo.pop()]:
                if on is None and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return frozenset(seen)


def parse(pattern: str):
    """A tree of ("set", bytes), ("cat", parts), ("or", parts) and ("rep", part, low, high or None)."""
    at = 0

    def char() -> int:
        nonlocal at
        if pattern[at] != "\\":
            at += 1
            return ord(pattern[at - 1])
        if pattern[at + 1] == "x":
            at += 4
            return int(pattern[at - 2 : at], 16)
        at += 2
        return ord(pattern[at - 1])

    def choice():
        nonlocal at
        parts = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence():
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            parts.append(repeated())
        return ("cat", parts)

    def repeated():
        nonlocal at
        part = atom()
        while at < len(pattern) and pattern[at] in "?*+{":
            mark = pattern[at]
            if mark == "{":
                end = pattern.index("}", at)
                low, comma, high = pattern[at + 1 : end].partition(",")
                part = ("rep", part, int(low), int(high) if high else None if comma else int(low))
                at = end + 1
            else:
                part = ("rep", part, int(mark == "+"), 1 if mark == "?" else None)
                at += 1
        return part

    def atom():
        nonlocal at
        if pattern[at] == "(":
            at += 1
            inner = choice()
            at += 1
            return inner
        if pattern[at] == "[":
            at += 1
            members: set[int] = set()
            while pattern[at] != "]":
                low = char()
                high = low
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    high = char()
                members.update(range(low, high + 1))
            at += 1
            return ("set", frozenset(members))
        return ("set", frozenset([char()]))

    return choice()


def reverse(tree):
    kind = tree[0]
    if kind == "cat":
        return ("cat", [reverse(x) for x in reversed(tree[1])])
    if kind == "or":
        return ("or", [reverse(x) for x in tree[1]])
    return ("rep", reverse(tree[1]), *tree[2:]) if kind == "rep" else tree


def build(nfa: Nfa, tree, start: int) -> int:
    """Adds the tree from start on; returns its end state."""
    kind = tree[0]
    if kind == "set":
        end = nfa.state()
        nfa.link(start, end, tree[1])
        return end
    if kind == "cat":
        for part in tree[1]:
            start = build(nfa, part, start)
        return start
    if kind == "or":
        end = nfa.state()
        for part in tree[1]:
            first = nfa.state()
            nfa.link(start, first)
            nfa.link(build(nfa, part, first), end)
        return end
    _, part, low, high = tree
    for _ in range(low):
        start = build(nfa, part, start)
    if high is None:
        loop, end = nfa.state(), nfa.state()
        nfa.link(start, loop)
        nfa.link(build(nfa, part, loop), loop)
        nfa.link(loop, end)
        return end
    end = nfa.state()
    nfa.link(start, end)
    for _ in range(high - low):
        start = build(nfa, part, start)
        nfa.link(start, end)
    return end


@dataclass(frozen=True)
class Dfa:
    """classes: byte to class. step: next row offset by row offset + class; rows from `accepting` on accept, with the rules in accepts."""

    classes: bytes
    width: int
    step: tuple[int, ...]
    start: int
    accepting: int
    accepts: dict
    dead: int


def determinise(nfa: Nfa, start: int, ends: dict[int, int], anywhere: bool) -> Dfa:
    """Subset construction, minimisation, and states sorted so that accepting ones come last."""
    sets = list(dict.fromkeys(on for out in nfa.edges for on, _ in out if on is not None))
    signature = [tuple(b in s for s in sets) for b in range(256)]
    kinds = list(dict.fromkeys(signature))
    classes = bytes(kinds.index(s) for s in signature)
    k = len(kinds)
    holds = [[kinds[c][i] for c in range(k)] for i in range(len(sets))]
    number = {s: i for i, s in enumerate(sets)}

    first = nfa.closure([start])
    names, order, rows = {first: 0}, [first], []
    for here in order:
        moves: list[set[int]] = [set(first) if anywhere else set() for _ in range(k)]
        for a in here:
            for on, b in nfa.edges[a]:
                if on is not None:
                    for c in range(k):
                        if holds[number[on]][c]:
                            moves[c].add(b)
        row = []
        for move in moves:
            to = nfa.closure(move)
            if to not in names:
                names[to] = len(order)
                order.append(to)
            row.append(names[to])
        rows.append(row)
    table = np.array(rows, np.int64)
    marks = [frozenset(ends[x] for x in s if x in ends) for s in order]

    group = np.unique([sum(1 << r for r in m) for m in marks], return_inverse=True)[1].astype(np.int64)
    while True:  # Moore's refinement: states stay together while all their moves lead to the same groups
        _, finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    one = {int(g): i for i, g in reversed(list(enumerate(group)))}
    ordered = sorted(one, key=lambda g: (bool(marks[one[g]]), g))
    place = {g: i for i, g in enumerate(ordered)}
    step = tuple(place[int(group[table[one[g], c]])] * k for g in ordered for c in range(k))
    dead = next((i for i, g in enumerate(ordered) if not marks[one[g]] and all(step[i * k + c] == i * k for c in range(k))), -1)
    return Dfa(classes, k, step, place[int(group[0])] * k, sum(not marks[one[g]] for g in ordered) * k, {place[g] * k: tuple(sorted(marks[one[g]])) for g in ordered if marks[one[g]]}, dead * k)


def _alone(tree) -> Dfa:
    nfa = Nfa()
    start = nfa.state()
    return determinise(nfa, start, {build(nfa, tree, start): 0}, anywhere=False)


@functools.lru_cache(maxsize=4)
def compile_rules(rules: tuple[Rule, ...] = RULES):
    """(combined automaton, forward automaton of each rule, reversed one of each)."""
    nfa = Nfa()
    start = nfa.state()
    ends, trees = {}, [parse(r.pattern) for r in rules]
    for i, tree in enumerate(trees):
        first = nfa.state()
        nfa.link(start, first)
        ends[build(nfa, tree, first)] = i
    return determinise(nfa, start, ends, anywhere=True), [_alone(t) for t in trees], [_alone(reverse(t)) for t in trees]


def furthest(dfa: Dfa, classes: bytes, places: range) -> int:
    """How many places, taken in order, the anchored automaton accepts at most; 0 for none. classes is the text as dfa's byte classes."""
    s, best, step, accepting, dead = dfa.start, 0, dfa.step, dfa.accepting, dfa.dead
    for n, i in enumerate(places, 1):
        s = step[s + classes[i]]
        if s >= accepting:
            best = n
        elif s == dead:
            break
    return best


def _passes(rule: Rule, match: bytes) -> bool:
    if len(match) < rule.least:
        return False
    if rule.tail == "assign":
        # The value follows the first : or = of the match, with its blanks and one quote.
        cutat = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
        value = match[cutat + 1 :].lstrip(b" ")
        return len(value[1:] if value[:1] in (b'"', b"'") else value) >= rule.tail_least
    return True


def spans_of(data: bytes, compiled, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, end, rule number) in bytes, by start, then rule."""
    scan, forward, backward = compiled
    s, step, accepting, accepts = scan.start, scan.step, scan.accepting, scan.accepts
    ends: dict[int, list[int]] = {}
    for i, c in enumerate(data.translate(scan.classes), 1):
        s = step[s + c]
        if s >= accepting:
            for r in accepts[s]:
                run = ends.setdefault(r, [])
                if run and run[-1] == i - 1:  # of adjacent ends the last one is kept
                    run[-1] = i
                else:
                    run.append(i)
    out = []
    for r, candidates in ends.items():
        # The text is translated once for each of a met rule's automata, which then walk it in place.
        ahead, behind = data.translate(forward[r].classes), data.translate(backward[r].classes)
        covered = 0
        for end in candidates:
            if end <= covered:
                continue
            back = furthest(backward[r], behind, range(end - 1, covered - 1, -1))
            if back:
                start = end - back
                covered = start + furthest(forward[r], ahead, range(start, len(data)))
                if _passes(rules[r], data[start:covered]):
                    out.append((start, covered, r))
    return sorted(out, key=lambda x: (x[0], x[2]))


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or data.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[a]), int(before[b]), r) for a, b, r in spans]


FOUND = "array<struct<kind:string,start:int,end:int>>"
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def secrets(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The spans of a text column, by start, then by the rules' order."""
    compiled = compile_rules(rules)
    kinds = [r.kind for r in rules]

    @F.arrow_udf(FOUND)
    def scan(texts: pa.Array) -> pa.Array:
        return pa.array([[{"kind": kinds[r], "start": a, "end": b} for a, b, r in in_code_points(data, spans_of(data, compiled, rules))] for data in as_bytes(texts)], _FOUND)

    return scan(text)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id and its spans (kind, start, end)."""
    return id_text(docs).select("doc_id", secrets(F.col("text"), rules).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with each secret (overlapping spans as one) replaced by mark; n_chars follows the text. A null text stays null."""
    compiled = compile_rules(rules)
    hidden = mark.encode()

    @F.arrow_udf("string")
    def cover(texts: pa.Array) -> pa.Array:
        out = []
        for data, null in zip(as_bytes(texts), texts.is_null().to_pylist(), strict=True):
            parts, at = [], 0
            for a, b, _ in spans_of(data, compiled, rules):
                if a >= at:
                    parts += [data[at:a], hidden]
                at = max(at, b)
            out.append(None if null else (b"".join(parts) + data[at:]).decode())
        return pa.array(out, pa.string())

    covered = docs.select(F.struct(*[own(c) for c in docs.columns]).alias("row"), cover("text").alias("covered"))
    new = {"text": F.col("covered"), "n_chars": F.length("covered").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return covered.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
