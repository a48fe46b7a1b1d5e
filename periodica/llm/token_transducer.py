"""Token counts from compiled finite-state transducers of a byte-level BPE tokenizer.

Two deterministic transducers are compiled; both annotate transitions, and neither builds token ids.

1. The splitter reads character classes and marks where pieces begin. Its state maps form a small monoid,
   which is compiled to a multiplication table: the map of a chunk of characters is then one number.
   Chunks of a batch are folded side by side, a parallel prefix scan composes the chunk maps, and a
   second sweep from the now known entry states reads the marks off the transitions.
2. The counter reads the bytes of one piece. Its states are determinised suffix sets: for each begin of
   a vocabulary entry that is still open, its trie node, the last token before it and how many tokens the
   text so far has beyond it. A transition carries the emitted-token count (by how many the number of
   tokens of the prefix changes). States are made when first met and kept; when their number reaches
   `MAX_STATES`, inside one long piece too, all but the current one are dropped and built anew, which changes no count.

A prefix has one valid encoding; a token may follow another if merging their joined bytes gives just the
two again; that holds if no merge across the border comes due while both sides are being made. Counts are
therefore exact for any merge list whose entries encode to themselves.

Edge cases: null and empty texts have no tokens; a special token's string counts as one token, as the
library does by default; any length of text, without blanks too, is read in one pass with bounded tables; repeated
rows keep a row each; an empty table gives no rows; other columns are not read. A tokenizer whose normaliser or
splitter differs from the one compiled here is refused.
"""

from __future__ import annotations

import functools
import json
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import as_strings, id_text, slabs

MAX_STATES = 150_000
MAX_PIECES = 500_000
CHUNK = 64

# Character classes of the splitter.
LETTER, LETTER_STMD, LETTER_RV, LETTER_E, LETTER_L, DIGIT, BLANK, SPACE, APOSTROPHE, OTHER, END = range(11)
# States: what the piece read so far is.
FRESH, IN_LETTERS, IN_DIGITS, IN_OTHER, AFTER_BLANK, AFTER_SPACE, QUOTED, QUOTED_RV, QUOTED_L = range(9)
HERE, BEFORE = 1, 2  # a piece begins at this character; at the one before


def _fresh(c: int) -> int:
    return QUOTED if c == APOSTROPHE else _inside(c)


def _inside(c: int) -> int:
    return IN_LETTERS if c <= LETTER_L else IN_DIGITS if c == DIGIT else IN_OTHER


def splitter_step(state: int, c: int) -> tuple[int, int]:
    """The next state and the marks of the transition."""
    if c == END:
        return FRESH, HERE | (BEFORE if state in (QUOTED_RV, QUOTED_L) else 0)
    white = AFTER_BLANK if c == BLANK else AFTER_SPACE if c == SPACE else None
    if state in (AFTER_BLANK, AFTER_SPACE):
        if white is not None:
            return white, 0
        # The last blank of a run joins what follows; another space stands alone.
        return (_inside(c), BEFORE) if state == AFTER_BLANK else (_fresh(c), BEFORE | HERE)
    if state == QUOTED and c in (LETTER_STMD, LETTER_RV, LETTER_L):
        return {LETTER_STMD: FRESH, LETTER_RV: QUOTED_RV, LETTER_L: QUOTED_L}[c], 0
    if (state, c) in ((QUOTED_RV, LETTER_E), (QUOTED_L, LETTER_L)):
        return FRESH, 0
    late = BEFORE if state in (QUOTED_RV, QUOTED_L) else 0  # no contraction after all: the letter begins a piece
    if white is not None:
        return white, HERE | late
    if state == FRESH:
        return _fresh(c), HERE
    kind = {QUOTED: IN_OTHER, QUOTED_RV: IN_LETTERS, QUOTED_L: IN_LETTERS}.get(state, state)
    if _inside(c) == kind:
        return kind, late
    return _fresh(c), HERE | late


@functools.lru_cache(maxsize=1)
def compile_splitter():
    """(marks and next state by state and class, generators, multiplication table, value of each map at FRESH)."""
    step = [[splitter_step(s, c) for c in range(END + 1)] for s in range(QUOTED_L + 1)]
    identity = tuple(range(QUOTED_L + 1))
    gens = [tuple(step[s][c][0] for s in identity) for c in range(END + 1)]
    names, order = {identity: 0}, [identity]
    for f in order:
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in names:
                names[h] = len(order)
                order.append(h)
    times = np.array([[names[tuple(g[x] for x in f)] for g in order] for f in order], np.int32)
    nexts = np.array([[t[0] for t in row] for row in step], np.uint8)
    marks = np.array([[t[1] for t in row] for row in step], np.uint8)
    return nexts, marks, np.array([names[g] for g in gens], np.int32), times, np.array([f[FRESH] for f in order], np.uint8)


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": DIGIT}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
    table[[9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    table[32], table[39] = BLANK, APOSTROPHE
    for letters, kind in (("stmd", LETTER_STMD), ("rv", LETTER_RV), ("e", LETTER_E), ("l", LETTER_L)):
        table[[ord(x) for x in letters]] = kind
    return table


def piece_starts(classes: np.ndarray) -> np.ndarray:
    """True where a piece begins; every text ends with the class END."""
    nexts, marks, gens, times, at_fresh = compile_splitter()
    n = len(classes)
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, END, np.uint8)
    padded[:n] = classes
    by = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    size = len(times)
    flat = times.ravel()
    maps = gens[by[0]]
    for row in by[1:]:
        maps = flat[maps * size + gens[row]]
    gap = 1  # inclusive prefix scan over the chunk maps
    while gap < chunks:
        maps = np.concatenate([maps[:gap], flat[maps[:-gap] * size + maps[gap:]]])
        gap *= 2
    state = np.concatenate([[FRESH], at_fresh[maps[:-1]]]).astype(np.uint8)
    seen = np.empty_like(by)
    width = nexts.shape[1]
    flat_next, flat_marks = nexts.ravel(), marks.ravel()
    for j, row in enumerate(by):
        at = state * np.uint8(width) + row
        seen[j] = flat_marks[at]
        state = flat_next[at]
    got = np.ascontiguousarray(seen.T).ravel()[:n]
    starts = (got & HERE) > 0
    starts[:-1] |= (got[1:] & BEFORE) > 0
    return starts


class Counter:
    """The second transducer, over bytes of a piece. Tokens are numbers: 0 for none, then bytes, then merges by rank."""

    def __init__(self, merges: list[tuple[str, str]]) -> None:
        letter = {b: chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
        spare = iter(range(256, 512))
        number = {letter[b] if b in letter else chr(next(spare)): 1 + b for b in range(256)}
        byte = {c: n - 1 for c, n in number.items()}
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int]] = {}
        for a, b in merges:
            pair = (number[a], number[b])
            new = number.setdefault(a + b, len(number) + 1)
            self.rank.setdefault(pair, len(self.rank))
            parts.setdefault(new, pair)
        # A spine lists the tokens that stand at an edge while a token is merged: (token, rank that made it, rank that used it).
        self.spines = [self._spines(parts, side) for side in (1, 0)]
        self.children: list[dict[int, int]] = [{}]
        self.entry = [0]
        for text, token in number.items():
            node = 0
            for c in text:
                at = byte[c]
                if at not in self.children[node]:
                    self.children[node][at] = len(self.entry)
                    self.children.append({})
                    self.entry.append(0)
                node = self.children[node][at]
            self.entry[node] = token
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def _spines(self, parts: dict[int, tuple[int, int]], side: int) -> dict[int, list[tuple[int, int, int]]]:
        never = len(self.rank)
        out: dict[int, list[tuple[int, int, int]]] = {}
        for token in range(1, 257):
            out[token] = [(token, -1, never)]
        for token, pair in parts.items():
            made = self.rank[pair]
            (top, at, _), *rest = out[pair[side]]
            out[token] = [(token, made, never), (top, at, made), *rest]
        return out

    def reset(self, carried: tuple[tuple[int, int, int], ...] | None = None) -> int:
        """Forgets all states but the first and the carried one, whose number is returned."""
        self.sets = list(dict.fromkeys([((0, 0, 0),), carried or ((0, 0, 0),)]))
        self.names = {s: i for i, s in enumerate(self.sets)}
        self.moves: list[dict[int, tuple[int, int]]] = [{} for _ in self.sets]
        self.counts: dict[str, int] = {}
        return len(self.sets) - 1

    def follows(self, left: int, right: int) -> bool:
        """No merge across the edge is due while the tokens on both sides of it are being made."""
        known = self.fits.get((left, right))
        if known is None:
            known, rank = True, self.rank.get
            for a, made_a, used_a in self.spines[0][left]:
                for b, made_b, used_b in self.spines[1][right]:
                    r = rank((a, b), -1)
                    if r > made_a and r > made_b and r < used_a and r <= used_b:
                        known = False
            if len(self.fits) >= MAX_STATES:
                self.fits.clear()
            self.fits[left, right] = known
        return known

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """Open begins are (trie node, last token before, tokens since), the newest begin last."""
        grown, last, since, children, entry = [], 0, 0, self.children, self.entry
        for node, left, more in self.sets[state]:
            node = children[node].get(byte)
            if node is not None:
                if children[node]:
                    grown.append((node, left, more))
                if not last and entry[node] and (not left or self.follows(left, entry[node])):
                    last, since = entry[node], more
        # Prefix counts: the begin that the last token covers had `since` fewer tokens than the text before.
        emitted = 1 - since
        opened = (*[(node, left, more + emitted) for node, left, more in grown], (0, last, 0))
        name = self.names.get(opened)
        if name is None:
            name = self.names[opened] = len(self.sets)
            self.sets.append(opened)
            self.moves.append({})
        made = self.moves[state][byte] = (name, emitted)
        return made

    def count(self, piece: str) -> int:
        if len(self.sets) >= MAX_STATES or len(self.counts) >= MAX_PIECES:
            self.reset()
        state = total = 0
        for b in piece.encode():
            made = self.moves[state].get(b)
            if made is None:
                if len(self.sets) >= MAX_STATES:  # within one long piece too: the open begins are carried over
                    state = self.reset(self.sets[state])
                made = self.move(state, b)
            state, emitted = made
            total += emitted
        if len(piece) <= 64:
            self.counts[piece] = total
        return total


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> tuple[Counter, tuple[str, ...]]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cutter = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
        raise ValueError(f"{path}: not a byte-level tokenizer with the usual splitter and without a normaliser")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    return Counter(merges), tuple(t["content"] for t in spec["added_tokens"])


def count_texts(texts: list[str], path: str) -> list[int]:
    counter, specials = _counter(path)
    segments, owner, totals = [], [], [0] * len(texts)
    for i, text in enumerate(texts):
        parts = [text]
        for special in specials:
            if special in text:
                totals[i] += text.count(special)
                parts = [y for x in parts for y in x.split(special)]
        segments += parts
        owner += [i] * len(parts)
    joined = "\n".join(segments) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = _classes()[codes]
    ends = np.cumsum([len(s) + 1 for s in segments]) - 1
    classes[ends] = END
    starts = np.flatnonzero(piece_starts(classes))
    at = starts.tolist()
    # A mark stands on each END too: what it begins is the separator, which counts nothing.
    pieces = [joined[a:b] for a, b in zip(at, at[1:], strict=False)] + [""]
    known = counter.counts.get
    counts = np.array([known(p, -1) for p in pieces], np.int64)
    counts[classes[starts] == END] = 0
    for j in np.flatnonzero(counts < 0).tolist():
        counts[j] = counter.counts.get(pieces[j], -1)
        if counts[j] < 0:
            counts[j] = counter.count(pieces[j])
    tally = np.bincount(np.asarray(owner)[np.searchsorted(ends, starts)], counts, len(texts)).astype(np.int64)
    return (tally + np.asarray(totals)).tolist()


COUNTED = "struct<n_bytes:long,n_tokens:long>"


def token_counts(text: Column, tokenizer: str) -> Column:
    """A struct of UTF-8 length and token count; tokenizer is the path of a byte-level BPE .json that every executor can read."""

    @F.arrow_udf(COUNTED)
    def count(texts: pa.Array) -> pa.Array:
        tokens, sizes = [], []
        for run in slabs(as_strings(texts)):
            tokens += count_texts(run, tokenizer)
            sizes += [len(t.encode()) for t in run]
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], ["n_bytes", "n_tokens"])

    return count(text)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    return id_text(docs).select("doc_id", token_counts(F.col("text"), tokenizer).alias("c")).select("doc_id", "c.n_bytes", "c.n_tokens", (F.col("c.n_tokens") > limit).alias("over_limit"))
