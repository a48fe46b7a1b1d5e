"""SentencePiece segmentations sampled by forward filtering and backward sampling; lossless decoding.

A text, with the dummy prefix and blanks as U+2581, is cut into units wherever no piece of the model holds the two
characters side by side: no edge crosses such a place, so the lattice of a text is the chain of its units' lattices. Edges are the vocabulary's pieces; a character that is no piece is one edge of its byte pieces. An edge
weighs exp(-alpha * log(1 + rank)) by the rank that the model's score gives. The forward pass sums the weights of
all paths to each place of a unit, once for each distinct unit, and stores for each place the cumulative
probabilities of the edges that end there. The backward pass draws edges from a unit's end to its begin for
all units of a batch at a time. Random numbers are a hash of the row's key, the unit's place and the step, so a
row has the same segmentation on any cluster, and two seeds give two.

Decoding joins the pieces: a blank piece gives spaces, byte pieces their bytes, and the dummy prefix goes. A
U+2581 of the text itself is kept apart from blanks by its byte pieces, so every text comes back unchanged.

Edge cases: null and empty texts have no pieces; repeated rows with one key get the same sample; a null key
counts as the text "null"; an empty table gives no rows; equally likely edges are drawn by the random number alone.
A very long text is one lattice; of its places only the edges of its distinct units are kept, about 60 bytes each. Other
columns keep their names, but for the three that `encode_documents` makes.
"""

from __future__ import annotations

import functools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import as_strings, own, slabs

ALPHA = 1.0
#: Edges remembered; about 60 bytes each with their units.
MAX_EDGES = 3_000_000
#: Characters sampled at a time; bounds the numpy temporaries of a worker.
RUN_CHARS = 1 << 18
_CHUNK = re.compile("(?:▁+[^▁]*|[^▁]+)")
_OWN_MARK = "\ud800"  # stands for a U+2581 of the text while units are cut: a lone surrogate, which no UTF-8 text can hold


class Lattices:
    """Forward-filtered lattices of the distinct units met so far."""

    def __init__(self, path: str, alpha: float) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.alpha = alpha
        self.weight: dict[str, tuple[int, float]] = {}
        self.bytes_of: list[bytes] = [b""] * model.vocab_size()
        self.byte_id = [0] * 256
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.weight[piece] = (i, math.exp(-alpha * math.log(1 + max(0.0, -model.get_score(i)))))
                self.bytes_of[i] = piece.replace("▁", " ").encode()
        self.longest = max(map(len, self.weight))
        self.joined = {a + b for piece in self.weight for a, b in zip(piece, piece[1:], strict=False)}
        self.lowest = min(w for _, w in self.weight.values())
        if self.lowest**self.longest < 1e-190:
            raise ValueError("alpha is too large: path weights would be lost before they can be lifted")
        self._compile_trie()
        self.forget()

    def _compile_trie(self) -> None:
        """Transitions of the vocabulary's trie as sorted numbers, (node, character) to node, and what ends at each node."""
        moves: dict[int, int] = {}
        ends: dict[int, tuple[int, float]] = {}
        for piece, got in self.weight.items():
            node = 0
            for c in piece:
                node = moves.setdefault(node << 21 | ord(c), len(moves) + 1)
            ends[node] = got
        self.moves = np.array(sorted(moves), np.int64)
        self.to = np.array([moves[k] for k in self.moves.tolist()], np.int64)
        self.ends_piece = np.full(len(moves) + 1, -1, np.int64)
        self.ends_weight = np.zeros(len(moves) + 1)
        for node, (i, w) in ends.items():
            self.ends_piece[node], self.ends_weight[node] = i, w

    def forget(self) -> None:
        self.chunks: dict[str, tuple[int, ...]] = {}  # a chunk's units, by their end nodes
        self.units: dict[str, int] = {}
        self.pending: list[str] = []  # units whose nodes are reserved and not yet filtered
        self.n_nodes = 0
        self.first = np.zeros(0, np.int32)  # a node's first edge
        self.upto = np.zeros(0)  # cumulative probability of an edge among those of its node
        self.source = np.zeros(0, np.int32)  # -1 for a unit's begin
        self.emits = np.zeros(0, np.int32)
        self.runs: list[tuple[int, ...]] = []  # byte pieces of an edge that emits several, numbered from vocab_size on
        self.run_of: dict[str, int] = {}

    def cut(self, chunk: str) -> tuple[int, ...]:
        """End nodes of the chunk's units."""
        joined, out, at = self.joined, [], 0
        for i in range(1, len(chunk) + 1):
            if i == len(chunk) or chunk[i - 1 : i + 1] not in joined:
                unit = chunk[at:i]
                end = self.units.get(unit)
                if end is None:
                    self.n_nodes += len(unit)
                    end = self.units[unit] = self.n_nodes - 1
                    self.pending.append(unit)
                out.append(end)
                at = i
        self.chunks[chunk] = tuple(out)
        return self.chunks[chunk]

    def _run(self, char: str) -> int:
        if char not in self.run_of:
            self.run_of[char] = len(self.bytes_of) + len(self.runs)
            self.runs.append(tuple(self.byte_id[b] for b in ("▁" if char == _OWN_MARK else char).encode()))
        return self.run_of[char]

    def settle(self) -> None:
        """Forward filtering of the pending units side by side; the node of a place is that of its last character."""
        if not self.pending:
            return
        chars = np.frombuffer("".join(self.pending).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.array([len(u) for u in self.pending])
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        stop = begin + np.repeat(sizes, sizes)
        self.pending = []

        # Edges: from every place the trie is walked while it can be.
        live, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        edges: list[tuple[np.ndarray, ...]] = []
        alone = np.zeros(len(chars), bool)
        for length in range(1, self.longest + 1):
            inside = live + length <= stop[live]
            live, node = live[inside], node[inside]
            key = node << 21 | chars[live + length - 1]
            move = np.minimum(np.searchsorted(self.moves, key), len(self.moves) - 1)
            met = self.moves[move] == key
            live, node = live[met], self.to[move[met]]
            final = self.ends_piece[node] >= 0
            edges.append((live[final], live[final] + length, self.ends_piece[node[final]], self.ends_weight[node[final]]))
            if length == 1:
                alone[live[final]] = True
        lone = np.flatnonzero(~alone)
        edges.append((lone, lone + 1, np.array([self._run(chr(c)) for c in chars[lone].tolist()], np.int64), np.full(len(lone), self.lowest)))
        start, end, piece, weight = (np.concatenate(x) for x in zip(*edges, strict=True))
        order = np.lexsort((start, end))
        start, end, piece, weight = start[order], end[order], piece[order], weight[order]
        into = np.bincount(end - 1, minlength=len(chars))
        first = np.cumsum(into) - into

        # Sums of path weights, place by place of all units; only conditional probabilities are kept.
        total, upto = np.zeros(len(chars)), np.zeros(len(start))
        place = np.arange(len(chars)) - begin
        by_place = np.argsort(place, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(place))])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            here = by_place[a:b]
            for k in range(int(into[here].max())):
                at = here[into[here] > k]
                e = first[at] + k
                came = np.where(start[e] == begin[at], 1.0, total[start[e] - 1])
                total[at] += came * weight[e]
                upto[e] = total[at]
            of_here = np.repeat(first[here], into[here]) + np.arange(int(into[here].sum())) - np.repeat(np.cumsum(into[here]) - into[here], into[here])
            upto[of_here] /= np.repeat(total[here], into[here])
            tiny = here[total[here] < 1e-200]
            for k in range(self.longest if len(tiny) else 0):  # sums that edges can still start from are lifted together
                back = tiny[place[tiny] >= k] - k
                total[back] *= 1e150
        upto[first + into - 1] = 1.0
        nodes = len(self.first)
        self.first = np.concatenate([self.first, (len(self.upto) + first).astype(np.int32)])
        self.upto = np.concatenate([self.upto, upto])
        self.source = np.concatenate([self.source, np.where(start == begin[end - 1], -1, nodes + start - 1).astype(np.int32)])
        self.emits = np.concatenate([self.emits, piece.astype(np.int32)])

    def sample(self, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        """Piece ids of each text."""
        if len(self.upto) > MAX_EDGES:
            self.forget()
        ends: list[int] = []
        counts, before = [], 0
        known = self.chunks.get
        for text in texts:
            for chunk in _chunks(text):
                ends += known(chunk) or self.cut(chunk)
            counts.append(len(ends) - before)
            before = len(ends)
        self.settle()
        n = len(ends)
        owner = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
        state = _mix(seeds[owner] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        node, live = np.array(ends, np.int64), np.arange(n)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        length = np.zeros(n, np.int64)
        while len(live):  # all units step back by one edge at a time
            state = _mix(state + np.uint64(0xD1B54A32D192ED03))
            drawn = (state >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self.first[node]
            below = np.flatnonzero(self.upto[edge] <= drawn)
            while len(below):  # long pieces come first and are likely, so few edges are looked at
                edge[below] += 1
                below = below[self.upto[edge[below]] <= drawn[below]]
            steps.append((live, self.emits[edge]))
            length[live] += 1
            node = self.source[edge]
            more = node >= 0
            live, node, state = live[more], node[more], state[more]
        begins = np.cumsum(length) - length
        out = np.zeros(int(length.sum()), np.int64)
        for back, (at, emitted) in enumerate(steps, 1):
            out[begins[at] + length[at] - back] = emitted
        per_text = np.bincount(owner, length, len(texts)).astype(np.int64)
        if len(out) and out.max() >= len(self.bytes_of):
            out, per_text = self._expanded(out, per_text)
        return np.split(out.astype(np.int32), np.cumsum(per_text)[:-1])

    def _expanded(self, out: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of several byte pieces in full."""
        first = len(self.bytes_of)
        flat = np.array([i for run in self.runs for i in run], np.int64)
        sizes_of = np.array([len(run) for run in self.runs])
        starts_of = np.cumsum(sizes_of) - sizes_of
        many = out >= first
        sizes = np.ones(len(out), np.int64)
        sizes[many] = sizes_of[out[many] - first]
        ends = np.cumsum(sizes)
        full = np.empty(int(ends[-1]), np.int64)
        full[ends[~many] - 1] = out[~many]
        n, at = sizes[many], starts_of[out[many] - first]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        full[np.repeat(ends[many] - n, n) + step] = flat[np.repeat(at, n) + step]
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        return full, np.diff(cuts)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


def _chunks(text: str) -> list[str]:
    if not text:
        return []
    return _CHUNK.findall("▁" + text.replace("▁", _OWN_MARK).replace(" ", "▁"))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _lattices(path: str, alpha: float) -> Lattices:
    return Lattices(path, alpha)


def _seeds(keys: list, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str("null" if k is None else k), seed) for k in keys], np.uint64)


def _sampled(texts: pa.Array, keys: pa.Array, path: str, alpha: float, seed: int):
    lattices, at, seeds = _lattices(path, alpha), 0, _seeds(keys.to_pylist(), seed)
    for run in slabs(as_strings(texts), RUN_CHARS):
        yield lattices, run, lattices.sample(run, seeds[at : at + len(run)])
        at += len(run)


def encode(text: Column, key: Column, model: str, alpha: float = ALPHA, seed: int = 0) -> Column:
    """The sampled piece ids; model is the path of a .model file that every executor can read."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array, keys: pa.Array) -> pa.Array:
        return pa.array([x for _, _, got in _sampled(texts, keys, model, alpha, seed) for x in got], pa.list_(pa.int32()))

    return ids(text, key)


def decode(ids: Column, model: str) -> Column:
    """The text of piece ids."""

    @F.arrow_udf("string")
    def texts(rows: pa.Array) -> pa.Array:
        lattices = _lattices(model, ALPHA)
        return pa.array([None if x is None else lattices.decode(np.array(x, np.int64)) for x in rows.to_pylist()], pa.string())

    return texts(ids)


SUMMARY = "struct<n_pieces:long,ids_crc32:long,lossless:boolean>"


def summarise(docs: DataFrame, model: str, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, n_pieces, ids_crc32, lossless (the decoded ids equal the text)."""
    arrow = pa.struct([("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("lossless", pa.bool_())])

    @F.arrow_udf(SUMMARY)
    def summary(texts: pa.Array, keys: pa.Array) -> pa.Array:
        out = []
        for lattices, run, got in _sampled(texts, keys, model, alpha, seed):
            for text, ids in zip(run, got, strict=True):
                out.append({"n_pieces": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()), "lossless": lattices.decode(ids) == text})
        return pa.array(out, arrow)

    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.select("doc_id", summary("text", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("s")).select("doc_id", "s.*")


def encode_documents(docs: DataFrame, model: str, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """The documents' columns without the text, with n_pieces, lossless (the ids decode to the text) and piece_ids.

    A column of the input that has one of these names gives way to the new one.
    """
    @F.arrow_udf("struct<ids:array<int>,lossless:boolean>")
    def coded(texts: pa.Array, keys: pa.Array) -> pa.Array:
        rows, same = [np.zeros(0, np.int32)], []
        for lattices, run, got in _sampled(texts, keys, model, alpha, seed):
            rows += [ids.astype(np.int32) for ids in got]
            same += [lattices.decode(ids) == text for text, ids in zip(run, got, strict=True)]
        ends = np.cumsum([len(r) for r in rows], dtype=np.int32)
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows))), pa.array(same, pa.bool_())], ["ids", "lossless"])

    made = ("n_pieces", "lossless", "piece_ids")
    kept = [c for c in docs.columns if c != "text" and c not in made]
    rows = docs.select(F.struct(*[own(c) for c in kept]).alias("row"), coded(F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("c"))
    return rows.select("row.*", F.size("c.ids").cast("long").alias("n_pieces"), F.col("c.lossless").alias("lossless"), F.col("c.ids").alias("piece_ids"))
