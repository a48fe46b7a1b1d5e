"""Token ids in a binary format, compressed by Re-Pair grammars.

Documents are ranged by id; each range is a shard, written in ascending order as blocks of whole
documents (about `block_ids` ids, or one longer document). A block is one row of a Parquet file:

    shard, block    place of the block; blocks of a shard are numbered in order
    shard_start     ids of the shard before this block
    n_ids           ids in the block
    doc_ids         ids of its documents, in order
    ends            where each document's symbols end in `symbols`
    first_rule      the first number that is no id of the vocabulary
    rules           int32 pairs: what the nonterminals first_rule + i stand for
    lengths         int32: how many ids each nonterminal expands to
    symbols         uint16: the block's grammar sequence

A document can be decoded on its own (`decode_one`): its symbols lie between two ends, their expansion lengths
give the place of every id, and only the rules that they use are expanded. Pairs never reach over the end of a document.

Re-Pair runs in rounds: each counts all neighbouring pairs, takes those that occur at least `least` times,
most frequent first, and replaces their non-overlapping occurrences from the left by new nonterminals, until no
pair occurs so often or the 16-bit symbols are used up.

Edge cases: null and empty texts hold the end id alone; repeated ids keep a row each, ordered by text; a null id
comes first; an empty table writes no blocks and reads back as no rows.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from periodica.llm.common import as_bytes, fresh_path, id_text, slabs

BLOCK_IDS = 1 << 20
MAX_WORDS = 1_000_000
#: Words that the library gets in one call.
JOINED = 500
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_END = b"\xff"  # stands for the end of a text among words; no UTF-8 text holds it
BLOCK = "shard int, block int, shard_start long, n_ids long, first_rule int, doc_ids array<long>, ends array<long>, rules binary, lengths binary, symbols binary"


def _is_plain(word: bytes) -> bool:
    """Lower-case letters in composed form: one piece that no normaliser changes."""
    if word.isalpha():
        return word.islower()
    text = word.decode()
    return text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text)


class _Numbers(dict):
    """Words in the order they are met, numbered."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Ids of texts by the tokenizers library, word by word.

    The vocabulary's pieces never reach over white space and are runs of letters, single digits or runs of other
    marks, so a word's ids are remembered, and a word of letters with marks behind it has the ids of both.
    Tokenizers whose normaliser or splitter differ are refused.
    """

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = [n["type"] for n in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0].get("pattern", {}).get("Regex", "") if cuts == ["Split", "ByteLevel"] else ""
        if steps != ["NFC", "Replace", "Lowercase"] or not pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") or spec.get("post_processor"):
            raise ValueError(f"{path}: not a lower-casing byte-level vocabulary of letters, digits and marks")
        self.library = Tokenizer.from_file(path)
        self.light = Tokenizer.from_file(path)  # for plain words, which need no normaliser and no pattern
        self.light.normalizer = normalizers.Sequence([])
        self.light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.library.get_vocab()
        self.first_rule = max(*vocabulary.values(), end_id) + 1
        self.closes = np.zeros(self.first_rule, bool)  # tokens that end a word
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.end_id = end_id
        self.forget()

    def forget(self) -> None:
        self.known = _Numbers({_END: 0})
        self.flat = np.array([self.end_id], np.int32)
        self.starts = np.array([0, 1], np.int64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each closed by the end id; where each text ends."""
        if len(self.known) > MAX_WORDS:
            self.forget()
        before = len(self.known)
        # The tokenizer lower-cases in any case, but for the strings of its special tokens.
        words = b"".join([(t if b"<|" in t else t.lower()) + b" \xff " for t in texts]).split()
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if len(self.known) > before:
            self._learn(list(islice(self.known, before, None)))
        sizes = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(sizes)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[at] - ends + sizes, sizes)]
        return ids, ends[at == 0]

    def _learn(self, words: list[bytes]) -> None:
        """Adds the ids of new words, in order."""
        stems: dict[bytes, int] = {}
        tails: dict[bytes, int] = {}
        others: dict[bytes, int] = {}
        parts: list[tuple[int, int]] = []  # places in the three lists, the first negative for others, the second -1 for none
        for word in words:
            stem = word.rstrip(_MARKS)
            if stem and _is_plain(stem):
                tail = word[len(stem) :]
                parts.append((stems.setdefault(stem, len(stems)), tails.setdefault(tail, len(tails)) if tail else -1))
            else:
                parts.append((-1 - others.setdefault(word, len(others)), -1))
        flat, starts = [], [0]
        for ids, sizes in (self._plain(list(stems)), self._each(list(tails)), self._each(list(others))):
            flat.append(ids)
            starts.append(starts[-1] + len(sizes))
            parts_of = sizes if len(starts) == 2 else np.concatenate([parts_of, sizes])
        pool, first = np.concatenate(flat), np.concatenate([[0], np.cumsum(parts_of)])
        head, tail = np.array(parts, np.int64).reshape(-1, 2).T
        head = np.where(head < 0, starts[2] - 1 - head, head)
        both = np.stack([head, np.where(tail < 0, -1, starts[1] + tail)], 1).ravel()
        both = both[both >= 0]
        sizes = first[both + 1] - first[both]
        ends = np.cumsum(sizes)
        whole = first[head + 1] - first[head]
        whole[tail >= 0] += (first[1:] - first[:-1])[starts[1] + tail[tail >= 0]]
        self.flat = np.concatenate([self.flat, pool[np.arange(ends[-1]) + np.repeat(first[both] - ends + sizes, sizes)]])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(whole)])

    def _plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of plain words and how many each has; a word's last token is marked as such in the vocabulary."""
        runs = [b" ".join(words[i : i + JOINED]).decode() for i in range(0, len(words), JOINED)]
        got = [e.ids for e in self.light.encode_batch_fast(runs, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(got), np.int32, sum(map(len, got)))
        return ids, np.diff(np.flatnonzero(self.closes[ids]), prepend=-1)

    def _each(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.int32, int(sizes.sum())), sizes


@functools.lru_cache(maxsize=2)
def _encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


def compress(ids: np.ndarray, ends: np.ndarray, first: int, each: int = 2048, least: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, ends in symbols, rules) of a block whose ids are below first, which must leave room in 16 bits."""
    if first > 1 << 16 or len(ids) and int(ids.max()) >= first:
        raise ValueError("ids do not fit 16 bits, or one is as large as the first rule")
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(symbols), bool)
    last[ends - 1] = True
    # Places where a pair may occur often. Replacing makes no new pair of old symbols, so one that is rare stays rare and isn't counted again.
    alive = ~last
    rules: list[np.ndarray] = []
    name = first
    while name < 1 << 16:
        at = np.flatnonzero(alive)
        keys = symbols[at] << np.uint32(16) | symbols[at + 1]
        bins = (keys * np.uint32(0x9E3779B1)) >> np.uint32(12)
        often = (np.bincount(bins, minlength=1 << 20) >= least)[bins]
        at = at[often]
        pairs, which, n = np.unique(keys[often], return_inverse=True, return_counts=True)
        chosen = np.lexsort((pairs, -n))[: min(each, (1 << 16) - name)]
        chosen = chosen[n[chosen] >= least]
        if not len(chosen):
            break
        alive[:] = False
        alive[at[(n >= least)[which]]] = True
        number = np.full(len(pairs), -1)
        number[chosen] = np.arange(len(chosen))
        number = number[which]
        taken = np.flatnonzero(number >= 0)
        at, rule = at[taken], number[taken]
        # Of a run of overlapping occurrences every second one is replaced.
        run = np.concatenate([[True], np.diff(at) > 1])
        first_of_run = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        free = (np.arange(len(at)) - first_of_run) % 2 == 0
        at, rule = at[free], rule[free]
        symbols[at] = name + rule
        last[at] = last[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        made = np.zeros(len(symbols), bool)
        made[at] = True
        symbols, last, alive, made = symbols[keep], last[keep], alive[keep], made[keep]
        alive |= made
        alive[:-1] |= made[1:]
        alive &= ~last
        rules.append(np.stack([pairs[chosen] >> 16, pairs[chosen] & 0xFFFF], 1).astype(np.int32))
        name += len(chosen)
    symbols = symbols.astype(np.int64)
    return symbols, np.flatnonzero(last) + 1, np.concatenate(rules) if rules else np.zeros((0, 2), np.int32)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1))
    return np.array(out, np.int32)


class Grammar:
    """Expands symbols of one block."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, first: int) -> None:
        self.first = first
        self.starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        flat = np.zeros(int(self.starts[-1]), np.int32)
        at = 0
        for a, b in rules.tolist():
            for x in (a, b):
                if x < first:
                    flat[at] = x
                    at += 1
                else:
                    s, e = self.starts[x - first], self.starts[x - first + 1]
                    flat[at : at + e - s] = flat[s:e]
                    at += int(e - s)
        self.flat = flat

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols.astype(np.int64) - self.first
        out = np.ones(len(symbols), np.int64)
        deep = rule >= 0
        out[deep] = np.diff(self.starts)[rule[deep]]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols.astype(np.int64) - self.first
        sizes = self.sizes(symbols)
        ends = np.cumsum(sizes)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        plain = rule < 0
        out[ends[plain] - 1] = symbols[plain]
        deep = ~plain
        n, s = sizes[deep], self.starts[rule[deep]]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(ends[deep] - n, n) + step] = self.flat[np.repeat(s, n) + step]
        return out


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block_ids: int = BLOCK_IDS) -> None:
    """Encodes the documents and writes the files to path, a folder that Spark can write."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        encoder = _encoder(tokenizer, end_id)
        doc_ids: list[int | None] = []
        parts: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        held = 0

        def closed() -> pa.RecordBatch:
            nonlocal block, before, doc_ids, parts, ends, held
            first = encoder.first_rule
            symbols, cuts, rules = compress(np.concatenate(parts), np.concatenate(ends), first)
            row = {"shard": shard, "block": block, "shard_start": before, "n_ids": held, "first_rule": first, "doc_ids": doc_ids, "ends": cuts.tolist(), "rules": rules.tobytes(), "lengths": expansion_lengths(rules, first).tobytes(), "symbols": symbols.astype(np.uint16).tobytes()}
            block, before = block + 1, before + held
            doc_ids, parts, ends, held = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            at, names = 0, batch.column(0).to_pylist()
            for run in slabs(as_bytes(batch.column(1)), 1 << 20):
                ids, cuts = encoder(run)
                parts.append(ids)
                ends.append(cuts + held)
                held += len(ids)
                doc_ids += names[at : at + len(run)]
                at += len(run)
                if held >= block_ids:
                    yield closed()
        if held:
            yield closed()

    arrow = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("shard_start", pa.int64()), ("n_ids", pa.int64()), ("first_rule", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("rules", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary())])
    ranged = id_text(docs).repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ranged.mapInArrow(encode, BLOCK).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The block rows."""
    return spark.read.schema(BLOCK).parquet(path)


def decode_one(block: Row, i: int, begin: int = 0, end: int | None = None) -> list[int]:
    """Ids begin to end of the i-th document of a block row, without expanding anything before or behind them."""
    symbols = np.frombuffer(block.symbols, np.uint16)[block.ends[i - 1] if i else 0 : block.ends[i]].astype(np.int64)
    rules, lengths, first = np.frombuffer(block.rules, np.int32).reshape(-1, 2), np.frombuffer(block.lengths, np.int32), block.first_rule
    size = lambda x: int(lengths[x - first]) if x >= first else 1
    place = np.cumsum([size(x) for x in symbols.tolist()])
    end = int(place[-1]) if end is None else min(end, int(place[-1]))
    k = int(np.searchsorted(place, begin, "right"))
    at = int(place[k - 1]) if k else 0
    out: list[int] = []
    stack = symbols[k:][::-1].tolist()
    while stack and at < end:
        x = stack.pop()
        if at + size(x) <= begin:
            at += size(x)
        elif x >= first:
            stack += rules[x - first][::-1].tolist()
        else:
            out.append(x)
            at += 1
    return out


DECODED = "doc_id long, shard int, at long, ids array<int>"


def decode_documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, shard, at, ids): each document's ids, and how many ids of its shard come before."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, shard, at, ids in _documents(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": doc_id, "shard": shard, "at": at, "ids": ids}, schema=pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("at", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    return blocks.mapInArrow(decode, DECODED)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list, list[np.ndarray]]]:
    for batch in batches:
        for i in range(batch.num_rows):
            r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            grammar = Grammar(np.frombuffer(r["rules"], np.int32).reshape(-1, 2), np.frombuffer(r["lengths"], np.int32), r["first_rule"])
            symbols = np.frombuffer(r["symbols"], np.uint16)
            ids, place = grammar.expand(symbols), np.concatenate([[0], np.cumsum(grammar.sizes(symbols))])
            cuts = place[np.concatenate([[0], np.array(r["ends"], np.int64)])].tolist()
            yield r["doc_ids"], [r["shard"]] * len(r["doc_ids"]), [r["shard_start"] + a for a in cuts[:-1]], [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def describe_ids(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, shard, at, ids in _documents(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": doc_id, "shard": shard, "at": at, "n_tokens": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]}, schema=pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]))

    each = blocks.mapInArrow(sums, "doc_id long, shard int, at long, n_tokens long, ids_crc32 long")
    # One row a shard: the only step over the whole order.
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return each.join(before, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes the files to a new folder in the shared one and describes them as read back."""
    path = fresh_path(docs.sparkSession, "ids")
    write_ids(docs, path, tokenizer, end_id)
    return describe_ids(read_ids(docs.sparkSession, path))
