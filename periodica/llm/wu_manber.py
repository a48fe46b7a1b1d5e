"""Benchmark decontamination by Wu-Manber search over words.

The patterns are all windows of `window` consecutive words of the benchmark items (an item of fewer
words is one pattern). Symbols of the search are words. For each pattern length a shift table over
blocks of two words says how far the search may jump: most blocks of a document stand in no pattern,
so nine words of ten are never looked at. Where the shift is zero, the buckets of that suffix block and
of the window's first block select the candidates, and a direct comparison of the words confirms them.

The pattern set is the stated query set. It is compiled in blocks of bounded size (`block_bytes` of item text,
or one longer item). One block, the usual case, is one broadcast and one scan. A larger benchmark takes one pass over the documents
for each block: only one block is broadcast at a time, the texts with hits are checkpointed under their digest, and
a last join unites them, so neither the driver nor a worker holds more than a block.

Edge cases: a null or empty text has no words and is clean; an item without words matches nothing;
repeated items and repeated documents each keep their own row; an item with a null id is named ""; an empty benchmark
leaves all documents, an empty table gives no rows; a very long text is one scan; overlapping and touching hits are
one span; other columns, whatever their names, keep theirs in `drop_contaminated` and are not read in `find_overlaps`.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import as_bytes, cut, id_text, own

#: Item text per compiled block; its tables take about 40 times as much in a worker.
BLOCK_BYTES = 1 << 20
#: Word bytes are 0-9, a-z (after lower-casing A-Z) and all bytes above ASCII.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

HITS = "struct<n_words:long,starts:array<int>,ends:array<int>,items:array<string>>"
_HITS = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Shifts:
    """Shift and bucket tables for patterns of one length."""

    def __init__(self, length: int) -> None:
        self.m = length
        self.b = min(2, length)
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list[tuple[list[bytes], set[str]]]]] = {}

    def add(self, pattern: list[bytes], item: str) -> None:
        m, b = self.m, self.b
        for end in range(b, m + 1):
            block = b" ".join(pattern[end - b : end])
            self.shift[block] = min(self.shift.get(block, m), m - end)
        first = self.buckets.setdefault(b" ".join(pattern[m - b :]), {}).setdefault(b" ".join(pattern[:b]), [])
        for words, items in first:
            if words == pattern:
                items.add(item)
                return
        first.append((pattern, {item}))

    def search(self, words: list[bytes], spans: list[tuple[int, int]], found: set[str]) -> None:
        m, b, n, shift, most = self.m, self.b, len(words), self.shift.get, self.m - self.b + 1
        end = m
        while end <= n:
            block = words[end - 1] if b == 1 else words[end - 2] + b" " + words[end - 1]
            jump = shift(block, most)
            if jump:
                end += jump
                continue
            start = end - m
            for pattern, items in self.buckets[block].get(b" ".join(words[start : start + b]), ()):
                if words[start:end] == pattern:
                    spans.append((start, end))
                    found |= items
            end += 1


def compile_block(items: Iterable[tuple[str, bytes]], window: int) -> list[Shifts]:
    by_length: dict[int, Shifts] = {}
    for item, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            by_length.setdefault(m, Shifts(m)).add(words[i : i + m], item)
    return list(by_length.values())


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


@functools.lru_cache(maxsize=1)
def _compiled(key: tuple, window: int) -> list[Shifts]:
    return compile_block(key, window)


def _hits(texts: pa.Array, block: tuple, window: int) -> pa.Array:
    tables, out = _compiled(block, window), []
    for text in as_bytes(texts):
        words, spans, found = words_of(text), [], set()
        for t in tables:
            t.search(words, spans, found)
        whole = merged(spans)
        out.append({"n_words": len(words), "starts": [s for s, _ in whole], "ends": [e for _, e in whole], "items": sorted(found)})
    return pa.array(out, _HITS)


def _searcher(block, window: int):
    """The scan for one broadcast block."""

    @F.arrow_udf(HITS)
    def scan(texts: pa.Array) -> pa.Array:
        return _hits(texts, block.value, window)

    return scan


def _united(*columns: Column) -> Column:
    """The hits of several blocks in one text (its words; starts, ends and items by block) as one."""

    @F.arrow_udf(HITS)
    def unite(n_words: pa.Array, starts: pa.Array, ends: pa.Array, items: pa.Array) -> pa.Array:
        out = []
        for n, s, e, names in zip(*(x.to_pylist() for x in (n_words, starts, ends, items)), strict=True):
            whole = merged(list(zip(chain.from_iterable(s), chain.from_iterable(e), strict=True)))
            out.append({"n_words": n, "starts": [x for x, _ in whole], "ends": [x for _, x in whole], "items": sorted(set(chain.from_iterable(names)))})
        return pa.array(out, _HITS)

    return unite(*columns)


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, item_col: str = "item_id", text_col: str = "text") -> Iterable[tuple]:
    """The items as tuples of (id, text), in blocks of about block_bytes; rows come to the driver one block at a time."""
    block, size = [], 0
    for item, text in benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")).cast("binary")).toLocalIterator():
        block.append((item, bytes(text)))
        size += len(text) + 32
        if size >= block_bytes:
            yield tuple(block)
            block, size = [], 0
    if block:
        yield tuple(block)


def _key(text: str = "text") -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def _hits_by_text(texts: DataFrame, first: tuple, rest: Iterator[tuple], window: int) -> DataFrame:
    """(key, hit) of the texts with hits, from one pass for each block; a block's broadcast goes before the next one comes."""
    found = None
    for block in chain([first], rest):
        sent = texts.sparkSession.sparkContext.broadcast(block)
        each = texts.select(_key().alias("key"), _searcher(sent, window)(F.col("text")).alias("hit")).where(F.size("hit.starts") > 0)
        each = cut(each.dropDuplicates(["key"]))
        sent.destroy()
        found = each if found is None else found.union(each)
    by_text = found.groupBy("key").agg(F.first("hit.n_words").alias("n"), *[F.collect_list(f"hit.{c}").alias(c) for c in ("starts", "ends", "items")])
    return cut(by_text.select("key", _united(*map(F.col, ("n", "starts", "ends", "items"))).alias("hit")))


def _opened(benchmark: DataFrame, block_bytes: int) -> tuple[tuple, tuple | None, Iterator[tuple]]:
    blocks = iter(benchmark_blocks(benchmark, block_bytes))
    return next(blocks, ()), next(blocks, None), blocks


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, starts and ends of hit word spans (merged, end exclusive), items whose windows occur."""
    texts = id_text(docs)
    first, second, rest = _opened(benchmark, block_bytes)
    if second is None:
        sent = docs.sparkSession.sparkContext.broadcast(first)
        return texts.select("doc_id", _searcher(sent, window)(F.col("text")).alias("hit")).select("doc_id", "hit.*")
    found = _hits_by_text(texts, first, chain([second], rest), window)
    none = docs.sparkSession.sparkContext.broadcast(())
    bare = texts.select("doc_id", _key().alias("key"), _searcher(none, window)(F.col("text")).alias("none"))
    return bare.join(found, "key", "left").select("doc_id", F.coalesce("hit", "none").alias("hit")).select("doc_id", "hit.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any benchmark window, with their columns."""
    first, second, rest = _opened(benchmark, block_bytes)
    row = F.struct(*[own(c) for c in docs.columns]).alias("row")
    if second is None:
        sent = docs.sparkSession.sparkContext.broadcast(first)
        tagged = docs.select(row, _searcher(sent, window)(F.coalesce(F.col("text"), F.lit(""))).alias("hit"))
        return tagged.where(F.size("hit.starts") == 0).select("row.*")
    found = _hits_by_text(id_text(docs), first, chain([second], rest), window).select("key")
    return docs.select(row, _key().alias("key")).join(found, "key", "left_anti").select("row.*")
