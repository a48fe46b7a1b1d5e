"""Exact substring removal: repeated word windows, counted in super-k-mer buckets.

A window is `window` consecutive words. Its minimiser is the smallest hash of its runs of `MINI` words.
Consecutive windows of a document that share a minimiser form a super-k-mer: one packed string holds their
words and goes, by the minimiser, to one bucket. All copies of a window meet there, since equal windows have
equal minimisers. A bucket is read in minimiser order in runs of bounded size; sorting the windows of a run
by a rolling hash brings copies together, and their words are compared. Windows that occur twice or more are
returned as word ranges of their documents; a last join by document removes them.

Windows of hot minimisers (passages that a large part of all documents share) travel one by one under a 128-bit
digest: digests are counted with map-side combination, so no task gathers them, and those counted twice or more
are joined back; on this route two windows are held to be equal by their digests, not by comparing words. Hot minimisers
are found from counts over a sixteenth of the rows, by a share and by an absolute number of super-k-mers that one task
is to sort, and never enter a bucket. Any other minimiser whose super-k-mers outgrow a run of the bucket is
passed on to the digests as it is read, so a run never holds more than its bound. Both choose the route of a
window, never the result: a minimiser's windows all go one way.

Packed strings are zstd-compressed against a dictionary of sampled text, and whole texts travel compressed to
the last join, which halves what is shuffled.

Edge cases: null and empty texts and texts shorter than a window lose nothing; rows with equal id and text are
each other's copies, so whole windows of both go, and their common word ranges are gathered once; rows with equal ids
but different texts are told apart by a hash of the text. An empty table gives no rows; a very long text is cut into
super-k-mers like any other; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import as_bytes, cut, id_text

WINDOW = 35
MINI = 4
#: A minimiser is hot if it has more than this share of all super-k-mers, or more of them than one task is to sort.
HOT_SHARE = 1 / 256
HOT_ROWS = 1 << 19
HOT_LEAST = 96
SAMPLED = 16
#: Bytes of packed words, unpacked, that a run of a bucket holds.
RUN_BYTES = 4 << 20
MAX_WORDS = 300_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes:
    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, digest = self.known, xxhash.xxh64_intdigest
        if len(known) > MAX_WORDS:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = digest(w)
            out.append(h)
        return np.array(out, np.uint64)


def minimisers(hashes: np.ndarray, window: int, mini: int = MINI) -> np.ndarray:
    """The minimiser of every window, as signed 64-bit numbers."""
    n = len(hashes) - mini + 1
    runs = hashes[:n].copy()
    for k in range(1, mini):
        runs = (runs * _ODD) ^ hashes[k : k + n]
    runs = (runs ^ (runs >> np.uint64(29))) * _ODD
    runs ^= runs >> np.uint64(32)
    span, done = window - mini + 1, 1
    while done < span:  # a minimum over a span from minima over shorter ones
        step = min(done, span - done)
        runs = np.minimum(runs[: len(runs) - step], runs[step:])
        done += step
    return runs.view(np.int64)


def super_kmers(words: list[bytes], hashes: WordHashes, window: int, mini: int = MINI) -> Iterator[tuple[int, int, int, bool]]:
    """(minimiser, first window, number of windows, loops): it may repeat a window in itself only if it loops, a run of its words coming twice."""
    if len(words) < window:
        return
    h = hashes(words)
    least = minimisers(h, window, mini)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1, [len(least)]])
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(h) + 1, np.int64)
    again[order[1:][same] + 1] = again[order[:-1][same] + 1] = 1
    again = np.cumsum(again)  # words so far that come twice in the text
    loops = again[cuts[1:] + window - 1] - again[cuts[:-1]] >= window
    yield from zip(least[cuts[:-1]].tolist(), cuts[:-1].tolist(), np.diff(cuts).tolist(), loops.tolist(), strict=True)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, int, list[bytes]]]:
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            yield doc, _text_key(text), text.split()


def _text_key(text: bytes) -> int:
    """Tells apart texts of rows with one id: 32 bits, signed."""
    return xxhash.xxh32_intdigest(text, 7) - (1 << 31)


_PLACE = [("doc_id", pa.int64()), ("text_key", pa.int32()), ("start", pa.int32())]
_PACKED = pa.schema([("mini", pa.int64()), *_PLACE, ("loops", pa.bool_()), ("packed", pa.binary())])
_SINGLE = pa.schema([("digest", pa.binary()), *_PLACE])
_FOUND = pa.schema([("digest", pa.binary()), *_PLACE, ("stop", pa.int32())])


def _flush(columns: tuple[list, ...], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def packed(docs: DataFrame, window: int, hot: frozenset[int], dictionary: bytes) -> DataFrame:
    """(mini, doc_id, text_key, start, loops, packed): the super-k-mers of minimisers that aren't hot."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True, write_dict_id=False).compress
        hashes, out, size = WordHashes(), tuple([] for _ in _PACKED), 0
        for doc, key, words in _rows(batches):
            for mini, start, n, loops in super_kmers(words, hashes, window):
                if mini not in hot:
                    data = shrink(b" ".join(words[start : start + n + window - 1]))
                    size += len(data) + 40
                    for c, x in zip(out, (mini, doc, key, start, loops, data), strict=True):
                        c.append(x)
            if size > RUN_BYTES:
                yield _flush(out, _PACKED)
                out, size = tuple([] for _ in _PACKED), 0
        yield _flush(out, _PACKED)

    return docs.mapInArrow(pack, "mini long, doc_id long, text_key int, start int, loops boolean, packed binary")


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def hot_windows(docs: DataFrame, window: int, hot: frozenset[int]) -> DataFrame:
    """(digest, doc_id, text_key, start): each window of a hot minimiser."""

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, out = WordHashes(), tuple([] for _ in _SINGLE)
        for doc, key, words in _rows(batches):
            for mini, start, n, _ in super_kmers(words, hashes, window):
                if mini in hot:
                    for at in range(start, start + n):
                        for c, x in zip(out, (_digest(words[at : at + window]), doc, key, at), strict=True):
                            c.append(x)
            if len(out[0]) > 50_000:
                yield _flush(out, _SINGLE)
                out = tuple([] for _ in _SINGLE)
        yield _flush(out, _SINGLE)

    return docs.mapInArrow(single, "digest binary, doc_id long, text_key int, start int")


def repeated_windows(rows: list[list[bytes]], window: int) -> list[np.ndarray]:
    """For each row of words the windows (by first word) that occur at least twice in all of the rows."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for words in rows for w in words], np.int64)
    sizes = np.array([len(words) for words in rows])
    begins = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - window + 1, 0)
    at = np.arange(int(counts.sum())) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
    keys = ids.astype(np.uint64) * _ODD
    keys ^= keys >> np.uint64(31)
    rolled = np.zeros(len(at), np.uint64)
    for k in range(window):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + keys[at + k]
    order = np.argsort(rolled, kind="stable")
    ordered = rolled[order]
    same = ordered[1:] == ordered[:-1]
    again = np.zeros(len(at), bool)
    left, right = order[:-1][same], order[1:][same]
    if len(left):
        equal = np.ones(len(left), bool)
        for k in range(window):
            equal &= ids[at[left] + k] == ids[at[right] + k]
        if equal.all():
            again[left] = again[right] = True
        else:  # two different windows with one hash: count by the words themselves
            seen: dict[bytes, int] = {}
            close = np.unique(np.concatenate([left, right]))
            texts = [ids[at[i] : at[i] + window].tobytes() for i in close]
            for t in texts:
                seen[t] = seen.get(t, 0) + 1
            again[close] = [seen[t] > 1 for t in texts]
    row = np.repeat(np.arange(len(rows)), counts)[again]
    found = (at - np.repeat(begins, counts))[again]
    cuts = np.searchsorted(row, np.arange(1, len(rows)))
    return np.split(found, cuts)


def ranges(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Word ranges that windows with ascending starts cover."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > window) + 1
    return [(int(g[0]), int(g[-1]) + window) for g in np.split(starts, breaks)]


def count_buckets(kmers: DataFrame, window: int, dictionary: bytes, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(digest, doc_id, text_key, start, stop): word ranges of repeated windows, without a digest; and each window, with one, of a minimiser that outgrew a run."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress
        run: list[tuple] = []
        size = same = 0  # bytes in the run, and of its last minimiser
        last, passing = None, False

        def counted(rows: list[tuple]) -> pa.RecordBatch:
            out = tuple([] for _ in _FOUND)
            minis = [None, *[r[0] for r in rows], None]
            # A super-k-mer alone in its bucket that doesn't loop repeats nothing.
            live = [(r, grow(r[5]).split(b" ")) for i, r in enumerate(rows, 1) if r[4] or minis[i] in (minis[i - 1], minis[i + 1])]
            for (r, _), starts in zip(live, repeated_windows([w for _, w in live], window) if live else [], strict=True):
                for a, b in ranges(starts, window):
                    for c, x in zip(out, (None, r[1], r[2], r[3] + a, r[3] + b), strict=True):
                        c.append(x)
            return _flush(out, _FOUND)

        def passed(rows: list[tuple]) -> pa.RecordBatch:
            out = tuple([] for _ in _FOUND)
            for r in rows:
                words = grow(r[5]).split(b" ")
                for at in range(len(words) - window + 1):
                    for c, x in zip(out, (_digest(words[at : at + window]), r[1], r[2], r[3] + at, r[3] + at + window), strict=True):
                        c.append(x)
            return _flush(out, _FOUND)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if row[0] != last:
                    if passing:
                        yield passed(run)
                        run, size, passing = [], 0, False
                    elif size > run_bytes:
                        yield counted(run)
                        run, size = [], 0
                    last, same = row[0], 0
                elif same > run_bytes:
                    own = [r for r in run if r[0] == last]
                    if not passing and len(own) < len(run):
                        yield counted(run[: len(run) - len(own)])
                    yield passed(own)
                    run, size, same, passing = [], 0, 0, True
                run.append(row)
                size += len(row[5]) * 3
                same += len(row[5]) * 3
        if run:
            yield passed(run) if passing else counted(run)

    return kmers.repartition("mini").sortWithinPartitions("mini").mapInArrow(count, "digest binary, doc_id long, text_key int, start int, stop int")


def hot_minimisers(docs: DataFrame, window: int) -> frozenset[int]:
    """Minimisers of more than HOT_SHARE, or of HOT_ROWS, of the super-k-mers, as counted in a sixteenth of the rows.

    There are 1 / HOT_SHARE and one for each HOT_ROWS super-k-mers at most, which bounds what is collected: about
    one number for each 100 MB of packed words.
    """

    def minis(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"mini": [m for text in as_bytes(batch.column(1)) for m, *_ in super_kmers(text.split(), hashes, window)]}, schema=pa.schema([("mini", pa.int64())]))

    # Chosen by what a row holds, not by where it stands: a rerun or a shuffle gives the same minimisers.
    some = docs.where(F.pmod(F.xxhash64(*docs.columns[:2]), F.lit(SAMPLED)) == 0)
    counts = some.mapInArrow(minis, "mini long").groupBy("mini").count()
    counts = cut(counts)
    total = counts.agg(F.sum("count").alias("total")).first().total or 0
    least = max(HOT_LEAST, min(total * HOT_SHARE, HOT_ROWS / SAMPLED))
    return frozenset(r["mini"] for r in counts.where(F.col("count") > least).select("mini").collect())


def shared_dictionary(docs: DataFrame, size: int = 48 << 10) -> bytes:
    """Sampled text, at most size bytes, that compression refers to; it changes no result."""
    rows = docs.select(F.substring("text", 1, 600).alias("t")).limit(size // 400).collect()
    return ("Words and blanks. " + " ".join(" ".join(r.t.split()) for r in rows)).encode()[:size]


def find_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, start, stop): word ranges that repeated windows cover; ranges of one document may touch or overlap."""
    texts = id_text(docs)
    dictionary, hot = shared_dictionary(texts), hot_minimisers(texts, window)
    found = cut(count_buckets(packed(texts, window, hot, dictionary), window, dictionary))
    single = found.where("digest IS NOT NULL")
    if hot:
        single = single.unionByName(cut(hot_windows(texts, window, hot)).withColumn("stop", F.col("start") + window))
    # Written first, so that the join is dealt by digest on both sides and Spark can split a digest of many rows.
    twice = cut(single.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    place = ["doc_id", "text_key", "start", "stop"]
    return found.where("digest IS NULL").select(*place).unionByName(single.join(twice, "digest").select(*place))


KEPT = "struct<n_words:long,n_removed:long,kept:string>"


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    spans = find_repeats(docs, window).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))  # repeated rows find the same ranges
    arrow = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    @F.arrow_udf("struct<text_key:int,packed:binary>")
    def carried(texts: pa.Array) -> pa.Array:
        shrink, rows = zstandard.ZstdCompressor(level=3).compress, as_bytes(texts)
        return pa.StructArray.from_arrays([pa.array([_text_key(t) for t in rows], pa.int32()), pa.array([shrink(t) for t in rows], pa.binary())], ["text_key", "packed"])

    @F.arrow_udf(KEPT)
    def keep(texts: pa.Array, removed: pa.Array) -> pa.Array:
        grow, out = zstandard.ZstdDecompressor().decompress, []
        for text, cut in zip(texts.to_pylist(), removed.to_pylist(), strict=True):
            words = grow(text).split()
            gone = np.zeros(len(words) + 1, np.int64)
            for s in cut or ():
                gone[s["start"]] += 1
                gone[s["stop"]] -= 1
            stay = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
            out.append({"n_words": len(words), "n_removed": len(words) - len(stay), "kept": b" ".join([words[i] for i in stay.tolist()]).decode()})
        return pa.array(out, arrow)

    texts = id_text(docs).select("doc_id", carried("text").alias("c")).select("doc_id", "c.*").alias("d")
    joined = texts.join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_key") == F.col("s.text_key")), "left")
    return joined.select("d.doc_id", keep(F.col("d.packed"), F.col("s.spans")).alias("k")).select("doc_id", "k.*")
