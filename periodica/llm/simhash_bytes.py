"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is a row of positional bytes. Posting lists of single bytes would hold a 256th of all rows each,
so an index entry is a tuple of `width` positional bytes. A pair of fingerprints that agree in s of n bytes
meets under C(s, width) tuples; the number of its meetings is its tally. Pairs whose tally reaches the
guaranteed minimum are retained and verified.

Two uses:

- `near_duplicates`: 64-bit fingerprints, linked at `max_bits` or fewer differing bits. Such a pair agrees in
  8 - max_bits bytes at least (6 of 8), so it meets under C(6, 5) = 6 of the 56 tuples of five bytes: that is the
  guaranteed minimum. Bits verify. A crowded posting (texts of one template can share five bytes) doesn't make its pairs:
  its members look up what lies within max_bits outside the tuple. Links are closed to components by spreading the smallest label with pointer
  jumping; every round is checkpointed. Only distinct fingerprints are indexed.
- `drop_near_copies`: copies by the similarity of their 5-word shingle sets (Jaccard, 0.8 or more). Fingerprints
  have 480 bits in 10 groups of 6 bytes and an entry is three bytes of one group (200 tuples). Agreement in
  21 bytes makes a meeting certain; a pair of similarity 0.8 agrees in 16 of 60 on average and meets with a high
  probability (README: measured recall). Pairs that meet and agree in `LEAST` bytes are verified by the exact
  similarity of their shingle sets.

In `drop_near_copies` a large posting's pairs are never made. Every round compares the members of a posting with its
leader, the text that shares most entries with others, which is one ordered window over the postings and grows
with their rows only. Members that are copies leave all postings, leaders leave theirs. Postings of up to CROWD of the rest
give pairs. The rest of a larger one is written as differences from a centre (symmetric difference is a metric), and dealt to finer postings:
two texts that are both far from the centre, and copies of each other, have a part of these differences in common, and meet again under one of
their rarer shingles. The next round has these postings, and pairs of LEADERS times as many, until no posting is left. So no two texts are kept
that share an entry and are similar. Postings that hold more than 1 / HOT of all texts are first worked off in salted parts.

3-word fingerprints: A-Z lower-cased, words split at ASCII white space, shingles with repeats, XXH64 (seed 42); a
bit is 1 if set in over half of the hashes. Fewer words than a shingle: the whole sequence.

Edge cases: null and empty texts have fingerprint zero and link like any other; texts without words are copies
of each other. Repeated rows keep a row each in `near_duplicates`; in `drop_near_copies` one of them stays. A row
whose id is null is linked but never names a component unless it has no other member (then null), and is
never dropped. Rows that share an id but not a text are told apart by the text. An empty table gives no rows.
Very long texts are hashed in runs of bounded size. Columns besides id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodica.llm.common import as_bytes, cut, id_text, own

SHINGLE = 3
SEED = 42
#: Bytes of a 64-bit fingerprint in one index entry.
WIDTH = 5
#: A posting of more than DENSE times the ways to flip bits outside its tuple looks its links up; those ways are tabulated up to MAX_FLIPS. Rows of a batch are worked on RUN at a time.
DENSE = 2
MAX_FLIPS = 10_000
RUN = 1024
#: Fingerprints of more than 1 / HOT of all rows, at most HOT of them, are joined by broadcast; postings of so large a share are salted.
HOT = 512
SALTS = 256
HOT_LEAST = 64
#: Rows of two short columns that a broadcast may have; more are joined by shuffle.
MAX_BROADCAST = 100_000

# Near copies: words in a shingle, bytes of a fingerprint, of a group and of an entry, and bytes that a pair must share.
COPY_SHINGLE = 5
COPY_BYTES, COPY_GROUP, COPY_WIDTH = 60, 6, 3
LEAST = 8
#: A copy has nine common shingles for every four of both sets together: similarity 0.8.
COMMON, WHOLE = 9, 4
#: Texts of a posting whose pairs are made, and how many times as many in each further round.
CROWD = 8
LEADERS = 4
MAX_WORDS = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # the unpacked bits of a run stay within 4 MB
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return ones


def fingerprint_of(text: bytes, width: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - np.array([len(w) for w in words])
    n = max(1, len(words) - width + 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    return int(np.packbits(2 * _votes(hashes) > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, width: int = SHINGLE) -> Column:
    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t, width) for t in as_bytes(texts)], pa.int64())

    return fingerprints(text)


def _flips(tuples: list[tuple[int, ...]], max_bits: int) -> np.ndarray | None:
    """For each tuple, the masks of up to max_bits bits outside its bytes; None if they are more than MAX_FLIPS."""
    free = 8 * (8 - len(tuples[0]))
    if sum(comb(free, k) for k in range(1, max_bits + 1)) > MAX_FLIPS:
        return None
    bits = [[8 * i + j for i in range(8) if i not in t for j in range(8)] for t in tuples]
    return np.array([[sum(1 << x for x in chosen) for k in range(1, max_bits + 1) for chosen in combinations(b, k)] for b in bits], np.uint64).view(np.int64)


def _neighbours(dense: DataFrame, flips: np.ndarray) -> DataFrame:
    """(a, b), a < b: each member of a posting with the fingerprints that differ from it in a few bits outside the posting's tuple, there or not."""

    def flipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                part = batch.slice(at, RUN)
                a = part.column("fp").to_numpy()[:, None]
                b = a ^ flips[part.column("tuple").to_numpy()]
                rows = b > a
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(a, b.shape)[rows]), pa.array(b[rows])], ["a", "b"])

    return dense.select("fp", "tuple").mapInArrow(flipped, "a long, b long")


def links(prints: DataFrame, max_bits: int = 2, width: int = WIDTH) -> DataFrame:
    """(a, b), a < b: the pairs of a table of distinct fingerprints `fp` at most max_bits apart (up to 7).

    Members of a posting meet each other. In a posting of many members (more than twice the ways to flip up to max_bits bits outside its
    tuple: 600 as dealt) a member meets only those members that lie so few bits away, which are looked up by their value: rows grow with the members and not with their square.
    Those that it doesn't meet there are further away and verification would drop them, so each link has the tally that it has by meetings.
    Beyond MAX_FLIPS ways (four bits and more) members of all postings meet each other.
    """
    sure = 8 - max_bits  # bytes that must agree
    width = min(width, sure)
    tuples = list(combinations(range(8), width))
    masks = [sum(255 << 8 * i for i in chosen) for chosen in tuples]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    posted = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("tuple", "entry"))
    flips = _flips(tuples, max_bits)
    met = []
    if flips is not None:
        crowded = cut(posted.groupBy("tuple", "entry").agg(F.count("*").alias("n")).where(F.col("n") > DENSE * flips.shape[1]).drop("n"))
        if not crowded.isEmpty():
            near = _neighbours(posted.join(crowded, ["tuple", "entry"]), flips)
            met.append(near.join(prints.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b"))
            posted = posted.join(crowded, ["tuple", "entry"], "left_anti")
    other = posted.withColumnRenamed("fp", "other")
    met.append(posted.join(other, ["tuple", "entry"]).where(F.col("fp") < F.col("other")).select(F.col("fp").alias("a"), F.col("other").alias("b")))
    retained = reduce(DataFrame.unionAll, met).groupBy("a", "b").agg(F.count("*").alias("tally")).where(F.col("tally") >= comb(sure, width))
    return retained.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")


def components(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(fp, label): for each end of an edge (a, b) the smallest name of its component; names is (fp, label), labels may be null."""
    both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("fp", "to")
    both = cut(both)
    at = cut(both.select("fp").distinct().select("fp", F.col("fp").alias("root")))
    while True:
        heard = both.join(at.select(F.col("fp").alias("to"), "root"), "to").groupBy("fp").agg(F.min("root").alias("near"))
        near = at.join(heard, "fp").select("fp", "root", F.least("root", "near").alias("new"))
        # Pointer jumping: take the root of one's root.
        jumped = near.join(near.select(F.col("fp").alias("new"), F.col("new").alias("next")), "new").select("fp", F.least("new", "next").alias("new"), (F.least("new", "next") < F.col("root")).alias("moved"))
        jumped = cut(jumped)
        at = jumped.select("fp", F.col("new").alias("root"))
        if jumped.where("moved").isEmpty():
            break
    named = at.join(names, "fp")
    smallest = named.groupBy("root").agg(F.min("label").alias("label"))
    return at.join(smallest, "root").select("fp", "label")


def near_duplicates(docs: DataFrame, max_bits: int = 2, width: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fp (signed), component_id (the smallest id reachable over links)."""
    prints = cut(id_text(docs).select("doc_id", fingerprint(F.col("text"), width).alias("fp")))
    names = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("label"), F.count("*").alias("n")))
    linked = components(links(names.select("fp"), max_bits), names.drop("n")).withColumnRenamed("label", "low")
    wide = names.join(linked, "fp", "left").select("fp", F.coalesce("low", "label").alias("component_id"), "n")
    total = prints.count()
    # A fingerprint of a large share of all rows would be one task of a shuffled join; there are HOT of them at most.
    hot = F.broadcast(wide.where(F.col("n") * HOT > total).drop("n"))
    rest = prints.join(hot.select("fp"), "fp", "left_anti").join(wide.where(F.col("n") * HOT <= total).drop("n"), "fp")
    return prints.join(hot, "fp").unionByName(rest).select("doc_id", "fp", "component_id")


class _Words(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MAX_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


_known = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, width: int = COPY_SHINGLE) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, ascending; a text without words has one shingle of none."""
    words = text.lower().split()
    h = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, min(len(words), width), np.uint64)
    for k in range(min(width, len(words))):
        out = (out ^ (out >> np.uint64(29))) * _MIX + h[k : k + n]
    return np.unique(_mixed(out))


def copy_print(shingles: np.ndarray, size: int = COPY_BYTES) -> np.ndarray:
    """The positional bytes of a set's wide fingerprint: 64 bits from each of several hashes of its shingles."""
    rows = [np.packbits(2 * _votes(_mixed(shingles + np.uint64(int(_MIX) * k % (1 << 64)))) > len(shingles), bitorder="little") for k in range(1, -(-size // 8) + 1)]
    return np.concatenate(rows)[:size]


def entries_of(prints: np.ndarray, group: int = COPY_GROUP, width: int = COPY_WIDTH) -> np.ndarray:
    """The index entries of fingerprints (one a row): each tuple of bytes of one group, with the tuple's number above them."""
    tuples = [t for at in range(0, prints.shape[1], group) for t in combinations(range(at, at + group), width)]
    wide = prints.astype(np.int64)
    return np.stack([reduce(lambda x, i: x << 8 | wide[:, i], t, np.full(len(wide), k, np.int64)) for k, t in enumerate(tuples)], 1)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0), kind))


def _runs(texts: pa.Array) -> Iterator[pa.Array]:
    """RUN texts at a time, so that few of a batch are copied at once."""
    return (texts.slice(at, RUN) for at in range(0, len(texts), RUN))


def _set_column(text: Column) -> Column:
    @F.arrow_udf("array<long>")
    def sets(texts: pa.Array) -> pa.Array:
        return _lists([shingle_set(t).view(np.int64) for run in _runs(texts) for t in as_bytes(run)], pa.int64())

    return sets(text)


def _print_column(text: Column) -> Column:
    @F.arrow_udf("array<tinyint>")
    def prints(texts: pa.Array) -> pa.Array:
        return _lists([copy_print(shingle_set(t)).view(np.int8) for run in _runs(texts) for t in as_bytes(run)], pa.int8())

    return prints(text)


def _entry_column(prints: Column) -> Column:
    @F.arrow_udf("array<long>")
    def entries(rows: pa.Array) -> pa.Array:
        wide = rows.flatten().to_numpy().view(np.uint8).reshape(-1, COPY_BYTES)
        made = np.empty((len(wide), entries_of(wide[:0]).shape[1]), np.int64)
        for at in range(0, len(wide), RUN):
            made[at : at + RUN] = entries_of(wide[at : at + RUN])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]), pa.array(made.ravel()))

    return entries(prints)


def _shared(posted: DataFrame) -> DataFrame:
    """The postings of entries that two texts or more have, with their number n."""
    return posted.withColumn("n", F.count("*").over(Window.partitionBy("entry"))).where("n > 1")


def _ranked(posted: DataFrame, *by: str) -> DataFrame:
    """Postings with their rank in the entry, texts that meet most others first, and the entry's leader a."""
    degree = posted.withColumn("degree", F.sum("n").over(Window.partitionBy("v")))
    order = Window.partitionBy(*by).orderBy(F.desc("degree"), "v")
    return degree.withColumn("rank", F.row_number().over(order)).withColumn("a", F.first("v").over(order))


def _tallied(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("tally"))


def _met(ranked: DataFrame) -> DataFrame:
    """(a, b, tally): how often b meets a as the leader of an entry."""
    return _tallied(ranked.where("rank > 1").select("a", F.col("v").alias("b")))


def _pairs(small: DataFrame) -> DataFrame:
    """(a, b, tally): how often b meets a, a text that stands before b in an entry."""
    first = small.select("entry", F.col("v").alias("a"), F.col("rank").alias("ahead"))
    return _tallied(first.join(small.drop("a"), "entry").where("ahead < rank").select("a", F.col("v").alias("b")))


def _with_sets(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b) with the shingle sets sa and sb."""
    sets = cut(sets_of(pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct()))
    return pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")


def _copies(met: DataFrame, prints: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(v): each b of a pair whose fingerprints share LEAST positional bytes and whose shingle sets are similar."""
    equal = F.size(F.filter(F.zip_with("fa", "fb", lambda x, y: x == y), lambda same: same))
    near = cut(met.join(prints.toDF("a", "fa"), "a").join(prints.toDF("b", "fb"), "b").where(equal >= LEAST).select("a", "b"))
    similar = COMMON * F.size(F.array_intersect("sa", "sb")) >= WHOLE * (F.size("sa") + F.size("sb"))
    return _with_sets(near, sets_of).where(similar).select(F.col("b").alias("v")).distinct()


def _finer(crowded: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Of postings' members v and leaders a: those (v) that are copies of a leader (LEAST is not asked for) or of a better member near a
    centre, and postings (v, entry) under which all pairs of other members that are copies meet again.

    A leader's members are one region: they are written as what they have other than the leader, then other than what most of them
    hold (symmetric difference keeps distances). With d and e the distances of x and y from that centre and c their common part, |x ^ y| = d + e - 2 c,
    and copies have |x ^ y| <= r (|x| + |y|), r being a ninth. So 2 c >= (d - r |x|) + (e - r |y|), whose second term is no less than
    the region's least one: x has one of the first d - c + 1 shingles of its difference, in the order of their number of texts, in common with y.
    If that least one and a member's own don't add up to more than zero, that member is a copy of the one that has it.
    """
    from periodica.llm import metric_join  # it imports this module

    percent = 100 * WHOLE // (COMMON - WHOLE)
    both = _with_sets(cut(crowded.select("a", F.col("v").alias("b")).distinct()), sets_of)
    apart = both.select(F.col("a").alias("region"), F.col("b").alias("v"), F.size("sa").alias("na"), F.size("sb").alias("n"), F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa")).alias("e"))
    apart = cut(apart.withColumn("copy", COMMON * F.size("e") <= (COMMON - 2 * WHOLE) * (F.col("na") + F.col("n"))))
    gone = cut(apart.where("copy").select("v").distinct())
    near, around = metric_join._centred(apart.join(gone, "v", "left_anti").select("region", "v", "n", "e"), percent)
    if not near.isEmpty():
        names = crowded.select(F.col("v").alias("fp"), F.struct((-F.col("degree")).alias("degree"), "v").alias("label")).distinct()
        gone = cut(gone.union(components(near, names).where("fp <> label.v").select(F.col("fp").alias("v"))))
    around = cut(around.withColumn("slack", F.col("n") * (100 - percent) - F.col("k") * (100 + percent)))
    most = around.groupBy("region").agg(F.max("slack").alias("any"), F.max(F.when(~F.col("star"), F.col("slack"))).alias("open"))
    common = F.ceil(-(F.col("slack") + F.when(F.col("star"), F.col("open")).otherwise(F.col("any"))) / (2 * (100 + percent)))
    around = cut(around.join(most, "region").withColumn("first", F.least(F.col("first"), F.col("k") - common + 1).cast("int")).drop("slack", "any", "open"))
    return gone, metric_join._posted(around).select("v", F.xxhash64("region", "entry").alias("entry"))


def _best_first(met: DataFrame, prints: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(v): as _copies, but a text is compared with other leaders only if it is no copy of the one it meets most often."""
    ranked = cut(met.withColumn("place", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("tally"), "a"))))
    found = cut(_copies(ranked.where("place = 1").select("a", "b"), prints, sets_of))
    rest = ranked.where("place > 1").select("a", "b").join(found.toDF("b"), "b", "left_anti")
    return found.union(_copies(rest, prints, sets_of))


def _posted(prints: DataFrame) -> DataFrame:
    return prints.select("v", F.explode(_entry_column(F.col("fp"))).alias("entry"))


def _hot_entries(prints: DataFrame) -> DataFrame:
    """(entry): those of more than 1 / HOT of a sixteenth of the texts; tuples times HOT at most."""
    some = prints.where(F.pmod("v", F.lit(16)) == 0)
    counts = _posted(some).groupBy("entry").agg(F.count("*").alias("n"))
    return cut(counts.where(F.col("n") > max(HOT_LEAST, some.count() // HOT)).select("entry"))


def near_copies(prints: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(v): the texts that go, each a copy of one that stays or of one that went for such a copy.

    prints is (v, fp) of distinct texts; sets_of gives the shingle sets (v, shingles) of a table of texts (v).
    """
    gone = prints.select("v").limit(0)
    every, hot = prints, _hot_entries(prints)
    if not hot.isEmpty():
        salted = _posted(prints).join(F.broadcast(hot), "entry", "left_semi").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS))).withColumn("n", F.lit(1))
        gone = cut(_best_first(_met(_ranked(salted, "entry", "salt")), prints, sets_of))
        every = prints.join(gone, "v", "left_anti")
    left, crowd = cut(_shared(_posted(every))), CROWD
    while not left.isEmpty():
        ranked = cut(_ranked(left, "entry"))
        found = cut(_best_first(_met(ranked), prints, sets_of))
        gone = gone.union(found)
        rest = cut(_shared(ranked.where("rank > 1").join(found, "v", "left_anti")))
        copies = cut(_copies(_pairs(rest.where(F.col("n") <= crowd)), prints, sets_of))
        gone = gone.union(copies)
        crowded = rest.where(F.col("n") > crowd).join(copies, "v", "left_anti")
        if crowded.isEmpty():
            break
        copies, finer = _finer(crowded, sets_of)
        gone = gone.union(copies)
        left = cut(_shared(finer.join(copies, "v", "left_anti")))
        crowd *= LEADERS
    return gone


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents without copies: of equal texts the row of smallest id, of similar ones the text that meets most others.

    Texts are indexed under a 64-bit hash; should two have one hash, that of the larger digest is kept without being compared.
    """
    digest = "_digest"
    while digest in docs.columns:
        digest += "_"
    of = lambda text: F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    named = docs.where(F.col("doc_id").isNotNull())
    rows = id_text(named).select("doc_id", "text", of("text").alias("digest"), F.xxhash64("text").alias("v"))
    coded = cut(rows.select("doc_id", "digest", "v", _print_column(F.col("text")).alias("fp")))
    kept = cut(coded.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("v").alias("v"), F.first("fp").alias("fp")))
    one = cut(kept.groupBy("v").agg(F.min(F.struct("digest", "fp")).alias("one")).select("v", "one.*"))

    def sets_of(some: DataFrame) -> DataFrame:
        wanted = cut(some.join(one.select("v", "digest"), "v"))
        few = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST else wanted
        return rows.join(few, ["v", "digest"]).select("v", _set_column(F.col("text")).alias("shingles")).dropDuplicates(["v"])

    gone = near_copies(one.select("v", "fp"), sets_of)
    kept = kept.join(one.join(gone, "v", "left_semi").select("digest"), "digest", "left_anti")
    chosen = kept.select("doc_id", F.col("digest").alias(digest))
    stay = named.withColumn(digest, of("text")).join(chosen, ["doc_id", digest], "left_semi").dropDuplicates(["doc_id", digest])
    return stay.select(*map(own, docs.columns)).unionByName(docs.where(F.col("doc_id").isNull()))
