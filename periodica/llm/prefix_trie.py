"""The trie of conversation prefixes, by sorted shards around a broadcast skeleton.

A conversation is a path of turns; a node is a distinct sequence of first turns. Paths are lists of 128-bit
digests of (role, text) with word counts, so texts are read once and never moved.

1. Equal paths are collapsed, with their number, smallest conversation and the digest of their ids.
2. Distinct paths are range-partitioned and sorted: every node's paths are a run, and a run lies in one shard or in neighbours.
3. Splitter paths (the first path of each shard) form the skeleton. A node whose run crosses a border is a prefix of a
   splitter, so it is in the skeleton. The skeleton is broadcast.
4. Every shard is walked once with a stack of open nodes. A node outside the skeleton is finished there, with its subtree's
   sums. For a skeleton node the shard gives partial aggregates.
5. Partial aggregates of skeleton nodes are added up by a grouping, and the skeleton is closed from its leaves to the root.

Bounds: the skeleton has at most MAX_NODES turns. It is made of one path a shard; if those are longer, the
number of shards is halved until they fit (one shard has no splitter). A worker holds the open path, and for each
open node the numbers of its closed children, which wait for their parent's smallest conversation; a shard's children
are bounded by the shard. A conversation is one row of 20 bytes a turn. The ids of equal paths pass one task in order, since SHA-256
has no parts that could be combined, but as a stream: nothing is held.

Edge cases: null role and text are empty; a null turn comes first; turns of equal number are ordered by their digest, and
repeated rows are turns of their own; rows with a null conv_id are left out; an empty text has no words; a
conversation without turns ends at the root; an empty table has no node; other columns, whatever their names, aren't read. Negative
ids take Spark's remainder, which has the sign of the id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import cut

#: Turns that the splitter paths may have together: at 100 bytes each some 100 MB in a worker.
MAX_NODES = 1_000_000
NONE = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PART = f"{NODE}, skeleton long, parent long"
_KIND = {"string": pa.string()}
_SCHEMA = pa.schema([(c.split()[0], _KIND.get(c.split()[1], pa.int64())) for c in PART.split(", ")])


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (turn, digest, words)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    words = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("int")
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), digest.alias("digest"), words.alias("words")).alias("turn"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def shared_heads(convs: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, turns): the first h turns of conversation c - c % every, then one's own after the first h; h is crc32(c) % heads."""
    base = F.col("conv_id") - F.col("conv_id") % every
    first = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("first"))
    joined = convs.withColumn("base", base).join(first, "base", "left").withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int"))
    own = F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")
    return joined.select("conv_id", F.concat(F.coalesce(F.expr("slice(first, 1, h)"), F.expr("slice(turns, 1, 0)")), own).alias("turns"))


def _ends(paths: DataFrame) -> DataFrame:
    """(key, ends_sha256): over the ids of each key, in ascending order, as a stream."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = sha = None
        for batch in batches:
            out: list[tuple[bytes, str]] = []
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k == key:
                    sha.update(b",%d" % c)
                    continue
                if sha:
                    out.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256(b"%d" % c)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([s for _, s in out], pa.string())], ["key", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], ["key", "ends_sha256"])

    return paths.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(digests, "key binary, ends_sha256 string")


class Skeleton:
    """The trie of the splitter paths; the root is node 0."""

    def __init__(self, splitters: list[list[bytes]]) -> None:
        self.children: list[dict[bytes, int]] = [{}]
        self.parent = [-1]
        for path in splitters:
            at = 0
            for turn in path:
                if turn not in self.children[at]:
                    self.children[at][turn] = len(self.parent)
                    self.children.append({})
                    self.parent.append(at)
                at = self.children[at][turn]


class _Open:
    """A node whose run has begun. words: of its last text; saved: of what lies below."""

    __slots__ = ("children", "low", "ends", "leaves", "n", "saved", "skeleton", "turn", "waiting", "words")

    def __init__(self, turn: bytes, words: int, skeleton: int) -> None:
        self.turn, self.words, self.skeleton = turn, words, skeleton
        self.n = self.children = self.leaves = self.saved = 0
        self.low: int | None = None
        self.ends = NONE
        self.waiting: list[tuple] = []  # closed children, which lack this node's smallest conversation


class Walk:
    """One shard's walk: feed sorted distinct paths, take finished rows."""

    def __init__(self, skeleton: Skeleton) -> None:
        self.skeleton = skeleton
        self.open = [_Open(b"", 0, 0)]
        self.out: list[tuple] = []

    def close(self) -> None:
        node = self.open.pop()
        depth, above = len(self.open), self.open[-1] if self.open else None
        self.out += [(c[0], depth + 1, node.low, *c[1:], None, None) for c in node.waiting] if node.skeleton < 0 else []
        if node.skeleton >= 0:
            # Its own words are added when its conversations of all shards are known.
            self.out.append((node.low, depth, None, node.n, node.children, node.leaves, node.saved, node.ends if node.ends != NONE else None, node.skeleton, node.words))
        else:
            node.saved += (node.n - 1) * node.words
            node.leaves += node.children == 0
            row = (node.low, node.n, node.children, node.leaves, node.saved, node.ends)
            above.children += 1
            above.leaves += node.leaves
            above.saved += node.saved
            if above.skeleton >= 0:
                self.out.append((row[0], depth, None, *row[1:], None, above.skeleton))
            else:
                above.waiting.append(row)
        if above:
            above.n += node.n
            above.low = node.low if above.low is None or (node.low is not None and node.low < above.low) else above.low

    def feed(self, path: list[tuple[bytes, int]], n: int, low: int, ends: str) -> None:
        same = 0
        while same < len(path) and same + 1 < len(self.open) and self.open[same + 1].turn == path[same][0]:
            same += 1
        while len(self.open) > same + 1:
            self.close()
        for turn, words in path[same:]:
            above = self.open[-1].skeleton
            self.open.append(_Open(turn, words, self.skeleton.children[above].get(turn, -1) if above >= 0 else -1))
        last = self.open[-1]
        last.n, last.low, last.ends = n, low, ends

    def end(self) -> None:
        while self.open:
            self.close()


def _shards(distinct: DataFrame, parts: int, max_nodes: int) -> tuple[DataFrame, Skeleton]:
    """The distinct paths in sorted shards, and the skeleton of their first paths, which has at most max_nodes turns."""
    while True:
        ordered = distinct.repartitionByRange(parts, "path") if parts > 1 else distinct.coalesce(1)
        sorted_ = cut(ordered.sortWithinPartitions("path").withColumn("shard", F.spark_partition_id()))
        first = sorted_.groupBy("shard").agg(F.min("path").alias("path"))
        if parts == 1:
            return sorted_, Skeleton([])
        if (first.agg(F.sum(F.size("path"))).first()[0] or 0) <= max_nodes:
            return sorted_, Skeleton([[bytes(x) for x in r.path] for r in first.orderBy("path").collect()])
        parts //= 2


def trie(paths: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """One row per node of the conversations (conv_id, turns), as NODE names them."""
    spark = paths.sparkSession
    steps = F.transform("turns", lambda t: t.digest)
    keyed = cut(paths.select("conv_id", steps.alias("path"), F.transform("turns", lambda t: t.words).alias("words"), F.unhex(F.md5(F.array_join(F.transform(steps, F.hex), "").cast("binary"))).alias("key")))
    distinct = keyed.groupBy("key").agg(F.first("path").alias("path"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("low"))
    distinct = distinct.join(_ends(keyed), "key").drop("key")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_, skeleton = _shards(distinct, parts, max_nodes)
    shared = spark.sparkContext.broadcast(skeleton)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(shared.value)
        for batch in batches:
            for path, words, n, low, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                walk.feed(list(zip(path, words, strict=True)), n, low, ends)
                if len(walk.out) > 10_000:
                    yield _batch(walk.out)
                    walk.out = []
        if walk.open[0].n or len(walk.open) > 1:
            walk.end()
        yield _batch(walk.out)

    made = cut(sorted_.select("path", "words", "n", "low", "ends_sha256").mapInArrow(walked, PART))
    whole = _finished(made.where("skeleton is not null"), skeleton)
    upper = spark.createDataFrame([(i, r[0], *r) for i, r in whole.items()], f"node long, low long, {NODE}")
    below = made.where("skeleton is null").join(F.broadcast(upper.select(F.col("node").alias("parent"), "low")), "parent", "left")
    names = [c.split()[0] for c in NODE.split(", ")]
    return below.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "low")).select(names).union(upper.select(names))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _finished(parts: DataFrame, skeleton: Skeleton) -> dict[int, tuple]:
    """The skeleton's nodes as NODE rows: partial aggregates added up by a grouping (a row a skeleton node), then closed from the leaves."""
    plus = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    added = parts.groupBy("skeleton").agg(F.min("conv_id").alias("low"), F.first("depth").alias("depth"), *plus, F.max("ends_sha256").alias("ends"), F.max("parent").alias("words"))
    nodes = {r.skeleton: r.asDict() for r in added.collect()}  # MAX_NODES and the root at most
    for i in sorted(nodes, key=lambda i: -nodes[i]["depth"]):
        node, above = nodes[i], nodes.get(skeleton.parent[i])
        node["saved_tokens"] += (node["n_convs"] - 1) * node["words"]
        node["n_leaves"] += node["n_children"] == 0
        if above:
            above["n_children"] += 1
            above["n_leaves"] += node["n_leaves"]
            above["saved_tokens"] += node["saved_tokens"]
    low = {i: n["low"] for i, n in nodes.items()}
    return {i: (n["low"], n["depth"], low.get(skeleton.parent[i]), n["n_convs"], n["n_children"], n["n_leaves"], n["saved_tokens"], n["ends"] or NONE) for i, n in nodes.items()}


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of the conversations as they stand."""
    return trie(conversations(turns))


def shared_head_trie(turns: DataFrame) -> DataFrame:
    """The trie of the conversations with heads shared in groups of twenty (`shared_heads`)."""
    return trie(shared_heads(cut(conversations(turns))))
