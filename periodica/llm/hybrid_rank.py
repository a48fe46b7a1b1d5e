"""Ranked lexical search: short lists term at a time, long lists document at a time.

The documents become an index of the query terms only: for each document its number of terms, and the query
terms that it holds with their counts. Shards of the index (runs of rows of a partition) are inverted in a
worker, and every item runs over a shard in two parts:

1. Term at a time: the lists that hold a 1 / SHORT of the shard's documents or less are summed into accumulators.
2. Document at a time: the accumulators are one more iterator, bounded by their own values, beside the long
   lists, each bounded by its best contribution in the shard. Lists whose bounds together stay below the
   score of the item's k-th best document so far bring up no documents of their own; documents that are brought up
   are looked up in the long lists in falling order of bounds and are given up as soon as what remains can't reach
   that score. It is carried from shard to shard of a partition.

The k best of each partition meet in one ranking an item, limited before the shuffle. All bounds are exact, so no
document is lost; equal scores rank by ascending doc_id.

Terms are the runs of digits, letters and characters beyond ASCII, with A-Z lower-cased. Score: see `contribution` and `weight`.

Scale: one pass over the texts for each block of items (ITEM_BYTES of item texts); the vocabulary of a block is
broadcast and bounded by it. Statistics (number of documents with a term, all terms, documents of each
query term) cover all documents.

Edge cases: null and empty texts, and texts without terms, are no documents and never ranked. Items without
terms give no rows. Rows of `items` that share an id are one item with the terms of all its rows; items with a null id
are left out. Rows of `docs` that share an id are ranked each for itself, null ids after others of equal score. Empty
tables give no rows. Very long texts are counted whole. Columns besides id and text are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periodica.llm.common import as_bytes, cut, id_text
from periodica.llm.wu_manber import words_of

#: Bytes of item texts that one pass over the documents serves; bounds what is broadcast.
ITEM_BYTES = 16 << 20
#: Lists of at most a 1 / SHORT of a shard's documents are summed term at a time.
SHORT = 16
#: Candidates that the first step of the document-at-a-time part scores; each further step takes twice as many.
FIRST = 256


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def contribution(tf: np.ndarray, n_terms: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    m = 100 - 75 + 75 * n_terms * n_docs // all_terms
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): the documents with a term, their number of terms, and the vocabulary's terms in them."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            sizes, ends, terms, tfs = [], [0], [], []
            for text in as_bytes(batch.column(1)):
                words = words_of(text)
                found = Counter(filter(known.__contains__, words))
                sizes.append(len(words))
                terms.extend(map(known.__getitem__, found))
                tfs.extend(found.values())
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    made = id_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(counted, "doc_id long, n long, terms array<int>, tfs array<int>")
    return made.where("n > 0")


class Shard:
    """The inverted lists of a run of documents; documents are numbered by their place."""

    def __init__(self, sizes: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_docs: int, all_terms: int, vocabulary: int):
        at = np.repeat(np.arange(len(sizes)), np.diff(ends))
        order = np.argsort(terms, kind="stable")
        self.n = len(sizes)
        self.docs = at[order]
        self.values = contribution(tfs.astype(np.int64), sizes[at], n_docs, all_terms)[order]
        self.starts = np.searchsorted(terms[order], np.arange(vocabulary + 1))
        filled = np.flatnonzero(np.diff(self.starts))
        self.most = np.zeros(vocabulary, np.int64)
        if len(filled):
            self.most[filled] = np.maximum.reduceat(self.values, self.starts[filled])

    def lookup(self, term: int, wanted: np.ndarray) -> np.ndarray:
        """The term's contribution to each of the ascending documents wanted, 0 where it doesn't occur."""
        a, b = self.starts[term], self.starts[term + 1]
        docs = self.docs[a:b]
        at = np.minimum(np.searchsorted(docs, wanted), b - a - 1)
        return np.where(docs[at] == wanted, self.values[a:b][at], 0)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of this shard with scores above 0 and of at least `least`; all that are among its k best, perhaps more."""
        lengths = self.starts[terms + 1] - self.starts[terms]
        terms, weights, lengths = terms[lengths > 0], weights[lengths > 0], lengths[lengths > 0]
        short = lengths * SHORT <= self.n
        sums = np.zeros(self.n, np.int64)
        for t, w in zip(terms[short], weights[short], strict=True):
            a, b = self.starts[t], self.starts[t + 1]
            sums[self.docs[a:b]] += w * self.values[a:b]
        terms, weights = terms[~short], weights[~short]
        bounds = weights * self.most[terms]
        order = np.argsort(-bounds, kind="stable")
        terms, weights, bounds = terms[order], weights[order], bounds[order]
        left = np.append(np.cumsum(bounds[::-1])[::-1], 0)  # what the lists from i on can still add

        def scored(docs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
            score = sums[docs]
            for i, (t, w) in enumerate(zip(terms, weights, strict=True)):
                open_ = score + left[i] >= least
                docs, score = docs[open_], score[open_]
                if not len(docs):
                    break
                score = score + w * self.lookup(t, docs)
            return docs[score >= least], score[score >= least]

        least = max(least, 1)
        held = np.flatnonzero(sums)
        if len(held) > k:  # the fullest accumulators first, for a high mark to beat
            first = np.sort(held[np.argpartition(-sums[held], k - 1)[:k]])
            _, score = scored(first, 1)
            if len(score) >= k:
                least = max(least, int(np.partition(score, -k)[-k]))
        essential = int(np.searchsorted(-left, -least, side="right"))  # lists that can bring up a document of their own
        up = np.zeros(self.n, bool)
        up[held] = True
        for t in terms[:essential]:
            up[self.docs[self.starts[t] : self.starts[t + 1]]] = True
        todo, step = np.flatnonzero(up), FIRST
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(todo):
            d, s = scored(todo[:step], least)
            docs, scores = np.concatenate([docs, d]), np.concatenate([scores, s])
            if len(scores) > k:
                least = max(least, int(np.partition(scores, -k)[-k]))
                docs, scores = docs[scores >= least], scores[scores >= least]
            todo = todo[step:]
            todo, step = todo[sums[todo] + left[0] >= least], step * 2
        return docs, scores


class Best:
    """The k best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.nulls, self.scores = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, ids: np.ndarray, nulls: np.ndarray, scores: np.ndarray) -> None:
        ids, nulls, scores = (np.concatenate(x) for x in ((self.ids, ids), (self.nulls, nulls), (self.scores, scores)))
        order = np.lexsort((ids, nulls, -scores))[: self.k]
        self.ids, self.nulls, self.scores = ids[order], nulls[order], scores[order]


def _block(docs: DataFrame, items: list[tuple[object, Counter]], k: int) -> DataFrame:
    """(item, doc_id, score): the k best of each partition for each numbered item."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    made = cut(index(docs, vocabulary))
    n_docs, all_terms = made.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in made.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a query term
        df[r["term"]] = r["count"]
    asked = []
    for _, terms in items:
        ids = np.array(sorted(vocabulary[t] for t in terms if df[vocabulary[t]]), np.int64)
        named = {vocabulary[t]: n for t, n in terms.items()}
        asked.append((ids, np.array([weight(int(df[i]), n_docs) * named[int(i)] for i in ids], np.int64)))
    shared = spark.sparkContext.broadcast(asked)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in shared.value]
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            ends = np.append(0, np.cumsum(column["terms"].value_lengths().to_numpy(zero_copy_only=False)))
            shard = Shard(column["n"].to_numpy(), ends, column["terms"].flatten().to_numpy(), column["tfs"].flatten().to_numpy(), n_docs, all_terms, len(df))
            nulls = column["doc_id"].is_null().to_numpy(zero_copy_only=False)
            ids = column["doc_id"].fill_null(0).to_numpy()
            for mine, (terms, weights) in zip(best, shared.value, strict=True):
                found, scores = shard.best(terms, weights, k, mine.least)
                mine.add(ids[found], nulls[found], scores)
        numbers = np.repeat(np.arange(len(best)), [len(b.ids) for b in best])
        joined = lambda name, kind: np.concatenate([getattr(b, name) for b in best]) if best else np.zeros(0, kind)
        doc_ids = pa.array(joined("ids", np.int64), pa.int64(), mask=joined("nulls", bool))
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), doc_ids, pa.array(joined("scores", np.int64), pa.int64())], ["item", "doc_id", "score"])

    return made.mapInArrow(ranked, "item long, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per item and ranked document: item_id, rank (from 1), doc_id, score."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("item_id is not null")
    blocks = -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    done = []
    for i in range(blocks):
        terms: dict[object, Counter] = {}
        for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).collect():  # about ITEM_BYTES
            terms.setdefault(r.item_id, Counter()).update(words_of(r.text.encode()))
        if not any(terms.values()):
            continue
        numbered = spark.createDataFrame([(n, item) for n, item in enumerate(terms)], f"item long, item_id {asked.schema['item_id'].dataType.simpleString()}")
        found = _block(docs, list(terms.items()), k).join(F.broadcast(numbered), "item")
        done.append(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    if not done:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return reduce(DataFrame.unionByName, done)
