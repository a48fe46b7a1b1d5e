"""The Jaccard join, the ranked search and the conversation trie against brute force, SQL and odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from periodica.llm import hybrid_rank, metric_join, prefix_trie, queries
from periodica.llm.wu_manber import words_of

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, hit string, region string, v long"
TURNS = "conv_id long, turn long, role string, text string, node string"
SPACE = r"[^\x20\x09-\x0D]+"
UPPER = {c: c + 32 for c in range(65, 91)}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


def classes(rows, percent=90):
    """Brute force: (id, set size, smallest id reachable), sorted."""
    sets = []
    for _, t in rows:
        w = re.findall(SPACE, (t or "").translate(UPPER))
        sets.append(frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[top(a)] = top(b)
    low = {}
    for a, (i, _) in enumerate(rows):
        low[top(a)] = min(filter(lambda x: x is not None, (low.get(top(a)), i)), default=None)
    return sorted(((i, len(sets[a]), low[top(a)]) for a, (i, _) in enumerate(rows)), key=repr)


def joined(spark, rows, **kw):
    return sorted((tuple(r) for r in metric_join.join_documents(frame(spark, rows).repartition(3), **kw).collect()), key=repr)


def edited(words, dice, edits, vocabulary=100_000):
    out = list(words)
    for _ in range(edits):
        out[dice.randrange(len(out))] = f"e{dice.randrange(vocabulary)}"
    return out


def test_join_of_groups_of_near_copies(spark):
    """Two bases, sub-bases with edits of their own, and their copies with more: large cells, regions, centres and deeper regions."""
    dice = random.Random(1)
    rows = []
    for base in range(2):
        words = [f"b{base}w{dice.randrange(900)}" for _ in range(150)]
        for _ in range(4):
            sub = edited(words, dice, 3)
            rows += [" ".join(edited(sub, dice, dice.randint(0, 4))) for _ in range(35)]
    rows += [" ".join(f"u{dice.randrange(50)}" for _ in range(dice.randint(1, 40))) for _ in range(60)]
    rows = list(enumerate(rows))
    assert joined(spark, rows) == classes(rows)


def test_join_of_a_group_that_needs_deeper_regions(spark, monkeypatch):
    dice = random.Random(3)
    monkeypatch.setattr(metric_join, "LEAF", 3)
    words = [f"w{k}" for k in range(120)]
    tops = [edited(words, dice, 4) for _ in range(5)]
    rows = list(enumerate(" ".join(edited(dice.choice(tops), dice, dice.randint(0, 3), 12)) for _ in range(150)))
    divided = []
    monkeypatch.setattr(metric_join, "_divided", lambda *a, f=metric_join._divided: divided.append(1) or f(*a))
    assert joined(spark, rows) == classes(rows)
    assert divided


@pytest.mark.parametrize("percent", [80, 95])
def test_join_at_other_similarities(spark, percent):
    dice = random.Random(percent)
    words = [f"w{dice.randrange(300)}" for _ in range(90)]
    rows = list(enumerate(" ".join(edited(words, dice, dice.randint(0, 6), 30)) for _ in range(120)))
    assert joined(spark, rows, percent=percent) == classes(rows, percent)


def test_join_of_odd_rows(spark):
    long = " ".join(f"w{i % 700}x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "same row here " * 9), (7, "same row here " * 9), (7, "another text of that id"), (None, "no name at all"), (None, "no name  at all"), (8, "no NAME at all"), (9, long), (10, long + " end"), (11, "É é"), (12, "é É")]
    assert joined(spark, rows) == classes(rows)
    assert joined(spark, [(None, "only nameless rows"), (None, "only nameless rows")]) == [(None, 1, None)] * 2
    assert joined(spark, []) == []


def test_frequent_shingles_are_bounded(spark):
    df = frame(spark, [(i, f"the very same words t{i} u{i} v{i}") for i in range(900)])
    keys, counts = metric_join.frequent_shingles(df, 3)
    assert len(keys) == 2 and (np.diff(keys.astype(object)) > 0).all() and min(counts) >= 4
    assert len(metric_join.frequent_shingles(df, 3, most=1)[0]) == 0  # both are equally frequent


def ranking(docs, items, k):
    """Brute force: (item, rank, doc, score)."""
    counts = [(i, Counter(words_of((t or "").encode()))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, all_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        if i is not None:
            asked[i].update(words_of((t or "").encode()))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in counts:
            m = 25 + 75 * c.total() * n_docs // all_terms if c else 0
            s = sum(n * hybrid_rank.weight(df[t], n_docs) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, n in terms.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "short", "first"), [(10, 16, 256), (3, 2, 4), (1, 10**6, 8), (50, 1, 16)])
def test_ranking_equals_brute_force(spark, monkeypatch, k, short, first):
    monkeypatch.setattr(hybrid_rank, "SHORT", short)
    monkeypatch.setattr(hybrid_rank, "FIRST", first)
    dice = random.Random(k)
    word = lambda: f"W{int(dice.paretovariate(0.6)) % 400}"
    docs = [(i, " ".join(word() for _ in range(dice.randint(1, 60)))) for i in range(700)] + [(900, "w1"), (901, "w1"), (None, "w1"), (899, "w1"), (902, None), (903, "!! --")]
    items = [(i, " ".join(word() for _ in range(dice.randint(1, 12)))) for i in range(12)] + [(20, "w1 W1 w1"), (21, None), (22, "missing"), (None, "w1"), (20, "w2")]
    monkeypatch.setattr(hybrid_rank, "ITEM_BYTES", 150)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = hybrid_rank.rank_documents(frame(spark, docs).repartition(3), spark.createDataFrame(items, "item_id long, text string"), k)
        assert sorted(map(tuple, got.collect()), key=repr) == ranking(docs, items, k)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ranking_of_empty_tables(spark):
    items = spark.createDataFrame([("a", "one two")], "item_id string, text string")
    docs = frame(spark, [(1, "one"), (2, "Two é")])
    assert hybrid_rank.rank_documents(frame(spark, []), items).count() == 0
    assert hybrid_rank.rank_documents(docs, items.limit(0)).count() == 0
    assert hybrid_rank.rank_documents(frame(spark, [(1, None), (2, "..")]), items).count() == 0
    assert [(r.item_id, r["rank"], r.doc_id) for r in hybrid_rank.rank_documents(docs, items).orderBy("rank").collect()] == [("a", 1, 1), ("a", 2, 2)]


def test_long_lists_are_skipped():
    """A document that holds only the frequent term isn't scored once rarer ones have filled the ranks."""
    n = 3000
    sizes = np.full(n, 10)
    terms = [[0, 1] if i < 40 else [0] for i in range(n)]
    shard = hybrid_rank.Shard(sizes, np.cumsum([0, *map(len, terms)]), np.array(sum(terms, [])), np.ones(sum(map(len, terms)), np.int64), n, 10 * n, 2)
    looked = []
    shard.lookup = lambda t, wanted, f=shard.lookup: looked.append(len(wanted)) or f(t, wanted)
    docs, _ = shard.best(np.array([0, 1]), np.array([3, 4000]), 5, 1)
    assert set(docs) <= set(range(40)) and sum(looked) <= 50


def nodes(rows, heads=True):
    """Brute force rows of the trie."""
    convs = defaultdict(list)
    said = lambda role, text: hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), said(role, text), role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    paths = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if heads else 0
        paths[c] = own.get(c - c % 20, [])[:h] + t[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
        ends[tuple(paths[c])].append(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        parents = {x[:-1] for x in below if x}
        saved = sum((len(members[x]) - 1) * len(re.findall(SPACE, x[-1][1])) for x in below if x)
        n_children = sum(len(x) == len(node) + 1 for x in below)
        out.append((m[0], len(node), min(members[node[:-1]]) if node else None, len(m), n_children, sum(x not in parents for x in below), saved, hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()))
    return sorted(out, key=repr)


def talk(dice, n):
    """Conversations with shared starts, copies, missing bases and empty turns."""
    rows = []
    for c in [*range(n), *range(400, 412), 1000]:
        if c == 60:
            continue
        for turn in range(dice.randint(1, 7)):
            rows.append((c, turn if turn else None, dice.choice(["user", None]), " ".join(["hi", "so", ""][dice.randrange(3)] for _ in range(turn % 3))))
    rows += [(c, k, "user", f"copy {k}") for c in range(2000, 2030) for k in range(5)]
    rows += [(None, 1, "user", "left out"), (3000, 0, None, None), (3000, 0, None, None)]
    return rows


def turns(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], TURNS)


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_trie_equals_brute_force(spark, shards):
    rows = talk(random.Random(shards), 90)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(shards))
    try:
        assert sorted(map(tuple, prefix_trie.shared_head_trie(turns(spark, rows)).collect()), key=repr) == nodes(rows)
        assert sorted(map(tuple, prefix_trie.conversation_trie(turns(spark, rows)).collect()), key=repr) == nodes(rows, heads=False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_trie_with_a_small_bound_on_the_skeleton(spark):
    rows = talk(random.Random(5), 40)
    paths = prefix_trie.shared_heads(prefix_trie.conversations(turns(spark, rows)))
    assert sorted(map(tuple, prefix_trie.trie(paths, max_nodes=3).collect()), key=repr) == nodes(rows)


def test_trie_of_odd_tables(spark):
    assert prefix_trie.shared_head_trie(turns(spark, [])).count() == 0
    long = [(7, k, "user", "word " * (k % 3)) for k in range(3000)]
    got = prefix_trie.conversation_trie(turns(spark, long))
    assert got.count() == 3001 and got.agg(F.max("depth"), F.sum("n_leaves"), F.sum("saved_tokens")).first() == (3000, 3001, 0)
    # Nothing of a conversation is left if its turns all lie in the head and the base is missing.
    gone = next(c for c in range(21, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    assert [tuple(r)[:7] for r in prefix_trie.shared_head_trie(turns(spark, [(gone, 0, "user", "x")])).collect()] == [(gone, 0, None, 1, 0, 1, 0)]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    assert oracle.difference(spark, oracle.connection(DATA), DATA, queries.QUERIES[name], queries.SQL[name]) is None


def test_join_of_the_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op11_jaccard_metric_join(spark, DATA).collect()), key=repr) == classes(docs)
