"""The training-data operators against brute force, the libraries, and odd tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from periodica.llm import piece_sampling, quality_bt, quality_rules, queries, repair_ids, secret_scan, simhash_bytes, superkmer_dedup, token_transducer, toxicity_ftrl, wu_manber

DATA = "/root/testdata/sf0.001"
SPACE = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


def odd(spark):
    """Null and empty texts, a null id, repeated rows, one long word, one long text, marks, and names that could clash."""
    long = " ".join(f"w{i % 700}x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "no id here"), (4, "same row " * 30), (4, "same row " * 30), (5, "x" * 50_000), (6, long), (7, "é▁ 😀 <|endoftext|> password = 'abcdefg' ok"), (8, "one")]
    df = frame(spark, rows)
    for name in ("hit", "row", "score", "spans", "words", "fp", "mini", "start", "c", "y", "kept"):
        df = df.withColumn(name, F.lit("own"))
    return df


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_signatures_of_every_query(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet").count()
    for name, query in queries.QUERIES.items():
        if name not in queries.SQL:  # those have rows of other kinds, and SQL to be held against
            assert query(spark, DATA).count() == documents, name


def test_token_counts_equal_the_library(spark, documents, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = by_id(queries.op2_token_counts(spark, DATA))
    for i, text in texts.items():
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len(text.encode()), n > 1024)


def test_token_counts_of_odd_strings():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, dice = Tokenizer.from_file(path), random.Random(5)
    letters = [*"abstmdrvel'   \n\t12.,!é你😀 ", "'re", "'ll", "<|endoftext|>", "don't", " the", "́", "\x1c"]
    texts = ["".join(dice.choice(letters) for _ in range(dice.randint(0, 50))) for _ in range(1500)] + ["a" * 3000, " " * 500, "'", "'r", "\n\n "]
    assert token_transducer.count_texts(texts, path) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counter_forgets_without_changing_counts(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [f"word{i} and{i * 7}ing" for i in range(400)]
    whole = token_transducer.count_texts(texts, path)
    token_transducer._counter.cache_clear()
    monkeypatch.setattr(token_transducer, "MAX_STATES", 50)
    assert token_transducer.count_texts(texts, path) == whole
    token_transducer._counter.cache_clear()


def test_one_long_piece_keeps_the_tables_bounded(monkeypatch):
    from tokenizers import Tokenizer

    path, dice = public_tokenizers.path("byte_bpe_50k.json"), random.Random(17)
    text = "".join(dice.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOP") for _ in range(300_000))
    token_transducer._counter.cache_clear()
    monkeypatch.setattr(token_transducer, "MAX_STATES", 3000)
    assert token_transducer.count_texts([text], path) == [len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)]
    assert len(token_transducer._counter(path)[0].sets) <= 3000
    token_transducer._counter.cache_clear()
    with pytest.raises(ValueError, match="splitter"):
        token_transducer.count_texts(["a"], public_tokenizers.path("word_bpe_49k.json"))


BASE = {"assign": re.compile(rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), "access": re.compile(rb"AKIA[A-Z0-9]+"), "hex": re.compile(rb"[0-9a-f]+")}


def base_spans(data):
    least = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    return sorted(((m.start(), m.end(), k) for k, (kind, r) in enumerate(BASE.items()) for m in r.finditer(data) if least[kind](m)), key=lambda s: (s[0], s[2]))


def test_secret_spans_equal_regexes(texts):
    compiled, dice = secret_scan.compile_rules(), random.Random(2)
    parts = ["password", "token", "TOKEN", "Secret", "api_key", "apikey", "=", ":", " ", "'", '"', "abc", "0123456789abcdef", "AKIA", "ABCDEFGH", "x", "é", "==", "\n"]
    tests = [t.encode() for t in texts.values()] + ["".join(dice.choice(parts) for _ in range(dice.randint(1, 22))).encode() for _ in range(6000)]
    for data in tests:
        assert [s for s in secret_scan.spans_of(data, compiled) if s[2] < 3] == base_spans(data)


def test_secrets_are_counted_in_code_points_and_covered(spark):
    df = frame(spark, [(1, "é token=abcdef9 é"), (2, "token=abc"), (3, None), (4, "-----BEGIN RSA PRIVATE KEY----- x")])
    spans = {i: [(s.kind, s.start, s.end) for s in r.spans] for i, r in by_id(secret_scan.find_secrets(df)).items()}
    assert spans == {1: [("assign", 2, 15)], 2: [], 3: [], 4: [("pem", 0, 31)]}
    covered = by_id(secret_scan.redact(df))
    assert covered[1].text == "é [SECRET] é" and covered[1].n_chars == 12 and covered[3].text is None and covered[2].text == "token=abc"


def test_quality_rules_base(spark, texts):
    got = by_id(queries.op3_quality_rules(spark, DATA))
    for i, t in texts.items():
        w = re.findall(SPACE, t)
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {x for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for x in range(k, k + 5)}
        lines = [x for x in t.split("\n") if re.search(SPACE, x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w)) and (not r.base_failed or not r.kept)


def test_quality_rules_prefer_the_trusted(spark):
    dice = random.Random(6)
    good = [(i, " ".join(f"word{dice.randint(0, 40)}" for _ in range(60))) for i in range(0, 60)]
    junk = [(i, " ".join(f"z{i}q{k}###" for k in range(30))) for i in range(60, 90)]
    got = by_id(quality_rules.score_rules(frame(spark, good + junk), labels(spark, [(i, int(i < 60), 0) for i in range(90)])))
    assert min(got[i].score for i in range(60)) > max(got[i].score for i in range(60, 90))
    assert not any(got[i].kept for i in range(60, 90))


def test_id_files_round_trip(spark, texts):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = by_id(queries.op5_repair_token_ids(spark, DATA))
    for i in sorted(texts):
        ids = np.array(library.encode(texts[i], add_special_tokens=False).ids + [1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_grammar_expands_to_what_it_compressed():
    dice = np.random.default_rng(0)
    ids = dice.integers(0, 30, 5000).astype(np.int32)
    ids[1000:1400] = 7
    ends = np.array([1, 2, 700, 1200, 1201, 5000])
    symbols, cuts, rules = repair_ids.compress(ids, ends, 49_408, least=8)
    grammar = repair_ids.Grammar(rules, repair_ids.expansion_lengths(rules, 49_408), 49_408)
    assert len(symbols) < len(ids) and (grammar.expand(symbols) == ids).all()
    begin = 0
    for cut, a, b in zip(cuts, [0, *ends], ends, strict=False):  # each document alone
        assert (grammar.expand(symbols[begin:cut]) == ids[a:b]).all()
        begin = cut


def test_words_with_marks_equal_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder, dice = Tokenizer.from_file(path), repair_ids.Encoder(path, 1), random.Random(9)
    letters = [*"abcXYZ019'\"#$.,;!?-_é×ñß中 ́…\u00a0\u2028\x1c\x85 \t\n   ", "'s", "n't", "<|endoftext|>", "<|", "|>", "İ", "ﬁ", "Å", "e\u0301", "ǅ"]
    texts = ["".join(dice.choice(letters) for _ in range(dice.randint(0, 40))) for _ in range(4000)] + ["", "a" * 5000, "." * 3000]
    for some in (texts, texts[::-1]):
        ids, ends = encoder([t.encode() for t in some])
        for t, a, b in zip(some, [0, *ends], ends, strict=False):
            assert ids[a:b].tolist() == [*library.encode(t, add_special_tokens=False).ids, 1], t


def test_one_document_is_decoded_alone(spark, tmp_path):
    dice = random.Random(4)
    rows = [(i, " ".join(dice.choice(["red apple", "green pear", "odd"]) for _ in range(dice.randint(0, 300)))) for i in range(60)]
    repair_ids.write_ids(frame(spark, rows), f"{tmp_path}/ids", public_tokenizers.path("word_bpe_49k.json"))
    blocks = repair_ids.read_ids(spark, f"{tmp_path}/ids")
    whole = {r.doc_id: list(r.ids) for r in repair_ids.decode_documents(blocks).collect()}
    seen = 0
    for block in blocks.collect():
        assert len(block.rules)
        for i, doc in enumerate(block.doc_ids):
            assert repair_ids.decode_one(block, i) == whole[doc]
            assert repair_ids.decode_one(block, i, 5, 17) == whole[doc][5:17]
            seen += 1
    assert seen == 60


def test_ids_that_do_not_fit_are_refused(tmp_path):
    with pytest.raises(ValueError, match="16 bits"):
        repair_ids.compress(np.array([70_000]), np.array([1]), 70_001)
    with pytest.raises(ValueError, match="letters, digits and marks"):
        repair_ids.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 1)


def removed_by_hand(rows, window):
    words = [t.encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {x for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for x in range(k, k + window)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


def test_repeats_equal_brute_force(spark, texts):
    rows = list(texts.items())
    got = sorted((tuple(r) for r in superkmer_dedup.remove_repeats(frame(spark, rows)).collect()), key=repr)
    assert got == removed_by_hand(rows, 35)


def test_repeats_inside_one_text_and_by_the_hot_route(spark, monkeypatch):
    dice = random.Random(4)
    passage = [f"p{k}" for k in range(50)]
    rows = [(i, " ".join([f"a{dice.randint(0, 10**6)}" for _ in range(dice.randint(0, 60))] + passage + [f"b{dice.randint(0, 10**6)}" for _ in range(20)])) for i in range(60)]
    rows += [(100, " ".join(["tick", "tock"] * 60)), (101, " ".join(f"u{k}" for k in range(90))), (101, "another text of the same id")]
    hot = frozenset(m for m, *_ in superkmer_dedup.super_kmers([w.encode() for w in passage], superkmer_dedup.WordHashes(), 35))
    assert hot
    plain = superkmer_dedup.count_buckets
    for some, run_bytes in ((frozenset(), 1 << 20), (hot, 1 << 20), (frozenset(), 300), (frozenset(), 5000)):
        monkeypatch.setattr(superkmer_dedup, "hot_minimisers", lambda docs, window, some=some: some)
        monkeypatch.setattr(superkmer_dedup, "count_buckets", lambda *a, n=run_bytes: plain(*a, run_bytes=n))
        got = sorted((tuple(r) for r in superkmer_dedup.remove_repeats(frame(spark, rows)).collect()), key=repr)
        assert got == removed_by_hand(rows, 35)


def test_ten_thousand_repeated_rows(spark):
    text = " ".join(f"r{k}" for k in range(60))
    rows = spark.range(10_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    got = superkmer_dedup.remove_repeats(rows).groupBy("doc_id", "n_words", "n_removed", "kept").count().collect()
    assert [tuple(r) for r in got] == [(7, 60, 60, "", 10_000)]


def test_hot_minimisers_by_share_and_by_rows(spark, monkeypatch):
    dice = random.Random(14)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(i, " ".join([f"a{dice.randint(0, 10**9)}" for _ in range(40)] + ([passage] if i % 4 == 0 else []))) for i in range(4000)]
    df = frame(spark, rows).repartition(4)
    monkeypatch.setattr(superkmer_dedup, "HOT_LEAST", 20)
    by_share = superkmer_dedup.hot_minimisers(df, 35)
    monkeypatch.setattr(superkmer_dedup, "HOT_SHARE", 1)
    assert by_share and not superkmer_dedup.hot_minimisers(df, 35)
    monkeypatch.setattr(superkmer_dedup, "HOT_ROWS", 320)
    assert superkmer_dedup.hot_minimisers(df, 35) == by_share


def test_hash_collisions_are_settled_by_words(monkeypatch):
    rows = [[b"a", b"b", b"c"], [b"a", b"b", b"d"], [b"x", b"b", b"c"], [b"a", b"b", b"c"]]
    monkeypatch.setattr(superkmer_dedup, "_ODD", np.uint64(0))  # every window gets one hash
    assert [list(x) for x in superkmer_dedup.repeated_windows(rows, 3)] == [[0], [], [], [0]]


def test_pieces_are_lossless_and_reproducible(spark, documents):
    a, b = by_id(queries.op7_sampled_pieces(spark, DATA)), by_id(queries.op7_sampled_pieces(spark, DATA))
    assert a == b and all(r.lossless for r in a.values())
    model = public_tokenizers.path("piece_bpe_32k.model")
    other = by_id(piece_sampling.summarise(documents, model, seed=1))
    assert any(other[i].ids_crc32 != a[i].ids_crc32 for i in a)
    coded = documents.select("text", piece_sampling.encode(F.col("text"), F.col("doc_id").cast("string"), model).alias("ids"))
    assert coded.where(~piece_sampling.decode(F.col("ids"), model).eqNullSafe(F.col("text"))).isEmpty()


def test_pieces_of_any_unicode_are_lossless(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    lattice, dice = piece_sampling.Lattices(model, 1.0), random.Random(21)
    marks = ["\ufdd0", "▁", "\ufffe", "\U0010ffff", "\0", " ", "  ", "\ufeff", "<s>", "<unk>", "<0x41>", "\u2028", "中", "ﬁ", "́"]

    def char():
        c = dice.choice([dice.randrange(0x110000), dice.randrange(0x3000), dice.randrange(128)])
        return dice.choice(marks) if 0xD800 <= c < 0xE000 or dice.random() < 0.2 else chr(c)

    texts = ["".join(char() for _ in range(dice.randint(0, 60))) for _ in range(2000)] + ["a\ufdd0b", "▁", " ", "▁ ▁", "x" * 300_000, "ab▁" * 50_000, "\ufdd0" * 100_000]
    for text, ids in zip(texts, lattice.sample(texts, piece_sampling._seeds(list(range(len(texts))), 0)), strict=True):
        assert lattice.decode(ids) == text
    rows = frame(spark, list(enumerate(texts[-1007:])))
    assert piece_sampling.encode_documents(rows, model).where("NOT lossless").isEmpty()


def test_samples_follow_the_lattice():
    lattice = piece_sampling.Lattices(public_tokenizers.path("piece_bpe_32k.model"), 1.0)

    def paths(rest):
        if not rest:
            yield (), 1.0
        for n in range(1, len(rest) + 1):
            if rest[:n] in lattice.weight:
                i, w = lattice.weight[rest[:n]]
                for tail, p in paths(rest[n:]):
                    yield (i, *tail), w * p

    exact = dict(paths("▁then"))
    n, total = 20_000, sum(exact.values())
    seen = Counter(tuple(x.tolist()) for x in lattice.sample(["then"] * n, piece_sampling._seeds(list(range(n)), 3)))
    assert set(seen) <= set(exact)
    assert all(abs(seen[p] / n - w / total) < 0.015 for p, w in exact.items())


def plain_print(text):
    w = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_simhash_components_equal_brute_force(spark, texts):
    prints = {i: plain_print(t) for i, t in texts.items()}
    root = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and root[b] < root[a]:
                    root[a], changed = root[b], True
    got = by_id(queries.op8_simhash_near_dups(spark, DATA))
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", root[i]) for i in prints}


def test_simhash_crowded_postings_look_their_links_up(spark, monkeypatch):
    """20,000 fingerprints that share five bytes: pairs would be 200 million rows. Few of one posting: the same links as by pairs."""
    dice = random.Random(21)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    crowd = {signed(0xA1B2C3D4E5 << 24 | dice.randrange(1 << 24)) for _ in range(20_000)}
    crowd |= {signed(dice.randrange(1 << 64)) for _ in range(300)} | {signed((x & (1 << 64) - 1) ^ 1 << dice.randrange(64) ^ 1 << dice.randrange(64)) for x in list(crowd)[:300]}
    near = lambda x: (signed((x & (1 << 64) - 1) ^ f) for f in [1 << i ^ (0 if i == j else 1 << j) for i in range(64) for j in range(i, 64)])
    want = {(x, y) for x in crowd for y in near(x) if x < y and y in crowd}
    df = spark.createDataFrame([(x,) for x in crowd], "fp long").repartition(4)
    assert len(want) > 300 and {tuple(r) for r in simhash_bytes.links(df).collect()} == want
    few = df.where(F.col("fp").isin(sorted(crowd)[:1500]))
    by_rule = {}
    for dense in (2, 0, 10**6):
        monkeypatch.setattr(simhash_bytes, "DENSE", dense)
        by_rule[dense] = Counter(tuple(r) for r in simhash_bytes.links(few, max_bits=2).collect())
    assert by_rule[0] == by_rule[2] == by_rule[10**6] and by_rule[0] and max(by_rule[0].values()) == 1


def test_simhash_links_chains(spark):
    prints = [0, 0b11, 0b1111, 0b111111 | 1 << 63, 1 << 40, 1 << 40 | 0b111]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = {tuple(sorted((a, b))) for a, b in simhash_bytes.links(df).collect()}
    assert edges == {tuple(sorted((a, b))) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    got = {r.fp: r.label for r in simhash_bytes.components(simhash_bytes.links(df), spark.createDataFrame(list(zip(signed, range(10, 16), strict=True)), "fp long, label long")).collect()}
    assert got[0] == got[3] == got[15] == 10


def test_benchmark_hits_equal_brute_force(spark, texts):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    patterns = {}
    for i, t in items.items():
        w = word.findall(t.encode().lower())
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            patterns.setdefault(tuple(w[k : k + m]), set()).add(str(i))
    got = by_id(queries.op9_benchmark_overlap(spark, DATA))
    for i, t in texts.items():
        w, hit, found = word.findall(t.encode().lower()), set(), set()
        for m in {len(p) for p in patterns}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in patterns:
                    hit |= set(range(k, k + m))
                    found |= patterns[tuple(w[k : k + m])]
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_benchmark_blocks_short_items_and_nulls(spark):
    bench = spark.createDataFrame([("b", "alpha beta"), ("a", None), ("c", "one two three four five six seven eight nine ten eleven"), (None, "gamma"), ("d", " . ")], "item_id string, text string")
    docs = frame(spark, [(1, "Alpha, BETA gamma"), (2, "x one two three four five six seven eight nine ten y"), (3, None), (4, "alpha x beta")])
    for size in (1, 1 << 20):  # one item a block, then all in one
        got = by_id(wu_manber.find_overlaps(docs, bench, block_bytes=size))
        assert (got[1].starts, got[1].ends, got[1]["items"]) == ([0], [3], ["", "b"])
        assert (got[2].starts, got[2].ends, got[2]["items"]) == ([1], [11], ["c"])
        assert got[3]["items"] == [] and got[3].n_words == 0 and got[4]["items"] == []
        assert sorted(r.doc_id for r in wu_manber.drop_contaminated(docs, bench, block_bytes=size).collect()) == [3, 4]
    empty = spark.createDataFrame([], bench.schema)
    assert sorted(r.doc_id for r in wu_manber.drop_contaminated(docs, empty).collect()) == [1, 2, 3, 4]


def test_fifty_blocks_find_what_one_finds(spark):
    dice = random.Random(30)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(dice.choice(words) for _ in range(12))) for k in range(50)]
    docs = [(i, " ".join([*(dice.choice(words) for _ in range(9)), *dice.choice(items)[1].split()[: dice.randint(9, 12)], *dice.choice(items)[1].split()])) for i in range(40)]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), frame(spark, docs + docs[:3])
    assert len(list(wu_manber.benchmark_blocks(bench, 1))) == 50
    one, many = (sorted(wu_manber.find_overlaps(df, bench, block_bytes=n).collect(), key=repr) for n in (1 << 20, 1))
    assert one == many and len(one) == 43
    kept = [sorted(r.doc_id for r in wu_manber.drop_contaminated(df, bench, block_bytes=n).collect()) for n in (1 << 20, 1)]
    assert kept[0] == kept[1]


@pytest.mark.parametrize("query, label, least", [(queries.op1_quality_bradley_terry, "quality", 0.97), (queries.op10_toxicity_ftrl, "toxic", 0.97)])
def test_held_out_accuracy(spark, query, label, least):
    sf = "/root/testdata/sf0.1"
    scored = query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert scored.select(F.avg((F.col("predicted") == F.col(label)).cast("int")).alias("a")).first().a >= least


def test_held_out_rows_teach_nothing(spark, documents):
    ids = [r.doc_id for r in documents.select("doc_id").collect()]
    held = [i for i in ids if zlib.crc32(str(i).encode()) % 3 == 1]
    rest = [(i, i % 2, i % 3 == 0) for i in ids if i not in set(held)]
    a = labels(spark, [(i, q, int(t)) for i, q, t in rest])
    b = a.union(labels(spark, [(i, 0, 1) for i in held]))
    for operator in (quality_bt, toxicity_ftrl):
        assert by_id(operator.score_documents(documents, a)) == by_id(operator.score_documents(documents, b))


ALL = {
    "quality": lambda s, d: quality_bt.score_documents(d, labels(s, [(4, 1, 0), (7, 0, 1), (8, 1, 0), (5, None, None)])),
    "tokens": lambda s, d: token_transducer.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")),
    "rules": lambda s, d: quality_rules.score_rules(d, labels(s)),
    "secrets": lambda s, d: secret_scan.find_secrets(d),
    "ids": lambda s, d: repair_ids.round_trip(d, public_tokenizers.path("word_bpe_49k.json")),
    "repeats": lambda s, d: superkmer_dedup.remove_repeats(d),
    "pieces": lambda s, d: piece_sampling.summarise(d, public_tokenizers.path("piece_bpe_32k.model")),
    "simhash": lambda s, d: simhash_bytes.near_duplicates(d),
    "overlap": lambda s, d: wu_manber.find_overlaps(d, s.createDataFrame([(1, "no id here")], "item_id long, text string")),
    "toxicity": lambda s, d: toxicity_ftrl.score_documents(d, labels(s)),
}


@pytest.mark.parametrize("name", ALL)
def test_odd_and_empty_tables(spark, name):
    df = odd(spark)
    rows = ALL[name](spark, df).collect()
    assert Counter(r.doc_id for r in rows) == Counter([1, 2, 3, None, 4, 4, 5, 6, 7, 8])
    assert ALL[name](spark, df.limit(0)).collect() == []


def test_filters_keep_columns_of_odd_tables(spark):
    df = odd(spark).withColumn("dot.ted", F.lit(1)).withColumn("back`tick", F.lit(2)).withColumn("_digest", F.lit(3))
    kept = simhash_bytes.drop_near_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4, 5, 6, 7, 8]
    assert secret_scan.redact(df).columns == df.columns
    assert quality_bt.keep_accepted(df, labels(spark)).count() == df.count()
    assert wu_manber.drop_contaminated(df, spark.createDataFrame([(1, "no id here")], "item_id long, text string")).count() == df.count() - 1
    coded = piece_sampling.encode_documents(df, public_tokenizers.path("piece_bpe_32k.model"))
    assert coded.where("NOT lossless").isEmpty() and coded.count() == df.count() and set(df.columns) - {"text"} < set(coded.columns)
    none = df.limit(0)
    for filtered in (simhash_bytes.drop_near_copies(none), secret_scan.redact(none), quality_bt.keep_accepted(none, labels(spark)), wu_manber.drop_contaminated(none, spark.createDataFrame([], "item_id long, text string"))):
        assert filtered.columns == df.columns and filtered.collect() == []
    assert piece_sampling.encode_documents(none, public_tokenizers.path("piece_bpe_32k.model")).collect() == []


def test_pipeline_by_hand(spark, tmp_path):
    import corpus_pipeline

    words = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("a", "o", "ira", "une", "eld")]
    dice = random.Random(1)
    sentence = lambda n: " ".join(dice.choice(words) for _ in range(n)).capitalize() + "."
    item = " ".join(f"bench{k}" for k in range(12))
    good = [(i, sentence(60)) for i in range(40)]
    junk = [(i, " ".join(f"{w}###" for w in sentence(60).split())) for i in range(40, 70)]
    rows = good + junk + [(70, good[3][1]), (71, sentence(40) + " " + item), (72, sentence(60) + " token=abcdef123")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, [(i, int(i < 40), 0) for i in range(70)]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = by_id(corpus_pipeline.run(spark, str(tmp_path)))
    assert set(out) == {*range(40), 72}
    lattice = piece_sampling.Lattices(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    assert all(lattice.decode(np.array(out[i].piece_ids)) == t for i, t in good)
    assert lattice.decode(np.array(out[72].piece_ids)).endswith(" [SECRET]")


def near_copy_rows(dice):
    """Texts, looser copies of some (5-word similarity 0.8 to 1), a chain's middle, and one below 0.8."""
    base = [[f"v{dice.randint(0, 10**6)}" for _ in range(120)] for _ in range(30)]
    changed = lambda w, at: [f"new{k}" if k in at else x for k, x in enumerate(w)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(100 + i, " ".join(changed(base[i], {20, 90}))) for i in range(20)]  # 106 of 126 shingles
    rows += [(200 + i, " ".join(changed(base[i], {10, 40, 60, 90}))) for i in range(20, 30)]  # 96 of 136
    return rows


def test_near_copies_equal_brute_force(spark, monkeypatch):
    rows = near_copy_rows(random.Random(3)) + [(5, "one text of a shared id"), (5, "a second text of it"), (None, "no id"), (300, None), (301, "")]
    rows += [(400 + i, " ".join([f"hot{k}" for k in range(200)] + [f"own{i}"])) for i in range(60)]
    for leaders, hot in ((1, 512), (4, 512), (4, 8)):
        monkeypatch.setattr(simhash_bytes, "LEADERS", leaders + 1)
        monkeypatch.setattr(simhash_bytes, "HOT", hot)
        monkeypatch.setattr(simhash_bytes, "HOT_LEAST", 2 if hot == 8 else 64)
        monkeypatch.setattr(simhash_bytes, "SALTS", 4)
        got = Counter(r.doc_id for r in simhash_bytes.drop_near_copies(frame(spark, rows)).collect())
        # One of each pair of copies stays, one of the hot group, both texts of a shared id, one row without words.
        assert sum(got[i] + got[100 + i] == 1 for i in range(20) if i != 5) >= 17 and got[5] >= 2
        assert all(got[i] == got[200 + i] == 1 for i in range(20, 30))
        assert sum(got[400 + i] for i in range(60)) == 1 and got[300] == 1 and got[301] == 0 and got[None] == 1


def test_no_two_kept_texts_that_meet_are_similar(spark):
    dice = random.Random(12)
    base = [f"v{k}" for k in range(150)]
    rows = []
    for i in range(120):  # near copies of near copies, some of them too far apart
        words = list(dice.choice(rows)[1].split() if rows else base)
        for _ in range(dice.randint(0, 3)):
            words[dice.randrange(len(words))] = f"x{dice.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    sets = {i: simhash_bytes.shingle_set(t.encode()) for i, t in rows}
    prints = {i: simhash_bytes.copy_print(s) for i, s in sets.items()}
    entries = {i: set(simhash_bytes.entries_of(p[None])[0].tolist()) for i, p in prints.items()}
    alike = lambda a, b: 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))
    linked = {(a, b) for a in sets for b in sets if a < b and entries[a] & entries[b] and (prints[a] == prints[b]).sum() >= simhash_bytes.LEAST and alike(a, b)}
    kept = {r.doc_id for r in simhash_bytes.drop_near_copies(frame(spark, rows)).collect()}
    assert not [p for p in linked if set(p) <= kept]
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    assert {root[i] for i in kept} == set(root.values())  # each component keeps one at least


@pytest.mark.parametrize("base", [0, 150])
def test_a_crowded_posting_makes_no_square_of_pairs(spark, monkeypatch, base):
    """400 texts that all share twelve positional bytes, near copies of one base or of none; one in four is a copy of an earlier one. Pairs would be 79,800."""
    dice = np.random.default_rng(5)
    drawn = lambda n: dice.integers(1, 1 << 60, n)
    common, sets = drawn(base), []
    for i in range(400):
        like = sets[int(dice.integers(i))] if i % 4 == 3 else None
        kept = common[dice.random(base) > 0.13] if like is None else like[dice.permutation(len(like))[: len(like) - 5]]
        sets.append(np.unique(np.concatenate([kept, drawn((25 if base else 100) if like is None else 5)])))
    prints = dice.integers(0, 256, (400, simhash_bytes.COPY_BYTES)).astype(np.uint8)
    prints[:, : 2 * simhash_bytes.COPY_GROUP] = 7
    prints = spark.createDataFrame([(i, x.view(np.int8).tolist()) for i, x in enumerate(prints)], "v long, fp array<byte>").repartition(4)
    known = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(sets)], "v long, shingles array<long>").repartition(4)
    compared = []
    monkeypatch.setattr(simhash_bytes, "_copies", lambda met, *a, f=simhash_bytes._copies: compared.append(met.count()) or f(met, *a))
    gone = {r.v for r in simhash_bytes.near_copies(prints, lambda some: known.join(some, "v")).collect()}
    alike = [(a, b) for a in range(400) for b in range(a) if 9 * len(np.intersect1d(sets[a], sets[b], assume_unique=True)) >= 4 * (len(sets[a]) + len(sets[b]))]
    root = list(range(400))
    for _ in sets:
        for a, b in alike:
            root[a] = root[b] = min(root[a], root[b])
    assert len(alike) >= 100 and not [p for p in alike if not gone & set(p)]
    assert {root[i] for i in range(400) if i not in gone} == set(root)  # one of each component stays
    assert sum(compared) < 12 * 400


def test_wide_index_entries():
    prints = np.arange(96, dtype=np.uint8).reshape(2, 48)
    got = simhash_bytes.entries_of(prints)
    assert got.shape == (2, 160) and len(set(got.ravel().tolist())) == 320
    other = prints.copy()
    other[1, :] ^= 1
    other[1, [6, 8, 11]] ^= 1  # three bytes of the second group agree
    assert (simhash_bytes.entries_of(other)[1] == got[1]).sum() == 1


def test_near_copies_of_odd_tables(spark):
    df = odd(spark)
    kept = simhash_bytes.drop_near_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4, 5, 6, 7, 8]
    assert simhash_bytes.drop_near_copies(df.limit(0)).collect() == []


def test_pipeline_stage_drops_a_planted_near_copy(spark):
    import corpus_pipeline

    rows = near_copy_rows(random.Random(8))
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), DATA).collect()}
    assert sum(len({i, 100 + i} & kept) == 1 for i in range(20)) >= 18  # copies of similarity 0.84: nine of ten at least
    assert all({i, 100 + i} & kept for i in range(20)) and {*range(20, 30), *range(220, 230)} <= kept


def test_every_trusted_row_counts(spark):
    ids = [i for i in range(32_000) if zlib.crc32(str(i).encode()) % 3 != 1][:20_400]
    docs = spark.createDataFrame([(i, "alpha beta gamma") for i in ids], "doc_id long, text string")
    line = quality_rules.ratio_weights(docs, labels(spark, [(i, 1, 0) for i in ids]))
    assert {abs(float(w)) for w in line.split(";")} == {0.0}  # all rows are trusted: both multinomials are equal


def test_simhash_keeps_both_texts_of_one_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    kept = simhash_bytes.drop_near_copies(frame(spark, [(1, a), (2, b), (2, c), (3, b), (4, a), (2, c)]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, a), (2, b), (2, c)]
    kept = simhash_bytes.drop_near_copies(frame(spark, [(1, a), (2, a), (2, b)]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, a), (2, b)]


def test_grammar_goes_on_until_no_pair_is_frequent():
    ids = np.tile(np.arange(64, dtype=np.int32), 100)
    symbols, cuts, rules = repair_ids.compress(ids, np.array([len(ids)]), 49_408, each=8, least=24)
    grammar = repair_ids.Grammar(rules, repair_ids.expansion_lengths(rules, 49_408), 49_408)
    assert max(Counter(zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True)).values()) < 24
    assert (grammar.expand(symbols) == ids).all() and cuts.tolist() == [len(symbols)]
    ids = np.random.default_rng(1).integers(0, 140, 1 << 20).astype(np.int32)
    symbols, _, rules = repair_ids.compress(ids, np.array([len(ids)]), 49_408, least=4)
    assert len(rules) == 16_128 and symbols.max() < 1 << 16
    assert (repair_ids.Grammar(rules, repair_ids.expansion_lengths(rules, 49_408), 49_408).expand(symbols) == ids).all()


def test_pairwise_ranker_equals_a_plain_loop():
    dice = np.random.default_rng(3)
    x = dice.normal(size=(40, 3))
    y = (x[:, 0] + 0.5 * dice.normal(size=40) > 0).astype(int)
    got = quality_bt.train(x, y, pairs_each=5, steps=60)
    z = (x - x.mean(0)) / x.std(0)
    good, bad = [i for i in range(40) if y[i] == 1], [i for i in range(40) if y[i] == 0]
    pairs = [(int(b), w) for w, b in zip([w for w in bad for _ in range(5)], np.random.default_rng(7).choice(good, 5 * len(bad)), strict=True)]
    w, speed = [0.0] * 3, [0.0] * 3
    for _ in range(60):
        slope = [0.0] * 3
        for b, v in pairs:  # the gradient of log sigmoid(score(b) - score(v))
            miss = 1 / (1 + math.exp(sum(w[k] * (z[b][k] - z[v][k]) for k in range(3))))
            slope = [s + miss * (z[b][k] - z[v][k]) / len(pairs) for k, s in enumerate(slope)]
        speed = [0.9 * s + 0.1 * (g - 1e-4 * w[k]) for k, (s, g) in enumerate(zip(speed, slope, strict=True))]
        w = [w[k] + 0.5 * speed[k] for k in range(3)]
    assert np.allclose(got.weights, w, atol=1e-8)
    scores = z @ np.array(w)
    assert (scores < got.threshold).sum() == len(bad)  # the quantile at the worse label's share


def test_ftrl_equals_a_plain_loop():
    dice = random.Random(8)
    rows = [(np.array(sorted(dice.sample(range(64), 6)), np.int32), int(dice.random() < 0.4)) for _ in range(80)]
    how = toxicity_ftrl.Ftrl(alpha=0.7, beta=1.0, l1=0.4, l2=0.3, passes=2)
    z, n = Counter(), Counter()

    def weight(i):
        free = 0.0 if i == "bias" else how.l1
        if abs(z[i]) <= free:
            return 0.0
        return (math.copysign(free, z[i]) - z[i]) / ((how.beta + math.sqrt(n[i])) / how.alpha + how.l2)

    for _ in range(how.passes):
        for x, y in rows:
            at = [*x.tolist(), "bias"]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in at:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / how.alpha * w[i]
                n[i] += g * g
    intercept, at, kept = toxicity_ftrl.train(rows, 6, how)
    assert intercept == pytest.approx(weight("bias"), abs=1e-9)
    assert dict(zip(at.tolist(), kept.tolist(), strict=True)) == pytest.approx({i: weight(i) for i in range(64) if weight(i)}, abs=1e-6)
    assert toxicity_ftrl.fold_loss(rows, how, bits=6) > 0


def test_quality_score_equals_brute_force(spark):
    dice = random.Random(16)
    docs = [(i, " ".join(f"w{dice.randint(0, 30)}" for _ in range(dice.randint(0, 25)))) for i in range(60)]
    good = [i for i in range(60) if i % 2 == 0 and zlib.crc32(str(i).encode()) % 3 != 1]
    got = by_id(quality_rules.score_rules(frame(spark, docs), labels(spark, [(i, int(i % 2 == 0), 0) for i in range(60)])))
    words = sorted({w for _, t in docs for w in t.split()})
    pairs = sorted({p for _, t in docs for p in zip(t.split(), t.split()[1:], strict=False)})
    h = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    p = {(r.a, r.b): r.h for r in spark.createDataFrame([(h[a], h[b]) for a, b in pairs], "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}

    def grams(text):
        w = [h[x] for x in text.split()]
        return [g % quality_rules.BUCKETS for g in [*w, *(p[a, b] for a, b in zip(w, w[1:], strict=False))]]

    raw = Counter(g for _, t in docs for g in grams(t))
    trusted = Counter(g for i, t in docs if i in good for g in grams(t))
    weight = lambda g: math.log((trusted[g] + 1) / (sum(trusted.values()) + quality_rules.BUCKETS)) - math.log((raw[g] + 1) / (sum(raw.values()) + quality_rules.BUCKETS))
    for i, t in docs:
        expected = sum(map(weight, grams(t))) / len(grams(t)) if t else 0.0
        assert got[i].score == pytest.approx(expected, abs=2e-5)
        assert got[i].kept == (not got[i].base_failed and got[i].score >= quality_rules.THRESHOLD)


def test_added_secret_kinds_equal_regexes():
    compiled, dice = secret_scan.compile_rules(), random.Random(5)
    patterns = [(k, r, re.compile(r.pattern.encode())) for k, r in enumerate(secret_scan.RULES) if r not in secret_scan.BASE]
    run = lambda n: "".join(dice.choice("abAB019") for _ in range(n))
    heads = ["ghp_", "gho_", "xoxb-", "eyJ", ".eyJ", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", " ", "-", "é"]
    for _ in range(1500):
        data = "".join(dice.choice([dice.choice(heads), run(dice.choice([2, 12, 36]))]) for _ in range(dice.randint(1, 9))).encode()
        expected = sorted((m.start(), m.end(), k) for k, r, p in patterns for m in p.finditer(data) if len(m[0]) >= r.least)
        assert sorted(s for s in secret_scan.spans_of(data, compiled) if s[2] >= 3) == expected, data


def test_long_texts_full_of_secrets_take_linear_time():
    """2 MB with a secret every 17 bytes, and a run of digits as long: walks of a match to the end of the text would take minutes."""
    compiled, unit = secret_scan.compile_rules(), b"token=abcdef123 \xc3\xa9"
    began = time.process_time()
    spans = secret_scan.spans_of(unit * 120_000, compiled)
    assert spans == [(k * len(unit), k * len(unit) + 15, 0) for k in range(120_000)]
    assert secret_scan.spans_of(b"0123456789abcdef" * 120_000, compiled) == [(0, 1_920_000, 2)]
    assert time.process_time() - began < 30
    assert secret_scan.in_code_points(unit * 2, secret_scan.spans_of(unit * 2, compiled)) == [(0, 15, 0), (17, 32, 0)]


def test_a_repeated_labelled_id_teaches_once(spark):
    from periodica.llm.common import labelled_sample

    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1][:20]
    docs = frame(spark, [(i, f"text {i} {k}") for i in ids for k in range(5)])
    assert labelled_sample(docs, labels(spark, [(i, 1, 0) for i in ids]), "quality", 12).count() == 12
