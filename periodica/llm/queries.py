"""The registered queries of the numbered operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.llm import hybrid_rank, metric_join, piece_sampling, prefix_trie, quality_bt, quality_rules, repair_ids, secret_scan, simhash_bytes, superkmer_dedup, token_transducer, toxicity_ftrl, wu_manber
from periodica.llm.common import table


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def op1_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bt.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_transducer.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.BASE]
    of = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(of, base), F.sha2(_joined(F.filter("spans", lambda s: s.kind.isin(base))).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op5_repair_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_ids.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = superkmer_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.summarise(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash_bytes.near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wu_manber.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    covered = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda n, s: n + s.ends - s.starts)
    return found.select("doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"))


def op10_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_ftrl.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_jaccard_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.join_documents(table(spark, sf_dir, "documents"))


def op12_hybrid_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_rank.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_head_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_quality_bradley_terry, op2_token_counts, op3_quality_rules, op4_secret_scan, op5_repair_token_ids, op6_superkmer_dedup, op7_sampled_pieces, op8_simhash_near_dups, op9_benchmark_overlap, op10_toxicity_ftrl, op11_jaccard_metric_join, op12_hybrid_ranked_search, op13_conversation_trie)}

SQL: dict[str, str] = {
    "op12_hybrid_ranked_search": r"""
    WITH words AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
    sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id),
    whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
    asked AS (
        SELECT item_id, term, count(*) AS times FROM (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
        GROUP BY ALL),
    weights AS (
        SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
        FROM counts, whole WHERE term IN (SELECT term FROM asked) GROUP BY term, docs),
    scored AS (
        SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))))::BIGINT AS score
        FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (doc_id), whole GROUP BY item_id, doc_id)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
    FROM scored WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""",
    "op13_conversation_trie": r"""
    WITH turns AS (
        SELECT conv_id, turn, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS said,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
        FROM conversations WHERE conv_id IS NOT NULL),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) AS d FROM turns),
    convs AS (
        SELECT conv_id, xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h
        FROM (SELECT DISTINCT conv_id FROM turns)),
    rebuilt AS (
        SELECT c.conv_id, d, said, words FROM convs c JOIN numbered n ON n.conv_id = c.conv_id - c.conv_id % 20 AND d <= h
        UNION ALL SELECT c.conv_id, 1000000 + d, said, words FROM convs c JOIN numbered n ON n.conv_id = c.conv_id AND d > h),
    steps AS (
        SELECT conv_id, row_number() OVER of_conv AS depth, string_agg(said, '/') OVER of_conv AS node, words FROM rebuilt
        WINDOW of_conv AS (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)
        UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
    nodes AS (SELECT node, depth, min(conv_id) AS low, count(*) AS n_convs, any_value(words) AS words FROM steps GROUP BY node, depth),
    parents AS (SELECT DISTINCT s.node, p.node AS parent FROM steps s JOIN steps p ON s.conv_id = p.conv_id AND s.depth = p.depth + 1),
    fans AS (SELECT parent AS node, count(*) AS n_children FROM parents GROUP BY parent),
    under AS (SELECT DISTINCT a.node AS top, b.node FROM steps a JOIN steps b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
    sums AS (
        SELECT top, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
        FROM under JOIN nodes USING (node) LEFT JOIN fans USING (node) GROUP BY top),
    ends AS (
        SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
        FROM (SELECT conv_id, arg_max(node, depth) AS node FROM steps GROUP BY conv_id) GROUP BY node)
    SELECT n.low AS conv_id, n.depth, up.low AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
    FROM nodes n JOIN sums s ON s.top = n.node LEFT JOIN parents p ON p.node = n.node LEFT JOIN nodes up ON up.node = p.parent LEFT JOIN fans f ON f.node = n.node LEFT JOIN ends e ON e.node = n.node""",
}
