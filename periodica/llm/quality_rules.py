"""Quality rules in Spark SQL functions only: base rules and a hashed n-gram log-likelihood ratio.

Base rules count words, symbols, repeated lines and words inside repeated 5-word windows of each text.
The method: words and word pairs are hashed to `BUCKETS` coordinates; two multinomials are counted, one over
all documents (raw), one over all trusted rows (labelled good, outside the held-out third). A document's verdict is the mean over its n-grams of log p_trusted - log p_raw, held
against a fixed threshold. Raw counts cover every document; the weights, one number a bucket whatever the
input, enter the scoring plan as an array literal, so scoring is one scan without a join or shuffle.

Edge cases: null and empty texts have no words, fail the base rules and score 0; a text of one word has one
n-gram; windows are compared by a 64-bit hash of their five words within one text; without trusted rows
both multinomials are flat and the method rejects nothing; repeated rows keep a row each; a score at the threshold
is kept; an empty table gives no rows; a very long text is one array of hashes; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import cut, held_out, id_text

BUCKETS = 1 << 15
SMOOTH = 1.0
#: Mean log-likelihood ratio an n-gram that a kept document must reach; best balanced accuracy on labelled rows outside the held-out third (README).
THRESHOLD = -0.07
#: Fixed by the base rules; windows are hashed as two pairs and a word.
WINDOW = 5
#: Trusted ids that a broadcast may have (16 bytes each).
MAX_BROADCAST = 2_000_000
_SPACE = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _hashes(words: Column) -> Column:
    """A 64-bit hash of each word; pairs and windows are hashed from these."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _pairs(hashes: Column) -> Column:
    """Hashes of neighbouring words."""
    n = F.greatest(F.size(hashes) - 1, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 2, n), lambda a, b: F.xxhash64(a, b))


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS).cast("long")).cast("int")


def _without(text: Column, letters: str) -> Column:
    return F.length(F.translate(text, letters, ""))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, hashes (of words), pairs (of neighbours), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.col("text")
    worded = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(_SPACE)) != "")
    # A window of five words is two pairs and a word.
    windows = F.transform(F.slice("pairs", 1, F.greatest(F.size("pairs") - WINDOW + 2, F.lit(0))), lambda p, i: F.xxhash64(p, F.get(F.col("pairs"), i + 2), F.get(F.col("hashes"), i + 4)))
    counted = (
        docs.select("doc_id", "text", _words(text).alias("words"))
        .select(
            "doc_id", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            (F.length(text) - _without(text, _SYMBOLS)).cast("long").alias("n_symbols"), worded.alias("lines"), _hashes(F.col("words")).alias("hashes"),
        )
        .select("*", _pairs(F.col("hashes")).alias("pairs"))
        .select("*", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows.alias("windows"))
    )
    # Only texts with an equal pair of windows sort them; neighbours in the sorted list show which repeat.
    ordered = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    again = F.filter(F.col("ordered"), lambda x, j: (F.get(F.col("ordered"), j - 1).h == x.h) | (F.get(F.col("ordered"), j + 1).h == x.h) | F.lit(False))
    again = F.array_sort(F.transform(again, lambda x: x.i))
    covered = F.aggregate(
        F.col("again"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, i: F.struct((s.n + i + WINDOW - F.greatest(s.end, i)).alias("n"), (i + WINDOW).alias("end")),
        lambda s: s.n,
    )
    kept = ["doc_id", "hashes", "pairs", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    counted = counted.select(*kept, ordered.alias("ordered")).select(*kept, again.alias("again"))
    counted = counted.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    return counted.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def ratio_weights(docs: DataFrame, labels: DataFrame) -> str:
    """log p_trusted - log p_raw of each bucket in order, as one line of numbers."""
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id").distinct()
    trusted = cut(trusted.withColumn("good", F.lit(1)))
    # Few ids are sent to the texts; more of them meet the texts by a shuffle.
    few = F.broadcast(trusted) if trusted.count() <= MAX_BROADCAST else trusted
    marked = id_text(docs).join(few, "doc_id", "left")
    hashed = marked.select(F.coalesce("good", F.lit(0)).alias("good"), _hashes(_words(F.col("text"))).alias("hashes"))
    grams = hashed.select("good", F.explode(F.concat("hashes", _pairs(F.col("hashes")))).alias("gram")).select("good", _bucket(F.col("gram")).alias("bucket"))
    counts = cut(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("good")))
    whole = counts.agg((F.sum("raw") + SMOOTH * BUCKETS).alias("raw"), F.sum("good").alias("good")).first()
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    if not whole.good:
        weight = F.lit(0.0)
    else:
        share = lambda c, total: F.log((F.coalesce(c, F.lit(0)) + SMOOTH) / total)
        weight = share("good", whole.good + SMOOTH * BUCKETS) - share("raw", whole.raw)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", F.format_number(weight, 5).alias("w")))), lambda x: x.w), ";")
    return every.agg(line.alias("line")).first().line


def score_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, score, kept."""
    weights = F.split(F.lit(ratio_weights(docs, labels)), ";").cast("array<double>")
    total = lambda grams: F.aggregate(grams, F.lit(0.0), lambda s, h: s + F.get(weights, _bucket(h)))
    n = F.size("hashes") + F.size("pairs")
    scored = base_counts(id_text(docs)).withColumn("score", F.round(F.when(n > 0, (total("hashes") + total("pairs")) / n).otherwise(0.0), 6))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"))
