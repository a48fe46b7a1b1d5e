"""Tables kept by content hash: diffs, merges, scoped deletes, ledgers, digests, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns that say when a row was made, not what it is.
UNHASHED = ("as_of", "inputs_version", "updated_at", "content_hash")


def row_text(columns: list[str]) -> Column:
    """`name=length:value` of the columns in name order; a null has no length. No value can pass for another column's, or for a null."""
    value = lambda c: F.col(c).cast("string")
    return F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.length(value(c)).cast("string"), F.lit(":"), value(c)), F.lit("∅"))) for c in sorted(columns) if c not in UNHASHED])


def null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on keys of which any may be null: null meets null. Other columns must have different names."""
    right = b.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    j = a.join(right, same, how)
    if how in ("left_semi", "left_anti"):
        return j
    return j.withColumns({k: F.coalesce(k, f"_right_{k}") for k in keys}).drop(*[f"_right_{k}" for k in keys])


def content_hash(columns: list[str]) -> Column:
    return F.sha2(row_text(columns).cast("binary"), 256)


def last_wins(rows: DataFrame, pk: list[str], seq: str) -> DataFrame:
    """One row a key: the last in sequence; `copies` says how many there were."""
    others = [c for c in rows.columns if c not in pk]
    return rows.groupBy(*pk).agg(F.max_by(F.struct(*others), F.col(seq)).alias("r"), F.count("*").alias("copies")).select(*pk, "r.*", "copies")


def prefer_complete(rows: DataFrame, pk: list[str], wanted: str, seq: str) -> DataFrame:
    """One row a key: one with a value in `wanted` if any has, else the first in sequence."""
    others = [c for c in rows.columns if c not in pk]
    return rows.groupBy(*pk).agg(F.min_by(F.struct(*others), F.struct(F.col(wanted).isNull(), F.col(seq))).alias("r")).select(*pk, "r.*")


def classify(current: DataFrame, stage: DataFrame, pk: list[str]) -> DataFrame:
    """Every key of either side with its action: insert, update, same or keep. Only keys and hashes are joined."""
    a = current.select(*pk, content_hash([c for c in current.columns if c not in pk]).alias("old"))
    b = stage.select(*pk, content_hash([c for c in stage.columns if c not in pk]).alias("new"))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "keep").when(F.col("old") == F.col("new"), "same").otherwise("update")
    return null_safe(a, b, pk, "full").select(*pk, action.alias("action"))


def merged(current: DataFrame, stage: DataFrame, pk: list[str], keep_first: tuple[str, ...] = ()) -> DataFrame:
    """The table after the upsert. Columns in keep_first hold on to their first non-null value; unchanged rows keep theirs whole."""
    others = [c for c in current.columns if c not in pk]
    a = current.select(*pk, F.struct(*others).alias("a"), content_hash(others).alias("old"))
    b = stage.select(*pk, F.struct(*others).alias("b"), content_hash(others).alias("new"))
    j = null_safe(a, b, pk, "full")
    take = F.col("b").isNotNull() & ~F.coalesce(F.col("old") == F.col("new"), F.lit(False))
    pick = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")) if c in keep_first else F.when(take, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return j.select(*pk, *[pick(c).alias(c) for c in others])


def without_stale(current: DataFrame, stage: DataFrame, pk: list[str], scope: Column) -> DataFrame:
    """The rows left when those in scope that the run didn't make again are deleted."""
    outside = current.where(~F.coalesce(scope, F.lit(False)))
    return outside.unionByName(null_safe(current.where(scope), stage.select(*pk), pk, "left_semi"))


def mirrored(current: DataFrame, feed: DataFrame, status: DataFrame, source: str) -> DataFrame:
    """Sources that are ok become exactly their feed, failed ones keep their rows, unlisted ones go. status is (source, ok)."""
    kept = current.join(status.where(~F.col("ok")), source, "left_semi")
    return kept.unionByName(feed.join(status.where("ok"), source, "left_semi").select(*current.columns))


def insert_once(ledger: DataFrame, rows: DataFrame, pk: list[str]) -> DataFrame:
    """The rows that the ledger doesn't hold yet; what it holds is never changed."""
    return null_safe(rows, ledger.select(*pk), pk, "left_anti")


def table_digest(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Order-free digest of each part: rows, sum and exclusive or of their hashes (the first 48 bits of an md5); the sum is given as text, as no integer holds it for any number of rows."""
    h = F.conv(F.substring(F.md5(row_text(columns).cast("binary")), 1, 12), 16, 10).cast("long")
    return rows.select(*keys, h.alias("h")).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).cast("string").alias("hash_sum"), F.bit_xor("h").alias("hash_xor"))


def changed_parts(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Parts whose digests differ, and how: new, gone or changed."""
    a = before.select(*keys, F.struct("n", "hash_sum", "hash_xor").alias("a"))
    b = now.select(*keys, F.struct("n", "hash_sum", "hash_xor").alias("b"))
    how = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") != F.col("b"), "changed")
    return null_safe(a, b, keys, "full").select(*keys, how.alias("change")).where("change IS NOT NULL")


def retention_plan(rows: DataFrame, name: str, age: Column, horizon: Column) -> DataFrame:
    """What a deletion beyond the horizon would do; a table that it would empty is refused."""
    g = rows.agg(F.count("*").alias("total"), F.count_if(age < horizon).alias("old"), F.min(age).alias("oldest"), F.max(age).alias("newest"))
    return g.select(F.lit(name).alias("name"), "total", "old", "oldest", "newest", ((F.col("old") > 0) & (F.col("old") == F.col("total"))).alias("refused"))


def fill_nulls(rows: DataFrame, candidates: DataFrame, pk: list[str], column: str) -> DataFrame:
    """Sets a value only where none is stored; `filled` marks those rows."""
    c = candidates.select(*pk, F.col(column).alias("_candidate"))
    j = null_safe(rows, c, pk, "left").withColumn("filled", F.col(column).isNull() & F.col("_candidate").isNotNull())
    return j.withColumn(column, F.coalesce(column, "_candidate")).drop("_candidate")


def due_sources(stored: DataFrame, live: DataFrame, source: str, dataset: str) -> DataFrame:
    """Datasets of which a source's live marker isn't the stored one, with the markers they would be built from."""
    j = live.join(stored.withColumnRenamed("marker", "stored"), [dataset, source], "left")
    built = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(source, "marker"))), lambda s: F.concat_ws("=", s[source], s["marker"])), ";")
    return j.groupBy(dataset).agg(F.max((~F.col("marker").eqNullSafe(F.col("stored"))).cast("int")).alias("due"), built.alias("built_from"))


def write_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replaces the partitions that rows touch and no others; path must not be among what rows reads."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def run_entry(spark: SparkSession, job: str, status: str, rows: int, seconds: float) -> DataFrame:
    """One line of the run ledger."""
    return spark.createDataFrame([(job, status, rows, seconds)], "job string, status string, rows long, seconds double").withColumn("at", F.current_timestamp())


def newest_first(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).drop("_i")


def retained(rows: DataFrame, epoch: Column, horizon: int) -> DataFrame:
    """The rows from the horizon on. Refuses an unknown horizon and a deletion that would empty the table, and checks that what stays and goes is all there was."""
    n = rows.agg(F.count("*").alias("total"), F.count_if(epoch < horizon).alias("old"), F.count_if(epoch.isNull()).alias("unknown"), F.count_if(epoch >= horizon).alias("kept")).first()
    if n.unknown:
        raise ValueError(f"{n.unknown} rows have no epoch")
    if n.total and n.old == n.total:
        raise ValueError("the table would be emptied")
    if n.old + n.kept != n.total:
        raise ValueError(f"{n.old} and {n.kept} rows are not {n.total}")
    return rows.where(epoch >= horizon)


def append_ledger(entries: DataFrame, path: str) -> None:
    """Adds run entries (job, status, rows, seconds) to the ledger, stamped now."""
    entries.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
