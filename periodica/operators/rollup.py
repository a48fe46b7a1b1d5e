"""Rollups of event rows: conditional sums in one grouping, two-level rollups, roles, participation, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


def sum_where(value: Column, cond: Column) -> Column:
    """Sum where the condition holds; an empty sum is 0."""
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0))


def n_where(value: Column, cond: Column) -> Column:
    """Rows where the condition holds and there is a value."""
    return F.count(F.when(cond, value))


def split_rollup(events: DataFrame, keys: list[str], value: str, splits: dict[str, Column]) -> DataFrame:
    """Counts and sums over all rows and over each split, in one grouping."""
    aggs = [F.count("*").alias("n"), F.sum(value).alias("total")]
    for name, cond in splits.items():
        aggs += [count_where(cond).alias(f"n_{name}"), sum_where(F.col(value), cond).alias(f"total_{name}")]
    return events.groupBy(*keys).agg(*aggs)


def segment_rollup(events: DataFrame, segment: list[str], keys: list[str], order: str, value: str, threshold: int) -> DataFrame:
    """Segments first (size, largest, first value, any over the threshold), then counts of them per key."""
    each = events.groupBy(*segment, *keys).agg(F.count("*").alias("size"), F.max(value).alias("most"), F.min_by(value, F.struct(order, value)).alias("first"), F.max((F.col(value) > threshold).cast("int")).alias("over"))
    return each.groupBy(*keys).agg(F.count("*").alias("segments"), F.sum("size").alias("events"), F.count_if(F.col("size") <= 3).alias("short"), F.sum("over").alias("over"), F.sum("most").alias("sum_most"), F.sum("first").alias("sum_first"))


def role_rollup(events: DataFrame, roles: dict[str, str], keys: list[str], value: str) -> DataFrame:
    """One row per identity and key over all roles; a role that never occurs is null, not zero.

    The roles of a row are exploded and meet in a single grouping, in place of one join a role.
    """
    tagged = events.select(*keys, value, F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).cast("long").alias("identity")) for r, c in roles.items()])).alias("r")).select(*keys, value, "r.*")
    aggs = []
    for r in roles:
        mine = F.col("role") == r
        n = count_where(mine)
        aggs += [F.when(n > 0, n).alias(f"n_{r}"), F.sum(F.when(mine, F.col(value))).alias(f"total_{r}")]
    return tagged.where(F.col("identity").isNotNull()).groupBy("identity", *keys).agg(*aggs)


def listed_counts(rows: DataFrame, keys: list[str], listed: Column, label: Column) -> DataFrame:
    """Distinct, trimmed, non-blank members of a delimited list, once per row, counted by label."""
    members = F.array_distinct(F.filter(F.transform(listed, F.trim), lambda x: x != ""))
    return rows.select(*keys, label.alias("label"), F.explode(members).alias("member")).groupBy("member", "label").agg(F.count("*").alias("n"))


def stacked(frames: dict[str, DataFrame], tag: str = "variant") -> DataFrame:
    """Typed variants under each other; columns a variant lacks are null."""
    out = None
    for name, df in frames.items():
        tagged = df.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def top_k(rows: DataFrame, keys: list[str], volume: str, tie: str, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(volume), F.asc(tie))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def modal_value(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key; null, with a tie flag, where several are."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.max("n").alias("n"))
    top = counts.join(best, [*keys, "n"]).groupBy(*keys, "n").agg(F.count("*").alias("ways"), F.min(value).alias("value"))
    return top.select(*keys, F.when(F.col("ways") == 1, F.col("value")).alias(value), "n", (F.col("ways") > 1).alias("tied"))


def run_labels(rows: DataFrame, keys: list[str], epoch: str) -> DataFrame:
    """A set of years as text: {2023, 2024, 2026} is "2023-2024, 2026"."""
    w = Window.partitionBy(*keys).orderBy(epoch)
    runs = rows.select(*keys, epoch).distinct().withColumn("run", F.col(epoch) - F.row_number().over(w))
    runs = runs.groupBy(*keys, "run").agg(F.min(epoch).alias("a"), F.max(epoch).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    runs = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))).alias("runs"))
    return runs.select(*keys, F.array_join(F.transform("runs", lambda r: r.t), ", ").alias("span"))


def funnel(rows: DataFrame, keys: list[str], stages: dict[str, Column]) -> DataFrame:
    """Rows that survive each predicate and all before it, in one pass."""
    aggs, so_far = [F.count("*").alias("n_all")], F.lit(True)
    for name, cond in stages.items():
        so_far = so_far & F.coalesce(cond, F.lit(False))
        aggs.append(F.count_if(so_far).alias(f"n_{name}"))
    return rows.groupBy(*keys).agg(*aggs)


def error_metrics(rows: DataFrame, keys: list[str], predicted: Column, actual: Column) -> DataFrame:
    """n, MAE, RMSE and bias over the pairs without a null."""
    e = predicted - actual
    return rows.where(e.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"), F.round(F.avg(e), 4).alias("bias"))
