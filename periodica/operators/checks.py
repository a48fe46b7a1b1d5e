"""Guards, ladders and reports that jobs apply to what they read and publish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.operators.upsert import null_safe


class Truncated(ValueError):
    """A read met its cap: what it returned isn't whole."""


def integral_key(rows: DataFrame, key: str) -> DataFrame:
    """Casts a key to bigint; a fractional value raises when the rows are read, in the same pass. Null stays null."""
    whole_number = F.col(key).cast("long")
    broken = F.raise_error(F.concat(F.lit(f"{key} is fractional: "), F.col(key).cast("string"))).cast("long")
    return rows.withColumn(key, F.when(F.col(key) == F.floor(key), whole_number).when(F.col(key).isNotNull(), broken))


def whole(rows: DataFrame, cap: int) -> DataFrame:
    """The rows, at most cap of them; raises if there are more."""
    if rows.limit(cap + 1).count() > cap:
        raise Truncated(f"more than {cap} rows")
    return rows


def whole_by(rows: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """The rows, at most cap of each key; raises if a key has more."""
    if not rows.groupBy(*keys).count().where(F.col("count") > cap).isEmpty():
        raise Truncated(f"more than {cap} rows of a key")
    return rows


def ladder(*steps: tuple[Column, int | str], otherwise: int | str | None = None) -> Column:
    """The code of the first condition that holds; a null condition doesn't."""
    out = None
    for cond, code in steps:
        out = F.when(cond, code) if out is None else out.when(cond, code)
    return out.otherwise(otherwise)


def gated(num: Column, den: Column) -> tuple[Column, Column]:
    """Numerator and denominator, both null unless the denominator is positive and the numerator known."""
    ok = (den > 0) & num.isNotNull()
    return F.when(ok, num), F.when(ok, den)


def oriented_third(pct: Column, higher_is_better: Column) -> Column:
    """better, middle or worse third of a percentile, by the metric's direction."""
    good = F.when(higher_is_better, pct).otherwise(100 - pct)
    return F.when(pct.isNull(), F.lit(None).cast("string")).when(good >= 67, "better").when(good < 33, "worse").otherwise("middle")


def centred(rows: DataFrame, keys: list[str], value: str, name: str = "centred") -> DataFrame:
    """The rows with the value less its group's mean; nulls count for nothing. Means are grouped and joined back, so no task gathers a group."""
    means = rows.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    return null_safe(rows, means, keys, "left").withColumn(name, F.col(value) - F.col("_mean")).drop("_mean")


def recommended(rows: DataFrame, parent: DataFrame) -> DataFrame:
    """k and r of (cohort, metric): its own where its interval is tight and r is above zero, else its parent's k, else the point estimate.

    rows: metric, cohort, k0, low, high, r_low, r. parent: metric, parent_k.
    """
    tight = F.col("low").isNotNull() & (F.col("low") > 0) & (F.col("high") / F.col("low") <= 2)
    pinned = tight & (F.col("r_low") > 0)
    k = F.when(pinned, F.col("k0")).otherwise(F.coalesce("parent_k", "k0"))
    rule = F.when(pinned, "own").when(F.col("parent_k").isNotNull(), "parent").when(F.col("k0").isNotNull(), "point").otherwise("none")
    return rows.join(parent, "metric", "left").select("metric", "cohort", rule.alias("rule"), k.alias("k"), F.when(F.col("r_low") > 0, F.col("r")).otherwise(0.0).alias("r"))


def terms(intercept: float, home: float, beta: dict[str, float], is_home: Column) -> tuple[Column, list[tuple[str, Column]]]:
    """A linear prediction and its contributions; null unless all inputs are known."""
    parts = [("home", F.when(is_home, home).otherwise(0.0)), *[(c, F.col(c) * b) for c, b in beta.items()]]
    total = F.lit(intercept)
    for _, p in parts:
        total = total + p
    return total, parts


def classified(label: Column, kinds: dict[str, tuple[str, ...]], unknown: str) -> tuple[Column, Column]:
    """(kind, flagged): the kind that lists a label; a label that none lists counts as `unknown` and is flagged. Null stays null."""
    kind = F.lit(None).cast("string")
    for name, labels in kinds.items():
        kind = F.when(label.isin(*labels), name).otherwise(kind)
    flagged = label.isNotNull() & kind.isNull()
    return F.when(flagged, unknown).otherwise(kind), flagged


def only_from(value: Column, source: Column, outside: tuple[str, ...]) -> Column:
    """The value, null for named sources."""
    return F.when(~F.coalesce(source.isin(*outside), F.lit(False)), value)


def guard_report(rows: DataFrame, key: list[str], member: str, owner: str, share: Column) -> DataFrame:
    """How many keys come twice, how many members have two owners, how many shares exceed one."""
    named = lambda df, guard: df.agg(F.count("*").alias("broken")).select(F.lit(guard).alias("guard"), "broken")
    twice = rows.groupBy(*key).count().where("count > 1")
    owners = rows.groupBy(member).agg(F.min(owner).alias("a"), F.max(owner).alias("b")).where("a <> b")
    return named(twice, "duplicate_key").unionByName(named(owners, "two_owners")).unionByName(named(rows.where(share > 1), "share_over_one"))
