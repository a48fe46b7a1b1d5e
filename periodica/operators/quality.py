"""Data-quality audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from periodica.operators.selection import quantiles
from periodica.operators.upsert import null_safe
from periodica.sources.shared import shared_dir


class MissingColumns(ValueError):
    """A source lacks columns that a job needs."""


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    """Raises before any job runs if columns are missing."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise MissingColumns(", ".join(missing))
    return df


def constraint_report(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations of each rule, in one pass; a rule that is null for a row is no violation."""
    one = rows.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("r")).select("r.*")


def floor_and_nulls(rows: DataFrame, keys: list[str], least: int, ceilings: dict[str, float]) -> DataFrame:
    """Groups below a row floor, and shares of nulls above a ceiling."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(c).isNull().cast("int")), 6).alias(f"null_{c}") for c in ceilings])
    return out.withColumn("below_floor", F.col("n") < least).withColumn("too_null", F.greatest(*[F.col(f"null_{c}") > m for c, m in ceilings.items()]) if len(ceilings) > 1 else F.col(f"null_{next(iter(ceilings))}") > next(iter(ceilings.values())))


def freshness(ledger: DataFrame, tiers: DataFrame, agent: str, at: str, now: Column) -> DataFrame:
    """fresh, stale or never_run, by an agent's last success and its tier's hours. tiers is (agent, hours)."""
    last = ledger.groupBy(agent).agg(F.max(at).alias("last"))
    age = (F.unix_micros(now) - F.unix_micros(F.col("last").cast("timestamp"))) / 3.6e9
    return tiers.join(last, agent, "left").select(agent, F.when(F.col("last").isNull(), "never_run").when(age > F.col("hours"), "stale").otherwise("fresh").alias("state"))


def alert_diff(before: DataFrame, now: DataFrame, key: str, text: str) -> DataFrame:
    """new, changed, unchanged or cleared alerts."""
    j = null_safe(before.select(key, F.struct(text).alias("old")), now.select(key, F.struct(text).alias("new")), [key], "full")
    return j.select(key, F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "cleared").when(~F.col("old").eqNullSafe(F.col("new")), "changed").otherwise("unchanged").alias("state"))


def snapshot_diff(before: DataFrame, now: DataFrame, pk: list[str], columns: list[str]) -> DataFrame:
    """Per column: rows that differ, those that became null or known, and quantiles of how far numbers moved. Texts have no distance."""
    j = null_safe(before.select(*pk, *[F.col(c).alias(f"a_{c}") for c in columns]), now.select(*pk, *[F.col(c).alias(f"b_{c}") for c in columns]), pk, "inner")
    by = lambda c: F.try_subtract(F.col(f"b_{c}"), F.col(f"a_{c}")).cast("double") if isinstance(before.schema[c].dataType, NumericType) else F.lit(None).cast("double")
    one = lambda c: F.struct(F.lit(c).alias("column"), by(c).alias("by"), F.col(f"a_{c}").isNull().alias("was_null"), F.col(f"b_{c}").isNull().alias("is_null"), F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")).alias("same"))
    tall = j.select(F.explode(F.array(*map(one, columns))).alias("r")).select("r.*").where("NOT same")
    shared_dir(before.sparkSession)
    moves = tall.groupBy("column", F.abs("by").alias("by")).agg(F.count("*").alias("n"), F.count_if("is_null").alias("to_null"), F.count_if("was_null").alias("from_null")).checkpoint()
    middle = quantiles(moves, ["column"], "by", [0.5], F.col("n")).select("column", F.round("q0", 6).alias("median_by"))
    totals = moves.groupBy("column").agg(F.sum("n").alias("changed"), F.sum("to_null").alias("to_null"), F.sum("from_null").alias("from_null"), F.round(F.max("by"), 6).alias("most"))
    return totals.join(middle, "column", "left").select("column", "changed", "to_null", "from_null", "median_by", "most")


def vocabulary(rows: DataFrame, code: str, sets: DataFrame) -> DataFrame:
    """Codes in the data but in no set, in a set but not in the data, in several sets, and nulls. sets is (code, set)."""
    seen = rows.groupBy(F.col(code).alias("code")).agg(F.count("*").alias("n"))
    listed = sets.groupBy("code").agg(F.count_distinct("set").alias("sets"))
    j = seen.join(listed, seen["code"].eqNullSafe(listed["code"]), "full").select(F.coalesce(seen["code"], listed["code"]).alias("code"), "n", "sets")
    verdict = F.when(F.col("code").isNull(), "null").when(F.col("sets").isNull(), "unlisted").when(F.col("n").isNull(), "unused").when(F.col("sets") > 1, "ambiguous").otherwise("ok")
    return j.select("code", F.coalesce("n", F.lit(0)).alias("n"), verdict.alias("verdict"))


def iff_known(value: Column, condition: Column) -> Column:
    """A rule: the value is known exactly where the condition holds."""
    return value.isNotNull() == condition


def row_faults(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """The rows with `faults`: the names of the rules that they break, in order, and duplicate_key last. A rule that is null for a row is broken, and so is a null key (no_key).

    Keys are counted with map-side combination and only repeated ones are joined back, so no task gathers the rows of a key.
    """
    again = rows.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key, F.lit("duplicate_key").alias("_again"))
    broken = [F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in ({"no_key": F.col(key).isNotNull()} | rules).items()]
    return rows.join(again, key, "left").withColumn("faults", F.array_compact(F.array(*broken, F.col("_again")))).drop("_again")


class FaultyRows(ValueError):
    """A source has rows that break its rules."""


def refuse_faults(rows: DataFrame, key: str) -> DataFrame:
    """The rows without their empty faults; raises if any has one, naming the first by key and how many there are."""
    n, first = rows.where(F.size("faults") > 0).agg(F.count("*"), F.min(F.struct(key, "faults"))).first()
    if n:
        raise FaultyRows(f"{n} rows; {first[0]}: {', '.join(first[1])}")
    return rows.drop("faults")


def unique_report(rows: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """Rows beyond the first of each key, by rule."""
    out = None
    for name, keys in rules.items():
        one = rows.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def capture_report(due: DataFrame, keys: list[str], state: str, explained: tuple[str, ...]) -> DataFrame:
    """Due targets by key: captured, missed with a reason, and missed without one (a null state is still pending)."""
    s = F.coalesce(F.col(state), F.lit("pending"))
    return due.groupBy(*keys).agg(F.count("*").alias("due"), F.count_if(s == "captured").alias("captured"), F.count_if(s.isin(*explained)).alias("explained"), F.count_if(~s.isin("captured", *explained)).alias("unexplained"))


def directed(before: DataFrame, after: DataFrame, key: str, state: str, healthy: str) -> DataFrame:
    """Per key whether its state is the same, changed to healthy (expected) or in another way (unexpected)."""
    j = null_safe(before.select(key, F.col(state).alias("_a")), after.select(key, F.col(state).alias("_b")), [key], "full")
    way = F.when(F.col("_a").eqNullSafe(F.col("_b")), "same").when((F.col("_b") == healthy) & (F.col("_a") != healthy), "expected").otherwise("unexpected")
    return j.select(key, way.alias("direction"))
