"""Point-in-time windows: a row of a period never reads a later one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodica.operators.upsert import null_safe


def _past(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def played_index(rows: DataFrame, keys: list[str], period: str) -> DataFrame:
    """How many periods were played so far, where the last four begin, and how many those are."""
    w = Window.partitionBy(*keys).orderBy(period)
    first = F.min(period).over(Window.partitionBy(*keys))
    played = rows.withColumn("played", F.row_number().over(w))
    return played.withColumn("l4_from", F.coalesce(F.lag(period, 3).over(w), first)).withColumn("l4_played", F.least("played", F.lit(4)))


def three_windows(rows: DataFrame, keys: list[str], period: str, num: str, den: str) -> DataFrame:
    """Sums and ratios over the period, the last four played and the epoch to date: ratios of sums, never means of ratios."""
    w = Window.partitionBy(*keys).orderBy(period)
    frames = {"game": w.rowsBetween(0, 0), "l4": w.rowsBetween(-3, 0), "std": w.rowsBetween(Window.unboundedPreceding, 0)}
    out = [*keys, period]
    for name, frame in frames.items():
        out += [F.sum(num).over(frame).alias(f"num_{name}"), F.sum(den).over(frame).alias(f"den_{name}")]
    summed = rows.select(*out)
    rates = {f"rate_{n}": F.round(F.when(F.col(f"den_{n}") != 0, F.col(f"num_{n}") / F.col(f"den_{n}")), 6) for n in frames}
    return summed.withColumns(rates)


def cumulative(rows: DataFrame, keys: list[str], period: str, columns: list[str]) -> DataFrame:
    """Sums of a group up to each period; rows of one period are summed first."""
    per = rows.groupBy(*keys, period).agg(*[F.sum(c).alias(c) for c in columns])
    return per.select(*keys, period, *[F.sum(c).over(_past(keys, period)).alias(f"cum_{c}") for c in columns])


def delta(rows: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(period)
    return rows.withColumn("delta", F.col(value) - F.lag(value).over(w))


def midrank(rows: DataFrame, group: list[str], value: str, name: str = "pct") -> DataFrame:
    """round(100 * (below + half the equal) / population), half up; a null value has no percentile and isn't counted."""
    # Ranks are formed over the distinct values of a group, counted with map-side combination, and joined back.
    values = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_equal"))
    below = F.sum("_equal").over(Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_equal")
    pop = F.sum("_equal").over(Window.partitionBy(*group))
    # In whole numbers, so that halves round alike everywhere.
    pct = F.floor((100 * (2 * below + F.col("_equal")) + pop) / (2 * pop)).cast("long")
    return null_safe(rows, values.select(*group, value, pct.alias(name)), [*group, value], "left").select(*rows.columns, name)


def as_of_percentile(rows: DataFrame, entity: str, cohort: str, period: str, value: str, eligible: Column, last_period: int) -> DataFrame:
    """Percentile at each of an entity's periods among every entity's latest row so far.

    A row stands for its entity until its next one; it is spread over those periods, at most last_period of them.
    An ineligible latest row takes its entity out of the population.
    """
    w = Window.partitionBy(entity).orderBy(period)
    until = F.coalesce(F.lead(period).over(w) - 1, F.lit(last_period))
    spread = rows.withColumn("eligible", eligible & F.col(value).isNotNull()).withColumn("until", until).where(F.col("until") >= F.col(period))
    spread = spread.withColumn("at", F.explode(F.sequence(period, "until"))).where("eligible")
    # The population's distinct values are counted over the spread rows; only rows of their own period are joined to them.
    counts = spread.groupBy("at", cohort, value).agg(F.count("*").alias("_equal"))
    w = Window.partitionBy("at", cohort)
    below = F.sum("_equal").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_equal")
    pop = F.sum("_equal").over(w)
    ranked = counts.select(F.col("at").alias(period), cohort, value, F.floor((100 * (2 * below + F.col("_equal")) + pop) / (2 * pop)).cast("long").alias("pct"), pop.alias("ranked_here"))
    own = spread.where(F.col("at") == F.col(period)).select(entity, cohort, period, value)
    return null_safe(own, ranked, [cohort, period, value], "inner").select(entity, cohort, period, value, "pct", "ranked_here")


def next_pointer(rows: DataFrame, keys: list[str], period: str) -> DataFrame:
    """next_period: the row holds as of W where period <= W and there is no next or next > W."""
    return rows.withColumn("next_period", F.lead(period).over(Window.partitionBy(*keys).orderBy(period)))


def as_of(rows: DataFrame, period: str, at: int) -> DataFrame:
    return rows.where((F.col(period) <= at) & (F.col("next_period").isNull() | (F.col("next_period") > at)))


def latest_before(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], before: Column | None = None) -> DataFrame:
    """The last row of each key, by one grouping; `order` must tell rows apart."""
    kept = rows if before is None else rows.where(before)
    return kept.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select(*keys, "r.*")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """For each left row the value of the last right row of its key at or before it; one sort by key, no range join."""
    both = left.select(*keys, order, F.lit(1).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias(value), F.struct(*left.columns).alias("row")).unionByName(
        right.select(*keys, order, F.lit(0).alias("side"), value, F.lit(None).cast(left.select(F.struct(*left.columns).alias("row")).schema["row"].dataType).alias("row"))
    )
    w = Window.partitionBy(*keys).orderBy(order, "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("side = 1").select("row.*", value)


def forward_fill(observed: DataFrame, calendar: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """The value on each calendar day: the last one observed up to it; days before the first have none."""
    entities = observed.groupBy(*keys).agg(F.min(day).alias("since"))
    # Each entity has the calendar's days from its first observation on.
    days = calendar.agg(F.array_sort(F.collect_set(day)).alias("days"))
    grid = entities.withColumn("days", days.scalar()).select(*keys, "since", F.explode("days").alias(day)).where(F.col(day) >= F.col("since")).select(*keys, day)
    return asof_join(grid, observed.select(*keys, day, value), keys, day, value)


def step_score(rows: DataFrame, keys: list[str], order: list[str], severity: str) -> DataFrame:
    """+1 for each worse step and -1 for each better one along a sequence; null below two observations."""
    w = Window.partitionBy(*keys).orderBy(*order)
    steps = rows.where(F.col(severity).isNotNull()).withColumn("step", F.signum(F.col(severity) - F.lag(severity).over(w)))
    return steps.groupBy(*keys).agg(F.count("*").alias("seen"), F.sum("step").cast("long").alias("score")).withColumn("score", F.when(F.col("seen") >= 2, F.col("score")))


def first_seen(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """First value and how often it changed afterwards."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("changed", (~F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(F.lit(1)).over(w).isNotNull()).cast("int"))
    return marked.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias("first"), F.sum("changed").alias("changes"), F.count("*").alias("polls"))
