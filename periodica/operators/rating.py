"""Ratings adjusted for the counterparties met, and the blends around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodica.functions.scalars import blend
from periodica.sources.shared import shared_dir


def arms(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Two rows a pair: the entity's offence against the counterparty's defence and the reverse, with the group's rate."""
    league = pairs.groupBy(*group).agg((F.sum("num") / F.sum("den")).alias("league"))
    rated = pairs.join(league, group)
    off = F.struct(F.col("entity").alias("id"), F.lit("off").alias("side"), F.col("counterparty").alias("opp"), F.lit("def").alias("opp_side"))
    de = F.struct(F.col("counterparty").alias("id"), F.lit("def").alias("side"), F.col("entity").alias("opp"), F.lit("off").alias("opp_side"))
    return rated.select(*group, "league", "num", "den", F.explode(F.array(off, de)).alias("a")).select(*group, "league", "num", "den", "a.*")


def start(arm: DataFrame, group: list[str]) -> DataFrame:
    return arm.groupBy(*group, "id", "side").agg(F.first("league").alias("value"))


def iterate(arm: DataFrame, ratings: DataFrame, group: list[str], k: float, priors: DataFrame | None = None) -> DataFrame:
    """One Jacobi step: every rating from the other side's last iterate, then each side recentred on the group's rate.

    With priors (group, id, side, prior, discount) a counterparty is seen through the blend of its iterate
    and its prior, and the own value isn't shrunk.
    """
    met = ratings.select(*group, F.col("id").alias("opp"), F.col("side").alias("opp_side"), F.col("value").alias("ref"))
    seen = arm.join(met, [*group, "opp", "opp_side"])
    own = k
    if priors is not None:
        known = priors.select(*group, F.col("id").alias("opp"), F.col("side").alias("opp_side"), "prior", "discount")
        volume = arm.groupBy(*group, "opp", "opp_side").agg(F.sum("den").alias("n_opp"))
        seen = seen.join(known, [*group, "opp", "opp_side"], "left").join(volume, [*group, "opp", "opp_side"])
        seen = seen.withColumn("ref", blend(F.col("ref"), F.col("n_opp"), k, F.col("prior"), F.coalesce("discount", F.lit(1.0)), F.col("league"))[0])
        own = 0.0
    summed = seen.groupBy(*group, "id", "side").agg(F.sum(F.col("num") + F.col("den") * (F.col("league") - F.col("ref"))).alias("n"), F.sum("den").alias("d"), F.first("league").alias("league"))
    raw = summed.withColumn("raw", (F.col("n") + own * F.col("league")) / (F.col("d") + own))
    # One row an entity is left by now; a grouping and a join back would compute the round twice.
    side = Window.partitionBy(*group, "side")
    mean = F.sum(F.col("raw") * F.col("d")).over(side) / F.sum("d").over(side)
    return raw.select(*group, "id", "side", (F.col("raw") + F.col("league") - mean).alias("value"))


def adjusted(pairs: DataFrame, group: list[str], k: float, rounds: int, priors: DataFrame | None = None) -> DataFrame:
    """A fixed number of rounds, as one plan."""
    arm = arms(pairs, group)
    ratings = start(arm, group)
    for _ in range(rounds):
        ratings = iterate(arm, ratings, group, k, priors)
    return ratings


def solved(pairs: DataFrame, group: list[str], k: float, tolerance: float = 1e-6, most: int = 200, priors: DataFrame | None = None, steps: int = 4) -> DataFrame:
    """Iterates all groups together until each one's largest change is below the tolerance; converged groups leave the loop.

    Every `steps` rounds are one plan, and what all of them changed decides; it is checkpointed to the shared folder, and so are the rows left when groups leave: plans stay short and
    a lost executor costs a few rounds. Groups that don't converge within `most` rounds come out as they are then.
    """
    shared_dir(pairs.sparkSession)
    arm = arms(pairs, group).checkpoint()
    ratings, done = start(arm, group).checkpoint(), None
    for _ in range(-(-most // steps)):
        new, old = ratings, ratings.withColumnRenamed("value", "old")
        for _ in range(steps):
            new = iterate(arm, new, group, k, priors)
        change = F.max(F.abs(F.col("value") - F.col("old"))).over(Window.partitionBy(*group))
        new = new.join(old, [*group, "id", "side"]).withColumn("change", change).drop("old").checkpoint()
        settled = new.where(F.col("change") < tolerance).drop("change")
        done = settled if done is None else done.unionByName(settled)
        ratings = new.where(F.col("change") >= tolerance).drop("change")
        if ratings.isEmpty():
            return done
        if not settled.isEmpty():
            arm = arm.join(ratings.select(*group).distinct(), group, "left_semi").checkpoint()
    return ratings if done is None else done.unionByName(ratings)


def continuity(own: Column, team_prior: Column) -> Column:
    """Discount from the share of the workload that stays: .6 without any, 1 from half of it on; unknown counts as 1."""
    share = F.least(F.lit(1.0), own / team_prior)
    return F.coalesce(1 - (1 - 0.6) * (1 - F.least(F.lit(1.0), share / 0.5)), F.lit(1.0))


def combined_discount(workload: Column, overlap: Column, by_workload: float, by_overlap: float) -> Column:
    """Both discounts, each weakened by the metric's sensitivity: 0 leaves the prior whole, 1 takes the full discount."""
    return (1 - by_workload * (1 - workload)) * (1 - by_overlap * (1 - overlap))


def overlap_discount(now: Column, before: Column, size: int = 5) -> Column:
    """.7 plus .3 times the part of a group that stays; unknown counts as 1."""
    return F.coalesce(0.7 + 0.3 * F.size(F.array_intersect(now, before)) / size, F.lit(1.0))
