"""Joins with a rule of their own: orientation, intervals, fallbacks, peers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodica.operators.checks import centred
from periodica.operators.upsert import null_safe


def left_with_flag(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join that says whether it matched."""
    return left.join(right.withColumn("matched", F.lit(True)), keys, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def first_known(rows: DataFrame, steps: list[tuple[DataFrame, str, str]], name: str = "resolved") -> DataFrame:
    """Resolves an id through lookups (table, key column of rows, value column) in order of preference; unresolved stays null."""
    out, found = rows, []
    for i, (lookup, key, value) in enumerate(steps):
        out = out.join(lookup.select(F.col(key), F.col(value).alias(f"_{i}")), key, "left")
        found.append(F.col(f"_{i}"))
    return out.withColumn(name, F.coalesce(*found)).drop(*[f"_{i}" for i in range(len(steps))])


def oriented(rows: DataFrame, matches: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Rows joined to matches on the unordered pair of sides; `swapped` says that the sides are reversed."""
    low, high = F.least(a, b), F.greatest(a, b)
    r = rows.withColumn("_low", low).withColumn("_high", high)
    m = matches.withColumn("_low", F.least("home", "away")).withColumn("_high", F.greatest("home", "away"))
    return r.join(m, [*keys, "_low", "_high"]).withColumn("swapped", F.col(a) != F.col("home")).drop("_low", "_high")


def interval_days(windows: DataFrame, start: str, stop: str, label: str) -> DataFrame:
    """(day, label) for each day from the first window to the last, day being a date.

    A day belongs to the earliest window that holds it, else to the nearest upcoming one. Days outside are to
    be clamped by the caller. The windows table is a calendar: its days are few whatever the data.
    """
    held = windows.select(F.explode(F.sequence(start, stop)).alias("day"), F.struct(F.col(start).alias("s"), F.col(label).alias("l")).alias("w")).groupBy("day").agg(F.min("w").alias("w"))
    days = windows.agg(F.min(start).alias("a"), F.max(stop).alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    w = Window.orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, 0)
    starts = windows.groupBy(F.col(start).alias("day")).agg(F.min(label).alias("opening"))
    filled = days.join(held, "day", "left").join(starts, "day", "left").withColumn("upcoming", F.last("opening", ignorenulls=True).over(w))
    return filled.select("day", F.coalesce("w.l", "upcoming").alias(label))


def interval_join(probes: DataFrame, windows: DataFrame, day: Column, start: str, stop: str, label: str) -> DataFrame:
    """Each probe with its window's label: an equi join on the day instead of a range join."""
    lookup = interval_days(windows, start, stop, label)
    ends = windows.agg(F.struct(F.min(start).alias("a"), F.max(stop).alias("b"))).scalar()
    clamped = F.greatest(F.least(day, ends.getField("b")), ends.getField("a"))
    return probes.withColumn("day", clamped).join(lookup, "day", "left").drop("day")


def adjacent(rows: DataFrame, keys: list[str], epoch: str, value: str) -> DataFrame:
    """Pairs of an entity's value in one epoch and the next."""
    later = rows.select(*keys, (F.col(epoch) - 1).alias(epoch), F.col(value).alias("next"))
    return rows.select(*keys, epoch, F.col(value).alias("this")).join(later, [*keys, epoch])


def paired_sides(signals: DataFrame, pairs: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_off", "_def")) -> DataFrame:
    """`<base>_off` of a subject beside `<base>_def` of its counterparty, which may be missing."""
    named = signals.withColumn("base", F.regexp_replace("signal", f"({suffixes[0]}|{suffixes[1]})$", ""))
    off = named.where(F.col("signal").endswith(suffixes[0])).select(*keys, "entity", "base", F.col("value").alias("own"))
    other = named.where(F.col("signal").endswith(suffixes[1])).select(*keys, F.col("entity").alias("counterparty"), "base", F.col("value").alias("theirs"))
    return pairs.join(off, [*keys, "entity"]).join(other, [*keys, "counterparty", "base"], "left")


def match_features(matches: DataFrame, signals: DataFrame, keys: list[str], bases: list[str], home_h: float = 0.5) -> DataFrame:
    """Matches with both sides' features: for each side (home, away), unit (off, def) and base the centred value, the raw one and its stability.

    matches has the keys, home, away and location (Home or Neutral; anything else raises as it is read). signals is tall: keys, entity, signal (`<base>_<unit>`), value,
    stability; a second row of a signal raises, so nothing is multiplied or chosen at random. Values are centred on their signal's mean over the keys.
    A missing input stays null; features_complete says that none is, and only then stability_min is the least stability. h_home is 0 on neutral ground.

    Signals become one row an entity in one grouping (the first of three; one for the means), and the wide rows are joined twice, once a side.
    """
    names = [f"{b}_{u}" for u in ("off", "def") for b in bases]
    tall = centred(signals.where(F.col("signal").isin(*names)).select(*keys, "entity", "signal", "value", "stability"), [*keys, "signal"], "value")
    mine = lambda s: F.col("signal") == s
    one = lambda s: F.when(F.count_if(mine(s)) > 1, F.raise_error(F.lit(f"two rows of signal {s}"))).otherwise(F.max(F.when(mine(s), F.struct("centred", "value", "stability"))))
    wide = tall.groupBy(*keys, "entity").agg(*[one(s).alias(s) for s in names])
    out, stabilities, features = matches, [], []
    for side in ("home", "away"):
        cells = []
        for base in bases:
            for unit in ("off", "def"):
                at = F.col(f"{base}_{unit}")
                cells += [at.centred.alias(f"{side}_{unit}__{base}"), at.value.alias(f"{side}_{unit}_raw__{base}"), at.stability.alias(f"{side}_{unit}_stab__{base}")]
                features.append(f"{side}_{unit}__{base}")
                stabilities.append(f"{side}_{unit}_stab__{base}")
        out = null_safe(out, wide.select(*keys, F.col("entity").alias(side), *cells), [*keys, side], "left")
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*features, *stabilities]]) if bases else F.lit(True)
    least = F.array_min(F.array(*stabilities)) if bases else F.lit(None).cast("double")
    place = F.when(F.col("location") == "Neutral", 0.0).when(F.col("location") == "Home", home_h).otherwise(F.raise_error(F.lit("a match needs location Home or Neutral")).cast("double"))
    return out.withColumn("h_home", place).withColumn("features_complete", complete).withColumn("stability_min", F.when(complete, least))


def next_candidate(rows: DataFrame, slot: list[str], rank: str, member: str, flagged: Column) -> DataFrame:
    """For each flagged member the best-ranked unflagged one behind it in its slot, by one window instead of a theta join.

    The window runs from the last rank to the first and looks back, so each row is taken in once; a frame that reaches ahead to the end
    is gone through anew for every row.
    """
    w = Window.partitionBy(*slot).orderBy(F.desc(rank), F.desc(member)).rowsBetween(Window.unboundedPreceding, -1)
    healthy = F.when(~flagged, F.struct(F.col(rank).alias("r"), F.col(member).alias("m")))
    found = rows.withColumn("_next", F.last(healthy, ignorenulls=True).over(w)).where(flagged)
    return found.select(*slot, member, rank, F.col("_next.m").alias("replacement"), (F.col("_next.r") - F.col(rank)).alias("rank_delta"))


def reallocate(rows: DataFrame, cohort: list[str], share: str, flagged: Column) -> DataFrame:
    """Flagged shares spread over the other members in proportion to their own; a cohort without others loses them."""
    sums = rows.groupBy(*cohort).agg(F.sum(F.when(flagged, F.col(share)).otherwise(0)).alias("_lost"), F.sum(F.when(flagged, 0).otherwise(F.col(share))).alias("_open"))
    gain = F.when(~flagged & (F.col("_open") > 0), F.col("_lost") * F.col(share) / F.col("_open")).otherwise(0.0)
    return null_safe(rows, sums, cohort, "left").withColumn("at_risk", F.when(flagged, F.col(share)).otherwise(0)).withColumn("gain", gain).drop("_lost", "_open")
