"""Estimates over groups: moments, reliability, resampling, least squares."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def variance_components(rows: DataFrame, group: list[str], entity: str, x: str, d: str) -> DataFrame:
    """k0 = within / between variance from weighted rows of entities with two rows or more; null where there is no excess between them."""
    each = rows.groupBy(*group, entity).agg(F.sum(d).alias("dd"), F.count("*").alias("g"), (F.sum(F.col(x) * F.col(d)) / F.sum(d)).alias("mean"), F.sum(F.col(d) * F.col(x) * F.col(x)).alias("sq"))
    each = each.where("g >= 2").withColumn("ss", F.col("sq") - F.col("dd") * F.col("mean") * F.col("mean"))
    both = each.groupBy(*group).agg(
        F.sum("ss").alias("ss"), F.sum(F.col("g") - 1).alias("df"), F.count("*").alias("entities"), F.sum("dd").alias("n"), F.sum(F.col("dd") * F.col("dd")).alias("nn"),
        F.sum(F.col("dd") * F.col("mean")).alias("s"), F.sum(F.col("dd") * F.col("mean") * F.col("mean")).alias("q"),
    )
    within = F.col("ss") / F.col("df")
    between = (F.col("q") - F.col("s") * F.col("s") / F.col("n") - (F.col("entities") - 1) * within) / (F.col("n") - F.col("nn") / F.col("n"))
    return both.select(*group, "entities", within.alias("within"), between.alias("between")).withColumn("k0", F.when(F.col("between") > 0, F.col("within") / F.col("between")))


def year_reliability(pairs: DataFrame, group: list[str], this: str, later: str, least: int = 5) -> DataFrame:
    """Pearson correlation of adjacent epochs, clipped to [0, 1], half drawn to the mean over groups; null below `least` pairs."""
    raw = pairs.groupBy(*group).agg(F.count("*").alias("pairs"), F.corr(this, later).alias("r"))
    raw = raw.withColumn("raw", F.when(F.col("pairs") >= least, F.least(F.greatest("r", F.lit(0.0)), F.lit(1.0)))).drop("r")
    mean = raw.agg(F.avg("raw")).scalar()
    return raw.withColumn("reliability", 0.5 * F.col("raw") + 0.5 * mean)


def weighted_slope(pairs: DataFrame, group: list[str], x: str, y: str, weight: Column) -> DataFrame:
    """Slope of y on x by weighted moments, with the plain correlation beside it."""
    w = pairs.withColumn("w", weight)
    m = w.groupBy(*group).agg(F.count("*").alias("pairs"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col(x)).alias("sx"), F.sum(F.col("w") * F.col(y)).alias("sy"), F.sum(F.col("w") * F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col("w") * F.col(x) * F.col(y)).alias("sxy"), F.corr(x, y).alias("r"))
    top, bottom = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("sw"), F.col("sxx") - F.col("sx") * F.col("sx") / F.col("sw")
    return m.select(*group, "pairs", F.when(bottom > 0, top / bottom).alias("slope"), "r")


def hash_uniform(*parts: Column) -> Column:
    """In [0, 1), from the first 32 bits of an md5: any engine draws the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def poisson_weight(u: Column) -> Column:
    """Poisson(1) count by inverting its distribution; counts above 6 are 6."""
    out, total, term = F.lit(6), 0.0, float(np.exp(-1.0))
    cuts = []
    for k in range(6):
        total += term
        cuts.append((k, round(total, 9)))
        term /= k + 1
    for k, cut in reversed(cuts):
        out = F.when(u < cut, k).otherwise(out)
    return out


def bootstrap(rows: DataFrame, keys: list[str], cluster: str, sums: dict[str, Column], estimate: Column, replicates: int = 200) -> DataFrame:
    """Percentile interval of an estimate from cluster sums, under hash-drawn Poisson weights.

    Rows are first summed by cluster; a cluster then meets its weights, so work is clusters times replicates.
    """
    by = rows.groupBy(*keys, cluster).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    drawn = by.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", poisson_weight(hash_uniform(F.col("rep"), F.col(cluster))))
    reps = drawn.groupBy(*keys, "rep").agg(*[F.sum(F.col("w") * F.col(n)).alias(n) for n in sums]).withColumn("estimate", estimate)
    p = F.percentile("estimate", F.array(F.lit(0.025), F.lit(0.975)))
    return reps.groupBy(*keys).agg(p.alias("p")).select(*keys, F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def cross_sums(rows: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """n, X'X, X'y and y'y of the columns xs (an intercept first), per key, in one grouping."""
    cols = ["1", *xs]
    at = lambda c: F.lit(1.0) if c == "1" else F.col(c)
    aggs = [F.sum(at(a) * at(b)).alias(f"xx_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    aggs += [F.sum(at(a) * F.col(y)).alias(f"xy_{i}") for i, a in enumerate(cols)]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(y) * F.col(y)).alias("yy"), *aggs)


def ols_clustered(rows: DataFrame, y: str, xs: list[str], cluster: str) -> DataFrame:
    """term, estimate, clustered standard error (CR1).

    Spark forms the sums; only matrices of the number of terms squared reach the driver.
    """
    k = len(xs) + 1
    s = cross_sums(rows, [], y, xs).first()
    xx = np.array([[s[f"xx_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    beta = np.linalg.solve(xx, np.array([s[f"xy_{i}"] for i in range(k)], float))
    fitted = sum((float(b) * F.col(c) for b, c in zip(beta[1:], xs, strict=True)), F.lit(float(beta[0])))
    scored = rows.withColumn("_e", F.col(y) - fitted)
    per = scored.groupBy(cluster).agg(F.sum("_e").alias("s_0"), *[F.sum(F.col("_e") * F.col(c)).alias(f"s_{i}") for i, c in enumerate(xs, 1)])
    m = per.agg(F.count("*").alias("g"), *[F.sum(F.col(f"s_{i}") * F.col(f"s_{j}")).alias(f"m_{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    meat = np.array([[m[f"m_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    inv, g, n = np.linalg.inv(xx), m["g"], s["n"]
    se = np.sqrt(np.diag(inv @ meat @ inv) * g / (g - 1) * (n - 1) / (n - k))
    data = [(t, float(b), float(e)) for t, b, e in zip(["intercept", *xs], beta, se, strict=True)]
    return rows.sparkSession.createDataFrame(data, "term string, estimate double, se double")


def walk_forward(rows: DataFrame, epoch: str, y: str, x: str) -> DataFrame:
    """For each epoch the line fitted on all earlier ones: running sums of cross products, so all fits are one pass."""
    sums = cross_sums(rows, [epoch], y, [x])
    w = Window.orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    names = ["n", "xx_0_1", "xx_1_1", "xy_0", "xy_1"]
    past = sums.select(epoch, *[F.sum(c).over(w).alias(c) for c in names])
    det = F.col("n") * F.col("xx_1_1") - F.col("xx_0_1") * F.col("xx_0_1")
    beta = (F.col("n") * F.col("xy_1") - F.col("xx_0_1") * F.col("xy_0")) / det
    return past.where("n > 2").select(epoch, F.col("n").alias("rows_before"), ((F.col("xy_0") - beta * F.col("xx_0_1")) / F.col("n")).alias("alpha"), beta.alias("beta"))


def side_reliability(pairs: DataFrame, metric: str, side: str, this: str, later: str, pinned: tuple[str, ...] = (), least: int = 5) -> DataFrame:
    """Year-over-year reliability by metric and side, half drawn to its side's mean; named metrics count as unreliable."""
    raw = pairs.groupBy(metric, side).agg(F.count("*").alias("pairs"), F.corr(this, later).alias("r"))
    raw = raw.withColumn("raw", F.when(F.col("pairs") >= least, F.least(F.greatest("r", F.lit(0.0)), F.lit(1.0))))
    mean = raw.groupBy(side).agg(F.avg("raw").alias("mean"))
    value = F.when(F.col(metric).isin(*pinned), 0.0).otherwise(0.5 * F.col("raw") + 0.5 * F.col("mean"))
    return raw.join(mean, side).select(metric, side, "pairs", value.alias("reliability"))


def recommended_shrinkage(estimates: DataFrame, parent: DataFrame, headline: float, tight: float = 2.0, steady: float = 1.5) -> DataFrame:
    """k and r of (metric, cohort) with the rule that gave k.

    estimates: metric, cohort, k0 (null: no excess variance), low, high (of k0), r_low, r_high, slope. parent: metric,
    parent_k. k is the own point if its interval is within `tight` and r is above zero (pinned); else the parent's;
    else the point; else that of the metric's first cohort with one (donor); else the headline's. r is 0 without
    signal, or where an unpinned slope may exceed `steady`.
    """
    donor = estimates.groupBy("metric").agg(F.min_by("k0", F.when(F.col("k0").isNotNull(), F.col("cohort"))).alias("donor_k"))
    x = estimates.join(donor, "metric").join(parent, "metric", "left")
    pinned = F.coalesce(F.col("k0").isNotNull() & (F.col("high") / F.col("low") <= tight) & (F.col("r_low") > 0), F.lit(False))
    steps = [(pinned, "pinned", F.col("k0")), (F.col("parent_k").isNotNull(), "parent", F.col("parent_k")), (F.col("k0").isNotNull(), "point", F.col("k0")), (F.col("donor_k").isNotNull(), "donor", F.col("donor_k"))]
    rule, k = F.when(*[steps[0][0], F.lit("pinned")]), F.when(steps[0][0], steps[0][2])
    for cond, name, value in steps[1:]:
        rule, k = rule.when(cond, name), k.when(cond, value)
    rule = rule.otherwise("headline")
    r = F.when(rule.isin("donor", "headline") | (F.col("r_low") <= 0) | (~pinned & (F.col("r_high") > steady)), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("slope"))))
    return x.select("metric", "cohort", rule.alias("rule"), k.otherwise(headline).alias("k"), r.alias("r"))


def walk_forward_terms(rows: DataFrame, epoch: str, y: str, xs: list[str]) -> DataFrame:
    """epoch, rows_before, b_0 ... b_k: for each epoch but the first the least-squares fit on all earlier ones.

    One grouping gives the cross products of each epoch; those few numbers an epoch reach the driver, which solves.
    Epochs whose past doesn't determine a fit have no row.
    """
    k = len(xs) + 1
    sums = sorted(cross_sums(rows, [epoch], y, xs).collect(), key=lambda r: r[epoch])
    xx, xy, n, out = np.zeros((k, k)), np.zeros(k), 0, []
    for s in sums:
        if n > k and np.linalg.matrix_rank(xx) == k:
            out.append((s[epoch], n, *map(float, np.linalg.solve(xx, xy))))
        xx += [[s[f"xx_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]
        xy += [s[f"xy_{i}"] for i in range(k)]
        n += s["n"]
    kind = rows.schema[epoch].dataType.simpleString()
    return rows.sparkSession.createDataFrame(out, f"{epoch} {kind}, rows_before long, " + ", ".join(f"b_{i} double" for i in range(k)))


def summary_of_rates(rows: DataFrame, slice_: str, hit: Column, decided: Column, null: float, least: int, primary: dict[str, int]) -> DataFrame:
    """Rate of hits among decided rows by slice, with Wilson bounds and a verdict, and one row on multiplicity.

    A slice in `primary` is a claim made beforehand, with the direction that supports it; others only explore. With
    fewer than `least` decided rows a slice has no other verdict than that.
    """
    from periodica.functions.scalars import wilson

    a = rows.groupBy(slice_).agg(F.count_if(decided).alias("n"), F.count_if(hit).alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    a = a.select(F.col(slice_).alias("slice"), "n", F.when(F.col("n") > 0, F.col("hits") / F.col("n")).alias("estimate"), low.alias("low"), high.alias("high"))
    above, below = F.col("low") > null, F.col("high") < null
    claimed = F.lit(None).cast("int")
    for name, direction in primary.items():
        claimed = F.when(F.col("slice") == name, direction).otherwise(claimed)
    for_it, against_it = (claimed > 0) & above | (claimed < 0) & below, (claimed > 0) & below | (claimed < 0) & above
    verdict = F.when(F.col("n") < least, "insufficient_n").when(claimed.isNull(), "exploratory").when(for_it, "supported").when(against_it, "against").otherwise("ci_spans_null")
    r6 = lambda c: F.round(c, 6).alias(c)
    tested = a.select("slice", F.lit("win_rate").alias("metric"), "n", r6("estimate"), r6("low"), r6("high"), F.lit(null).alias("null_value"), F.lit(least).alias("min_n"), verdict.alias("verdict"))
    none = F.lit(None).cast("double")
    many = a.where(F.col("n") >= least).agg(F.count("*").alias("n"), F.count_if(above | below).cast("double").alias("estimate"))
    family = many.select(F.lit("all").alias("slice"), F.lit("tests").alias("metric"), "n", "estimate", none.alias("low"), none.alias("high"), F.round(0.05 * F.col("n"), 6).alias("null_value"), F.lit(0).alias("min_n"), F.lit("descriptive").alias("verdict"))
    return tested.unionByName(family)


def fingerprint(rows: DataFrame, keys: list[str], numbers: list[str], texts: list[str]) -> DataFrame:
    """Order-free digest of rows per key: numbers at nine decimals, so noise of the last bits doesn't count; null has its own token.

    A number is rounded as the binary value that it is. `format_string` rounds its shortest decimal form instead, half up, and so may give another last digit.
    """
    nine = F.udf(lambda x: None if x is None else f"{x:.9f}", "string", useArrow=True)
    number = lambda c: F.coalesce(nine(F.col(c).cast("double")), F.lit("null")) if c in numbers else F.coalesce(F.col(c).cast("string"), F.lit("null"))
    text = F.concat_ws(";", *[F.when(F.col(c).isNull(), F.lit(f"{c}=null")).otherwise(F.concat(F.lit(f"{c}="), number(c))) for c in sorted([*numbers, *texts])])
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")
    return rows.select(*keys, h.alias("h")).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).cast("string").alias("hash_sum"), F.bit_xor("h").alias("hash_xor"))
