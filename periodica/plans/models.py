"""Queries: ratings to their fixed point, blends from the registry, recommendations, projections, grading summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from periodica.functions import scalars as S
from periodica.operators import rating as R
from periodica.operators import registry as G
from periodica.operators import stats as T
from periodica.operators.rollup import error_metrics
from periodica.operators.upsert import null_safe
from periodica.plans.base import LINES, lines, query, table
from periodica.plans.ratings import _ADJ, _ARMS, _EDGES, _EPOCHS, _RESULT, K, _adjacent, _edges, _epochs, _pairs, _round
from periodica.sources.shared import shared_dir

#: Rounds that the SQL makes; the solver stops by its tolerance, in cents a unit.
_MANY = 40
TOLERANCE = 1e-7
_FIXED = _ARMS.replace("arm AS (", "arm AS MATERIALIZED (")


def _solved_sql(rounds: int = _MANY) -> str:
    return _FIXED + "".join(_round(i) for i in range(1, rounds + 1))


@query("op_M1_converged_ratings", "WITH " + _solved_sql() + f" SELECT epoch, CAST(id AS INTEGER) AS id, side, round(value, 2) AS value FROM r{_MANY}")
def converged_ratings(spark: SparkSession, d: str) -> DataFrame:
    """M1: opponent-adjusted ratings iterated to the fixed point, all epochs together; each leaves the loop when it stands still."""
    r = R.solved(_pairs(spark, d), ["epoch"], K, TOLERANCE)
    return r.select("epoch", F.col("id").cast("int").alias("id"), "side", F.round("value", 2).alias("value"))


def _prior_round(i: int) -> str:
    return f""", m{i} AS (SELECT a.*, r.value AS cur, p.prior, p.discount, v.n_opp / (v.n_opp + {K}) AS wc FROM arm a JOIN q{i - 1} r ON r.epoch = a.epoch AND r.id = a.opp AND r.side = a.opp_side JOIN vol v ON v.epoch = a.epoch AND v.id = a.opp AND v.side = a.opp_side LEFT JOIN prior p ON p.epoch = a.epoch AND p.id = a.opp AND p.side = a.opp_side),
w{i} AS (SELECT epoch, id, side, sum(num + den * (league - (wc * cur + (CASE WHEN prior IS NULL THEN 0 ELSE (1 - wc) * discount END) * coalesce(prior, 0) + (1 - wc - CASE WHEN prior IS NULL THEN 0 ELSE (1 - wc) * discount END) * league))) / sum(den) AS raw, sum(den) AS d, any_value(league) AS league FROM m{i} GROUP BY epoch, id, side),
q{i} AS (SELECT epoch, id, side, raw + league - sum(raw * d) OVER (PARTITION BY epoch, side) / sum(d) OVER (PARTITION BY epoch, side) AS value FROM w{i})"""


@query(
    "op_M2_converged_with_priors",
    "WITH " + _solved_sql() + f""", prior AS MATERIALIZED (SELECT epoch + 1 AS epoch, id, side, value AS prior, CASE WHEN side = 'off' AND id % 4 = 0 THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END AS discount FROM r{_MANY}),
    vol AS MATERIALIZED (SELECT epoch, id, side, sum(den) AS n_opp FROM arm GROUP BY ALL), q0 AS (SELECT * FROM r0)""" + "".join(_prior_round(i) for i in range(1, _MANY + 1)) + f" SELECT epoch, CAST(id AS INTEGER) AS id, side, round(value, 2) AS value FROM q{_MANY}",
)
def converged_with_priors(spark: SparkSession, d: str) -> DataFrame:
    """M2: to the fixed point, counterparties seen through a blend with last epoch's rating; some offences are discounted more."""
    pairs = _pairs(spark, d)
    weak = (F.col("side") == "off") & (F.col("id") % 4 == 0)
    priors = R.solved(pairs, ["epoch"], K, TOLERANCE).select((F.col("epoch") + 1).alias("epoch"), "id", "side", F.col("value").alias("prior"), F.when(weak, 0.6).otherwise(0.8).alias("discount"))
    r = R.solved(pairs, ["epoch"], K, TOLERANCE, priors=priors)
    return r.select("epoch", F.col("id").cast("int").alias("id"), "side", F.round("value", 2).alias("value"))


_BY_W = _FIXED.replace(f"{LINES}, p AS (SELECT epoch, entity, counterparty, sum(cents)::DOUBLE AS num, sum(qty)::DOUBLE AS den FROM lines GROUP BY ALL)", f"{LINES}, base AS (SELECT epoch AS e, period, entity, counterparty, sum(cents)::DOUBLE AS num, sum(qty)::DOUBLE AS den FROM lines WHERE epoch < (SELECT max(epoch) FROM lines) GROUP BY ALL), ws AS (SELECT DISTINCT e, period AS w FROM base), p AS MATERIALIZED (SELECT ws.e * 100 + ws.w AS epoch, entity, counterparty, sum(num) AS num, sum(den) AS den FROM ws JOIN base b ON b.e = ws.e AND b.period < ws.w GROUP BY ALL)")


@query("op_M23_rated_backfill", "WITH " + _BY_W + "".join(_round(i) for i in range(1, _MANY + 1)) + f" SELECT CAST(epoch // 100 AS INTEGER) AS epoch, CAST(epoch % 100 AS INTEGER) AS w, CAST(id AS INTEGER) AS id, side, round(value, 2) AS value FROM r{_MANY}")
def rated_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Ratings as of every period of every completed epoch, each from earlier periods only; the current epoch is refused."""
    x = lines(spark, d, "epoch", "period", "entity", "counterparty", "cents", "qty")
    x = x.join(x.agg(F.max("epoch").alias("current")), F.col("epoch") < F.col("current")).drop("current")
    g = x.groupBy("epoch", "period", "entity", "counterparty").agg(F.sum("cents").cast("double").alias("num"), F.sum("qty").cast("double").alias("den"))
    # A row counts for every later period of its epoch; periods are twelve at most.
    later = g.select("epoch", F.col("period").alias("w")).distinct().groupBy("epoch").agg(F.collect_set("w").alias("ws"))
    at = g.join(later, "epoch").withColumn("w", F.explode(F.filter("ws", lambda w: w > F.col("period"))))
    pairs = at.groupBy("epoch", "w", "entity", "counterparty").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    r = R.solved(pairs, ["epoch", "w"], K, TOLERANCE)
    return r.select("epoch", "w", F.col("id").cast("int").alias("id"), "side", F.round("value", 2).alias("value"))


@query(
    "op_M3_combined_discounts",
    f"""WITH {_EPOCHS}, t AS (SELECT s_nationkey AS nation, g.supp, g.epoch, g.den, sum(den) OVER (PARTITION BY s_nationkey, epoch) AS team FROM g JOIN supplier ON supp = s_suppkey),
    top AS (SELECT nation, epoch, list(supp) AS five FROM (SELECT *, row_number() OVER (PARTITION BY nation, epoch ORDER BY den DESC, supp) AS i FROM t) WHERE i <= 5 GROUP BY ALL),
    lead AS (SELECT nation, epoch, supp FROM (SELECT *, row_number() OVER (PARTITION BY nation, epoch ORDER BY den DESC, supp) AS i FROM t) WHERE i = 1),
    j AS (SELECT l.nation, l.epoch, b.den AS own, tb.team AS before, len(list_intersect(a.five, p.five)) AS kept, p.five IS NULL AS unknown FROM lead l JOIN top a USING (nation, epoch) LEFT JOIN t b ON b.supp = l.supp AND b.epoch = l.epoch - 1 LEFT JOIN (SELECT DISTINCT nation, epoch, team FROM t) tb ON tb.nation = l.nation AND tb.epoch = l.epoch - 1 LEFT JOIN top p ON p.nation = l.nation AND p.epoch = l.epoch - 1),
    f AS (SELECT nation, epoch, CASE WHEN before IS NULL THEN 1 ELSE 1 - 0.4::DOUBLE * (1 - least(1.0::DOUBLE, least(1.0::DOUBLE, coalesce(own, 0) / before) / 0.5::DOUBLE)) END AS workload, CASE WHEN unknown THEN 1 ELSE 0.7::DOUBLE + 0.3::DOUBLE * kept / 5 END AS overlap FROM j)
    SELECT CAST(nation AS INTEGER) AS nation, epoch, round(workload, 6) AS workload, round(overlap, 6) AS overlap, round((1 - 1.0::DOUBLE * (1 - workload)) * (1 - 0.5::DOUBLE * (1 - overlap)), 6) AS pass_like, round((1 - 0.25::DOUBLE * (1 - workload)) * (1 - 1.0::DOUBLE * (1 - overlap)), 6) AS run_like FROM f""",
)
def combined_discounts(spark: SparkSession, d: str) -> DataFrame:
    """M3: the leader's share of last epoch's workload and the overlap of the top five, combined by each metric's sensitivities; unknown counts as 1."""
    t = _epochs(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("supp"), F.col("s_nationkey").alias("nation")), "supp")
    order = Window.partitionBy("nation", "epoch").orderBy(F.desc("den"), "supp")
    ranked = t.withColumn("i", F.row_number().over(order)).where("i <= 5")
    teams = t.groupBy("nation", "epoch").agg(F.sum("den").alias("before"))
    five = ranked.groupBy("nation", "epoch").agg(F.collect_list("supp").alias("five"), F.max(F.when(F.col("i") == 1, F.col("supp"))).alias("supp"))
    next_ = lambda df: df.withColumn("epoch", F.col("epoch") + 1)
    j = five.join(next_(t.select("supp", "epoch", F.col("den").alias("own"))), ["supp", "epoch"], "left").join(next_(teams), ["nation", "epoch"], "left").join(next_(five.select("nation", "epoch", F.col("five").alias("was"))), ["nation", "epoch"], "left")
    workload = R.continuity(F.when(F.col("before").isNotNull(), F.coalesce("own", F.lit(0.0))), F.col("before"))
    overlap = R.overlap_discount(F.col("five"), F.col("was"))
    r6 = lambda c, n: F.round(c, 6).alias(n)
    return j.select(F.col("nation").cast("int").alias("nation"), "epoch", r6(workload, "workload"), r6(overlap, "overlap"), r6(R.combined_discount(workload, overlap, 1.0, 0.5), "pass_like"), r6(R.combined_discount(workload, overlap, 0.25, 1.0), "run_like"))


_REGISTRY = f"""{LINES}, s AS (SELECT supp, epoch, {", ".join(f"sum(CASE WHEN {'segment % 3 <> 0' if m.charted else 'true'} THEN ({m.num})::DOUBLE END) AS {m.name}_num, sum(CASE WHEN {'segment % 3 <> 0' if m.charted else 'true'} THEN ({m.den})::DOUBLE END) AS {m.name}_den" for m in G.METRICS)} FROM lines GROUP BY ALL),
t AS ({" UNION ALL ".join(f"SELECT supp, epoch, '{m.name}' AS metric, '{m.family}' AS family, {m.name}_num AS num, {m.name}_den AS den, {m.k}::DOUBLE AS k, {m.r}::DOUBLE AS r FROM s" for m in G.METRICS)})"""


def _registered(spark: SparkSession, d: str) -> DataFrame:
    x = lines(spark, d, "supp", "epoch", "segment", "kind", "status", "qty", "cents", "disc")
    return G.tall(G.sums_of(x, ["supp", "epoch"], G.METRICS, F.col("segment") % 3 != 0), ["supp", "epoch"], G.METRICS)


@query(
    "op_M5_registry_blend",
    f"""WITH {_REGISTRY}, l AS (SELECT metric, epoch, sum(num) / sum(den) AS league FROM t GROUP BY ALL),
    j AS (SELECT t.supp, t.epoch, t.metric, t.family, t.num / t.den AS cur, t.den AS n, t.k, t.r, l.league, CASE WHEN p.den > 0 THEN (p.num + t.k * pl.league) / (p.den + t.k) END AS prior, coalesce(p.den / (p.den + t.k), 0) AS held FROM t JOIN l USING (metric, epoch) LEFT JOIN t p ON p.supp = t.supp AND p.metric = t.metric AND p.epoch = t.epoch - 1 LEFT JOIN l pl ON pl.metric = t.metric AND pl.epoch = t.epoch - 1 WHERE t.den > 0),
    w AS (SELECT *, n / (n + k) AS wc, CASE WHEN prior IS NULL THEN 0 ELSE (1 - n / (n + k)) * r END AS wp FROM j)
    SELECT supp, epoch, metric, round(wc * cur + wp * coalesce(prior, 0) + (1 - wc - wp) * league, 5) AS value, round(avg(wc + wp * held) OVER (PARTITION BY supp, epoch, family), 6) AS family_stability FROM w""",
)
def registry_blend(spark: SparkSession, d: str) -> DataFrame:
    """M5, 2.10: every registered metric blended with its shrunk prior; stability of a family is the mean weight of what was observed. Null samples have no row.

    The lines are read once: sums are checkpointed, and last epoch's row comes by a window over an entity's epochs.
    """
    shared_dir(spark)
    t = _registered(spark, d).checkpoint()
    league = t.groupBy("metric", "epoch").agg((F.sum("num") / F.sum("den")).alias("league"))
    last = F.lag(F.struct("epoch", "num", "den", "league")).over(Window.partitionBy("supp", "metric").orderBy("epoch"))
    j = t.where("den > 0").join(F.broadcast(league), ["metric", "epoch"]).withColumn("p", last).withColumn("p", F.when(F.col("p.epoch") == F.col("epoch") - 1, F.col("p")))
    j = j.withColumn("prior", (F.col("p.num") + F.col("k") * F.col("p.league")) / (F.col("p.den") + F.col("k"))).withColumn("held", F.col("p.den") / (F.col("p.den") + F.col("k")))
    wc = F.col("den") / (F.col("den") + F.col("k"))
    wp = F.when(F.col("prior").isNotNull(), (1 - wc) * F.col("r")).otherwise(0.0)
    value = wc * F.col("num") / F.col("den") + wp * F.coalesce("prior", F.lit(0.0)) + (1 - wc - wp) * F.col("league")
    family = F.avg(wc + wp * F.coalesce("held", F.lit(0.0))).over(Window.partitionBy("supp", "epoch", "family"))
    return j.select("supp", "epoch", "metric", F.round(value, 5).alias("value"), F.round(family, 6).alias("family_stability"))


#: k and r by metric and cohort as far as they are known; the rest is resolved from parents and the fallback cohort.
_KNOWN = {
    ("price", "c0"): (150.0, 0.8), ("price", "c1"): (400.0, 0.5), ("price", "c2"): (90.0, 0.0), ("price_r", "c0"): (60.0, 0.3), ("big_share", "c0"): (25.0, 0.6), ("big_share", "c3"): (45.0, 0.2),
    ("big_share_a", "c3"): (70.0, 0.1), ("returned_share", "c1"): (80.0, 0.45), ("deep_share", "c2"): (15.0, 0.25), ("open_share", "c0"): (35.0, 0.0), ("full_returned_share", "c2"): (20.0, 0.15),
}
_BY_COHORT = G.resolved_shrinkage(G.WITH_PARTS, _KNOWN, "c0")
_COHORT = "CASE WHEN s_nationkey % 6 < 5 THEN 'c' || s_nationkey % 6 END"


@query(
    "op_M5_metric_cohort_blend",
    f"""WITH {LINES}, s AS MATERIALIZED (SELECT supp, epoch, {", ".join(f"sum(CASE WHEN {'segment % 3 <> 0' if m.charted else 'true'} THEN ({m.num})::DOUBLE END) AS {m.name}_num, sum(CASE WHEN {'segment % 3 <> 0' if m.charted else 'true'} THEN ({m.den})::DOUBLE END) AS {m.name}_den" for m in G.WITH_PARTS)} FROM lines GROUP BY ALL),
    u AS ({" UNION ALL ".join(f"SELECT supp, epoch, '{m.name}' AS metric, '{m.family}' AS family, {m.name}_num AS num, {m.name}_den AS den FROM s" for m in G.WITH_PARTS)}),
    kr(metric, cohort, k, r) AS (VALUES {", ".join(f"('{m}', '{c}', {k}::DOUBLE, {r}::DOUBLE)" for (m, c), (k, r) in _BY_COHORT.items())}),
    t AS MATERIALIZED (SELECT u.*, {_COHORT} AS cohort, coalesce(a.k, z.k) AS k, coalesce(a.r, z.r) AS r FROM u JOIN supplier ON supp = s_suppkey LEFT JOIN kr a ON a.metric = u.metric AND a.cohort = {_COHORT} JOIN kr z ON z.metric = u.metric AND z.cohort = 'c0' WHERE den > 0),
    l AS (SELECT metric, cohort, epoch, sum(num) / sum(den) AS league FROM t GROUP BY ALL), b AS (SELECT t.*, l.league FROM t JOIN l ON l.metric = t.metric AND l.epoch = t.epoch AND l.cohort IS NOT DISTINCT FROM t.cohort),
    j AS (SELECT b.*, (p.num + b.k * p.league) / (p.den + b.k) AS prior, coalesce(p.den / (p.den + b.k), 0) AS held FROM b LEFT JOIN b p ON p.supp = b.supp AND p.metric = b.metric AND p.epoch = b.epoch - 1),
    w AS (SELECT *, den / (den + k) AS wc, CASE WHEN prior IS NULL THEN 0 ELSE (1 - den / (den + k)) * r END AS wp FROM j)
    SELECT supp, epoch, metric, cohort, k, r, round(wc * num / den + wp * coalesce(prior, 0) + (1 - wc - wp) * league, 5) AS value, round(avg(wc + wp * held) OVER (PARTITION BY supp, epoch, family), 6) AS family_stability FROM w""",
)
def metric_cohort_blend(spark: SparkSession, d: str) -> DataFrame:
    """M5, 2.10: every metric and part blended with k and r of its metric and cohort, parents and a fallback cohort filling what isn't known; the mean is the cohort's.

    The lines are read once: sums are checkpointed, and last epoch's row comes by a window over an entity's epochs.
    """
    shared_dir(spark)
    x = lines(spark, d, "supp", "epoch", "segment", "kind", "status", "qty", "cents", "disc")
    t = G.tall(G.sums_of(x, ["supp", "epoch"], G.WITH_PARTS, F.col("segment") % 3 != 0), ["supp", "epoch"], G.WITH_PARTS).where("den > 0")
    nation = F.col("s_nationkey") % 6
    of = table(spark, d, "supplier").select(F.col("s_suppkey").alias("supp"), F.when(nation < 5, F.concat(F.lit("c"), nation.cast("string"))).alias("cohort"))
    t = G.shrunk_by_cohort(t.join(of, "supp"), _BY_COHORT, "cohort", "c0").checkpoint()
    league = t.groupBy("metric", "cohort", "epoch").agg((F.sum("num") / F.sum("den")).alias("league"))
    last = F.lag(F.struct("epoch", "num", "den", "league")).over(Window.partitionBy("supp", "metric").orderBy("epoch"))
    j = null_safe(t, league, ["metric", "cohort", "epoch"], "inner").withColumn("p", last).withColumn("p", F.when(F.col("p.epoch") == F.col("epoch") - 1, F.col("p")))
    prior = (F.col("p.num") + F.col("k") * F.col("p.league")) / (F.col("p.den") + F.col("k"))
    wc = F.col("den") / (F.col("den") + F.col("k"))
    wp = F.when(F.col("p").isNotNull(), (1 - wc) * F.col("r")).otherwise(0.0)
    value = wc * F.col("num") / F.col("den") + wp * F.coalesce(prior, F.lit(0.0)) + (1 - wc - wp) * F.col("league")
    held = F.coalesce(F.col("p.den") / (F.col("p.den") + F.col("k")), F.lit(0.0))
    family = F.avg(wc + wp * held).over(Window.partitionBy("supp", "epoch", "family"))
    return j.select("supp", "epoch", "metric", "cohort", "k", "r", F.round(value, 5).alias("value"), F.round(family, 6).alias("family_stability"))


_ROLES = {"supplier": "supp", "customer": "cust", "part": "part"}


@query(
    "op_A4_A5_assembled_roles",
    f"""WITH {LINES}, x AS ({" UNION ALL ".join(f"SELECT '{role}' AS role, {c}::BIGINT AS id, segment % 3 <> 0 AS charted, * FROM lines" for role, c in _ROLES.items())})
    SELECT id, epoch, {G.assembled_sql(_ROLES)} FROM x GROUP BY id, epoch""",
)
def assembled_roles(spark: SparkSession, d: str) -> DataFrame:
    """A4, A5, 2.10: each of three roles sums what its list says, per id, charted columns over their own denominators, in one grouping."""
    return G.assembled(lines(spark, d, "segment", "step", "epoch", "kind", "status", "qty", "cents", "disc", "supp", "cust", "part"), _ROLES, ["epoch"], F.col("segment") % 3 != 0)


@query(
    "op_M7_pinned_reliability",
    _ADJ + """, r AS (SELECT kind, supp % 2 AS side, count(*) AS pairs, CASE WHEN count(*) >= 5 THEN least(greatest(corr(this, next), 0.0::DOUBLE), 1.0::DOUBLE) END AS raw FROM p GROUP BY ALL)
    SELECT kind, CAST(side AS INTEGER) AS side, pairs, round(CASE WHEN kind = 'R' THEN 0 ELSE 0.5 * raw + 0.5 * avg(raw) OVER (PARTITION BY side) END, 6) AS reliability FROM r""",
)
def pinned_reliability(spark: SparkSession, d: str) -> DataFrame:
    """M7: correlation of adjacent epochs by metric and side, half drawn to the side's mean; named metrics are pinned to 0."""
    r = T.side_reliability(_adjacent(spark, d).withColumn("side", (F.col("supp") % 2).cast("int")), "kind", "side", "this", "next", pinned=("R",))
    return r.select("kind", "side", "pairs", F.round("reliability", 6).alias("reliability"))


@query(
    "op_M9_donor_recommendation",
    """WITH e AS (SELECT p_brand AS metric, CAST(p_size % 3 AS INTEGER) AS cohort, CASE WHEN count(*) % 4 <> 0 THEN round(avg(p_retailprice) / 100, 4) END AS k0, (count(*) % 3 + 1)::DOUBLE AS low, (count(*) % 7 + 2)::DOUBLE AS high, (count(*) % 5 - 1)::DOUBLE AS r_low, 1 + (count(*) % 3)::DOUBLE / 2 AS r_high, (count(*) % 13)::DOUBLE / 10 AS slope FROM part GROUP BY ALL),
    d AS (SELECT metric, arg_min(k0, cohort) FILTER (WHERE k0 IS NOT NULL) AS donor_k FROM e GROUP BY metric), p AS (SELECT p_brand AS metric, CASE WHEN count(*) % 3 = 0 THEN round(max(p_retailprice), 2) END AS parent_k FROM part GROUP BY 1),
    x AS (SELECT *, coalesce(k0 IS NOT NULL AND high / low <= 2 AND r_low > 0, false) AS pinned FROM e JOIN d USING (metric) LEFT JOIN p USING (metric)),
    y AS (SELECT *, CASE WHEN pinned THEN 'pinned' WHEN parent_k IS NOT NULL THEN 'parent' WHEN k0 IS NOT NULL THEN 'point' WHEN donor_k IS NOT NULL THEN 'donor' ELSE 'headline' END AS rule FROM x)
    SELECT metric, cohort, rule, CASE rule WHEN 'pinned' THEN k0 WHEN 'parent' THEN parent_k WHEN 'point' THEN k0 WHEN 'donor' THEN donor_k ELSE 500 END AS k, CASE WHEN rule IN ('donor', 'headline') OR r_low <= 0 OR (NOT pinned AND r_high > 1.5) THEN 0 ELSE least(1, greatest(0, slope)) END AS r FROM y""",
)
def donor_recommendation(spark: SparkSession, d: str) -> DataFrame:
    """M9: own k where its interval is tight, else the parent's, the point estimate, the first cohort that has one, or the headline's; r is 0 without a stable signal."""
    p = table(spark, d, "part")
    n = F.count("*")
    e = p.groupBy(F.col("p_brand").alias("metric"), (F.col("p_size") % 3).alias("cohort")).agg(
        F.when(n % 4 != 0, F.round(F.avg("p_retailprice") / 100, 4)).alias("k0"), (n % 3 + 1).cast("double").alias("low"), (n % 7 + 2).cast("double").alias("high"),
        (n % 5 - 1).cast("double").alias("r_low"), (1 + (n % 3) / 2).alias("r_high"), ((n % 13) / 10).alias("slope"),
    )
    parent = p.groupBy(F.col("p_brand").alias("metric")).agg(F.when(n % 3 == 0, F.round(F.max("p_retailprice"), 2)).alias("parent_k"))
    return T.recommended_shrinkage(e, parent, headline=500.0)


@query(
    "op_M10_ratio_to_parent",
    "WITH " + _ARMS + "".join(_round(i, 0.0) for i in range(1, 6)) + """, x AS (SELECT a.side, a.id, (a.num + a.den * (a.league - r.value)) / a.den AS x, a.den AS d FROM arm a JOIN r5 r ON r.epoch = a.epoch AND r.id = a.opp AND r.side = a.opp_side),
    y AS (SELECT side AS part, * FROM x UNION ALL SELECT 'both', * FROM x), e AS (SELECT part, side, id, sum(d) AS dd, count(*) AS g, sum(x * d) / sum(d) AS mean, sum(d * x * x) AS sq FROM y GROUP BY ALL HAVING count(*) >= 2),
    b AS (SELECT part, sum(sq - dd * mean * mean) / sum(g - 1) AS within FROM e GROUP BY part)
    SELECT a.part AS side, round(a.within / b.within, 6) AS within_to_parent FROM b a JOIN b b ON b.part = 'both' WHERE a.part <> 'both'""",
)
def ratio_to_parent(spark: SparkSession, d: str) -> DataFrame:
    """The variance of counterparty-adjusted rows of each side, as a ratio to that of both."""
    arm, group = R.arms(_pairs(spark, d), ["epoch"]), ["epoch"]
    ratings = R.start(arm, group)
    for _ in range(5):
        ratings = R.iterate(arm, ratings, group, 0.0)
    seen = ratings.select("epoch", F.col("id").alias("opp"), F.col("side").alias("opp_side"), "value")
    x = arm.join(seen, ["epoch", "opp", "opp_side"]).select("side", F.concat_ws("|", "side", F.col("id").cast("string")).alias("id"), ((F.col("num") + F.col("den") * (F.col("league") - F.col("value"))) / F.col("den")).alias("x"), F.col("den").alias("d"))
    v = T.variance_components(x.withColumn("part", F.explode(F.array("side", F.lit("both")))), ["part"], "id", "x", "d")
    whole = v.where("part = 'both'").agg(F.first("within")).scalar()
    return v.where("part <> 'both'").select(F.col("part").alias("side"), F.round(F.col("within") / whole, 6).alias("within_to_parent"))


#: Prices of all lines and of two kinds, which are its parts; SQL groups by epoch and metric in one number.
_PARTS = {"all": "true", "accepted": "kind = 'A'", "returned": "kind = 'R'"}
_PRICED = f"""{LINES}, p AS (SELECT epoch * 10 + m AS epoch, entity, counterparty, sum(cents)::DOUBLE AS num, sum(qty)::DOUBLE AS den FROM (SELECT *, unnest([{", ".join(f"CASE WHEN {c} THEN {i} END" for i, c in enumerate(_PARTS.values()))}]) AS m FROM lines) WHERE m IS NOT NULL GROUP BY ALL),""" + _FIXED.split("GROUP BY ALL),", 1)[1]


@query(
    "op_M10_k0_by_side",
    "WITH " + _PRICED + "".join(_round(i, 0.0) for i in range(1, _MANY + 1)) + f""", x AS (SELECT a.epoch % 10 AS m, a.side, a.epoch // 10 || '|' || a.id AS id, (a.num + a.den * (a.league - r.value)) / a.den AS x, a.den AS d FROM arm a JOIN r{_MANY} r ON r.epoch = a.epoch AND r.id = a.opp AND r.side = a.opp_side),
    e AS (SELECT m, side, id, sum(d) AS dd, count(*) AS g, sum(x * d) / sum(d) AS mean, sum(d * x * x) AS sq FROM x GROUP BY ALL HAVING count(*) >= 2),
    v AS (SELECT m, side, count(*) AS entities, sum(sq - dd * mean * mean) / sum(g - 1) AS within, sum(dd) AS n, sum(dd * dd) AS nn, sum(dd * mean) AS s, sum(dd * mean * mean) AS q FROM e GROUP BY ALL),
    b AS (SELECT *, (q - s * s / n - (entities - 1) * within) / (n - nn / n) AS tau FROM v), k AS (SELECT *, CASE WHEN tau > 0 THEN within / tau END AS k0 FROM b)
    SELECT ['{"', '".join(_PARTS)}'][CAST(a.m AS INTEGER) + 1] AS metric, a.side, a.entities, round(a.within / 1e6, 1) AS within, round(a.k0, 1) AS k0, CASE WHEN a.m > 0 THEN round(a.k0 / p.k0, 3) END AS to_parent FROM k a JOIN k p ON p.m = 0 AND p.side = a.side""",
)
def k0_by_side(spark: SparkSession, d: str) -> DataFrame:
    """k0 (variance within over between entity-epochs) of rows adjusted by the converged unshrunk ratings, by metric and side, and the ratio of a part's to its parent's; null where there is no excess between."""
    shared_dir(spark)
    of = F.explode(F.array_compact(F.array(*[F.when(F.expr(c), name) for name, c in _PARTS.items()])))
    x = lines(spark, d, "epoch", "entity", "counterparty", "kind", "qty", "cents").withColumn("metric", of)
    group = ["metric", "epoch"]
    pairs = x.groupBy(*group, "entity", "counterparty").agg(F.sum("cents").cast("double").alias("num"), F.sum("qty").cast("double").alias("den")).checkpoint()
    seen = R.solved(pairs, group, 0.0, TOLERANCE).select(*group, F.col("id").alias("opp"), F.col("side").alias("opp_side"), "value")
    rows = R.arms(pairs, group).join(seen, [*group, "opp", "opp_side"])
    rows = rows.select("metric", "side", F.concat_ws("|", "epoch", "id").alias("id"), ((F.col("num") + F.col("den") * (F.col("league") - F.col("value"))) / F.col("den")).alias("x"), F.col("den").alias("d"))
    k = T.variance_components(rows, ["metric", "side"], "id", "x", "d").checkpoint()
    parent = k.where("metric = 'all'").select("side", F.col("k0").alias("parent_k0"))
    ratio = F.when(F.col("metric") != "all", F.round(F.col("k0") / F.col("parent_k0"), 3))
    return k.join(parent, "side").select("metric", "side", "entities", F.round(F.col("within") / 1e6, 1).alias("within"), F.round("k0", 1).alias("k0"), ratio.alias("to_parent"))


_SIDES = f"""{_EPOCHS}, c AS (SELECT supp, epoch, num / den / 1e5 - avg(num / den / 1e5) OVER (PARTITION BY epoch) AS off, CASE WHEN supp % 6 <> 0 THEN den / 100 - avg(den / 100) OVER (PARTITION BY epoch) END AS def FROM g),
m AS (SELECT a.epoch, a.supp AS home, b.supp AS away, 22.5::DOUBLE + 1.5 + 3 * a.off - 2 * b.def AS hp, 22.5::DOUBLE + 3 * b.off - 2 * a.def AS ap FROM c a JOIN c b ON a.epoch = b.epoch AND b.supp = a.supp + 1)"""


@query("op_M13_projected_scores", f"WITH {_SIDES} SELECT epoch, home, away, round(hp, 5) AS home_points, round(ap, 5) AS away_points, round(hp - ap, 5) AS margin, round(ap - hp, 5) AS spread, round(hp + ap, 5) AS total FROM m")
def projected_scores(spark: SparkSession, d: str) -> DataFrame:
    """Both sides' points from centred ratings; margin, spread (its negative) and total, null unless all inputs are known.

    The means are one row an epoch, and are broadcast.
    """
    g = _epochs(spark, d).select("supp", "epoch", (F.col("num") / F.col("den") / 1e5).alias("off"), (F.col("den") / 100).alias("size"))
    means = g.groupBy("epoch").agg(F.avg("off").alias("mo"), F.avg("size").alias("ms"))
    c = g.join(F.broadcast(means), "epoch").select("epoch", "supp", (F.col("off") - F.col("mo")).alias("off"), F.when(F.col("supp") % 6 != 0, F.col("size") - F.col("ms")).alias("def"))
    home, away = c.toDF("epoch", "home", "ho", "hd"), c.withColumn("home", F.col("supp") - 1).toDF("epoch", "away", "ao", "ad", "home")
    hp, ap = S.projected_points(F.col("ho"), F.col("ad"), True), S.projected_points(F.col("ao"), F.col("hd"), False)
    m = home.join(away, ["epoch", "home"]).select("epoch", "home", "away", hp.alias("hp"), ap.alias("ap"))
    r5 = lambda x, n: F.round(x, 5).alias(n)
    hp, ap = F.col("hp"), F.col("ap")
    return m.select("epoch", "home", "away", r5(hp, "home_points"), r5(ap, "away_points"), r5(hp - ap, "margin"), r5(ap - hp, "spread"), r5(hp + ap, "total"))


_XYZ = f"""{LINES}, t AS (SELECT epoch, epoch * 100 + period AS month, entity, sum(cents)::DOUBLE / 1e6 AS y, sum(qty)::DOUBLE / 100 AS x, sum(disc)::DOUBLE / 10 AS z FROM lines GROUP BY ALL)"""


def _xyz(spark: SparkSession, d: str) -> DataFrame:
    g = lines(spark, d, "epoch", "period", "entity", "cents", "qty", "disc").groupBy("epoch", (F.col("epoch") * 100 + F.col("period")).alias("month"), "entity")
    return g.agg((F.sum("cents") / 1e6).alias("y"), (F.sum("qty") / 100.0).alias("x"), (F.sum("disc") / 10.0).alias("z"))


@query(
    "op_M14_walk_forward_terms",
    f"""WITH {_XYZ}, f AS (SELECT e.epoch, count(*) AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, covar_pop(x, x) AS xx, covar_pop(z, z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM (SELECT DISTINCT epoch FROM t) e JOIN t ON t.epoch < e.epoch GROUP BY e.epoch),
    b AS (SELECT epoch, n, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz, mx, mz, my FROM f),
    p AS (SELECT t.epoch, my + bx * (x - mx) + bz * (z - mz) - y AS e FROM t JOIN b USING (epoch))
    SELECT epoch, count(*) AS n, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(e), 4) AS bias FROM p GROUP BY epoch""",
)
def walk_forward_terms(spark: SparkSession, d: str) -> DataFrame:
    """Several regressors; each epoch predicted by a fit on all earlier ones, the first refused. Only sums of cross products leave Spark."""
    t = _xyz(spark, d)
    fits = T.walk_forward_terms(t, "epoch", "y", ["x", "z"])
    return error_metrics(t.join(fits, "epoch"), ["epoch"], F.col("b_0") + F.col("b_1") * F.col("x") + F.col("b_2") * F.col("z"), F.col("y"))


@query(
    "op_M15_edge_flags",
    f"""WITH {_EDGES}, e AS (SELECT *, epoch % 5 + 1 AS status, CASE WHEN (entity + counterparty) % 4 <> 0 THEN abs(margin % 5) END AS book_range FROM q)
    SELECT epoch, CAST(entity AS INTEGER) AS entity, CAST(counterparty AS INTEGER) AS counterparty, CAST(CASE WHEN status <= 3 THEN edge - line END AS BIGINT) AS edge, status = 3 AS lookahead_only, status <= 3 AND book_range IS NULL AS single_quoter,
     coalesce(status <= 3 AND abs(edge - line) <= book_range / 2.0, false) AS within_range, (least(line, close_line) < -3 AND greatest(line, close_line) > -3) OR (least(line, close_line) < 3 AND greatest(line, close_line) > 3) AS key_straddle FROM e""",
)
def edge_flags(spark: SparkSession, d: str) -> DataFrame:
    """The edge against the market only in allowed statuses, and what qualifies it."""
    e = _edges(spark, d).withColumn("status", F.col("epoch") % 5 + 1).withColumn("book_range", F.when((F.col("entity") + F.col("counterparty")) % 4 != 0, F.abs(F.col("margin") % 5)))
    edge, flags = S.gated_edge(F.col("edge"), F.col("line"), F.col("status"), F.col("book_range"))
    straddle = S.key_crossings(F.col("line").cast("double"), F.col("close_line").cast("double"), [-3, 3]) > 0
    return e.select("epoch", F.col("entity").cast("int").alias("entity"), F.col("counterparty").cast("int").alias("counterparty"), edge.cast("long").alias("edge"), *[f.alias(n) for n, f in flags.items()], straddle.alias("key_straddle"))


@query(
    "op_M17_graded_outcomes",
    f"""WITH {_EDGES} SELECT epoch, CAST(entity AS INTEGER) AS entity, CAST(counterparty AS INTEGER) AS counterparty, CAST(edge - margin AS BIGINT) AS margin_error, abs(edge - margin) <= 8 AS in_band, {_RESULT} AS vs_lock, {_RESULT.replace("margin + line", "margin + close_line")} AS vs_close,
     CAST(sign(edge) * (line - close_line) AS DOUBLE) AS clv, CAST(line - close_line AS BIGINT) AS basis, {_RESULT} = {_RESULT.replace("margin + line", "margin + close_line")} AS same_result FROM q""",
)
def graded_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Error, whether it is in the band, results against lock and close, closing-line value, basis and a parity flag."""
    e = _edges(spark, d)
    lock, close = (S.pick_result(F.col("edge"), F.col("margin"), F.col(c)) for c in ("line", "close_line"))
    error = F.col("edge") - F.col("margin")
    return e.select(
        "epoch", F.col("entity").cast("int").alias("entity"), F.col("counterparty").cast("int").alias("counterparty"), error.cast("long").alias("margin_error"), (F.abs(error) <= 8).alias("in_band"), lock.alias("vs_lock"), close.alias("vs_close"),
        S.closing_value(F.col("edge"), F.col("line"), F.col("close_line")).cast("double").alias("clv"), (F.col("line") - F.col("close_line")).cast("long").alias("basis"), (lock == close).alias("same_result"),
    )


@query(
    "op_A20_graded_summary",
    f"""WITH {_EDGES}, g AS (SELECT epoch, abs(edge) AS size, {_RESULT} AS result FROM q), s AS (SELECT unnest(['all', 'epoch=' || epoch, CASE WHEN size < 3 THEN 'edge=0-3' WHEN size < 7 THEN 'edge=3-7' ELSE 'edge=7+' END]) AS slice, result FROM g),
    a AS (SELECT slice, count(*) FILTER (WHERE result IN ('win', 'loss')) AS n, count(*) FILTER (WHERE result = 'win') AS wins FROM s GROUP BY slice),
    c AS (SELECT *, wins::DOUBLE / n AS p, 3.841458820694124::DOUBLE AS zz, 1.959963984540054::DOUBLE AS z FROM a),
    v AS (SELECT slice, n, p, (p + zz / (2 * n) - z * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n) AS low, (p + zz / (2 * n) + z * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n) AS high FROM c),
    r AS (SELECT slice, 'win_rate' AS metric, n, p AS estimate, low, high, 0.5::DOUBLE AS null_value, 30 AS min_n, CASE WHEN n < 30 THEN 'insufficient_n' WHEN slice <> 'all' THEN 'exploratory' WHEN low > 0.5 THEN 'supported' WHEN high < 0.5 THEN 'against' ELSE 'ci_spans_null' END AS verdict FROM v)
    SELECT slice, metric, n, round(estimate, 6) AS estimate, round(low, 6) AS low, round(high, 6) AS high, null_value, min_n, verdict FROM r
    UNION ALL SELECT 'all', 'tests', count(*), round(count(*) FILTER (WHERE low > 0.5 OR high < 0.5)::DOUBLE, 6), NULL, NULL, round(0.05::DOUBLE * count(*), 6), 0, 'descriptive' FROM r WHERE n >= 30""",
)
def graded_summary(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping slices with interval, null value, minimum and verdict; a last row says how many tests came out and how many by chance alone."""
    g = _edges(spark, d).select("epoch", F.abs("edge").alias("size"), S.pick_result(F.col("edge"), F.col("margin"), F.col("line")).alias("result"))
    bucket = F.when(F.col("size") < 3, "edge=0-3").when(F.col("size") < 7, "edge=3-7").otherwise("edge=7+")
    s = g.select("result", F.explode(F.array(F.lit("all"), F.concat(F.lit("epoch="), F.col("epoch").cast("string")), bucket)).alias("slice"))
    return T.summary_of_rates(s, "slice", F.col("result") == "win", F.col("result").isin("win", "loss"), null=0.5, least=30, primary={"all": 1})


@query(
    "op_M20_input_fingerprint",
    f"""WITH {_EPOCHS}, x AS (SELECT epoch, 'off=' || CASE WHEN supp % 6 <> 0 THEN printf('%.9f', num / den / 1000) ELSE 'null' END || ';size=' || printf('%.9f', den) || ';supp=' || supp AS row FROM g), h AS (SELECT epoch, ('0x' || substr(md5(row), 1, 12))::BIGINT AS h FROM x)
    SELECT epoch, count(*) AS n, CAST(sum(h) AS VARCHAR) AS hash_sum, bit_xor(h) AS hash_xor FROM h GROUP BY epoch""",
)
def input_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """An order-free digest of feature rows at nine decimals, with a token for null, by epoch."""
    g = _epochs(spark, d).select("epoch", F.col("supp"), F.when(F.col("supp") % 6 != 0, F.col("num") / F.col("den") / 1000).alias("off"), F.col("den").alias("size"))
    return T.fingerprint(g, ["epoch"], numbers=["off", "size"], texts=["supp"])
