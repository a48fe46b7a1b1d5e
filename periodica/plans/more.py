"""Queries: guards, status ladders, reports, counterfactuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from periodica.functions import scalars as S
from periodica.operators import checks as C
from periodica.operators import rating as R
from periodica.operators import stats as T
from periodica.operators import upsert as U
from periodica.operators.joins import first_known
from periodica.operators.rollup import error_metrics
from periodica.plans.base import LINES, USER_DAYS, lines, query, table, user_days
from periodica.plans.ratings import _ARMS, _EDGES, _EPOCHS, _XY, _edges, _epochs, _pairs, _round, _xy


@query("op_F1_F7_F24_projection", "SELECT CAST(o_orderkey AS VARCHAR) AS match_id, CAST(year(o_orderdate) AS INTEGER) AS epoch, CASE WHEN month(o_orderdate) <= 10 THEN 'REG' ELSE 'POST' END AS season_type, CAST(o_totalprice AS FLOAT)::DOUBLE AS price FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus IN ('F', 'O')")
def projection(spark: SparkSession, d: str) -> DataFrame:
    """key and enum filter, derived season type, renamed and cast columns."""
    o = table(spark, d, "orders").where(F.col("o_custkey").isNotNull() & F.col("o_orderstatus").isin("F", "O"))
    return o.select(F.col("o_orderkey").cast("string").alias("match_id"), F.year("o_orderdate").alias("epoch"), F.when(F.month("o_orderdate") <= 10, "REG").otherwise("POST").alias("season_type"), F.col("o_totalprice").cast("float").cast("double").alias("price"))


@query("op_F8_derived_predicates", f"WITH {LINES} SELECT epoch, entity, count(*) FILTER (WHERE kind = 'A' AND status <> 'O') AS targets, CAST(sum(CASE WHEN kind = 'A' THEN cents - qty * 100000 END) AS BIGINT) AS over_expected FROM lines GROUP BY ALL")
def derived_predicates(spark: SparkSession, d: str) -> DataFrame:
    """F8: flags derived from flags, and a difference to an expectation."""
    a = F.col("kind") == "A"
    return lines(spark, d, "epoch", "entity", "kind", "status", "cents", "qty").groupBy("epoch", "entity").agg(F.count_if(a & (F.col("status") != "O")).alias("targets"), F.sum(F.when(a, F.col("cents") - F.col("qty") * 100000)).alias("over_expected"))


@query("op_F10_integral_keys", "SELECT CAST(p_retailprice * 0 + p_partkey AS BIGINT) AS k, p_brand FROM part")
def integral_keys(spark: SparkSession, d: str) -> DataFrame:
    """a float key cast only because all its values are whole."""
    p = table(spark, d, "part").select((F.col("p_retailprice") * 0 + F.col("p_partkey")).alias("k"), "p_brand")
    return C.integral_key(p, "k")


@query("op_F14_F19_gated_clean", f"WITH {USER_DAYS}, g AS (SELECT user_id, period, CASE WHEN den - 1 > 0 THEN num END AS num, CASE WHEN den - 1 > 0 THEN den - 1 END AS den FROM user_days) SELECT user_id, period, num, den, round(num::DOUBLE / den, 6) AS rate FROM g")
def gated_clean(spark: SparkSession, d: str) -> DataFrame:
    """a pair is null unless its denominator is positive; rates rounded, no NaN."""
    num, den = C.gated(F.col("num"), F.col("den") - 1)
    return user_days(spark, d).select("user_id", "period", num.alias("num"), den.alias("den")).withColumn("rate", S.cleaned(S.ratio(F.col("num"), F.col("den"))))


_VENUES = "v AS (SELECT n_nationkey, [n_name, 'OLD ' || n_name] AS names, CASE n_nationkey % 4 WHEN 0 THEN 'fixed' WHEN 1 THEN 'retractable' ELSE 'open' END AS roof FROM nation WHERE n_nationkey < 20)"


@query(
    "op_F15_F16_venue_ladder",
    f"""WITH {_VENUES}, c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 9 = 0 THEN 'ELSEWHERE' ELSE n_name END AS said, c_custkey % 3 = 0 AS closed FROM customer JOIN nation ON c_nationkey = nation.n_nationkey)
    SELECT CASE WHEN roof IS NULL THEN 'unknown_venue' WHEN NOT list_contains(names, said) THEN 'name_conflict' WHEN roof = 'fixed' THEN 'fixed_roof' WHEN roof = 'retractable' AND closed THEN 'closed' ELSE 'ok' END AS reason, count(*) AS n FROM c LEFT JOIN v ON c.c_nationkey = v.n_nationkey GROUP BY 1""",
)
def venue_ladder(spark: SparkSession, d: str) -> DataFrame:
    """F15, F16, DQ6: the first reason of a fixed ladder that applies."""
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    roof = F.when(k % 4 == 0, "fixed").when(k % 4 == 1, "retractable").otherwise("open")
    venues = n.where(k < 20).select(k.alias("c_nationkey"), F.array(F.col("n_name"), F.concat(F.lit("OLD "), "n_name")).alias("names"), roof.alias("roof"))
    names = n.select(k.alias("c_nationkey"), "n_name")
    c = table(spark, d, "customer").join(names, "c_nationkey").join(venues, "c_nationkey", "left")
    said = F.when(F.col("c_custkey") % 9 == 0, "ELSEWHERE").otherwise(F.col("n_name"))
    reason = C.ladder((F.col("roof").isNull(), "unknown_venue"), (~F.array_contains("names", said), "name_conflict"), (F.col("roof") == "fixed", "fixed_roof"), ((F.col("roof") == "retractable") & (F.col("c_custkey") % 3 == 0), "closed"), otherwise="ok")
    return c.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(
    "op_F21_F23_shown_rows",
    f"""WITH {USER_DAYS}, r AS (SELECT user_id, cohort, period, den, CASE WHEN den >= 2 THEN 1 END AS e, num FROM user_days WHERE period <= 10), p AS (SELECT *, CASE WHEN e = 1 THEN CAST(floor((100 * (2 * (rank() OVER (PARTITION BY cohort, period, e ORDER BY num) - 1) + count(*) OVER (PARTITION BY cohort, period, e, num)) + count(*) OVER (PARTITION BY cohort, period, e)) / (2 * count(*) OVER (PARTITION BY cohort, period, e))::DOUBLE) AS BIGINT) END AS pct FROM r)
    SELECT cohort, CASE WHEN e IS NULL THEN 'below_minimum' WHEN cohort = 4 THEN 'no_cohort' ELSE 'ranked' END AS part, CASE WHEN pct IS NULL THEN NULL WHEN (CASE WHEN cohort < 2 THEN pct ELSE 100 - pct END) >= 67 THEN 'better' WHEN (CASE WHEN cohort < 2 THEN pct ELSE 100 - pct END) < 33 THEN 'worse' ELSE 'middle' END AS third, count(*) AS n FROM p GROUP BY ALL""",
)
def shown_rows(spark: SparkSession, d: str) -> DataFrame:
    """F21, F23 over the first ten days: percentiles turned to thirds by direction, rows split by whether they are ranked."""
    return _shown(user_days(spark, d).where("period <= 10"))


def _shown(days: DataFrame) -> DataFrame:
    from periodica.operators.windows import midrank

    p = midrank(days.withColumn("shown", F.when(F.col("den") >= 2, F.col("num"))), ["cohort", "period"], "shown")
    part = C.ladder((F.col("shown").isNull(), "below_minimum"), (F.col("cohort") == 4, "no_cohort"), otherwise="ranked")
    return p.groupBy("cohort", part.alias("part"), C.oriented_third(F.col("pct"), F.col("cohort") < 2).alias("third")).agg(F.count("*").alias("n"))


@query(
    "op_F21_F23_shown_rows_all_days",
    f"""WITH {USER_DAYS}, r AS (SELECT user_id, cohort, period, den, CASE WHEN den >= 2 THEN 1 END AS e, num FROM user_days), p AS (SELECT *, CASE WHEN e = 1 THEN CAST(floor((100 * (2 * (rank() OVER (PARTITION BY cohort, period, e ORDER BY num) - 1) + count(*) OVER (PARTITION BY cohort, period, e, num)) + count(*) OVER (PARTITION BY cohort, period, e)) / (2 * count(*) OVER (PARTITION BY cohort, period, e))::DOUBLE) AS BIGINT) END AS pct FROM r)
    SELECT cohort, CASE WHEN e IS NULL THEN 'below_minimum' WHEN cohort = 4 THEN 'no_cohort' ELSE 'ranked' END AS part, CASE WHEN pct IS NULL THEN NULL WHEN (CASE WHEN cohort < 2 THEN pct ELSE 100 - pct END) >= 67 THEN 'better' WHEN (CASE WHEN cohort < 2 THEN pct ELSE 100 - pct END) < 33 THEN 'worse' ELSE 'middle' END AS third, count(*) AS n FROM p GROUP BY ALL""",
)
def shown_rows_all_days(spark: SparkSession, d: str) -> DataFrame:
    """as op_F21_F23_shown_rows, over every day of the month."""
    return _shown(user_days(spark, d))


@query("op_A11_group_centring", f"WITH {USER_DAYS} SELECT user_id, period, round(den - avg(den) OVER (PARTITION BY cohort, period), 6) AS centred FROM user_days")
def group_centring(spark: SparkSession, d: str) -> DataFrame:
    """Values less their group's mean."""
    u = user_days(spark, d)
    return C.centred(u, ["cohort", "period"], "den").select("user_id", "period", F.round("centred", 6).alias("centred"))


@query("op_A17_distinct_counts", f"WITH {LINES} SELECT epoch, count(DISTINCT segment) AS segments, count(DISTINCT cust) AS customers, count(DISTINCT CASE WHEN disc > 9 THEN segment END) AS marked FROM lines GROUP BY epoch")
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    """Exact distinct counts, also under a condition."""
    return lines(spark, d, "epoch", "segment", "cust", "disc").groupBy("epoch").agg(F.count_distinct("segment").alias("segments"), F.count_distinct("cust").alias("customers"), F.count_distinct(F.when(F.col("disc") > 9, F.col("segment"))).alias("marked"))


@query(
    "op_A27_mean_with_fallback",
    f"""WITH {LINES}, g AS (SELECT supp, epoch, sum(qty) AS s, count(*) AS n FROM lines WHERE period < 3 GROUP BY ALL), f AS (SELECT supp, epoch + 1 AS epoch, avg(qty) AS m FROM lines GROUP BY ALL)
    SELECT f.supp, f.epoch, round(coalesce(s::DOUBLE / n, m), 6) AS mean FROM f LEFT JOIN g USING (supp, epoch)""",
)
def mean_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The mean so far in this epoch, else the last epoch's."""
    x = lines(spark, d, "supp", "epoch", "period", "qty")
    g = x.where("period < 3").groupBy("supp", "epoch").agg(F.avg("qty").alias("now"))
    f = x.groupBy("supp", (F.col("epoch") + 1).alias("epoch")).agg(F.avg("qty").alias("before"))
    return f.join(g, ["supp", "epoch"], "left").select("supp", "epoch", F.round(F.coalesce("now", "before"), 6).alias("mean"))


@query(
    "op_J13_ledger_report",
    """SELECT o_orderpriority, count(*) AS scheduled, count(c_custkey) AS with_customer, count(l.k) AS shipped, count(*) FILTER (WHERE l.k IS NULL) AS missed FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 30) l ON l.k = o_orderkey GROUP BY 1""",
)
def ledger_report(spark: SparkSession, d: str) -> DataFrame:
    """J13, DQ4, DQ5: schedule beside what was recorded for it."""
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(1).alias("c"))
    li = table(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("l", F.lit(1))
    j = o.join(c, "o_custkey", "left").join(li, "o_orderkey", "left")
    return j.groupBy("o_orderpriority").agg(F.count("*").alias("scheduled"), F.count("c").alias("with_customer"), F.count("l").alias("shipped"), F.count_if(F.col("l").isNull()).alias("missed"))


@query(
    "op_J20_resolution_summary",
    """WITH e AS (SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'T' || (user_id % 30) ELSE CAST(user_id AS VARCHAR) END AS id FROM events)
    SELECT CASE WHEN c.c_custkey IS NOT NULL THEN 'player' WHEN n.n_nationkey IS NOT NULL THEN 'team' WHEN regexp_matches(id, '^[0-9]+$') THEN 'no_row' ELSE 'unresolved' END AS kind, count(*) AS n FROM e LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON CAST(c.c_custkey AS VARCHAR) = id LEFT JOIN nation n ON 'T' || n.n_nationkey = id GROUP BY 1""",
)
def resolution_summary(spark: SparkSession, d: str) -> DataFrame:
    """Ids resolved to players, teams, nothing or unknown."""
    u = F.col("user_id")
    e = table(spark, d, "events").select("event_id", F.when(u % 10 == 0, F.concat(F.lit("T"), (u % 30).cast("string"))).otherwise(u.cast("string")).alias("id"))
    players = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("id"), F.lit("player").alias("kind"))
    teams = table(spark, d, "nation").select(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("team").alias("kind"))
    r = first_known(e, [(players, "id", "kind"), (teams, "id", "kind")], "found")
    kind = F.coalesce("found", F.when(F.col("id").rlike("^[0-9]+$"), "no_row").otherwise("unresolved"))
    return r.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(
    "op_X4_lead_hours",
    "WITH m AS (SELECT user_id, event_id, ts, max(ts) OVER (PARTITION BY user_id) AS last FROM events) SELECT user_id, event_id, round((epoch_us(last) - epoch_us(ts)) / 3600000000.0::DOUBLE, 6) AS lead FROM m",
)
def lead_hours(spark: SparkSession, d: str) -> DataFrame:
    """Hours from a row to its entity's last one."""
    last = F.max("ts").over(Window.partitionBy("user_id"))
    return table(spark, d, "events").select("user_id", "event_id", F.round(S.lead_hours(F.col("ts"), last), 6).alias("lead"))


_N = "sin(radians(38.5::DOUBLE))"
_F = f"(cos(radians(38.5::DOUBLE)) * pow(tan(pi() / 4 + radians(38.5::DOUBLE) / 2), {_N}) / {_N})"


@query(
    "op_X7_grid_domain",
    f"""WITH p AS (SELECT c_custkey, (c_custkey * 7 % 50 + CASE WHEN c_custkey % 3 = 0 THEN -40 ELSE 10 END)::DOUBLE AS lat, (c_custkey * 11 % 90 - 140)::DOUBLE AS lon FROM customer), g AS (SELECT *, 6370 * {_F} / pow(tan(pi() / 4 + radians(lat) / 2), {_N}) AS rho, 6370 * {_F} / pow(tan(pi() / 4 + radians(38.5::DOUBLE) / 2), {_N}) AS rho0, {_N} * radians(lon + 97.5) AS theta FROM p)
    SELECT c_custkey, lat > 0 AND abs(rho * sin(theta)) <= 2697 AND abs(rho0 - rho * cos(theta)) <= 1587 AS inside FROM g""",
)
def grid_domain(spark: SparkSession, d: str) -> DataFrame:
    """Whether a point lies in a Lambert grid's box (fixed values: its origin and half sizes)."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", S.in_lambert_domain((k * 7 % 50 + F.when(k % 3 == 0, -40).otherwise(10)).cast("double"), (k * 11 % 90 - 140).cast("double"), 38.5, -97.5, 2697.0, 1587.0).alias("inside"))


@query(
    "op_M9_recommendation",
    """WITH r AS (SELECT p_brand AS metric, p_size % 3 AS cohort, round(avg(p_retailprice) / 100, 4) AS k0, min(p_size)::DOUBLE AS low, max(p_size)::DOUBLE AS high, (count(*) % 5 - 1)::DOUBLE AS r_low, (count(*) % 7)::DOUBLE / 10 AS r FROM part GROUP BY ALL), p AS (SELECT p_brand AS metric, CASE WHEN count(*) % 2 = 0 THEN round(max(p_retailprice), 2) END AS parent_k FROM part GROUP BY 1)
    SELECT metric, cohort, CASE WHEN low > 0 AND high / low <= 2 AND r_low > 0 THEN 'own' WHEN parent_k IS NOT NULL THEN 'parent' ELSE 'point' END AS rule, CASE WHEN low > 0 AND high / low <= 2 AND r_low > 0 THEN k0 ELSE coalesce(parent_k, k0) END AS k, CASE WHEN r_low > 0 THEN r ELSE 0 END AS r FROM r LEFT JOIN p USING (metric)""",
)
def recommendation(spark: SparkSession, d: str) -> DataFrame:
    """M9: own, parent or point k by the width of the interval."""
    p = table(spark, d, "part")
    r = p.groupBy(F.col("p_brand").alias("metric"), (F.col("p_size") % 3).alias("cohort")).agg(F.round(F.avg("p_retailprice") / 100, 4).alias("k0"), F.min("p_size").cast("double").alias("low"), F.max("p_size").cast("double").alias("high"), (F.count("*") % 5 - 1).cast("double").alias("r_low"), ((F.count("*") % 7) / 10).alias("r"))
    parent = p.groupBy(F.col("p_brand").alias("metric")).agg(F.when(F.count("*") % 2 == 0, F.round(F.max("p_retailprice"), 2)).alias("parent_k"))
    return C.recommended(r, parent)


@query(
    "op_M10_split_against_parent",
    "WITH " + _ARMS + _round(1, 0.0) + """, x AS (SELECT a.side, a.id, (a.num + a.den * (a.league - r.value)) / a.den AS x, a.den AS d FROM arm a JOIN r1 r ON r.epoch = a.epoch AND r.id = a.opp AND r.side = a.opp_side),
    e AS (SELECT side, id, sum(d) AS dd, count(*) AS g, sum(x * d) / sum(d) AS mean, sum(d * x * x) AS sq FROM x GROUP BY ALL HAVING count(*) >= 2) SELECT side, count(*) AS entities, round(sum(sq - dd * mean * mean) / sum(g - 1) / 1e6, 2) AS within FROM e GROUP BY side""",
)
def split_against_parent(spark: SparkSession, d: str) -> DataFrame:
    """Variance components of counterparty-adjusted rows by side."""
    arm = R.arms(_pairs(spark, d), ["epoch"])
    first = R.iterate(arm, R.start(arm, ["epoch"]), ["epoch"], 0.0).select("epoch", F.col("id").alias("opp"), F.col("side").alias("opp_side"), "value")
    x = arm.join(first, ["epoch", "opp", "opp_side"]).select("side", "id", ((F.col("num") + F.col("den") * (F.col("league") - F.col("value"))) / F.col("den")).alias("x"), F.col("den").alias("d"))
    v = T.variance_components(x, ["side"], "id", "x", "d")
    return v.select("side", "entities", F.round(F.col("within") / 1e6, 2).alias("within"))


@query(
    "op_M13_prediction_terms",
    f"WITH {_EPOCHS}, x AS (SELECT supp, epoch, num / den / 1e5 - avg(num / den / 1e5) OVER (PARTITION BY epoch) AS own, CASE WHEN supp % 6 <> 0 THEN den / 100 - avg(den / 100) OVER (PARTITION BY epoch) END AS size FROM g) SELECT supp, epoch, round(22.5::DOUBLE + CASE WHEN supp % 2 = 0 THEN 1.5 ELSE 0 END + own * 3 - size * 2, 5) AS predicted, round(own * 3, 5) AS from_own, round(size * -2, 5) AS from_size FROM x",
)
def prediction_terms(spark: SparkSession, d: str) -> DataFrame:
    """A prediction and what each term adds; null unless complete."""
    w = Window.partitionBy("epoch")
    rate, den = F.col("num") / F.col("den") / 1e5, F.col("den") / 100
    x = _epochs(spark, d).select("supp", "epoch", (rate - F.avg(rate).over(w)).alias("own"), F.when(F.col("supp") % 6 != 0, den - F.avg(den).over(w)).alias("size"))
    total, parts = C.terms(22.5, 1.5, {"own": 3.0, "size": -2.0}, F.col("supp") % 2 == 0)
    of = dict(parts)
    return x.select("supp", "epoch", F.round(total, 5).alias("predicted"), F.round(of["own"], 5).alias("from_own"), F.round(of["size"], 5).alias("from_size"))


@query(
    "op_M18_rule_comparison",
    f"WITH {_EDGES}, h AS (SELECT epoch, (edge > 0) = (margin > 0) AS a, (line < 0) = (margin > 0) AS b FROM q WHERE edge <> 0) SELECT epoch, count(*) AS n, count(*) FILTER (WHERE a) AS hits_a, count(*) FILTER (WHERE b) AS hits_b, count(*) FILTER (WHERE a AND NOT b) AS only_a, round(avg(a::INT - b::INT), 6) AS difference FROM h GROUP BY epoch",
)
def rule_comparison(spark: SparkSession, d: str) -> DataFrame:
    """M18, hits and their difference: two rules on the same rows; op_M18_rule_intervals has the intervals."""
    won = F.col("margin") > 0
    h = _edges(spark, d).where("edge <> 0").select("epoch", ((F.col("edge") > 0) == won).alias("a"), ((F.col("line") < 0) == won).alias("b"))
    return h.groupBy("epoch").agg(F.count("*").alias("n"), F.count_if("a").alias("hits_a"), F.count_if("b").alias("hits_b"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.round(F.avg(F.col("a").cast("int") - F.col("b").cast("int")), 6).alias("difference"))


@query(
    "op_M21_variant_comparison",
    f"""WITH {_XY}, v AS (SELECT unnest(['all', 'early', 'late']) AS variant), r AS (SELECT variant, t.* FROM t, v WHERE variant = 'all' OR (variant = 'early') = (month % 100 <= 6)), s AS (SELECT variant, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM r GROUP BY variant),
    f AS (SELECT variant, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b, (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n AS a FROM s)
    SELECT r.variant, count(*) AS n, round(avg(abs(a + b * x - y)), 4) AS mae, round(sqrt(avg((a + b * x - y) * (a + b * x - y))), 4) AS rmse, round(avg(a + b * x - y), 4) AS bias FROM r JOIN f USING (variant) GROUP BY r.variant""",
)
def variant_comparison(spark: SparkSession, d: str) -> DataFrame:
    """One fit a variant of the rows, all in one job."""
    early = F.col("month") % 100 <= 6
    r = _xy(spark, d).withColumn("variant", F.explode(F.array(F.lit("all"), F.when(early, "early").otherwise("late"))))
    s = T.cross_sums(r, ["variant"], "y", ["x"])
    b = (F.col("n") * F.col("xy_1") - F.col("xx_0_1") * F.col("xy_0")) / (F.col("n") * F.col("xx_1_1") - F.col("xx_0_1") * F.col("xx_0_1"))
    fits = s.select("variant", b.alias("b"), ((F.col("xy_0") - b * F.col("xx_0_1")) / F.col("n")).alias("a"))
    return error_metrics(r.join(fits, "variant"), ["variant"], F.col("a") + F.col("b") * F.col("x"), F.col("y"))


@query(
    "op_M22_counterfactual",
    f"""WITH {LINES}, c AS (SELECT supp, epoch, CAST(sum(cents) FILTER (WHERE kind <> 'N') AS BIGINT) AS stored, CAST(sum(cents) FILTER (WHERE kind <> 'N' OR entity < 5) AS BIGINT) AS changed, max((entity < 5)::INT) AS in_scope FROM lines GROUP BY ALL)
    SELECT in_scope, count(*) AS n, count(*) FILTER (WHERE stored IS DISTINCT FROM changed) AS moved FROM c GROUP BY in_scope""",
)
def counterfactual(spark: SparkSession, d: str) -> DataFrame:
    """M22, DQ11: history under another setting; rows out of scope must not move."""
    x, base = lines(spark, d, "supp", "epoch", "kind", "entity", "cents"), F.col("kind") != "N"
    c = x.groupBy("supp", "epoch").agg(F.sum(F.when(base, F.col("cents"))).alias("stored"), F.sum(F.when(base | (F.col("entity") < 5), F.col("cents"))).alias("changed"), F.max((F.col("entity") < 5).cast("int")).alias("in_scope"))
    return c.groupBy("in_scope").agg(F.count("*").alias("n"), F.count_if(~F.col("stored").eqNullSafe(F.col("changed"))).alias("moved"))


@query(
    "op_DQ7_changed_input",
    """WITH l AS (SELECT event_type AS job, max(ts) AS success FROM events WHERE value > 60 GROUP BY 1), i AS (SELECT event_type AS job, max(ts) AS changed FROM events GROUP BY 1) SELECT job, changed > success AS stale_skip FROM i LEFT JOIN l USING (job)""",
)
def changed_input(spark: SparkSession, d: str) -> DataFrame:
    """DQ7, SK11: inputs that changed after a job's last success."""
    e = table(spark, d, "events")
    g = e.groupBy(F.col("event_type").alias("job")).agg(F.max("ts").alias("changed"), F.max(F.when(F.col("value") > 60, F.col("ts"))).alias("success"))
    return g.select("job", (F.col("changed") > F.col("success")).alias("stale_skip"))


@query(
    "op_DQ10_replay_equivalence",
    """WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events), a AS (SELECT user_id, event_id FROM l WHERE event_type IS DISTINCT FROM was), b AS (SELECT user_id, event_id FROM l WHERE event_type IS DISTINCT FROM was AND event_id % 50 <> 0 UNION ALL SELECT user_id, event_id FROM l WHERE event_type = was AND event_id % 40 = 0)
    SELECT CASE WHEN a.event_id IS NULL THEN 'only_replayed' WHEN b.event_id IS NULL THEN 'only_stored' ELSE 'both' END AS side, count(*) AS n FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_id = b.event_id GROUP BY 1""",
)
def replay_equivalence(spark: SparkSession, d: str) -> DataFrame:
    """DQ10, the comparison only: the change-log against itself with set rows left out and added; op_DQ10_history_replay replays."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").select("user_id", "event_id", "event_type").withColumn("new", ~F.col("event_type").eqNullSafe(F.lag("event_type").over(w)))
    stored = e.where("new").select("user_id", "event_id", F.lit(1).alias("a"))
    replayed = e.where((F.col("new") & (F.col("event_id") % 50 != 0)) | (~F.col("new") & (F.col("event_id") % 40 == 0))).select("user_id", "event_id", F.lit(1).alias("b"))
    side = F.when(F.col("a").isNull(), "only_replayed").when(F.col("b").isNull(), "only_stored").otherwise("both")
    return stored.join(replayed, ["user_id", "event_id"], "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


@query(
    "op_DQ10_history_replay",
    "WITH l AS (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) SELECT 'both' AS side, count(*) AS n FROM l WHERE event_type IS DISTINCT FROM was",
)
def history_replay(spark: SparkSession, d: str) -> DataFrame:
    """DQ10: the log that the stream has stored against one rebuilt in batch from all polls."""
    from periodica.operators.state import replayed
    from periodica.plans.streams import change_log

    polls = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return replayed(polls, change_log(spark, d), ["user_id"], ["event_id"], ["event_type"]).groupBy("side").agg(F.count("*").alias("n"))


@query("op_M18_rule_intervals")
def rule_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Hit rates of two rules with Wilson bounds and the paired bootstrap interval of their difference."""
    won = F.col("margin") > 0
    h = _edges(spark, d).where("edge <> 0").select("epoch", F.concat_ws("-", "entity", "counterparty").alias("pair"), ((F.col("edge") > 0) == won).cast("int").alias("a"), ((F.col("line") < 0) == won).cast("int").alias("b"))
    g = h.groupBy("epoch").agg(F.count("*").alias("n"), F.sum("a").alias("hits_a"), F.sum("b").alias("hits_b"))
    ci = T.bootstrap(h, ["epoch"], "pair", {"num": F.col("a") - F.col("b"), "den": F.lit(1)}, F.try_divide("num", "den"))
    bounds = {f"{end}_{x}": F.round(S.wilson(F.col(f"hits_{x}"), F.col("n"))[i], 6) for x in "ab" for i, end in enumerate(("low", "high"))}
    ci = ci.select("epoch", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
    return g.join(ci, "epoch").withColumns(bounds).withColumn("difference", F.round((F.col("hits_a") - F.col("hits_b")) / F.col("n"), 6))


@query("op_M16_edge_intervals")
def edge_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of edge and outcome by size of edge with its bootstrap interval; validated if that lies above zero."""
    x, y = F.col("edge").cast("double"), (F.col("margin") + F.col("line")).cast("double")
    g = _edges(spark, d).select(S.third_of(F.abs("edge"), F.lit(3), F.lit(7)).alias("bucket"), F.concat_ws("-", "epoch", "entity", "counterparty").alias("pair"), x.alias("x"), y.alias("y"))
    sums = {"sw": F.lit(1.0), "sx": F.col("x"), "sy": F.col("y"), "sxx": F.col("x") * F.col("x"), "syy": F.col("y") * F.col("y"), "sxy": F.col("x") * F.col("y")}
    n = {k: F.col(k) for k in sums}
    top, bottom = n["sw"] * n["sxy"] - n["sx"] * n["sy"], (n["sw"] * n["sxx"] - n["sx"] * n["sx"]) * (n["sw"] * n["syy"] - n["sy"] * n["sy"])
    ci = T.bootstrap(g, ["bucket"], "pair", sums, F.when(bottom > 0, top / F.sqrt(bottom)))
    ci = ci.select("bucket", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), (F.col("low") > 0).alias("validated"))
    return g.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.corr("x", "y"), 6).alias("r")).join(ci, "bucket")


@query("op_T2_truncation_guard", "SELECT n_nationkey, n_name FROM nation")
def truncation_guard(spark: SparkSession, d: str) -> DataFrame:
    """A capped read that raises instead of losing rows."""
    return C.whole(table(spark, d, "nation").select("n_nationkey", "n_name"), 1000)


@query("op_T2_keyed_truncation_guard", "SELECT l_orderkey, l_linenumber FROM lineitem")
def keyed_truncation_guard(spark: SparkSession, d: str) -> DataFrame:
    """Reads capped at 1,000 rows a key, each key of a fact table; raises if one has more."""
    return C.whole_by(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], 1000)


@query("op_SK8_replace_version", "SELECT v, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS s FROM (SELECT 'v1' AS v, c_custkey FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'v2', c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY v")
def replace_version(spark: SparkSession, d: str) -> DataFrame:
    """SK4, SK8: a version's partition replaced, the other one kept."""
    from periodica.streaming.streams import shared_path

    path = shared_path(spark, "versions")
    c = table(spark, d, "customer").select("c_custkey")
    first = c.where("c_custkey % 2 = 0").withColumn("v", F.lit("v1")).unionByName(c.where("c_custkey % 5 = 0").withColumn("v", F.lit("v2")))
    U.write_partitions(first, path, ["v"])
    U.write_partitions(c.where("c_custkey % 3 = 0").withColumn("v", F.lit("v2")), path, ["v"])
    return spark.read.schema("c_custkey long, v string").parquet(path).groupBy("v").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("s"))


@query(
    "op_SC4_blocks_with_fallback",
    "SELECT c_nationkey AS team, c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'note ' || c_mktsegment ELSE c_mktsegment END AS comment FROM customer",
)
def blocks_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """SC4: team blocks to entries; a missing comment falls back to the first note."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    entry = F.struct(k.alias("id"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("longComment"), F.struct(F.array(F.struct(F.concat(F.lit("note "), "c_mktsegment").alias("text"))).alias("items")).alias("notes"))
    docs = c.groupBy("c_nationkey").agg(F.collect_list(entry).alias("entries")).select(F.to_json(F.struct(F.col("c_nationkey").alias("team"), "entries")).alias("doc"))
    e = docs.select(F.from_json("doc", "team int, entries array<struct<id: bigint, longComment: string, notes: struct<items: array<struct<text: string>>>>>").alias("d")).select("d.team", F.explode("d.entries").alias("e"))
    return e.select("team", F.col("e.id").alias("id"), F.coalesce("e.longComment", F.get("e.notes.items", 0).getField("text")).alias("comment"))
