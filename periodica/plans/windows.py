"""Queries: point-in-time windows and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.operators import joins as J
from periodica.operators import windows as W
from periodica.plans.base import LINES, USER_DAYS, lines, query, table, user_days
from periodica.sources.shared import shared_dir


@query(
    "op_W1_played_index",
    f"""WITH {USER_DAYS} SELECT *, CAST(row_number() OVER w AS INTEGER) AS played, coalesce(lag(period, 3) OVER w, min(period) OVER (PARTITION BY user_id)) AS l4_from, CAST(least(row_number() OVER w, 4) AS INTEGER) AS l4_played
    FROM user_days WINDOW w AS (PARTITION BY user_id ORDER BY period)""",
)
def played_index(spark: SparkSession, d: str) -> DataFrame:
    """The last four played, not the last four with a value."""
    return W.played_index(user_days(spark, d), ["user_id"], "period")


_THREE = {"game": "ROWS BETWEEN CURRENT ROW AND CURRENT ROW", "l4": "ROWS BETWEEN 3 PRECEDING AND CURRENT ROW", "std": "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"}


@query(
    "op_W2_three_window_sums",
    f"""WITH {USER_DAYS}, s AS (SELECT user_id, period, {", ".join(f"CAST(sum(num) OVER (PARTITION BY user_id ORDER BY period {f}) AS BIGINT) AS num_{n}, CAST(sum(den) OVER (PARTITION BY user_id ORDER BY period {f}) AS BIGINT) AS den_{n}" for n, f in _THREE.items())} FROM user_days)
    SELECT *, {", ".join(f"round(num_{n}::DOUBLE / den_{n}, 6) AS rate_{n}" for n in _THREE)} FROM s""",
)
def three_windows(spark: SparkSession, d: str) -> DataFrame:
    """Period, last four and to-date sums in one sort."""
    return W.three_windows(user_days(spark, d), ["user_id"], "period", "num", "den")


@query(
    "op_W3_cumulative_cohort",
    f"""WITH {USER_DAYS}, p AS (SELECT cohort, period, sum(num) AS num, sum(den) AS den FROM user_days GROUP BY ALL)
    SELECT cohort, period, CAST(sum(num) OVER w AS BIGINT) AS cum_num, CAST(sum(den) OVER w AS BIGINT) AS cum_den FROM p WINDOW w AS (PARTITION BY cohort ORDER BY period)""",
)
def cumulative_cohort(spark: SparkSession, d: str) -> DataFrame:
    """Cohort sums through each period."""
    return W.cumulative(user_days(spark, d), ["cohort"], "period", ["num", "den"])


@query("op_W4_delta", f"WITH {USER_DAYS} SELECT *, num - lag(num) OVER (PARTITION BY user_id ORDER BY period) AS delta FROM user_days")
def deltas(spark: SparkSession, d: str) -> DataFrame:
    """Change against the entity's row before."""
    return W.delta(user_days(spark, d), ["user_id"], "period", "num")


@query(
    "op_W5_midrank_percentile",
    f"""WITH {USER_DAYS}, r AS (SELECT user_id, cohort, period, den, rank() OVER (PARTITION BY cohort, period ORDER BY den) - 1 AS below, count(*) OVER (PARTITION BY cohort, period, den) AS equal, count(*) OVER (PARTITION BY cohort, period) AS pop FROM user_days)
    SELECT user_id, cohort, period, den, CAST(floor((100 * (2 * below + equal) + pop) / (2 * pop)::DOUBLE) AS BIGINT) AS pct FROM r""",
)
def midrank_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Mid-rank percentile, half up."""
    return W.midrank(user_days(spark, d).select("user_id", "cohort", "period", "den"), ["cohort", "period"], "den")


@query(
    "op_W6_as_of_percentile",
    f"""WITH {USER_DAYS}, v AS (SELECT *, coalesce(lead(period) OVER (PARTITION BY user_id ORDER BY period) - 1, 31) AS until FROM user_days),
    a AS (SELECT v.*, p.w FROM v JOIN (SELECT CAST(unnest(range(1, 32)) AS INTEGER) AS w) p ON p.w BETWEEN period AND until WHERE den >= 2),
    r AS (SELECT *, rank() OVER (PARTITION BY w, cohort ORDER BY num) - 1 AS below, count(*) OVER (PARTITION BY w, cohort, num) AS equal, count(*) OVER (PARTITION BY w, cohort) AS pop FROM a)
    SELECT user_id, cohort, period, num, CAST(floor((100 * (2 * below + equal) + pop) / (2 * pop)::DOUBLE) AS BIGINT) AS pct, pop_at AS ranked_here FROM (SELECT *, pop AS pop_at FROM r) WHERE w = period""",
)
def as_of_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Population of a period is every entity's latest row so far, if eligible."""
    return W.as_of_percentile(user_days(spark, d), "user_id", "cohort", "period", "num", F.col("den") >= 2, 31)


@query(
    "op_W7_as_of_view",
    f"""WITH {USER_DAYS}, n AS (SELECT *, lead(period) OVER (PARTITION BY user_id ORDER BY period) AS next_period FROM user_days) SELECT * FROM n WHERE period <= 15 AND (next_period IS NULL OR next_period > 15)""",
)
def as_of_view(spark: SparkSession, d: str) -> DataFrame:
    """Rows that hold as of a period."""
    return W.as_of(W.next_pointer(user_days(spark, d), ["user_id"], "period"), "period", 15)


@query(
    "op_W8_latest_before",
    """SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY user_id""",
)
def latest_before(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each key before a time."""
    return W.latest_before(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "event_type"], F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))


@query(
    "op_W9_forward_fill",
    """WITH o AS (SELECT user_id, CAST(dayofmonth(ts) AS INTEGER) AS day, max(CAST(round(value * 100) AS BIGINT)) AS v FROM events WHERE event_type = 'purchase' GROUP BY ALL),
    c AS (SELECT DISTINCT CAST(dayofmonth(ts) AS INTEGER) AS day FROM events WHERE user_id % 2 = 0),
    g AS (SELECT user_id, c.day FROM (SELECT user_id, min(day) AS since FROM o GROUP BY 1) JOIN c ON c.day >= since)
    SELECT g.user_id, g.day, o.v FROM g ASOF JOIN o ON g.user_id = o.user_id AND g.day >= o.day""",
)
def forward_filled(spark: SparkSession, d: str) -> DataFrame:
    """Last observed value on each day of an outside calendar."""
    e = table(spark, d, "events")
    seen = e.where("event_type = 'purchase'").groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(F.max(F.round(F.col("value") * 100).cast("long")).alias("v"))
    calendar = e.where("user_id % 2 = 0").select(F.dayofmonth("ts").alias("day")).distinct()
    return W.forward_fill(seen, calendar, ["user_id"], "day", "v")


@query(
    "op_W10_step_score",
    """WITH s AS (SELECT user_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END AS sev, ts, event_id FROM events),
    l AS (SELECT user_id, CAST(sign(sev - lag(sev) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS INTEGER) AS step FROM s WHERE sev IS NOT NULL)
    SELECT user_id, count(*) AS seen, CASE WHEN count(*) >= 2 THEN CAST(sum(step) AS BIGINT) END AS score FROM l GROUP BY user_id""",
)
def step_scores(spark: SparkSession, d: str) -> DataFrame:
    """Worse and better steps along each entity's states; unknown states are skipped."""
    t = F.col("event_type")
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", F.when(t == "view", 1).when(t == "click", 2).when(t == "purchase", 3).alias("sev"))
    return W.step_score(rows, ["user_id"], ["ts", "event_id"], "sev")


@query(
    "op_W13_first_seen_changes",
    """WITH l AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER w AS was, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, arg_min(event_type, (ts, event_id)) AS first, count(*) FILTER (WHERE i > 1 AND event_type <> was) AS changes, count(*) AS polls FROM l GROUP BY user_id""",
)
def first_seen(spark: SparkSession, d: str) -> DataFrame:
    """First value and later changes."""
    return W.first_seen(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query(
    "op_W12_previous_primary",
    f"""WITH {LINES}, v AS (SELECT entity, epoch, cust, CAST(sum(qty) AS BIGINT) AS q FROM lines GROUP BY ALL), p AS (SELECT entity, epoch, arg_max(cust, (q, -cust)) AS primary_cust FROM v GROUP BY ALL)
    SELECT entity, epoch, primary_cust, lag(primary_cust) OVER (PARTITION BY entity ORDER BY epoch) AS was FROM p""",
)
def previous_primary(spark: SparkSession, d: str) -> DataFrame:
    """Largest customer of an epoch beside the one of the epoch before."""
    v = lines(spark, d, "entity", "epoch", "cust", "qty").groupBy("entity", "epoch", "cust").agg(F.sum("qty").alias("q"))
    p = v.groupBy("entity", "epoch").agg(F.max_by("cust", F.struct("q", -F.col("cust"))).alias("primary_cust"))
    from pyspark.sql import Window

    return p.withColumn("was", F.lag("primary_cust").over(Window.partitionBy("entity").orderBy("epoch")))


@query(
    "op_J1_left_with_flag",
    """WITH o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority LIKE '1%') SELECT c_custkey, o_orderkey, o_orderkey IS NOT NULL AS matched FROM customer LEFT JOIN o ON c_custkey = o_custkey""",
)
def left_with_flag(spark: SparkSession, d: str) -> DataFrame:
    """Left join with a matched flag."""
    o = table(spark, d, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return J.left_with_flag(table(spark, d, "customer").select("c_custkey"), o, ["c_custkey"])


@query("op_J3_anti_diagnostics", "SELECT c_nationkey, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%') GROUP BY ALL")
def anti_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Unmatched rows counted."""
    orders = table(spark, d, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(orders, "c_custkey", "left_anti").groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("op_J4_semi", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50)")
def semi(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose key is in a set."""
    big = table(spark, d, "lineitem").where("l_quantity >= 50").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, d, "supplier").join(big, "s_suppkey", "left_semi").select("s_suppkey", "s_nationkey")


@query(
    "op_J5_full_outer",
    f"""WITH {LINES}, a AS (SELECT entity AS nation, epoch, count(*) AS sold FROM lines WHERE kind = 'A' GROUP BY ALL), b AS (SELECT counterparty AS nation, epoch, count(*) AS bought FROM lines WHERE kind = 'R' AND qty > 45 GROUP BY ALL)
    SELECT nation, epoch, sold, bought FROM a FULL JOIN b USING (nation, epoch)""",
)
def full_outer(spark: SparkSession, d: str) -> DataFrame:
    """Two sources on coalesced keys."""
    x = lines(spark, d)
    a = x.where("kind = 'A'").groupBy(F.col("entity").alias("nation"), "epoch").agg(F.count("*").alias("sold"))
    b = x.where("kind = 'R' AND qty > 45").groupBy(F.col("counterparty").alias("nation"), "epoch").agg(F.count("*").alias("bought"))
    return a.join(b, ["nation", "epoch"], "full").select("nation", "epoch", "sold", "bought")


@query(
    "op_J8_crosswalk",
    """SELECT e.user_id, e.event_id, coalesce(a.c_custkey, b.s_suppkey, c.n_nationkey) AS resolved FROM events e LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) a ON a.c_custkey = e.user_id
    LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) b ON b.s_suppkey = e.user_id LEFT JOIN nation c ON c.n_nationkey = e.user_id""",
)
def crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """An id through three lookups in order of preference."""
    customer = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"), F.col("c_custkey").alias("v"))
    supplier = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("user_id"), F.col("s_suppkey").alias("v"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("user_id"), F.col("n_nationkey").cast("long").alias("v"))
    return J.first_known(table(spark, d, "events").select("user_id", "event_id"), [(customer, "user_id", "v"), (supplier, "user_id", "v"), (nation, "user_id", "v")])


@query(
    "op_J9_unordered_pairs",
    f"""WITH {LINES}, r AS (SELECT epoch, period, entity, counterparty, CAST(sum(cents) AS BIGINT) AS flow FROM lines GROUP BY ALL), m AS (SELECT epoch, period, min(least(entity, counterparty)) AS home, greatest(entity, counterparty) AS away FROM lines WHERE (entity + counterparty) % 3 = 0 GROUP BY epoch, period, least(entity, counterparty), greatest(entity, counterparty))
    SELECT r.epoch, r.period, entity, counterparty, home, away, entity <> home AS swapped, CASE WHEN entity <> home THEN -flow ELSE flow END AS signed_flow FROM r JOIN m ON r.epoch = m.epoch AND r.period = m.period AND least(entity, counterparty) = home AND greatest(entity, counterparty) = away""",
)
def unordered_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Rows joined to matches whichever side is first; the sign flips when swapped."""
    x = lines(spark, d)
    rows = x.groupBy("epoch", "period", "entity", "counterparty").agg(F.sum("cents").alias("flow"))
    matches = x.where("(entity + counterparty) % 3 = 0").select("epoch", "period", F.least("entity", "counterparty").alias("home"), F.greatest("entity", "counterparty").alias("away")).distinct()
    out = J.oriented(rows, matches, "entity", "counterparty", ["epoch", "period"])
    return out.select("epoch", "period", "entity", "counterparty", "home", "away", "swapped", F.when(F.col("swapped"), -F.col("flow")).otherwise(F.col("flow")).alias("signed_flow"))


@query(
    "op_J10_interval_join",
    """WITH w AS (SELECT k, DATE '2024-01-03' + CAST(k * 7 AS INTEGER) AS a, DATE '2024-01-03' + CAST(k * 7 + 4 AS INTEGER) AS b FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 3)),
    p AS (SELECT event_id, CAST(ts AS DATE) AS day FROM events)
    SELECT event_id, coalesce((SELECT arg_min(k, a) FROM w WHERE day BETWEEN a AND b), (SELECT arg_min(k, a) FROM w WHERE a > day), (SELECT arg_max(k, b) FROM w WHERE b < day)) AS k FROM p""",
)
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    """The window that holds a day, else the nearest upcoming, else the nearest past."""
    k = F.col("n_nationkey")
    first = F.lit("2024-01-03").cast("date")
    windows = table(spark, d, "nation").where(k < 3).select(k.alias("k"), F.date_add(first, k * 7).alias("a"), F.date_add(first, k * 7 + 4).alias("b"))
    return J.interval_join(table(spark, d, "events").select("event_id", "ts"), windows, F.to_date("ts"), "a", "b", "k").select("event_id", "k")


@query(
    "op_J11_adjacent_epochs",
    f"""WITH {LINES}, g AS (SELECT supp, epoch, CAST(sum(qty) AS BIGINT) AS v FROM lines GROUP BY ALL) SELECT a.supp, a.epoch, a.v AS this, b.v AS next FROM g a JOIN g b ON a.supp = b.supp AND b.epoch = a.epoch + 1""",
)
def adjacent_epochs(spark: SparkSession, d: str) -> DataFrame:
    """An entity's value in one epoch and the next."""
    return J.adjacent(lines(spark, d, "supp", "epoch", "qty").groupBy("supp", "epoch").agg(F.sum("qty").alias("v")), ["supp"], "epoch", "v")


_SIGNALS = f"""WITH {LINES}, s AS (SELECT entity, epoch, 'sold_' || kind || '_off' AS signal, CAST(sum(qty) AS BIGINT) AS value FROM lines GROUP BY ALL UNION ALL SELECT counterparty, epoch, 'sold_' || kind || '_def', CAST(sum(disc) AS BIGINT) FROM lines WHERE disc > 8 GROUP BY ALL)"""


def _signals(spark: SparkSession, d: str) -> DataFrame:
    x = lines(spark, d)
    off = x.groupBy("entity", "epoch", F.concat(F.lit("sold_"), "kind", F.lit("_off")).alias("signal")).agg(F.sum("qty").alias("value"))
    de = x.where("disc > 8").groupBy(F.col("counterparty").alias("entity"), "epoch", F.concat(F.lit("sold_"), "kind", F.lit("_def")).alias("signal")).agg(F.sum("disc").alias("value"))
    return off.unionByName(de)


@query("op_J14_tall_to_wide", _SIGNALS + """ SELECT entity, epoch, max(value) FILTER (WHERE signal = 'sold_A_off') AS a_off, max(value) FILTER (WHERE signal = 'sold_A_def') AS a_def, max(value) FILTER (WHERE signal = 'sold_R_off') AS r_off FROM s GROUP BY ALL""")
def tall_to_wide(spark: SparkSession, d: str) -> DataFrame:
    """Features from tall signals in one grouping."""
    pick = lambda s: F.max(F.when(F.col("signal") == s, F.col("value")))
    return _signals(spark, d).groupBy("entity", "epoch").agg(pick("sold_A_off").alias("a_off"), pick("sold_A_def").alias("a_def"), pick("sold_R_off").alias("r_off"))


_SIDES = [(side, unit, base) for side in ("home", "away") for base in ("A", "R") for unit in ("off", "def")]


@query(
    "op_J14_match_features",
    f"""WITH {LINES}, b AS (SELECT entity, counterparty, epoch, kind, CAST(sum(qty) AS BIGINT) AS value, count(*) AS n FROM lines GROUP BY ALL),
    r AS (SELECT entity, epoch, kind || '_off' AS signal, value, n FROM b UNION ALL SELECT counterparty, epoch, kind || '_def', value, n FROM b),
    g AS (SELECT entity, epoch, signal, CAST(sum(value) AS BIGINT) AS value, sum(n)::DOUBLE / (sum(n) + 50) AS stab FROM r WHERE signal LIKE 'A%' OR signal LIKE 'R%' AND entity % 9 <> 4 GROUP BY ALL),
    c AS (SELECT *, value - avg(value) OVER (PARTITION BY epoch, signal) AS mid FROM g), m AS (SELECT DISTINCT entity AS home, counterparty AS away, epoch FROM b),
    w AS (SELECT entity, epoch, {", ".join(f"max(mid) FILTER (WHERE signal = '{b}_{u}') AS {u}__{b}, max(value) FILTER (WHERE signal = '{b}_{u}') AS {u}_raw__{b}, max(stab) FILTER (WHERE signal = '{b}_{u}') AS {u}_stab__{b}" for b in "AR" for u in ("off", "def"))} FROM c GROUP BY ALL),
    f AS (SELECT m.epoch, home, away, CASE WHEN (home + away) % 7 = 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS h_home, {", ".join(f"{side}_.{u}{what}__{b} AS {side}_{u}{what}__{b}" for side, u, b in _SIDES for what in ("", "_raw", "_stab"))}
      FROM m LEFT JOIN w home_ ON home_.entity = home AND home_.epoch = m.epoch LEFT JOIN w away_ ON away_.entity = away AND away_.epoch = m.epoch)
    SELECT epoch, home, away, h_home, {", ".join(f"round({side}_{u}{what}__{b}, 6)::DOUBLE AS {side}_{u}{what}__{b}" for side, u, b in _SIDES for what in ("", "_raw", "_stab"))},
     {" AND ".join(f"{side}_{u}__{b} IS NOT NULL" for side, u, b in _SIDES)} AS features_complete, CASE WHEN {" AND ".join(f"{side}_{u}__{b} IS NOT NULL" for side, u, b in _SIDES)} THEN round(least({", ".join(f"{side}_{u}_stab__{b}" for side, u, b in _SIDES)}), 6) END AS stability_min FROM f""",
)
def match_features(spark: SparkSession, d: str) -> DataFrame:
    """Matches with both sides' centred, raw and stability features from tall signals; a repeated signal raises (tested). The lines are read once."""
    shared_dir(spark)
    b = lines(spark, d, "entity", "counterparty", "epoch", "kind", "qty").groupBy("entity", "counterparty", "epoch", "kind").agg(F.sum("qty").alias("value"), F.count("*").alias("n")).checkpoint()
    sides = F.explode(F.array(*[F.struct(F.col(who).alias("entity"), F.concat("kind", F.lit(unit)).alias("signal")) for who, unit in (("entity", "_off"), ("counterparty", "_def"))])).alias("s")
    g = b.select("epoch", "value", "n", sides).groupBy("epoch", "s.entity", "s.signal").agg(F.sum("value").alias("value"), (F.sum("n") / (F.sum("n") + 50)).alias("stability"))
    g = g.where(F.col("signal").startswith("A") | (F.col("entity") % 9 != 4))
    m = b.select(F.col("entity").alias("home"), F.col("counterparty").alias("away"), "epoch").distinct()
    m = m.withColumn("location", F.when((F.col("home") + F.col("away")) % 7 == 0, "Neutral").otherwise("Home"))
    f = J.match_features(m, g, ["epoch"], ["A", "R"]).drop("location")
    return f.select("epoch", "home", "away", "h_home", "features_complete", F.round("stability_min", 6).alias("stability_min"), *[F.round(F.col(c).cast("double"), 6).alias(c) for c in f.columns if "__" in c])


@query(
    "op_J15_suffix_pairs",
    _SIGNALS + """, p AS (SELECT DISTINCT entity, counterparty, epoch FROM lines), o AS (SELECT *, regexp_replace(signal, '(_off|_def)$', '') AS base FROM s)
    SELECT p.epoch, p.counterparty, a.base, p.entity, a.value AS own, b.value AS theirs FROM p JOIN o a ON a.entity = p.entity AND a.epoch = p.epoch AND a.signal LIKE '%\\_off' ESCAPE '\\' LEFT JOIN o b ON b.entity = p.counterparty AND b.epoch = p.epoch AND b.base = a.base AND b.signal LIKE '%\\_def' ESCAPE '\\'""",
)
def suffix_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Own offence beside the counterparty's defence."""
    pairs = lines(spark, d, "entity", "counterparty", "epoch").select("entity", "counterparty", "epoch").distinct()
    return J.paired_sides(_signals(spark, d), pairs, ["epoch"])


_SHARES = f"""WITH {LINES}, g AS (SELECT c_nationkey AS nation, c_mktsegment AS seg, cust, c_acctbal, CAST(sum(cents) AS BIGINT) AS spend FROM lines JOIN customer ON cust = c_custkey GROUP BY ALL),
 r AS (SELECT nation, seg, cust, c_acctbal < 500 AS flagged, spend, CAST(row_number() OVER (PARTITION BY nation, seg ORDER BY spend DESC, cust) AS INTEGER) AS rank FROM g)"""


def _shares(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    c = table(spark, d, "customer")
    g = lines(spark, d, "cust", "cents").groupBy("cust").agg(F.sum("cents").alias("spend")).join(c, F.col("cust") == F.col("c_custkey"))
    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy(F.desc("spend"), "cust")
    return g.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("seg"), "cust", (F.col("c_acctbal") < 500).alias("flagged"), "spend", F.row_number().over(w).alias("rank"))


@query(
    "op_J16_next_candidate",
    _SHARES + """, c AS (SELECT a.nation, a.seg, a.cust, a.rank, arg_min(b.cust, b.rank) AS replacement, min(b.rank) - a.rank AS rank_delta FROM r a LEFT JOIN r b ON a.nation = b.nation AND a.seg = b.seg AND b.rank > a.rank AND NOT b.flagged WHERE a.flagged GROUP BY a.nation, a.seg, a.cust, a.rank) SELECT * FROM c""",
)
def next_candidate(spark: SparkSession, d: str) -> DataFrame:
    """The best unflagged peer behind a flagged one."""
    return J.next_candidate(_shares(spark, d), ["nation", "seg"], "rank", "cust", F.col("flagged"))


@query(
    "op_J17_reallocation",
    _SHARES + """, t AS (SELECT *, sum(CASE WHEN flagged THEN spend ELSE 0 END) OVER (PARTITION BY nation, seg) AS lost, sum(CASE WHEN flagged THEN 0 ELSE spend END) OVER (PARTITION BY nation, seg) AS open FROM r)
    SELECT nation, seg, cust, flagged, spend, rank, CASE WHEN flagged THEN spend ELSE 0 END AS at_risk, round(CASE WHEN NOT flagged AND open > 0 THEN lost::DOUBLE * spend / open ELSE 0 END, 2) AS gain FROM t""",
)
def reallocation(spark: SparkSession, d: str) -> DataFrame:
    """Flagged shares spread pro rata over the others."""
    return J.reallocate(_shares(spark, d).withColumn("spend_d", F.col("spend").cast("double")), ["nation", "seg"], "spend_d", F.col("flagged")).select("nation", "seg", "cust", "flagged", "spend", "rank", F.col("at_risk").cast("long").alias("at_risk"), F.round("gain", 2).alias("gain"))


@query("op_A16_cluster_counts", _SHARES + " SELECT nation, seg, count(*) AS n FROM r WHERE flagged GROUP BY ALL")
def cluster_counts(spark: SparkSession, d: str) -> DataFrame:
    """Flagged members where there are any."""
    return _shares(spark, d).where("flagged").groupBy("nation", "seg").agg(F.count("*").alias("n"))
