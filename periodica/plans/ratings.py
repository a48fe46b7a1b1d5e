"""Queries: ratings, blends, reliability, regression, grading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from periodica.functions import scalars as S
from periodica.operators import rating as R
from periodica.operators import stats as T
from periodica.operators.joins import adjacent
from periodica.operators.rollup import error_metrics
from periodica.operators.windows import midrank
from periodica.plans.base import LINES, lines, query, table
from periodica.sources.shared import shared_dir

K = 50.0
ROUNDS = 3


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d, "epoch", "entity", "counterparty", "cents", "qty").groupBy("epoch", "entity", "counterparty").agg(F.sum("cents").cast("double").alias("num"), F.sum("qty").cast("double").alias("den"))


_ARMS = f"""{LINES}, p AS (SELECT epoch, entity, counterparty, sum(cents)::DOUBLE AS num, sum(qty)::DOUBLE AS den FROM lines GROUP BY ALL),
l AS (SELECT *, sum(num) OVER (PARTITION BY epoch) / sum(den) OVER (PARTITION BY epoch) AS league FROM p),
arm AS (SELECT epoch, league, num, den, entity AS id, 'off' AS side, counterparty AS opp, 'def' AS opp_side FROM l UNION ALL SELECT epoch, league, num, den, counterparty, 'def', entity, 'off' FROM l),
r0 AS (SELECT epoch, id, side, any_value(league) AS value FROM arm GROUP BY ALL)"""


def _round(i: int, k: float = K) -> str:
    return f""", s{i} AS (SELECT a.epoch, a.id, a.side, (sum(num + den * (league - r.value)) + {k} * any_value(league)) / (sum(den) + {k}) AS raw, sum(den) AS d, any_value(league) AS league
 FROM arm a JOIN r{i - 1} r ON r.epoch = a.epoch AND r.id = a.opp AND r.side = a.opp_side GROUP BY a.epoch, a.id, a.side),
r{i} AS (SELECT epoch, id, side, raw + league - sum(raw * d) OVER (PARTITION BY epoch, side) / sum(d) OVER (PARTITION BY epoch, side) AS value FROM s{i})"""


_SOLVED = "WITH " + _ARMS + "".join(_round(i) for i in range(1, ROUNDS + 1))


@query("op_M1_adjusted_ratings", _SOLVED + f" SELECT epoch, CAST(id AS INTEGER) AS id, side, round(value, 4) AS value FROM r{ROUNDS}")
def adjusted_ratings(spark: SparkSession, d: str) -> DataFrame:
    """M1: opponent-adjusted ratings of nations, all epochs in one plan, after a fixed number of rounds."""
    r = R.adjusted(_pairs(spark, d), ["epoch"], K, ROUNDS)
    return r.select("epoch", F.col("id").cast("int").alias("id"), "side", F.round("value", 4).alias("value"))


@query("op_M1_flagship_percentiles", _SOLVED + f""", v AS (SELECT epoch, CAST(id AS INTEGER) AS id, side, round(value, 4) AS value FROM r{ROUNDS}),
k AS (SELECT *, rank() OVER (PARTITION BY epoch, side ORDER BY value) - 1 AS below, count(*) OVER (PARTITION BY epoch, side, value) AS equal, count(*) OVER (PARTITION BY epoch, side) AS pop FROM v)
SELECT epoch, id, side, value, CAST(floor((100 * (2 * below + equal) + pop) / (2 * pop)::DOUBLE) AS BIGINT) AS pct FROM k""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """A2, A10, M1, W5 end to end."""
    return midrank(adjusted_ratings(spark, d), ["epoch", "side"], "value")


@query(
    "op_M2_ratings_with_priors",
    "WITH " + _ARMS + _round(1) + """, prior AS (SELECT epoch + 1 AS epoch, id, side, value AS prior, 0.8::DOUBLE AS discount FROM r1),
    m AS (SELECT a.*, r.value AS cur, p.prior, coalesce(p.discount, 1.0::DOUBLE) AS discount, sum(a.den) OVER (PARTITION BY a.epoch, a.opp, a.opp_side) AS n_opp FROM arm a JOIN r0 r ON r.epoch = a.epoch AND r.id = a.opp AND r.side = a.opp_side LEFT JOIN prior p ON p.epoch = a.epoch AND p.id = a.opp AND p.side = a.opp_side),
    w AS (SELECT *, n_opp / (n_opp + 50.0::DOUBLE) AS wc, CASE WHEN prior IS NULL THEN 0 ELSE (1 - n_opp / (n_opp + 50.0::DOUBLE)) * discount END AS wp FROM m),
    s AS (SELECT epoch, id, side, sum(num + den * (league - (wc * cur + wp * coalesce(prior, 0) + (1 - wc - wp) * league))) / sum(den) AS raw, sum(den) AS d, any_value(league) AS league FROM w GROUP BY epoch, id, side)
    SELECT epoch, CAST(id AS INTEGER) AS id, side, round(raw + league - sum(raw * d) OVER (PARTITION BY epoch, side) / sum(d) OVER (PARTITION BY epoch, side), 4) AS value FROM s""",
)
def ratings_with_priors(spark: SparkSession, d: str) -> DataFrame:
    """M2: counterparties seen through a blend with last epoch's rating."""
    pairs = _pairs(spark, d)
    priors = R.adjusted(pairs, ["epoch"], K, 1).select((F.col("epoch") + 1).alias("epoch"), "id", "side", F.col("value").alias("prior"), F.lit(0.8).alias("discount"))
    r = R.adjusted(pairs, ["epoch"], K, 1, priors)
    return r.select("epoch", F.col("id").cast("int").alias("id"), "side", F.round("value", 4).alias("value"))


_EPOCHS = f"""{LINES}, g AS (SELECT supp, epoch, sum(cents)::DOUBLE AS num, sum(qty)::DOUBLE AS den FROM lines GROUP BY ALL), lg AS (SELECT epoch, sum(num) / sum(den) AS league FROM g GROUP BY epoch)"""


def _epochs(spark: SparkSession, d: str) -> DataFrame:
    """Sums of a supplier's epoch, checkpointed: most queries read them several times, and the lines are to be read once."""
    shared_dir(spark)
    return lines(spark, d, "supp", "epoch", "cents", "qty").groupBy("supp", "epoch").agg(F.sum("cents").cast("double").alias("num"), F.sum("qty").cast("double").alias("den")).checkpoint()


@query(
    "op_M3_continuity_discounts",
    f"""WITH {_EPOCHS}, t AS (SELECT s_nationkey AS nation, g.*, sum(den) OVER (PARTITION BY s_nationkey, epoch) AS team FROM g JOIN supplier ON supp = s_suppkey)
    SELECT CAST(a.supp AS BIGINT) AS supp, a.epoch, round(1 - 0.4::DOUBLE * (1 - least(1.0::DOUBLE, least(1.0::DOUBLE, a.den / b.team) / 0.5)), 6) AS discount FROM t a JOIN t b ON a.supp = b.supp AND b.epoch = a.epoch - 1""",
)
def continuity_discounts(spark: SparkSession, d: str) -> DataFrame:
    """M3: how much of last epoch's workload stays."""
    t = _epochs(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("supp"), "s_nationkey"), "supp")
    t = t.withColumn("team", F.sum("den").over(Window.partitionBy("s_nationkey", "epoch")))
    before = t.select("supp", (F.col("epoch") + 1).alias("epoch"), F.col("team").alias("before"))
    return t.join(before, ["supp", "epoch"]).select("supp", "epoch", F.round(R.continuity(F.col("den"), F.col("before")), 6).alias("discount"))


@query(
    "op_M4_three_way_blend",
    f"""WITH {_EPOCHS}, j AS (SELECT g.supp, g.epoch, g.den AS n, g.num / g.den AS cur, p.num / p.den AS prior, league FROM g JOIN lg USING (epoch) LEFT JOIN g p ON p.supp = g.supp AND p.epoch = g.epoch - 1),
    w AS (SELECT *, n / (n + 200.0::DOUBLE) AS wc, CASE WHEN prior IS NULL THEN 0 ELSE (1 - n / (n + 200.0::DOUBLE)) * 0.7::DOUBLE END AS wp FROM j)
    SELECT supp, epoch, round(wc * cur + wp * coalesce(prior, 0) + (1 - wc - wp) * league, 4) AS value, round(wc + wp, 6) AS stability FROM w""",
)
def three_way_blend(spark: SparkSession, d: str) -> DataFrame:
    """Current, discounted prior and league."""
    g = _epochs(spark, d)
    league = g.groupBy("epoch").agg((F.sum("num") / F.sum("den")).alias("league"))
    prior = g.select("supp", (F.col("epoch") + 1).alias("epoch"), (F.col("num") / F.col("den")).alias("prior"))
    j = g.join(league, "epoch").join(prior, ["supp", "epoch"], "left")
    value, stability = S.blend(F.col("num") / F.col("den"), F.col("den"), 200.0, F.col("prior"), F.lit(0.7), F.col("league"))
    return j.select("supp", "epoch", F.round(value, 4).alias("value"), F.round(stability, 6).alias("stability"))


@query(
    "op_M5_cohort_blend",
    f"""WITH {_EPOCHS}, c AS (SELECT g.*, supp % 4 AS cohort FROM g), m AS (SELECT cohort, epoch, sum(num) / sum(den) AS mean FROM c GROUP BY ALL), kr AS (SELECT * FROM (VALUES (0, 20.0::DOUBLE, 0.6::DOUBLE), (1, 60.0::DOUBLE, 0.4::DOUBLE), (-1, 120.0::DOUBLE, 0.2::DOUBLE)) t(cohort, k, r)),
    j AS (SELECT c.supp, c.epoch, c.den AS n, c.num / c.den AS cur, coalesce(a.k, z.k) AS k, coalesce(a.r, z.r) AS r, m.mean, (p.num + coalesce(a.k, z.k) * pm.mean) / (p.den + coalesce(a.k, z.k)) AS prior FROM c JOIN m USING (cohort, epoch) LEFT JOIN kr a ON a.cohort = c.cohort JOIN kr z ON z.cohort = -1 LEFT JOIN c p ON p.supp = c.supp AND p.epoch = c.epoch - 1 LEFT JOIN m pm ON pm.cohort = c.cohort AND pm.epoch = c.epoch - 1)
    SELECT supp, epoch, round(n / (n + k) * cur + (CASE WHEN prior IS NULL THEN 0 ELSE (1 - n / (n + k)) * r END) * coalesce(prior, 0) + (1 - n / (n + k) - (CASE WHEN prior IS NULL THEN 0 ELSE (1 - n / (n + k)) * r END)) * mean, 4) AS value FROM j""",
)
def cohort_blend(spark: SparkSession, d: str) -> DataFrame:
    """M5: k and r by cohort, with a fallback; the prior is itself shrunk to its cohort."""
    c = _epochs(spark, d).withColumn("cohort", F.col("supp") % 4)
    mean = c.groupBy("cohort", "epoch").agg((F.sum("num") / F.sum("den")).alias("mean"))
    k = F.when(F.col("cohort") == 0, 20.0).when(F.col("cohort") == 1, 60.0).otherwise(120.0)
    r = F.when(F.col("cohort") == 0, 0.6).when(F.col("cohort") == 1, 0.4).otherwise(0.2)
    c = c.join(mean, ["cohort", "epoch"])
    prior = c.select("supp", (F.col("epoch") + 1).alias("epoch"), ((F.col("num") + k * F.col("mean")) / (F.col("den") + k)).alias("prior"))
    j = c.join(prior, ["supp", "epoch"], "left")
    w = F.col("den") / (F.col("den") + k)
    wp = F.when(F.col("prior").isNotNull(), (1 - w) * r).otherwise(0.0)
    value = w * F.col("num") / F.col("den") + wp * F.coalesce("prior", F.lit(0.0)) + (1 - w - wp) * F.col("mean")
    return j.select("supp", "epoch", F.round(value, 4).alias("value"))


@query(
    "op_M6_variance_components",
    f"""WITH {LINES}, x AS (SELECT kind, supp, cents::DOUBLE / qty AS x, qty::DOUBLE AS d FROM lines), e AS (SELECT kind, supp, sum(d) AS dd, count(*) AS g, sum(x * d) / sum(d) AS mean, sum(d * x * x) AS sq FROM x GROUP BY ALL HAVING count(*) >= 2),
    b AS (SELECT kind, sum(sq - dd * mean * mean) / sum(g - 1) AS within, count(*) AS entities, sum(dd) AS n, sum(dd * dd) AS nn, sum(dd * mean) AS s, sum(dd * mean * mean) AS q FROM e GROUP BY kind),
    t AS (SELECT kind, entities, within, (q - s * s / n - (entities - 1) * within) / (n - nn / n) AS between_ FROM b)
    SELECT kind, entities, round(within, 0) AS within, round(between_, 0) AS "between", CASE WHEN between_ > 0 THEN round(within / between_, 1) END AS k0 FROM t""",
)
def variance_components(spark: SparkSession, d: str) -> DataFrame:
    """Within and between variance, k0."""
    x = lines(spark, d, "kind", "supp", "cents", "qty").select("kind", "supp", (F.col("cents") / F.col("qty")).alias("x"), F.col("qty").cast("double").alias("d"))
    v = T.variance_components(x, ["kind"], "supp", "x", "d")
    return v.select("kind", "entities", F.round("within", 0).alias("within"), F.round("between", 0).alias("between"), F.round("k0", 1).alias("k0"))


_ADJ = f"""WITH {LINES}, g AS (SELECT kind, supp, epoch, sum(cents)::DOUBLE / sum(qty) AS v FROM lines GROUP BY ALL), p AS (SELECT a.kind, a.supp, a.epoch, a.v AS this, b.v AS next FROM g a JOIN g b ON a.kind = b.kind AND a.supp = b.supp AND b.epoch = a.epoch + 1)"""


def _adjacent(spark: SparkSession, d: str) -> DataFrame:
    return adjacent(lines(spark, d, "kind", "supp", "epoch", "cents", "qty").groupBy("kind", "supp", "epoch").agg((F.sum("cents") / F.sum("qty")).alias("v")), ["kind", "supp"], "epoch", "v")


@query(
    "op_M7_year_reliability",
    _ADJ + """, r AS (SELECT kind, count(*) AS pairs, CASE WHEN count(*) >= 5 THEN least(greatest(corr(this, next), 0.0::DOUBLE), 1.0::DOUBLE) END AS raw FROM p GROUP BY kind) SELECT kind, pairs, round(raw, 6) AS raw, round(0.5 * raw + 0.5 * avg(raw) OVER (), 6) AS reliability FROM r""",
)
def year_reliability(spark: SparkSession, d: str) -> DataFrame:
    """M7: correlation of adjacent epochs, half drawn to the mean."""
    r = T.year_reliability(_adjacent(spark, d), ["kind"], "this", "next")
    return r.select("kind", "pairs", F.round("raw", 6).alias("raw"), F.round("reliability", 6).alias("reliability"))


@query(
    "op_M8_weighted_slope",
    _ADJ + """, w AS (SELECT *, (supp % 9 + 1)::DOUBLE / (supp % 9 + 4) AS w FROM p), m AS (SELECT kind, count(*) AS pairs, sum(w) AS sw, sum(w * this) AS sx, sum(w * next) AS sy, sum(w * this * this) AS sxx, sum(w * this * next) AS sxy, corr(this, next) AS r FROM w GROUP BY kind)
    SELECT kind, pairs, round((sxy - sx * sy / sw) / (sxx - sx * sx / sw), 5) AS slope, round(r, 6) AS r FROM m""",
)
def weighted_slope(spark: SparkSession, d: str) -> DataFrame:
    """M8: slope of the next epoch on this one under reliability weights."""
    n = F.col("supp") % 9 + 1
    s = T.weighted_slope(_adjacent(spark, d), ["kind"], "this", "next", n.cast("double") / (n + 3))
    return s.select("kind", "pairs", F.round("slope", 5).alias("slope"), F.round("r", 6).alias("r"))


_POISSON = "CASE WHEN u < 0.367879441 THEN 0 WHEN u < 0.735758882 THEN 1 WHEN u < 0.919698603 THEN 2 WHEN u < 0.981011843 THEN 3 WHEN u < 0.996340153 THEN 4 WHEN u < 0.999405815 THEN 5 ELSE 6 END"


@query(
    "op_M11_cluster_bootstrap",
    f"""WITH {LINES}, c AS (SELECT kind, supp, sum(cents)::DOUBLE AS num, sum(qty)::DOUBLE AS den FROM lines GROUP BY ALL), u AS (SELECT *, ('0x' || substr(md5(rep::VARCHAR || '|' || supp::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM c, (SELECT unnest(range(0, 100)) AS rep)),
    r AS (SELECT kind, rep, sum(({_POISSON}) * num) / sum(({_POISSON}) * den) AS e FROM u GROUP BY ALL)
    SELECT kind, round(quantile_cont(e, 0.025), 3) AS low, round(quantile_cont(e, 0.975), 3) AS high FROM r GROUP BY kind""",
)
def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Percentile interval of a ratio of sums, suppliers as clusters."""
    sums = {"num": F.col("cents").cast("double"), "den": F.col("qty").cast("double")}
    b = T.bootstrap(lines(spark, d, "kind", "supp", "cents", "qty"), ["kind"], "supp", sums, F.col("num") / F.col("den"), 100)
    return b.select("kind", F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))


_XY = f"""{LINES}, t AS (SELECT epoch, epoch * 100 + period AS month, entity, sum(cents)::DOUBLE / 1e6 AS y, sum(qty)::DOUBLE / 100 AS x FROM lines GROUP BY ALL)"""


def _xy(spark: SparkSession, d: str) -> DataFrame:
    g = lines(spark, d, "epoch", "period", "entity", "cents", "qty").groupBy("epoch", (F.col("epoch") * 100 + F.col("period")).alias("month"), "entity")
    return g.agg((F.sum("cents") / 1e6).alias("y"), (F.sum("qty") / 100.0).alias("x"))


@query(
    "op_M12_ols_clustered",
    f"""WITH {_XY}, s AS (SELECT count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM t), b AS (SELECT *, n * sxx - sx * sx AS det, (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS a, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b FROM s),
    e AS (SELECT month, sum(y - a - b * x) AS s0, sum((y - a - b * x) * x) AS s1 FROM t, b GROUP BY month), m AS (SELECT count(*)::DOUBLE AS g, sum(s0 * s0) AS m00, sum(s0 * s1) AS m01, sum(s1 * s1) AS m11 FROM e),
    v AS (SELECT a, b, g / (g - 1) * (n - 1) / (n - 2) AS f, sxx / det AS i00, -sx / det AS i01, n / det AS i11, m00, m01, m11 FROM b, m)
    SELECT 'intercept' AS term, round(a, 5) AS estimate, round(sqrt(f * (i00 * i00 * m00 + 2 * i00 * i01 * m01 + i01 * i01 * m11)), 5) AS se FROM v UNION ALL
    SELECT 'x', round(b, 5), round(sqrt(f * (i01 * i01 * m00 + 2 * i01 * i11 * m01 + i11 * i11 * m11)), 5) FROM v""",
)
def ols_clustered(spark: SparkSession, d: str) -> DataFrame:
    """Least squares with month clusters, CR1."""
    r = T.ols_clustered(_xy(spark, d), "y", ["x"], "month")
    return r.select("term", F.round("estimate", 5).alias("estimate"), F.round("se", 5).alias("se"))


@query(
    "op_M14_walk_forward",
    f"""WITH {_XY}, s AS (SELECT epoch, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM t GROUP BY epoch),
    c AS (SELECT epoch, sum(n) OVER w AS n, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy, sum(sxx) OVER w AS sxx, sum(sxy) OVER w AS sxy FROM s WINDOW w AS (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT epoch, n, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS beta, (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n AS alpha FROM c WHERE n > 2)
    SELECT t.epoch, count(*) AS n, round(avg(abs(alpha + beta * x - y)), 4) AS mae, round(sqrt(avg((alpha + beta * x - y) * (alpha + beta * x - y))), 4) AS rmse, round(avg(alpha + beta * x - y), 4) AS bias FROM t JOIN f USING (epoch) GROUP BY t.epoch""",
)
def walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """Each epoch predicted by a fit on all earlier ones."""
    t = _xy(spark, d)
    fits = T.walk_forward(t, "epoch", "y", "x")
    return error_metrics(t.join(fits, "epoch"), ["epoch"], F.col("alpha") + F.col("beta") * F.col("x"), F.col("y"))


_EDGES = f"""{LINES}, q AS (SELECT epoch, entity, counterparty, (sum(cents) // 100000 % 21) - 10 AS edge, (sum(qty) % 29) - 14 AS margin, (count(*) % 13) - 6 AS line, (sum(disc) % 9) - 4 AS close_line FROM lines GROUP BY ALL)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    g = lines(spark, d, "epoch", "entity", "counterparty", "cents", "qty", "disc").groupBy("epoch", "entity", "counterparty")
    return g.agg((F.floor(F.sum("cents") / 100000) % 21 - 10).alias("edge"), (F.sum("qty") % 29 - 14).alias("margin"), (F.count("*") % 13 - 6).alias("line"), (F.sum("disc") % 9 - 4).alias("close_line"))


_RESULT = "CASE WHEN edge = 0 THEN 'no_pick' WHEN margin + line = 0 THEN 'push' WHEN sign(edge) = sign(margin + line) THEN 'win' ELSE 'loss' END"


@query("op_M17_graded_rows", f"WITH {_EDGES} SELECT epoch, CAST(entity AS INTEGER) AS entity, CAST(counterparty AS INTEGER) AS counterparty, {_RESULT} AS result, CAST(sign(edge) * (line - close_line) AS DOUBLE) AS clv, CAST(abs(edge) AS BIGINT) AS size FROM q")
def graded_rows(spark: SparkSession, d: str) -> DataFrame:
    """Pick results and closing-line value."""
    e = _edges(spark, d)
    return e.select("epoch", F.col("entity").cast("int").alias("entity"), F.col("counterparty").cast("int").alias("counterparty"), S.pick_result(F.col("edge"), F.col("margin"), F.col("line")).alias("result"), S.closing_value(F.col("edge"), F.col("line"), F.col("close_line")).cast("double").alias("clv"), F.abs("edge").alias("size"))


@query(
    "op_A21_win_rates",
    f"""WITH {_EDGES}, g AS (SELECT {_RESULT} AS result, CASE WHEN abs(edge) < 3 THEN 'low' WHEN abs(edge) < 7 THEN 'mid' ELSE 'high' END AS bucket FROM q),
    a AS (SELECT bucket, count(*) FILTER (WHERE result <> 'no_pick') AS picks, count(*) FILTER (WHERE result IN ('win', 'loss')) AS decided, count(*) FILTER (WHERE result = 'win') AS wins, count(*) FILTER (WHERE result = 'push') AS pushes FROM g GROUP BY bucket)
    SELECT *, round(wins::DOUBLE / decided, 6) AS rate, round((wins::DOUBLE / decided + 3.841458820694124::DOUBLE / (2 * decided) - 1.959963984540054::DOUBLE * sqrt(wins::DOUBLE / decided * (1 - wins::DOUBLE / decided) / decided + 3.841458820694124::DOUBLE / (4 * decided * decided))) / (1 + 3.841458820694124::DOUBLE / decided), 6) AS low FROM a""",
)
def win_rates(spark: SparkSession, d: str) -> DataFrame:
    """Results by size of edge, with the Wilson bound."""
    g = graded_rows(spark, d).withColumn("bucket", S.third_of(F.col("size"), F.lit(3), F.lit(7)))
    is_ = lambda *r: F.count_if(F.col("result").isin(*r))
    a = g.groupBy("bucket").agg(is_("win", "loss", "push").alias("picks"), is_("win", "loss").alias("decided"), is_("win").alias("wins"), is_("push").alias("pushes"))
    return a.withColumn("rate", F.round(S.ratio(F.col("wins"), F.col("decided")), 6)).withColumn("low", F.round(S.wilson(F.col("wins"), F.col("decided"))[0], 6))


@query(
    "op_M16_edge_calibration",
    f"""WITH {_EDGES} SELECT CASE WHEN abs(edge) < 3 THEN 'low' WHEN abs(edge) < 7 THEN 'mid' ELSE 'high' END AS bucket, count(*) AS n, round(corr(edge::DOUBLE, (margin + line)::DOUBLE), 6) AS r, round(sqrt(avg((margin + line)::DOUBLE * (margin + line))), 6) AS rms, CAST(min(edge) AS BIGINT) AS least, CAST(max(edge) AS BIGINT) AS most FROM q GROUP BY 1""",
)
def edge_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Correlation and spread of outcomes by size of edge; op_M16_edge_intervals has the interval and the flag."""
    cover = (F.col("margin") + F.col("line")).cast("double")
    g = _edges(spark, d).withColumn("bucket", S.third_of(F.abs("edge"), F.lit(3), F.lit(7)))
    return g.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.corr(F.col("edge").cast("double"), cover), 6).alias("r"), F.round(F.sqrt(F.avg(cover * cover)), 6).alias("rms"), F.min("edge").alias("least"), F.max("edge").alias("most"))


@query(
    "op_M19_parity_compare",
    f"""WITH {LINES}, a AS (SELECT epoch, period, entity, CAST(sum(cents) AS BIGINT) AS v FROM lines GROUP BY ALL), b AS (SELECT epoch, period, entity, CAST(sum(cents) + max(CASE WHEN entity = 3 THEN 5 ELSE 0 END) AS BIGINT) AS v FROM lines WHERE NOT (entity = 7 AND period = 2) GROUP BY ALL), j AS (SELECT epoch, period, a.v AS av, b.v AS bv FROM a FULL JOIN b USING (epoch, period, entity))
    SELECT epoch, period, count(*) AS n, count(*) FILTER (WHERE av IS NULL OR bv IS NULL) AS unmatched, max(abs(av - bv)) AS worst, count(*) FILTER (WHERE av <> bv) AS differing FROM j GROUP BY ALL""",
)
def parity_compare(spark: SparkSession, d: str) -> DataFrame:
    """Stored rows against recomputed ones, per period."""
    x = lines(spark, d, "epoch", "period", "entity", "cents")
    a = x.groupBy("epoch", "period", "entity").agg(F.sum("cents").alias("a"))
    b = x.where("NOT (entity = 7 AND period = 2)").groupBy("epoch", "period", "entity").agg((F.sum("cents") + F.when(F.col("entity") == 3, 5).otherwise(0)).alias("b"))
    j = a.join(b, ["epoch", "period", "entity"], "full")
    return j.groupBy("epoch", "period").agg(F.count("*").alias("n"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"), F.max(F.abs(F.col("a") - F.col("b"))).alias("worst"), F.count_if(F.col("a") != F.col("b")).alias("differing"))


@query(
    "op_M23_point_in_time_backfill",
    f"""WITH {LINES}, g AS (SELECT epoch, period, entity, sum(cents)::DOUBLE AS num, sum(qty)::DOUBLE AS den FROM lines GROUP BY ALL), w AS (SELECT DISTINCT epoch, period AS w FROM g)
    SELECT w.epoch, w.w, entity, round(sum(num) / sum(den), 4) AS rate, CAST(sum(den) AS BIGINT) AS n FROM w JOIN g ON g.epoch = w.epoch AND g.period < w.w GROUP BY ALL""",
)
def backfill(spark: SparkSession, d: str) -> DataFrame:
    """Every period from its own past only, as one window over each epoch's periods."""
    g = lines(spark, d, "epoch", "period", "entity", "cents", "qty").groupBy("epoch", "period", "entity").agg(F.sum("cents").alias("num"), F.sum("qty").alias("den"))
    # An entity needs a row at every period of its epoch: its own sums, or none.
    periods = g.select("epoch", F.col("period").alias("w")).distinct()
    grid = periods.join(g.select("epoch", "entity").distinct(), "epoch")
    full = grid.join(g.withColumnRenamed("period", "w"), ["epoch", "w", "entity"], "left")
    past = Window.partitionBy("epoch", "entity").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    out = full.select("epoch", "w", "entity", F.sum("num").over(past).alias("num"), F.sum("den").over(past).alias("n")).where("n IS NOT NULL")
    return out.select("epoch", "w", "entity", F.round(F.col("num") / F.col("n"), 4).alias("rate"), "n")
