"""Queries: scopes, rollups, roles, participation, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.functions import scalars as S
from periodica.operators import rollup as R
from periodica.operators.selection import quantiles
from periodica.plans.base import LINES, USER_DAYS, lines, query, table, user_days

_LATE = """(CASE WHEN step <= 2 THEN false WHEN step = 3 THEN (disc < 2 OR disc > 8) ELSE (disc < 1 OR disc > 9) END)"""


@query(
    "op_A2_entity_match_rollup",
    f"""WITH {LINES}, e AS (SELECT *, {_LATE} AS late FROM lines)
    SELECT epoch, period, entity, counterparty, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total,
      {", ".join(f"count(*) FILTER (WHERE {c}) AS n_{n}, CAST(coalesce(sum(cents) FILTER (WHERE {c}), 0) AS BIGINT) AS total_{n}" for n, c in {"A": "kind = 'A'", "N": "kind = 'N'", "R": "kind = 'R'", "s1": "step = 1", "s2": "step = 2", "s3": "step = 3", "s4": "step = 4", "late": "late"}.items())}
    FROM e GROUP BY ALL""",
)
def entity_match_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Conditional counts and sums by kind and step, with the decided events beside them."""
    late = F.when(F.col("step") <= 2, False).when(F.col("step") == 3, (F.col("disc") < 2) | (F.col("disc") > 8)).otherwise((F.col("disc") < 1) | (F.col("disc") > 9))
    splits = {k: F.col("kind") == k for k in "ANR"} | {f"s{i}": F.col("step") == i for i in range(1, 5)} | {"late": late}
    return R.split_rollup(lines(spark, d), ["epoch", "period", "entity", "counterparty"], "cents", splits)


@query(
    "op_A3_segment_rollup",
    f"""WITH {LINES}, seg AS (SELECT segment, entity, epoch, count(*) AS size, max(cents) AS most, arg_min(cents, (step, cents)) AS first, max((cents > 3000000)::INT) AS over FROM lines GROUP BY ALL)
    SELECT entity, epoch, count(*) AS segments, CAST(sum(size) AS BIGINT) AS events, count(*) FILTER (WHERE size <= 3) AS short, CAST(sum(over) AS BIGINT) AS over, CAST(sum(most) AS BIGINT) AS sum_most, CAST(sum(first) AS BIGINT) AS sum_first FROM seg GROUP BY ALL""",
)
def segment_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A3: orders as segments, then counts per entity and epoch."""
    return R.segment_rollup(lines(spark, d), ["segment"], ["entity", "epoch"], "step", "cents", 3_000_000)


@query(
    "op_A5_role_assembly",
    f"""WITH {LINES}, t AS (SELECT epoch, cents, 'supplier' AS role, supp AS identity FROM lines UNION ALL SELECT epoch, cents, 'customer', cust FROM lines UNION ALL SELECT epoch, cents, 'part', part FROM lines)
    SELECT identity, epoch, {", ".join(f"nullif(count(*) FILTER (WHERE role = '{r}'), 0) AS n_{r}, CAST(sum(cents) FILTER (WHERE role = '{r}') AS BIGINT) AS total_{r}" for r in ("supplier", "customer", "part"))}
    FROM t GROUP BY ALL""",
)
def role_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Three roles of one event frame in one grouping."""
    return R.role_rollup(lines(spark, d, "supp", "cust", "part", "epoch", "cents"), {"supplier": "supp", "customer": "cust", "part": "part"}, ["epoch"], "cents")


@query(
    "op_A6_participation",
    """WITH m AS (SELECT p_partkey, p_brand AS label, unnest(list_distinct(list_filter(list_transform(string_split(p_name, ' '), lambda x: trim(x)), lambda x: x <> ''))) AS member FROM part)
    SELECT member, label, count(*) AS n FROM m GROUP BY ALL""",
)
def participation(spark: SparkSession, d: str) -> DataFrame:
    """Members of a delimited list counted by label, each once a row."""
    return R.listed_counts(table(spark, d, "part"), ["p_partkey"], F.split("p_name", " "), F.col("p_brand"))


@query(
    "op_A7_stacked_variants",
    """SELECT variant, count(*) AS n, count(c_acctbal) AS with_balance, count(s_suppkey) AS with_supplier FROM (
      SELECT 'customer' AS variant, c_acctbal, NULL AS s_suppkey FROM customer UNION ALL SELECT 'supplier', NULL, s_suppkey FROM supplier) GROUP BY ALL""",
)
def stacked_variants(spark: SparkSession, d: str) -> DataFrame:
    """Typed frames under each other."""
    frames = {"customer": table(spark, d, "customer").select("c_custkey", "c_acctbal"), "supplier": table(spark, d, "supplier").select("s_suppkey")}
    return R.stacked(frames).groupBy("variant").agg(F.count("*").alias("n"), F.count("c_acctbal").alias("with_balance"), F.count("s_suppkey").alias("with_supplier"))


@query(
    "op_A10_pooled_rate",
    f"""WITH {LINES} SELECT epoch, kind, CAST(sum(cents) AS BIGINT) AS num, CAST(sum(qty) AS BIGINT) AS den, round(sum(cents)::DOUBLE / sum(qty), 6) AS rate FROM lines GROUP BY ALL""",
)
def pooled_rate(spark: SparkSession, d: str) -> DataFrame:
    """Ratio of sums over the league."""
    g = lines(spark, d, "epoch", "kind", "cents", "qty").groupBy("epoch", "kind").agg(F.sum("cents").alias("num"), F.sum("qty").alias("den"))
    return g.withColumn("rate", F.round(S.ratio(F.col("num"), F.col("den")), 6))


@query(
    "op_A12_top_k",
    f"""WITH {LINES}, g AS (SELECT epoch, entity, cust, CAST(sum(qty) AS BIGINT) AS volume FROM lines GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY epoch, entity ORDER BY volume DESC, cust) AS INTEGER) AS rank FROM g) SELECT * FROM r WHERE rank <= 5""",
)
def top_customers(spark: SparkSession, d: str) -> DataFrame:
    """Five largest customers of each entity and epoch, ties by id."""
    g = lines(spark, d, "epoch", "entity", "cust", "qty").groupBy("epoch", "entity", "cust").agg(F.sum("qty").alias("volume"))
    return R.top_k(g, ["epoch", "entity"], "volume", "cust", 5)


@query(
    "op_A14_modal_value",
    f"""WITH {LINES}, c AS (SELECT entity, epoch, disc, count(*) AS n FROM lines GROUP BY ALL), b AS (SELECT *, max(n) OVER (PARTITION BY entity, epoch) AS best FROM c)
    SELECT entity, epoch, CASE WHEN count(*) = 1 THEN min(disc) END AS disc, n, count(*) > 1 AS tied FROM b WHERE n = best GROUP BY entity, epoch, n""",
)
def modal_discount(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent value; a tie is reported, not broken."""
    return R.modal_value(lines(spark, d, "entity", "epoch", "disc"), ["entity", "epoch"], "disc")


@query(
    "op_A18_error_metrics",
    f"""WITH {LINES}, e AS (SELECT epoch, (qty * 100000 - cents)::DOUBLE AS e FROM lines)
    SELECT epoch, count(*) AS n, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(e), 4) AS bias FROM e GROUP BY ALL""",
)
def error_metrics(spark: SparkSession, d: str) -> DataFrame:
    """MAE, RMSE and bias."""
    return R.error_metrics(lines(spark, d, "epoch", "qty", "cents"), ["epoch"], (F.col("qty") * 100000).cast("double"), F.col("cents").cast("double"))


@query("op_A22_histogram", "WITH b AS (SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS bin, count(*) AS n FROM orders GROUP BY 1) SELECT bin, n, round(n / sum(n) OVER ()::DOUBLE, 6) AS share FROM b")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    """Share of rows in each [low, high) bin; the total is one row, joined as a scalar."""
    orders = table(spark, d, "orders")
    bins = orders.groupBy(F.floor(F.col("o_totalprice") / 50000).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return bins.withColumn("share", F.round(F.col("n") / orders.agg(F.count("*")).scalar(), 6))


@query(
    "op_A23_year_spans",
    f"""WITH {LINES}, y AS (SELECT DISTINCT supp, part % 7 AS lane, epoch FROM lines WHERE disc = 10), r AS (SELECT *, epoch - row_number() OVER (PARTITION BY supp, lane ORDER BY epoch) AS run FROM y),
    s AS (SELECT supp, lane, min(epoch) AS a, max(epoch) AS b FROM r GROUP BY supp, lane, run)
    SELECT supp, lane, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS span FROM s GROUP BY supp, lane""",
)
def year_spans(spark: SparkSession, d: str) -> DataFrame:
    """Gaps and islands as text."""
    rows = lines(spark, d).where("disc = 10").select("supp", (F.col("part") % 7).alias("lane"), "epoch")
    return R.run_labels(rows, ["supp", "lane"], "epoch")


@query(
    "op_A26_filter_funnel",
    f"""WITH {LINES} SELECT entity, epoch, count(*) AS n_all, count(*) FILTER (WHERE kind <> 'N') AS n_kind, count(*) FILTER (WHERE kind <> 'N' AND disc > 2) AS n_disc, count(*) FILTER (WHERE kind <> 'N' AND disc > 2 AND qty >= 25) AS n_qty FROM lines GROUP BY ALL""",
)
def filter_funnel(spark: SparkSession, d: str) -> DataFrame:
    """How many rows pass each predicate and all before."""
    return R.funnel(lines(spark, d), ["entity", "epoch"], {"kind": F.col("kind") != "N", "disc": F.col("disc") > 2, "qty": F.col("qty") >= 25})


@query(
    "op_A28_nested_maps",
    """SELECT user_id, string_agg(event_type || '=' || n, ';' ORDER BY event_type) AS packed FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""",
)
def nested_maps(spark: SparkSession, d: str) -> DataFrame:
    """Tall rows to a map per entity, shown in key order."""
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return g.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e.key, e.value.cast("string"))), ";").alias("packed"))


@query(
    "op_A24_history_sums",
    f"""WITH {LINES} SELECT supp, CAST(sum(cents) FILTER (WHERE kind = 'A') AS BIGINT) AS num_a, nullif(count(*) FILTER (WHERE kind = 'A'), 0) AS n_a,
      round(sum(cents) FILTER (WHERE kind = 'A')::DOUBLE / nullif(count(*) FILTER (WHERE kind = 'A'), 0), 6) AS rate_a FROM lines WHERE epoch BETWEEN 1997 AND 1999 GROUP BY supp""",
)
def history_sums(spark: SparkSession, d: str) -> DataFrame:
    """Sums over three completed epochs; the count is null, not 0, without events."""
    a = F.col("kind") == "A"
    g = lines(spark, d, "supp", "epoch", "kind", "cents").where(F.col("epoch").between(1997, 1999)).groupBy("supp").agg(F.sum(F.when(a, F.col("cents"))).alias("num_a"), F.count_if(a).alias("n_a"))
    return g.select("supp", "num_a", F.nullif("n_a", F.lit(0)).alias("n_a"), F.round(S.ratio(F.col("num_a"), F.col("n_a")), 6).alias("rate_a"))


@query(
    "op_A19_cutpoints",
    f"WITH {USER_DAYS} SELECT cohort, round(quantile_cont(num::DOUBLE / den, 1.0 / 3), 6) AS low, round(quantile_cont(num::DOUBLE / den, 2.0 / 3), 6) AS high FROM user_days GROUP BY cohort",
)
def cutpoints(spark: SparkSession, d: str) -> DataFrame:
    """Exact terciles with linear interpolation, by selection: a cohort is a fifth of all rows."""
    p = quantiles(user_days(spark, d).withColumn("rate", F.col("num") / F.col("den")), ["cohort"], "rate", [1 / 3, 2 / 3])
    return p.select("cohort", F.round("q0", 6).alias("low"), F.round("q1", 6).alias("high"))


@query(
    "op_A20_slice_summary",
    f"""WITH {LINES}, s AS (SELECT qty, disc, unnest(CASE WHEN kind = 'N' THEN ['all', 'epoch:' || epoch, 'open'] ELSE ['all', 'epoch:' || epoch] END) AS slice FROM lines)
    SELECT slice, count(*) AS n, round(avg(qty), 6) AS mean_qty, count(*) FILTER (WHERE disc >= 5) AS wins, round(avg((disc >= 5)::INT), 6) AS rate, count(*) >= 50 AS enough FROM s GROUP BY slice""",
)
def slice_summary(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping slices by exploding each row to its labels, then one grouping."""
    labels = F.array_compact(F.array(F.lit("all"), F.concat(F.lit("epoch:"), F.col("epoch").cast("string")), F.when(F.col("kind") == "N", "open")))
    s = lines(spark, d).select("qty", (F.col("disc") >= 5).cast("int").alias("win"), F.explode(labels).alias("slice"))
    return s.groupBy("slice").agg(F.count("*").alias("n"), F.round(F.avg("qty"), 6).alias("mean_qty"), F.sum("win").alias("wins"), F.round(F.avg("win"), 6).alias("rate"), (F.count("*") >= 50).alias("enough"))


@query(
    "op_F2_code_aliases",
    """SELECT coalesce(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'MACHINERY' WHEN 'HOUSEHOLD' THEN 'FURNITURE' END, c_mktsegment) AS code, count(*) AS n FROM customer GROUP BY 1""",
)
def code_aliases(spark: SparkSession, d: str) -> DataFrame:
    """retired codes to current ones."""
    return table(spark, d, "customer").groupBy(S.code_of(F.col("c_mktsegment"), {"AUTOMOBILE": "MACHINERY", "HOUSEHOLD": "FURNITURE"}).alias("code")).agg(F.count("*").alias("n"))


@query(
    "op_F5_threshold_flags",
    f"""WITH {LINES} SELECT epoch, kind, count(*) FILTER (WHERE (kind = 'A' AND qty >= 40) OR (kind = 'R' AND qty >= 20)) AS explosive, count(*) AS n FROM lines GROUP BY ALL""",
)
def threshold_flags(spark: SparkSession, d: str) -> DataFrame:
    """a threshold that depends on the type; other types are false."""
    flag = F.coalesce(F.when(F.col("kind") == "A", F.col("qty") >= 40).when(F.col("kind") == "R", F.col("qty") >= 20), F.lit(False))
    return lines(spark, d, "epoch", "kind", "qty").groupBy("epoch", "kind").agg(F.count_if(flag).alias("explosive"), F.count("*").alias("n"))


@query(
    "op_F11_uniqueness_guard",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def uniqueness_guard(spark: SparkSession, d: str) -> DataFrame:
    """the keys that occur more than once."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies")).where("copies > 1")


@query(
    "op_F9_unknown_labels",
    """SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' END AS label, c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AS unknown, count(*) AS n,
    string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS codes FROM customer GROUP BY 1, 2""",
)
def unknown_labels(spark: SparkSession, d: str) -> DataFrame:
    """mapped labels, and what the map doesn't know."""
    c = F.col("c_mktsegment")
    label = F.when(c == "BUILDING", "b").when(c == "MACHINERY", "m")
    return table(spark, d, "customer").groupBy(label.alias("label"), (~c.isin("BUILDING", "MACHINERY")).alias("unknown")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(c)), ",").alias("codes"))
