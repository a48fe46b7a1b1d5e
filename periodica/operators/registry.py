"""Metrics as data: what is summed, over what, and how it is shrunk. Wide column lists are generated from this."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    """A ratio of two sums. num and den are SQL expressions over a row; k and r shrink it; charted ones count charted rows only. A metric with a parent is a part of it, and shrinks as it does where nothing is known of its own."""

    name: str
    family: str
    num: str
    den: str
    k: float
    r: float
    charted: bool = False
    parent: str | None = None


def _count_if(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def _where(expr: str, cond: str) -> str:
    return f"CASE WHEN {cond} THEN {expr} END"


#: What each role sums over its lines, as SQL over a line. Names with `charted_` count charted lines only.
ROLES: dict[str, dict[str, str]] = {
    # What a supplier ships: volumes, what came back, terms, and how it does at the start of an order.
    "supplier": {
        "qty": "qty", "cents": "cents", "returned": _count_if("kind = 'R'"), "returned_qty": _where("qty", "kind = 'R'"), "returned_cents": _where("cents", "kind = 'R'"), "accepted": _count_if("kind = 'A'"),
        "accepted_cents": _where("cents", "kind = 'A'"), "open": _count_if("status = 'O'"), "open_qty": _where("qty", "status = 'O'"), "full": _count_if("qty >= 40"), "full_cents": _where("cents", "qty >= 40"), "small": _count_if("qty < 10"),
        "first": _count_if("step = 1"), "first_cents": _where("cents", "step = 1"), "given": "cents * disc", "given_n": _count_if("disc > 0"),
        "charted_deep": _count_if("disc >= 8"), "charted_deep_cents": _where("cents", "disc >= 8"), "charted_thin": _count_if("disc <= 1"), "charted_thin_cents": _where("cents", "disc <= 1"),
        "charted_deep_full": _count_if("disc >= 8 AND qty >= 40"), "charted_deep_returned": _count_if("disc >= 8 AND kind = 'R'"), "charted_returned": _count_if("kind = 'R'"), "charted_full": _count_if("qty >= 40"),
    },
    # What a customer buys: volumes, and three sums for each place of a line in its order.
    "customer": {
        "qty": "qty", "cents": "cents", "returned": _count_if("kind = 'R'"), "full": _count_if("qty >= 40"), "single": _count_if("qty <= 1"), "saved": "cents * disc", "dear": _count_if("cents >= 5000000"),
        **{f"n_{k}": _count_if(f"step = {k}") for k in range(1, 8)}, **{f"cents_{k}": _where("cents", f"step = {k}") for k in range(1, 8)}, **{f"full_{k}": _count_if(f"step = {k} AND qty >= 40") for k in range(1, 8)},
        "charted_deep": _count_if("disc >= 8"), "charted_deep_cents": _where("cents", "disc >= 8"), "charted_returned": _count_if("kind = 'R'"),
    },
    # How a part sells: volumes, by what became of it, and prices by the piece.
    "part": {
        "qty": "qty", "cents": "cents", "cents_n": _count_if("cents IS NOT NULL"), "full": _count_if("qty >= 40"), "deep": _count_if("disc >= 8"), "dear_piece": _count_if("cents >= qty * 150000"), "cheap_piece": _count_if("cents < qty * 100000"),
        "over": "cents - qty * 100000", "last": _count_if("step = 7"),
        **{f"n_{k}": _count_if(f"kind = '{k.upper()}'") for k in "anr"}, **{f"qty_{k}": _where("qty", f"kind = '{k.upper()}'") for k in "anr"}, **{f"cents_{k}": _where("cents", f"kind = '{k.upper()}'") for k in "anr"},
        "charted_returned": _count_if("kind = 'R'"), "charted_returned_qty": _where("qty", "kind = 'R'"), "charted_deep": _count_if("disc >= 8"), "charted_deep_qty": _where("qty", "disc >= 8"), "charted_deep_returned": _count_if("disc >= 8 AND kind = 'R'"),
        "charted_open": _count_if("status = 'O'"), "charted_open_deep": _count_if("status = 'O' AND disc >= 8"), "charted_thin": _count_if("disc <= 1"), "charted_thin_full": _count_if("disc <= 1 AND qty >= 40"), "charted_full": _count_if("qty >= 40"),
        "charted_dear_piece": _count_if("cents >= qty * 150000"), "charted_over": "cents - qty * 100000",
    },
}


def assembled(rows: DataFrame, roles: dict[str, str], keys: list[str], charted: Column) -> DataFrame:
    """One row an id over all its roles: each role's aggregates, null where it has no row in that role, in one grouping.

    `roles` maps a role to its id column. Aggregates named `charted_` count charted rows only, beside their own
    denominator `<role>_charted`; they are null where no row of the role is charted.

    Rows are shuffled once and as they are, by id and keys: a line's few columns are far less than sums of all roles, and there are few rows an id.
    Behind that, a role's sums stand in slots that the roles share, so a row goes into its own role's sums only. All rows of an id and its keys meet in one task, as a stream.
    """
    names = {role: ["rows", "charted", *ROLES[role]] for role in roles}
    slots = [f"_{i}" for i in range(max(map(len, names.values())))]
    used = [c for c in rows.columns if c not in roles.values()]

    def slot(role: str, i: int) -> Column:
        name = names[role][i] if i < len(names[role]) else None
        if name is None:
            return F.lit(None).cast("long")
        if name in ("rows", "charted"):
            return F.lit(1).cast("long") if name == "rows" else F.when(F.col("charted"), F.lit(1).cast("long"))
        value = F.coalesce(F.expr(ROLES[role][name]), F.lit(0)).cast("long")
        return F.when(F.col("charted"), value) if name.startswith("charted_") else value

    def by_role(i: int) -> Column:
        out = F.lit(None).cast("long")
        for n, role in enumerate(roles):
            out = F.when(F.col("_role") == n, slot(role, i)).otherwise(out)
        return out

    of = F.explode(F.array(*[F.struct(F.lit(n).alias("_role"), F.col(c).alias("id")) for n, c in enumerate(roles.values())]))
    tall = rows.withColumn("charted", charted).withColumn("_r", of).select(*used, "charted", "_r.*").where("id IS NOT NULL").repartition("id", *keys)
    sums = tall.select("id", *keys, "_role", *[by_role(i).alias(c) for i, c in enumerate(slots)]).groupBy("id", *keys, "_role").agg(*[F.sum(c).alias(c) for c in slots])
    each = sums.groupBy("id", *keys).agg(*[F.max(F.when(F.col("_role") == n, F.struct(*slots))).alias(f"_of_{n}") for n in range(len(roles))])
    return each.select("id", *keys, *[F.col(f"_of_{n}")[slots[i]].alias(f"{role}_{name}") for n, role in enumerate(roles) for i, name in enumerate(names[role])])


def assembled_sql(roles: dict[str, str]) -> str:
    """The aggregates of `assembled` as a select list over rows (role, id, charted, ...)."""
    out = []
    for role in roles:
        out += [f"nullif(count(*) FILTER (WHERE role = '{role}'), 0) AS {role}_rows", f"nullif(count(*) FILTER (WHERE role = '{role}' AND charted), 0) AS {role}_charted"]
        for name, expr in ROLES[role].items():
            cond = f"role = '{role}'" + (" AND charted" if name.startswith("charted_") else "")
            out.append(f"CAST(sum(CASE WHEN {cond} THEN coalesce({expr}, 0) END) AS BIGINT) AS {role}_{name}")
    return ", ".join(out)


#: Metrics of the suppliers' year: volume-weighted prices and shares, with their shrinkage by family.
METRICS = [
    Metric("price", "money", "cents", "qty", 200.0, 0.7),
    Metric("big_share", "volume", "CASE WHEN qty >= 40 THEN 1 ELSE 0 END", "1", 30.0, 0.5),
    Metric("returned_share", "volume", "CASE WHEN kind = 'R' THEN qty ELSE 0 END", "qty", 60.0, 0.4),
    Metric("deep_share", "terms", "CASE WHEN disc >= 8 THEN 1 ELSE 0 END", "1", 30.0, 0.3, True),
    Metric("open_share", "terms", "CASE WHEN status = 'O' THEN 1 ELSE 0 END", "1", 30.0, 0.2, True),
]


def sums_of(rows: DataFrame, keys: list[str], metrics: list[Metric], charted: Column) -> DataFrame:
    """Numerator and denominator of each metric per key, in one grouping."""
    aggs = []
    for m in metrics:
        counted = charted if m.charted else F.lit(True)
        aggs += [F.sum(F.when(counted, F.expr(m.num)).cast("double")).alias(f"{m.name}_num"), F.sum(F.when(counted, F.expr(m.den)).cast("double")).alias(f"{m.name}_den")]
    return rows.groupBy(*keys).agg(*aggs)


def tall(sums: DataFrame, keys: list[str], metrics: list[Metric]) -> DataFrame:
    """One row a key and metric: family, num, den, k, r."""
    one = lambda m: F.struct(F.lit(m.name).alias("metric"), F.lit(m.family).alias("family"), F.col(f"{m.name}_num").alias("num"), F.col(f"{m.name}_den").alias("den"), F.lit(m.k).alias("k"), F.lit(m.r).alias("r"))
    return sums.select(*keys, F.explode(F.array(*map(one, metrics))).alias("m")).select(*keys, "m.*")


#: The metrics above with their parts: price, full lines and returns of each kind of line, under their parents.
WITH_PARTS = METRICS + [
    Metric(f"{name}_{kind}", family, f"CASE WHEN kind = '{kind.upper()}' THEN {num} END", f"CASE WHEN kind = '{kind.upper()}' THEN {den} END", k, r, False, name)
    for name, family, num, den, k, r in (("price", "money", "cents", "qty", 200.0, 0.7), ("big_share", "volume", "CASE WHEN qty >= 40 THEN 1 ELSE 0 END", "1", 30.0, 0.5))
    for kind in "anr"
] + [Metric("full_returned_share", "volume", "CASE WHEN kind = 'R' AND qty >= 40 THEN qty ELSE 0 END", "CASE WHEN qty >= 40 THEN qty END", 60.0, 0.4, False, "returned_share")]


def resolved_shrinkage(metrics: list[Metric], known: dict[tuple[str, str], tuple[float, float]], fallback: str) -> dict[tuple[str, str], tuple[float, float]]:
    """(k, r) of every metric and cohort named in `known`: its own entry, else its parent's for that cohort, else that of the fallback cohort, else the metric's own k and r.

    Parents are resolved before their parts; an unknown parent, or a metric above itself, raises.
    """
    named, out, cohorts = {m.name: m for m in metrics}, {}, sorted({c for _, c in known} | {fallback}, key=lambda c: c != fallback)

    def resolve(name: str, cohort: str, path: tuple[str, ...]) -> tuple[float, float] | None:
        if name not in named or name in path:
            raise ValueError(f"metrics in a circle or unknown: {' > '.join([*path, name])}")
        above = named[name].parent
        inherited = None if above is None else resolve(above, cohort, (*path, name))
        return known.get((name, cohort), inherited)

    for m in metrics:
        for cohort in cohorts:  # the fallback cohort first
            found = resolve(m.name, cohort, ())
            out[m.name, cohort] = found if found is not None else out.get((m.name, fallback), (m.k, m.r))
    return out


def shrunk_by_cohort(tall: DataFrame, resolved: dict[tuple[str, str], tuple[float, float]], cohort: str, fallback: str) -> DataFrame:
    """The tall rows with k and r of their metric and cohort; a cohort that isn't in the registry, or null, takes the fallback's. The table is a literal of the plan: one entry for a metric and cohort."""
    entries = [x for (m, c), (k, r) in resolved.items() for x in (F.lit(f"{m}|{c}"), F.struct(F.lit(float(k)).alias("k"), F.lit(float(r)).alias("r")))]
    at = lambda c: F.try_element_at(F.create_map(*entries), F.concat("metric", F.lit("|"), c))
    kr = F.coalesce(at(F.col(cohort)), at(F.lit(fallback)))
    return tall.drop("k", "r").withColumn("_kr", kr).withColumns({"k": F.col("_kr.k"), "r": F.col("_kr.r")}).drop("_kr")
