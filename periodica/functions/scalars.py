"""Column expressions that operators and queries share. All are null for null arguments unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den; null where den is null or zero: no sample is not a zero."""
    return F.when(den != 0, num / den)


def cleaned(x: Column, digits: int = 6) -> Column:
    """Rounded; NaN and infinities are null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.round(x, digits))


def code_of(x: Column, aliases: dict[str, str]) -> Column:
    """Retired codes to current ones; unknown codes stay."""
    pairs = [F.lit(y) for pair in aliases.items() for y in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), x), x)


def late_exclusion(part: Column, share: Column) -> Column:
    """Whether an event counts as decided: never in parts 1 and 2, outside .02-.98 in part 3, outside .05-.95 after; null keeps it."""
    third = (share < 0.02) | (share > 0.98)
    later = (share < 0.05) | (share > 0.95)
    return F.coalesce(F.when(part <= 2, F.lit(False)).when(part == 3, third).otherwise(later), F.lit(False))


def third_of(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNull(), F.lit(None).cast("string")).when(x < low, "low").when(x < high, "mid").otherwise("high")


def blend(cur: Column, n: Column, k: float, prior: Column, discount: Column, league: Column) -> tuple[Column, Column]:
    """(value, stability): current sample, discounted prior and league share the weight 1.

    The current share is n / (n + k); the prior has the discounted rest if there is one; the league has what
    is left. Stability is the weight that isn't the league's. Both sources missing: value null, stability 0.
    """
    w_cur = F.when(cur.isNotNull(), n / (n + k)).otherwise(0.0)
    w_prior = F.when(prior.isNotNull(), (1 - w_cur) * discount).otherwise(0.0)
    value = w_cur * F.coalesce(cur, F.lit(0.0)) + w_prior * F.coalesce(prior, F.lit(0.0)) + (1 - w_cur - w_prior) * league
    return F.when(cur.isNotNull() | prior.isNotNull(), value), w_cur + w_prior


def wilson(wins: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; null without trials."""
    p, zz = wins / n, z * z
    middle, half = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return F.when(n > 0, (middle - half) / (1 + zz / n)), F.when(n > 0, (middle + half) / (1 + zz / n))


def price_chance(price: Column) -> Column:
    """Chance that an American price implies."""
    return F.when(price < 0, -price / (100 - price)).when(price > 0, 100 / (price + 100))


def implied_totals(line: Column, total: Column) -> tuple[Column, Column]:
    """Home and away scores from the home line (negative: favoured) and the total."""
    return (total - line) / 2, (total + line) / 2


def pick_result(edge: Column, margin: Column, line: Column) -> Column:
    """Outcome of backing the side of edge (positive: home) at the home line."""
    cover = margin + line
    return F.when(edge.isNull() | (edge == 0), "no_pick").when(cover == 0, "push").when(F.signum(edge) == F.signum(cover), "win").otherwise("loss")


def closing_value(edge: Column, locked: Column, close: Column) -> Column:
    """How far the line has moved toward the pick since it was locked."""
    return F.signum(edge) * (locked - close)


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    # Fixed value: the earth's radius in miles.
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 3958.8 * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def wind_parts(speed: Column, direction: Column, bearing: Column) -> tuple[Column, Column]:
    """Sizes of the components along and across a field's bearing, in degrees; below 8 mph direction is noise and both are null."""
    angle, steady = F.radians(direction - bearing), speed >= 8
    return F.when(steady, F.abs(speed * F.cos(angle))), F.when(steady, F.abs(speed * F.sin(angle)))


def zone_shift(hours: Column) -> Column:
    """Wrapped to [-12, 12)."""
    return F.pmod(hours + 12, F.lit(24)) - 12


def lead_hours(early: Column, late: Column) -> Column:
    return (F.unix_micros(late.cast("timestamp")) - F.unix_micros(early.cast("timestamp"))) / 3.6e9


def in_lambert_domain(lat: Column, lon: Column, lat0: float, lon0: float, half_width: float, half_height: float) -> Column:
    """Whether a point lies in a box, in kilometres, of a Lambert conformal grid with one standard parallel; never south of the equator."""
    import math

    radius = 6370.0  # fixed value: the sphere of the grid, in kilometres
    n = math.sin(math.radians(lat0))
    f = math.cos(math.radians(lat0)) * math.tan(math.pi / 4 + math.radians(lat0) / 2) ** n / n
    rho = radius * f / F.pow(F.tan(math.pi / 4 + F.radians(lat) / 2), n)
    rho0 = radius * f / math.tan(math.pi / 4 + math.radians(lat0) / 2) ** n
    theta = n * F.radians(zone_like(lon - lon0))
    inside = (F.abs(rho * F.sin(theta)) <= half_width) & (F.abs(rho0 - rho * F.cos(theta)) <= half_height)
    return F.when(lat <= 0, F.lit(False)).otherwise(inside)


def zone_like(degrees: Column) -> Column:
    return F.pmod(degrees + 180, F.lit(360)) - 180


def key_crossings(opened: Column, now: Column, keys: list[float]) -> Column:
    """Signed keys strictly between two lines; landing on a key is not a crossing."""
    low, high = F.least(opened, now), F.greatest(opened, now)
    return F.size(F.filter(F.array(*[F.lit(float(k)) for k in keys]), lambda k: (low < k) & (k < high))).cast("long")


def coin_tail(wins: Column, n: Column) -> Column:
    """P(at least `wins` heads in n fair tosses)."""
    return binomial_tail(wins, n, 0.5)


def against_coin(wins: Column, n: Column) -> Column:
    """How many binomial standard errors a share of wins lies above one half; null without trials."""
    return F.when(n > 0, (wins / n - 0.5) / F.sqrt(0.25 / n))


def binomial_tail(wins: Column, n: Column, p: float) -> Column:
    """P(at least `wins` successes in n trials of chance p): the first term in log space, each next one by its ratio to the one before; steps are in proportion to n."""
    import math

    wins = F.greatest(wins, F.lit(0))
    odds = math.log(p) - math.log(1 - p)
    choose = F.aggregate(F.sequence(F.lit(1), F.greatest(wins, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + F.when(i <= wins, F.log((n - wins + i) / i)).otherwise(0.0))
    first = choose + wins * math.log(p) + (n - wins) * math.log(1 - p)
    step = lambda s, k: F.struct((s.log + F.log(F.greatest(n - k, F.lit(1)) / (k + 1)) + odds).alias("log"), (s.sum + F.exp(s.log)).alias("sum"))
    tail = F.aggregate(F.sequence(wins.cast("int"), n.cast("int")), F.struct(first.alias("log"), F.lit(0.0).alias("sum")), step, lambda s: s.sum)
    return F.when(wins <= n, tail).otherwise(0.0)


def market_line(home_positive: Column) -> Column:
    """A home-positive line in market convention, where the favoured side has the negative one."""
    return -home_positive


def scaled_size(size: Column, total: Column, part: Column) -> Column:
    """The size of part of a table's rows, in megabytes, if all rows are alike; null for an empty table."""
    return F.when(total > 0, size / total * part / 1e6)


def span_years(label: Column) -> Column:
    """"2023-2025, 2027" as an array of years."""
    parts = F.filter(F.split(label, r",\s*"), lambda x: x != "")
    return F.flatten(F.transform(parts, lambda p: F.sequence(F.split(p, "-")[0].cast("int"), F.element_at(F.split(p, "-"), -1).cast("int"))))


def projected_points(own: Column, against: Column, home: bool, intercept: float = 22.5, edge: float = 1.5, own_weight: float = 3.0, against_weight: float = -2.0) -> Column:
    """Points of one side from its centred offence and the other's centred defence; null unless both are known."""
    return intercept + (edge if home else 0.0) + own_weight * own + against_weight * against


def gated_edge(projected: Column, market: Column, status: Column, book_range: Column, allowed: int = 3) -> tuple[Column, dict[str, Column]]:
    """The edge where the market's status allows one (up to `allowed`; the last of them is a look ahead only), and what qualifies it."""
    usable = status <= allowed
    edge = F.when(usable, projected - market)
    flags = {
        "lookahead_only": status == allowed,
        "single_quoter": usable & book_range.isNull(),
        "within_range": F.coalesce(F.abs(edge) <= book_range / 2, F.lit(False)),
    }
    return edge, flags
