"""N-gram Jaccard join in the metric space of shingle sets: pivots, Voronoi regions, windows, recursion.

A document's set is its distinct `width`-word shingles (A-Z lower-cased; with fewer words the whole sequence). Two link
when 100 * intersection >= percent * union. Equal sets are one point; points get ids, links, and components.
Jaccard distance and symmetric difference are both metrics here: points x, y of sizes n, m link exactly when
|x ^ y| * (100 + percent) <= (n + m) * (100 - percent).

1. Around the empty set. A point's distance to it is its size, so linked points lie in one ring of sizes or in
   neighbouring ones; each point also stands in the next ring. Shingles have a global order, rare ones first, and linked points share at
   least EXTRA of their first shingles (a tenth of a set and EXTRA more). Points that share a ring and a first shingle are a cell. Cells
   of up to LEAF points give pairs; pairs with too few meetings are dropped.
2. Larger cells take pivots: points that stand in more such cells (EXTRA at least) than any other point of these.
   Pivots within REACH of a better one give way. All pivots within REACH of a point are known to it, by an index of first shingles. A point within REACH less
   the link distance of a pivot is settled: it is dealt to the Voronoi region of the nearest one, and by the triangle inequality to
   every other region whose pivot is no more than twice the link distance further away. Other points stand in all regions of pivots known to them,
   so every link of a settled point lies in its region. What isn't settled goes on without the settled points: its cells give pairs up to
   GROWTH times the size, and larger ones take new pivots.
3. Inside a region points are written as what they have other than a centre (symmetric difference), which keeps all
   distances. The centre is what most of the region's points hold. With k and l the distances of two points from the
   centre, k + l bounds their distance from above: whoever links so, links with the point of most slack, by one comparison each. All other links
   share part of what sets them apart from the centre. So the step repeats on those differences, rare ones of the region first: cells, pairs, and for each larger
   cell a region of its own, whose centre holds what its points share. Every level takes at least one element from each point.
4. Pairs are verified by their sets; links are closed to components (pointer jumping, checkpointed rounds).

So a group of near copies costs rows in proportion to its size, not to its square, and no link is lost.

Scale: texts are read three times (a sixteenth for the order of shingles; all; those with partners). Broadcast: at most
MAX_HEAVY frequent shingles with counts, which decide speed only. No set is stored but for points with partners.

Shingles stand for themselves by 64-bit hashes, sets by 128-bit digests: equal hashes of different shingles would count as one.

Edge cases: null and empty texts and texts without words have empty sets and link with nothing, not with each other either. Repeated rows
each keep a row. A row with a null id links, but names no component unless there is no other name (then null). Rows
that share an id are told apart by their sets. Ties (pivots of equal degree: the smaller point id; equal distances: both regions) change no result. An empty table gives no rows. A very long text is one set in one worker. Columns besides id and
text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodica.llm.common import as_bytes, cut, id_text
from periodica.llm.simhash_bytes import components, shingle_set

WIDTH = 3
PERCENT = 90
#: Points of a cell whose pairs are made; common first shingles beyond the least number.
LEAF = 12
EXTRA = 4
#: How many times larger cells may give pairs after each round of pivots.
GROWTH = 4
#: Frequent shingles that the order of shingles knows, and the share of texts (one in SAMPLED) that they are counted in.
MAX_HEAVY = 1 << 20
SAMPLED = 16
#: Pivots within REACH of a point are known to it (Jaccard distance).
REACH = 0.3
#: Points on more than 1 / HOT of all rows are joined to them by broadcast.
HOT = 512
#: Rows of three short columns, and elements of pivots' sets (8 bytes each), that a broadcast may have; more are shuffled, pivots in SALTS parts.
MAX_ROWS = 200_000
#: Rows of a partition of a table that is small, or may be.
ROWS = 20_000
MAX_ELEMENTS = 8_000_000
SALTS = 16


def word_shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The set of a text: 64-bit hashes, ascending; none without words."""
    return shingle_set(text, width) if text.strip() else np.zeros(0, np.uint64)


def _ordered(s: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A set by frequency (0 if not known to be frequent), then hash."""
    keys, counts = heavy
    if not len(keys) or not len(s):
        return s
    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
    return s[np.lexsort((s, np.where(keys[at] == s, counts[at], 0)))]


def least_common(n: int, percent: int) -> int:
    """Elements that a set of n shares with each that it links with, at least."""
    return -(-percent * n // 100)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))


def _set_column(text: Column, width: int, heavy: Broadcast | None = None) -> Column:
    @F.arrow_udf("array<long>")
    def sets(texts: pa.Array) -> pa.Array:
        order = heavy.value if heavy else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return _lists([_ordered(word_shingles(t, width), order) for t in as_bytes(texts)])

    return sets(text)


def _coded_column(text: Column, width: int, percent: int, heavy: Broadcast) -> Column:
    """Size, digest and first shingles of each set."""

    @F.arrow_udf("struct<n:int,digest:binary,first:array<long>>")
    def coded(texts: pa.Array) -> pa.Array:
        sizes, digests, firsts = [], [], []
        for t in as_bytes(texts):
            s = word_shingles(t, width)
            least = least_common(len(s), percent)
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            firsts.append(_ordered(s, heavy.value)[: len(s) - least + min(EXTRA, least)])
        columns = [pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), _lists(firsts)]
        return pa.StructArray.from_arrays(columns, ["n", "digest", "first"])

    return coded(text)


def frequent_shingles(docs: DataFrame, width: int, most: int = MAX_HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, counts) of the most frequent shingles of one text in SAMPLED, `most` at most."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select(F.explode(_set_column(F.col("text"), width)).alias("s"))
    counts = cut(some.groupBy("s").count().where("count >= 4"))
    least, room = 4, most
    for r in counts.groupBy("count").agg(F.count("*").alias("rows")).orderBy(F.desc("count")).toLocalIterator():
        if r.rows > room:
            least = r["count"] + 1
            break
        room -= r.rows
    found = counts.where(F.col("count") >= least).toArrow()
    keys, n = found.column("s").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def _near(k: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether points of sizes n and m link at a symmetric difference of k."""
    return k * (100 + percent) <= (n + m) * (100 - percent)


def _cells(posted: DataFrame) -> DataFrame:
    """Postings (region, entry, v, ...) of cells that can hold a new link, with the number of their points."""
    cell = Window.partitionBy("region", "entry")
    counted = posted.withColumn("size", F.count("*").over(cell)).where("size > 1")
    return counted.withColumn("may", F.max(F.col("home") & ~F.col("star")).over(cell)).where("may").drop("may")


def _pairs(small: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs that meet often enough in small cells, and whose sizes and distances from the centre let them link."""
    other = small.select("region", "entry", *[F.col(c).alias(f"{c}2") for c in ("v", "n", "k", "need", "star", "home")])
    may = (F.col("v") < F.col("v2")) & (F.col("home") | F.col("home2")) & ~(F.col("star") & F.col("star2"))
    fits = (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) & _near(F.abs(F.col("k") - F.col("k2")), F.col("n"), F.col("n2"), percent)
    met = small.join(other, ["region", "entry"]).where(may & fits).groupBy("region", F.col("v").alias("a"), F.col("v2").alias("b"))
    return met.agg(F.count("*").alias("tally"), F.first(F.least("need", "need2")).alias("need")).where("tally >= need").select("a", "b")


def _apart(sx: Column, sp: Column) -> Column:
    """The symmetric difference of two sets."""

    @F.arrow_udf("array<long>")
    def apart(xs: pa.Array, ps: pa.Array) -> pa.Array:
        value = lambda column, i: column[i].values.to_numpy().view(np.uint64)
        return _lists([np.setxor1d(value(xs, i), value(ps, i), assume_unique=True) for i in range(len(xs))])

    return apart(sx, sp)


def _distance(k: Column, n: Column, m: Column) -> Column:
    return 2 * k / (n + m + k)


def _few(df: DataFrame) -> DataFrame:
    """Checkpointed, and in no more partitions than its rows call for: many tables of this join are small beside the documents."""
    df = cut(df)
    return df.coalesce(1 + df.count() // ROWS)


def _beside(ids: DataFrame, sets: DataFrame, key: str, name: str) -> DataFrame:
    """ids (checkpointed) with the set of the point in column key; few ids go to the sets, so that these stay where they are."""
    side = sets.select(F.col("v").alias(key), F.col("s").alias(name))
    return side.join(F.broadcast(ids) if ids.count() <= MAX_ROWS else ids, key)


def _known(pivots: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """(p, v) with sizes, difference e and Jaccard distance d: all pivots within REACH of each point. Both are (v, s), sets in the common order."""
    least = F.ceil((1 - REACH) * F.col("n") - 1e-9).cast("int")
    sized = lambda sets: sets.select("v", "s", F.size("s").alias("n")).withColumn("need", F.least(F.lit(EXTRA), least)).withColumn("most", F.col("n") - least + F.col("need"))
    first = F.explode(F.expr("slice(s, 1, most)")).alias("entry")
    ours = sized(pivots).select(F.col("v").alias("p"), F.col("need").alias("asked"), F.col("n").alias("np"), first)
    theirs = sized(points).select("v", "n", "need", first)
    fits = F.least("n", "np") >= (1 - REACH) * F.greatest("n", "np") - 1e-9
    met = ours.join(theirs, "entry").where(fits).groupBy("p", "v").agg(F.count("*").alias("tally"), F.first(F.least("need", "asked")).alias("need"))
    met = _few(met.where("tally >= need").select("p", "v"))
    rows = _few(_beside(met, points, "v", "s"))
    named = pivots.select(F.col("v").alias("p"), F.col("s").alias("sp"))
    if (named.agg(F.sum(F.size("sp"))).first()[0] or 0) <= MAX_ELEMENTS:
        joined = rows.join(F.broadcast(named), "p")
    else:
        salted = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, ["p", "salt"]).drop("salt")
    found = joined.select("p", "v", F.size("s").alias("n"), F.size("sp").alias("np"), _apart(F.col("s"), F.col("sp")).alias("e"))
    return _few(found.withColumn("d", 2 * F.size("e") / (F.col("n") + F.col("np") + F.size("e"))).where(F.col("d") <= REACH + 1e-9))


def _voronoi(hot: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The members (region, v, n, e) of the regions of pivots, for the points of large cells (region, entry, v), and the points (v) whose links all lie in these regions."""
    degree = hot.groupBy("v").agg(F.count("*").alias("degree"))
    ranked = hot.join(degree, "v").select("region", "entry", "v", F.struct("degree", (-F.col("v")).alias("low")).alias("at"))
    best = ranked.groupBy("region", "entry").agg(F.max("at").alias("best"))
    # A pivot is the best point of each of its cells, so one group gives few of them; the best point of all is always one.
    top = ranked.join(best, ["region", "entry"]).groupBy("v", "at").agg(F.max("best").alias("best"))
    pivots = _few(top.where((F.col("at") == F.col("best")) & (F.col("at.degree") >= EXTRA)).select("v", "at"))
    points = _few(_beside(_few(degree.select("v")), sets, "v", "s"))
    # Pivots within REACH of better ones give way.
    own = _few(_beside(pivots.select("v"), points, "v", "s"))
    near = _known(own, own, percent).select("p", "v").join(pivots.select("v", "at"), "v").join(pivots.toDF("p", "better"), "p")
    stay = _few(own.join(near.where("better > at").select("v").distinct(), "v", "left_anti"))
    known = _known(stay, points, percent)
    apart = 1 - percent / 100
    home = known.where(F.col("d") <= REACH - apart).groupBy("v").agg(F.min("d").alias("least"))
    dealt = known.join(home, "v", "left").where(F.col("least").isNull() | (F.col("d") <= F.col("least") + 2 * apart + 1e-9))
    return _few(dealt.select(F.col("p").alias("region"), "v", "n", "e")), _few(home.select("v"))


def _centred(members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) by distances from the centres alone, and the members (region, v, n, k, star, need, e) around them, of regions that aren't done by these."""
    size = members.groupBy("region").agg(F.count("*").alias("points"))
    held = members.select("region", F.explode("e").alias("entry")).groupBy("region", "entry").count()
    most = held.join(size, "region").where(2 * F.col("count") > F.col("points")).groupBy("region").agg(F.collect_list("entry").alias("flip"))
    moved = members.join(most, "region", "left").withColumn("flip", F.coalesce("flip", F.array().cast("array<long>")))
    around = moved.select("region", "v", "n", F.concat(F.array_except("e", "flip"), F.array_except("flip", "e")).alias("e")).withColumn("k", F.size("e"))
    slack = F.col("n") * (100 - percent) - F.col("k") * (100 + percent)
    around = _few(around.withColumn("slack", slack))
    lead = around.groupBy("region").agg(F.max(F.struct("slack", "v")).alias("lead"))
    starred = around.join(lead, "region").withColumn("star", F.col("slack") + F.col("lead.slack") >= 0)
    links = starred.where("star and v <> lead.v").select(F.col("lead.v").alias("a"), F.col("v").alias("b"))
    open_ = starred.where("not star").select("region").distinct()
    bound = F.floor((F.col("n") + F.floor(F.col("n") * 100 / percent)) * (100 - percent) / (100 + percent)).cast("int")
    least = F.greatest(F.lit(1), F.col("k") - bound)
    # One common element is asked for, not EXTRA: each more would put points into more regions below.
    left = starred.join(open_, "region", "left_semi").where("k > 0").withColumn("need", F.lit(1)).withColumn("first", F.col("k") - least + 1)
    return _few(links), left.select("region", "v", "n", "k", "star", "need", "first", "e")


def _posted(members: DataFrame) -> DataFrame:
    """Postings of each member's first elements in its region's order, rare ones first."""
    every = members.select("region", "v", F.explode("e").alias("entry"))
    counted = every.withColumn("held", F.count("*").over(Window.partitionBy("region", "entry")))
    ranked = counted.groupBy("region", "v").agg(F.sort_array(F.collect_list(F.struct("held", "entry"))).alias("order"))
    some = ranked.join(members.drop("e"), ["region", "v"]).withColumn("order", F.expr("slice(order, 1, first)"))
    return some.select("region", "v", "n", "k", "star", "need", F.lit(True).alias("home"), F.explode("order.entry").alias("entry"))


def _divided(hot: DataFrame, members: DataFrame) -> DataFrame:
    """(region, v, n, e): a region for each large cell; cells of the same points make one."""
    point = F.xxhash64("v", F.lit(7))
    named = hot.groupBy("region", "entry").agg(F.count("*").alias("c"), F.sum(point.cast("decimal(38,0)")).alias("h"), F.bit_xor(point).alias("x"))
    chosen = named.groupBy("region", "c", "h", "x").agg(F.min("entry").alias("entry")).select("region", "entry")
    inside = hot.join(chosen, ["region", "entry"]).select(F.struct("region", "entry").alias("inner"), "region", "v")
    return inside.join(members.select("region", "v", "n", "e"), ["region", "v"]).select(F.xxhash64("inner.region", "inner.entry").alias("region"), "v", "n", "e")


def _regions(members: DataFrame, percent: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Links (a, b) found inside the regions, and pairs (a, b) to be verified: the recursion."""
    found, made = [], []
    while True:
        direct, around = _centred(members, percent)
        found.append(direct)
        around = _few(around)
        cells = _few(_cells(_posted(around)))
        made.append(_few(_pairs(cells.where(F.col("size") <= LEAF), percent)))
        hot = cells.where(F.col("size") > LEAF)
        if hot.isEmpty():
            return found, made
        members = _few(_divided(hot, around))


def links(points: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int = PERCENT) -> DataFrame:
    """(a, b): links that join the same points to components as all links do. points is (v, n, first); sets_of gives (v, s) of a table (v)."""
    ring = F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("long")
    rows = points.select("v", "n", F.explode("first").alias("entry")).repartition("entry")
    rows = rows.withColumn("held", F.count("*").over(Window.partitionBy("entry"))).where("held > 1").withColumn("ring", ring)
    need = F.least(F.lit(EXTRA), F.ceil(F.col("n") * percent / 100 - 1e-9).cast("int")).alias("need")
    rings = F.explode(F.array(F.struct(F.col("ring").alias("region"), F.lit(True).alias("home")), F.struct((F.col("ring") + 1).alias("region"), F.lit(False).alias("home"))))
    posted = rows.withColumn("in", rings).select("in.region", "entry", "v", "n", F.col("n").alias("k"), need, F.lit(False).alias("star"), "in.home")
    cells, leaf = cut(_cells(posted)), LEAF
    made, found = [_few(_pairs(cells.where(F.col("size") <= leaf), percent))], []
    hot = cells.where(F.col("size") > leaf)
    wanted = _few(hot.select("v").union(made[0].select("a")).union(made[0].select("b")).distinct())
    sets = cut(sets_of(wanted).dropDuplicates(["v"]))
    while not hot.isEmpty():
        members, settled = _voronoi(hot.select("region", "entry", "v"), sets, percent)
        direct, pairs = _regions(members, percent)
        found += direct
        made += pairs
        # The rest has pairs in larger and larger cells, which hold no points of settled groups any more.
        open_ = _few(hot.select("v").distinct().join(settled, "v", "left_anti"))
        leaf *= GROWTH
        cells = _few(_cells(cells.join(F.broadcast(open_) if open_.count() <= MAX_ROWS else open_, "v", "left_semi").drop("size")))
        made.append(_few(_pairs(cells.where(F.col("size") <= leaf), percent)))
        hot = cells.where(F.col("size") > leaf)
    every = _few(reduce(DataFrame.union, made).distinct())
    both = _beside(every, sets, "a", "sa").join(sets.select(F.col("v").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    checked = both.where((100 + percent) * common >= percent * (F.size("sa") + F.size("sb"))).select("a", "b")
    return reduce(DataFrame.union, found, checked)


def join_documents(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable over links)."""
    rows = id_text(docs).select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias("of"))
    heavy = docs.sparkSession.sparkContext.broadcast(frequent_shingles(rows, width))
    coded = cut(rows.select("doc_id", "of", _coded_column(F.col("text"), width, percent, heavy).alias("c")).select("doc_id", "of", "c.*"))
    classes = coded.where("n > 0").groupBy("digest").agg(F.count("*").alias("rows"), F.min("doc_id").alias("label"), F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), "of")).alias("one"), F.first("n").alias("n"), F.first("first").alias("first"))
    points = cut(classes.withColumn("v", F.monotonically_increasing_id()))

    def sets_of(some: DataFrame) -> DataFrame:
        wanted = points.join(some, "v", "left_semi").select("v", "one.id", "one.of")
        wanted = F.broadcast(wanted) if some.count() <= MAX_ROWS else wanted
        texts = rows.select(F.coalesce("doc_id", F.lit(0)).alias("id"), "of", "text").join(wanted, ["id", "of"])
        return texts.select("v", _set_column(F.col("text"), width, heavy).alias("s"))

    edges = _few(links(points.select("v", "n", "first"), sets_of, percent))
    linked = components(edges, points.select(F.col("v").alias("fp"), "label")).select(F.col("fp").alias("v"), F.col("label").alias("low"))
    named = points.select("v", "digest", "label", "rows").join(linked, "v", "left").select("digest", F.coalesce("low", "label").alias("component_id"), "rows")
    named = cut(named)
    total = coded.count()
    # A set on a large share of all rows would be one task of a shuffled join; there are HOT of them at most.
    hot = F.broadcast(named.where(F.col("rows") * HOT > total).drop("rows"))
    full = coded.where("n > 0").select("doc_id", "n", "digest")
    rest = full.join(hot.select("digest"), "digest", "left_anti").join(named.where(F.col("rows") * HOT <= total).drop("rows"), "digest")
    joined = full.join(hot, "digest").unionByName(rest).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return joined.unionByName(coded.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))
