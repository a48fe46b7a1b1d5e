"""Rows out of nested, keyed, columnar and XML documents, and typed CSV."""

from __future__ import annotations

import zoneinfo
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUOTES = "id bigint, bookmakers array<struct<key: string, outcomes: array<struct<name: string, price: bigint>>>>"
RSS = "channel struct<item: array<struct<title: string, link: string, pubDate: string>>>, _version string"


def quotes_from_json(documents: DataFrame, column: str) -> DataFrame:
    """match, quoter, home_price, away_price, outcomes: one row a quoter."""
    d = documents.select(F.from_json(column, QUOTES).alias("d")).select(F.col("d.id").alias("match"), F.explode("d.bookmakers").alias("b"))
    o = d.select("match", F.col("b.key").alias("quoter"), F.explode("b.outcomes").alias("o"))
    price = lambda side: F.max(F.when(F.col("o.name") == side, F.col("o.price")))
    return o.groupBy("match", "quoter").agg(price("home").alias("home_price"), price("away").alias("away_price"), F.count("*").alias("outcomes"))


def keyed_entries(documents: DataFrame, column: str, fields: str) -> DataFrame:
    """id and the fields of every entry of objects keyed by id."""
    m = documents.select(F.explode(F.from_json(column, f"map<string, struct<{fields.replace(' ', ': ').replace(',: ', ', ')}>>")).alias("id", "e"))
    return m.select("id", "e.*")


def columnar_rows(documents: DataFrame, column: str, fields: str) -> DataFrame:
    """Parallel arrays as rows with their place; arrays of unequal length leave nulls."""
    d = documents.withColumn("_d", F.from_json(column, fields))
    names = [f.split()[0] for f in fields.split(", ")]
    rows = d.select(*[c for c in documents.columns if c != column], F.posexplode(F.arrays_zip(*[F.col(f"_d.{n}") for n in names])).alias("place", "z"))
    return rows.select(*[c for c in documents.columns if c != column], "place", *[F.col("z").getField(n).alias(n) for n in names])


def rss_items(documents: DataFrame, column: str) -> DataFrame:
    """Items with a title and a web link, and their time (UTC) or null; documents that aren't RSS 2.0 have none."""
    d = documents.withColumn("_d", F.from_xml(F.col(column), RSS)).where(F.col("_d._version") == "2.0")
    i = d.select(*[c for c in documents.columns if c != column], F.explode("_d.channel.item").alias("i"))
    kept = i.where(F.col("i.title").isNotNull() & F.col("i.link").rlike("^https?://"))
    return kept.select(*[c for c in documents.columns if c != column], "i.title", "i.link", F.try_to_timestamp(F.regexp_replace("i.pubDate", r"^\w{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss Z")).alias("published"))


def id_from(url: Column, patterns: list[str], fallback: Column) -> Column:
    """The first pattern's group that matches, else a synthetic id."""
    found = [F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*found, F.concat(F.lit("unmatched:"), fallback.cast("string")))


def typed_csv(spark: SparkSession, path: str, schema: str, lists: tuple[str, ...] = ()) -> DataFrame:
    """A CSV with a header, read by a fixed schema; columns in lists are split at bars."""
    df = spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")
    return df.withColumns({c: F.split(c, r"\|") for c in lists}) if lists else df


def checked_header_csv(spark: SparkSession, path: str, schema: str, lists: tuple[str, ...] = ()) -> DataFrame:
    """As `typed_csv`, but a header that isn't the schema's names in their order is refused; empty entries of lists are left out."""
    df = spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)
    return df.withColumns({c: F.filter(F.split(c, r"\|"), lambda x: x != "") for c in lists}) if lists else df


def venue_rules(bases: tuple[str, ...], kept: tuple[str, ...], roofs: tuple[str, ...]) -> dict[str, Column]:
    """Rules of a table of venues: names, coordinates and a bearing in range, codes of their sets, a bearing and its outline exactly where the basis keeps them, a zone that exists.

    The zones are the ones that Python's zone database lists.
    """
    basis, bearing = F.col("bearing_basis"), F.col("bearing")
    return {
        "names": F.size("names") > 0,
        "coordinates": F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180),
        "roof": F.col("roof").isin(*roofs),
        "basis": basis.isin(*bases),
        "bearing_range": bearing.isNull() | ((bearing >= 0) & (bearing < 180)),
        "bearing_iff_basis": basis.isin(*kept) == (bearing.isNotNull() & F.col("outline").isNotNull()),
        "zone": F.col("zone").isin(*sorted(zoneinfo.available_timezones())),
    }


def expected_hours(start: Column, hours: int) -> Column:
    """The texts (UTC, minutes, no zone) of as many hours from the one that holds the start; the session's zone is to be UTC."""
    first = F.date_trunc("hour", start)
    return F.transform(F.sequence(F.lit(0), F.lit(hours - 1)), lambda k: F.date_format(first + F.make_dt_interval(hours=k), "yyyy-MM-dd'T'HH:mm"))


def hourly_rows(documents: DataFrame, column: str, expected: Column, units: dict[str, str], required: tuple[str, ...]) -> DataFrame:
    """Hours of columnar documents, checked against what was asked for: one row an hour (hour_offset, valid_time and the variables), or one with the first fault as verdict.

    units names the variables and their units. The verdict is `malformed`, `units`, `variables` (one isn't there, or not as long as the hours), `hours` (not exactly the expected ones, in order),
    `no_data` (a null in a required variable) or `ok`; other variables may be null.
    """
    rest = [c for c in documents.columns if c != column]
    fields = "units struct<time: string, " + ", ".join(f"{v}: string" for v in units) + ">, hourly struct<time: array<string>, " + ", ".join(f"{v}: array<double>" for v in units) + ">, _broken string"
    d = documents.withColumn("_d", F.from_json(column, fields, {"columnNameOfCorruptRecord": "_broken"})).withColumn("_expected", expected)
    every = lambda conds: reduce(lambda a, b: a & b, conds)
    as_units = every([F.col(f"_d.units.{v}").eqNullSafe(F.lit(u)) for v, u in ({"time": "iso8601"} | units).items()])
    there = every([F.size(f"_d.hourly.{v}").eqNullSafe(F.size("_d.hourly.time")) & F.col(f"_d.hourly.{v}").isNotNull() for v in units])
    known = every([~F.exists(F.col(f"_d.hourly.{v}"), lambda x: x.isNull()) for v in required])
    verdict = (
        F.when(F.col("_d").isNull() | F.col("_d._broken").isNotNull(), "malformed").when(~as_units, "units").when(F.col("_d.hourly.time").isNull() | ~there, "variables")
        .when(~F.col("_d.hourly.time").eqNullSafe(F.col("_expected")), "hours").when(~known, "no_data").otherwise("ok")
    )
    zipped = F.arrays_zip(F.col("_d.hourly.time"), *[F.col(f"_d.hourly.{v}") for v in units])
    d = d.withColumn("verdict", verdict)
    rows = d.select(*rest, "verdict", F.posexplode_outer(F.when(F.col("verdict") == "ok", zipped)).alias("hour_offset", "_z"))
    return rows.select(*rest, "verdict", "hour_offset", F.col("_z.time").alias("valid_time"), *[F.col("_z").getField(v).alias(v) for v in units])


def hourly_verdicts(documents: DataFrame, column: str, variable: str, unit: str) -> DataFrame:
    """Each document's first fault, or ok, and its number of hours: a foreign unit, hours that aren't an unbroken run, a null in the variable."""
    fields = f"units struct<{variable}: string>, hourly struct<time: array<int>, {variable}: array<double>>"
    d = documents.withColumn("_d", F.from_json(column, fields))
    time, values = F.col("_d.hourly.time"), F.col(f"_d.hourly.{variable}")
    unbroken = time == F.sequence(F.array_min(time), F.array_max(time))
    verdict = F.when(~F.col(f"_d.units.{variable}").eqNullSafe(F.lit(unit)), "units").when(~F.coalesce(unbroken, F.lit(False)), "hours").when(F.exists(values, lambda v: v.isNull()), "missing").otherwise("ok")
    return d.select(*[c for c in documents.columns if c != column], verdict.alias("verdict"), F.size(time).cast("long").alias("n"))


def feed_verdicts(documents: DataFrame, column: str) -> DataFrame:
    """Each feed's reason (ok, malformed, version or empty) and, where it is ok, how many items it has, keeps and can date.

    All of it comes from the document. Malformed is what the parser can't read to its end, and null; a feed needs one item at least. A kept item has a title and a web link.
    """
    rest = [c for c in documents.columns if c != column]
    d = documents.withColumn("_d", F.from_xml(F.col(column), RSS + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    items = F.coalesce(F.col("_d.channel.item"), F.array())
    broken = F.col("_d").isNull() | F.col("_d._corrupt_record").isNotNull()
    reason = F.when(broken, "malformed").when(~F.col("_d._version").eqNullSafe(F.lit("2.0")), "version").when(F.size(items) == 0, "empty").otherwise("ok")
    kept = F.filter(items, lambda i: i.title.isNotNull() & i.link.rlike("^https?://"))
    dated = F.filter(kept, lambda i: F.try_to_timestamp(F.regexp_replace(i.pubDate, r"^\w{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss Z")).isNotNull())
    ok = reason == "ok"
    return d.select(*rest, reason.alias("reason"), *[F.when(ok, F.size(x).cast("long")).alias(n) for x, n in ((items, "items"), (kept, "kept"), (dated, "dated"))])
