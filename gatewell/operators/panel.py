"""Point queries over the cube: a window's activity against its baseline, escalated while the base is thin; peaks, strips and mixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatewell.operators.baseline import DAYS_SQL, matched_baseline, window3
from gatewell.operators.cube import ISSUERS, code_axis, compact, cube_cells, nat_cells
from gatewell.operators.gates import _cells, gates_at, joined
from gatewell.functions.scalar import local_time
from gatewell.operators.hierarchy import _A, addresses, sectors
from gatewell.operators.summary import _EV, city_events, event_hours
from gatewell.session import stored
from gatewell.sources.adapters import SENTINEL, tx_time

THIN = 12


def win_stats(tx: DataFrame) -> DataFrame:
    """For each area, day and hour: three-hour activity and its base, of the area, or while the base is thin of its five codes, its ten, and at last the city; the parents climbed to
    (hops; the city is no parent), how far activity is off, with a band, and the excess over the city."""
    rows = compact(tx)
    at = Window.partitionBy("ci").orderBy("t").rowsBetween(-1, 1)
    both = matched_baseline(rows).withColumn("t", F.col("di") * 24 + F.col("h")).withColumns({"n3": F.sum("n").over(at), "b3": F.when(F.count("base").over(at) == F.count("n").over(at), F.sum("base").over(at))})
    tens = F.substring("code", 1, 5)
    axis = code_axis(rows).filter("ci >= 1").select("ci", tens.alias("tens"), F.concat(tens, F.when(F.substring("code", 6, 1).cast("int") < 5, "a").otherwise("b")).alias("fives"))
    x = both.join(axis, "ci")
    for level, keys in (("fives", ["fives"]), ("tens", ["tens"]), ("city", [])):
        w = Window.partitionBy("di", "h", *keys)  # an hour has as many rows as there are areas
        x = x.withColumns({f"{level}_n": F.sum("n3").over(w), f"{level}_b": F.when(F.count("b3").over(w) == F.count("*").over(w), F.sum("b3").over(w))})
    x = x.filter("b3 is not null and city_b > 0")
    enough = [(F.col("b3") >= THIN, "area", 0, "n3", "b3"), (F.col("fives_b") >= THIN, "fives", 1, "fives_n", "fives_b"), (F.col("tens_b") >= THIN, "tens", 2, "tens_n", "tens_b"), (F.lit(True), "city", 2, "city_n", "city_b")]
    source, hops, n, b = (F.coalesce(*[F.when(e[0], F.col(e[i]) if i > 2 else F.lit(e[i])) for e in enough]) for i in range(1, 5))
    rel, city_rel = n / b - 1, F.col("city_n") / F.col("city_b") - 1
    force = F.greatest(F.lit(-100.0), F.least(F.lit(100.0), (rel - city_rel) * 100 * F.least(F.lit(1.0), b / 30)))
    return x.select("ci", "di", "h", source.alias("source"), hops.alias("hops"), F.round(rel, 6).alias("rel"), F.round(F.least(F.lit(1.5), 1.96 / F.sqrt(b)), 6).alias("band"), F.round(force, 6).alias("force"))


def hourly_profile(tx: DataFrame) -> DataFrame:
    """Local hours by volume, with the share of 11 to 15 and the peak (of equal ones the first); all of it again (known) without the rows of the unknown time, which fall into one hour of each day."""
    hours = tx.groupBy(F.hour(local_time(F.col("day"), F.col("tm"))).alias("h")).agg(F.count("*").alias("n"), F.count_if(F.col("tm") != SENTINEL).alias("known"))
    of = lambda c: [F.round(F.try_divide(F.sum(F.when(F.col("h").between(11, 15), F.col(c))), F.sum(c)), 6).alias(f"{c}_share"), F.max_by("h", F.struct(c, -F.col("h"))).alias(f"{c}_peak")]
    return hours.crossJoin(F.broadcast(hours.agg(*of("n"), *of("known"))))  # one row


def top_area(tx: DataFrame) -> DataFrame:
    """Each day's largest area and its share; of equal ones the first."""
    days = cube_cells(tx).filter("ci >= 1").groupBy("di", "ci").agg(F.sum("n").alias("n"))
    return days.groupBy("di").agg(F.max_by("ci", F.struct("n", -F.col("ci"))).alias("ci"), F.max("n").alias("n"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


def day_strip(tx: DataFrame) -> DataFrame:
    """Each area's day with the days before and after."""
    days = cube_cells(tx).groupBy("ci", "di").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("ci").orderBy("di")
    return days.select("ci", "di", "n", F.lag("n").over(w).alias("before"), F.lead("n").over(w).alias("after"))


def issuer_mix(tx: DataFrame) -> DataFrame:
    """Each bucket's share of each day, in basis points rounded down."""
    days = nat_cells(tx).groupBy("di", "bucket").agg(F.sum("n").alias("n"))
    return days.select("di", "bucket", "n", F.floor(F.col("n") * 10000 / F.sum("n").over(Window.partitionBy("di"))).cast("long").alias("basis_points"))


def hierarchy_rollup(tx: DataFrame) -> DataFrame:
    """Areas, their tens and the city in one aggregate by grouping sets; cards are counted anew at every level."""
    t = tx.filter(F.col("pc").startswith("81-")).withColumn("tens", F.substring("pc", 1, 5))
    out = t.groupingSets([["pc", "tens"], ["tens"], []], "pc", "tens").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.countDistinct("card").alias("cards"))
    return out.select(F.when(F.col("g") == 0, "area").when(F.col("g") == 2, "tens").otherwise("city").alias("level"), F.coalesce("pc", "tens", F.lit("all")).alias("unit"), "n", "cards")


def readable_source(tx: DataFrame) -> DataFrame:
    """For each area the nearest level that may be shown, of area, tens and city, and its volume shared out over the codes it stands for; null if none may be."""
    t = tx.filter(F.col("pc").startswith("81-")).withColumn("tens", F.substring("pc", 1, 5))
    # one pass for the three levels; what is stored are cells
    cells = stored(gates_at(t, {"area": ["pc"], "tens": ["tens"], "city": []}, asked=["pc", "tens"]), "cells")
    level = lambda grain, name: cells.filter(F.col("level") == name).select(*grain, F.col("ok").alias(f"{name}_ok"), F.col("n_tx").alias(f"{name}_n"))
    codes = cells.filter("level = 'asked'").select("pc", "tens")
    sizes = codes.groupBy("tens").agg(F.count("*").alias("tens_codes"))
    city = joined(level([], "city"), codes.agg(F.count("*").alias("city_codes")), [])
    x = joined(codes.join(level(["pc"], "area"), "pc").join(level(["tens"], "tens"), "tens").join(sizes, "tens"), city, [])
    pick = lambda a, b, c: F.when(F.col("area_ok"), a).when(F.col("tens_ok"), b).when(F.col("city_ok"), c)
    share = pick(F.col("area_n").cast("double"), F.col("tens_n") / F.col("tens_codes"), F.col("city_n") / F.col("city_codes"))
    return x.select("pc", pick(F.lit("area"), F.lit("tens"), F.lit("city")).alias("source"), F.round(share, 6).alias("volume"))


def attribute_share(tx: DataFrame, attributes: DataFrame, least: float = 0.3) -> DataFrame:
    """Each day's share of volume in areas whose attribute of (code, value), as the share of their shore that is beach, is at least `least`, and that share of the base, on days that have one; an area without the attribute doesn't count."""
    rows = compact(tx)
    held = code_axis(rows).join(attributes.filter(F.col("value") >= least), "code", "left_semi").select("ci", F.lit(True).alias("held"))
    cells = matched_baseline(rows).filter("ci >= 1").join(held, "ci", "left")
    share = lambda c: F.try_divide(F.sum(F.when(F.col("held"), F.col(c)).otherwise(0)), F.sum(c))
    return cells.groupBy("di").agg(F.sum("n").alias("n"), F.round(share("n"), 6).alias("share"), F.round(F.when(F.count("base") == F.count("*"), share("base")), 6).alias("base_share"))


def area_uplift(tx: DataFrame) -> DataFrame:
    """How far each area's day is off its base, less how far the city is off its own; days of areas whose every hour has a base count."""
    days = matched_baseline(tx).filter("ci >= 1").groupBy("ci", "di").agg(F.sum("n").alias("n"), F.when(F.count("base") == F.count("*"), F.sum("base")).alias("base")).filter("base > 0")
    city = Window.partitionBy("di")
    rel = lambda n, b: n / b - 1
    return days.select("ci", "di", F.round(rel(F.col("n"), F.col("base")), 6).alias("rel"), F.round(rel(F.col("n"), F.col("base")) - rel(F.sum("n").over(city), F.sum("base").over(city)), 6).alias("over_city"))


def event_uplift(tx: DataFrame, events: DataFrame) -> DataFrame:
    """The city's activity over its base within each event's window, from an hour before the start to the end, as a ratio and in whole percents; 0 without a base."""
    city = matched_baseline(tx).filter("ci >= 1").groupBy("di", "h").agg(F.sum("n").alias("n"), F.when(F.count("base") == F.count("*"), F.sum("base")).alias("base"))
    held = event_hours(events).select("event", "di", "h").join(city, ["di", "h"], "left").groupBy("event").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("base"), F.lit(0.0)).alias("base"))
    uplift = F.coalesce(F.try_divide("n", "base") - 1, F.lit(0.0))
    return held.select("event", "n", F.round("base", 6).alias("base"), F.round(uplift, 6).alias("uplift"), F.floor(F.round(uplift, 9) * 100 + 0.5).cast("long").alias("percent"))


def events_for(uplifts: DataFrame, least: int) -> DataFrame:
    """The events whose uplift is at least so many percents."""
    return uplifts.filter(F.col("percent") >= least)


def interpolated(tx: DataFrame) -> DataFrame:
    """Activity at half past each hour, between the hour and the next."""
    w = Window.partitionBy("ci").orderBy(F.col("di") * 24 + F.col("h"))
    return window3(tx).select("ci", "di", "h", ((F.col("n3") + F.coalesce(F.lead("n3").over(w), F.col("n3"))) / 2).alias("half"))


def _q(f):
    return lambda spark, sf_dir: f(tx_time(spark, sf_dir))


QUERIES = {k: _q(f) for k, f in {
    "win_stats": win_stats, "hourly_profile": hourly_profile, "top_area": top_area, "day_strip": day_strip, "issuer_mix": issuer_mix,
    "hierarchy_rollup": hierarchy_rollup, "readable_source": readable_source, "area_uplift": area_uplift, "interpolated": interpolated,
}.items()}


def _shore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sectors(addresses(spark, sf_dir)).select("code", F.col("shore").alias("value"))


QUERIES |= {
    "attribute_share": lambda spark, sf_dir: attribute_share(tx_time(spark, sf_dir), _shore(spark, sf_dir), 0.5),
    "event_uplift": lambda spark, sf_dir: event_uplift(tx_time(spark, sf_dir), city_events(spark, sf_dir)),
    "events_for": lambda spark, sf_dir: events_for(event_uplift(tx_time(spark, sf_dir), city_events(spark, sf_dir)), 2),
}

_W = f"WITH {DAYS_SQL}"
_BUCKET = "CASE issuer " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(ISSUERS)) + " ELSE 5 END"
_UP = f"""{_W}, {_EV}, c AS (SELECT di, h, sum(n) AS n, CASE WHEN count(base) = count(*) THEN sum(base) END AS base FROM matched WHERE ci >= 1 GROUP BY di, h), f AS (SELECT event, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, coalesce(sum(base), 0) AS base FROM eh LEFT JOIN c USING (di, h) GROUP BY event),
      up AS (SELECT event, n, round(base, 6) AS base, round(CASE WHEN base > 0 THEN n / base - 1 ELSE 0 END, 6) AS uplift, CAST(floor(round(CASE WHEN base > 0 THEN n / base - 1 ELSE 0 END, 9) * 100 + 0.5) AS BIGINT) AS percent FROM f)"""
ORACLES = {
    "win_stats": f"""{_W}, b AS (SELECT ci, di, h, sum(n) OVER t AS n3, CASE WHEN count(base) OVER t = count(*) OVER t THEN sum(base) OVER t END AS b3 FROM matched WINDOW t AS (PARTITION BY ci ORDER BY di * 24 + h ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
      k AS (SELECT b.*, substr(code, 1, 5) AS tens, substr(code, 1, 5) || CASE WHEN substr(code, 6, 1)::INT < 5 THEN 'a' ELSE 'b' END AS fives FROM b JOIN axis USING (ci) WHERE ci >= 1),
      u AS (SELECT *, sum(n3) OVER f AS fn, CASE WHEN count(b3) OVER f = count(*) OVER f THEN sum(b3) OVER f END AS fb, sum(n3) OVER t AS tn, CASE WHEN count(b3) OVER t = count(*) OVER t THEN sum(b3) OVER t END AS tb, sum(n3) OVER c AS cn, CASE WHEN count(b3) OVER c = count(*) OVER c THEN sum(b3) OVER c END AS cb
        FROM k WINDOW f AS (PARTITION BY di, h, fives), t AS (PARTITION BY di, h, tens), c AS (PARTITION BY di, h)),
      s AS (SELECT ci, di, h, CASE WHEN b3 >= 12 THEN 'area' WHEN fb >= 12 THEN 'fives' WHEN tb >= 12 THEN 'tens' ELSE 'city' END AS source, CAST(CASE WHEN b3 >= 12 THEN 0 WHEN fb >= 12 THEN 1 ELSE 2 END AS INTEGER) AS hops,
        CAST(CASE WHEN b3 >= 12 THEN n3 WHEN fb >= 12 THEN fn WHEN tb >= 12 THEN tn ELSE cn END AS DOUBLE) AS n, CASE WHEN b3 >= 12 THEN b3 WHEN fb >= 12 THEN fb WHEN tb >= 12 THEN tb ELSE cb END AS b, CAST(cn AS DOUBLE) / cb - 1 AS city_rel FROM u WHERE b3 IS NOT NULL AND cb > 0)
      SELECT ci, di, h, source, hops, round(n / b - 1, 6) AS rel, round(least(1.5, 1.96 / sqrt(b)), 6) AS band, round(greatest(-100.0, least(100.0, (n / b - 1 - city_rel) * 100 * least(1.0, b / 30))), 6) AS force FROM s""",
    "readable_source": f"""{_W}, tx AS (SELECT *, substr(pc, 1, 5) AS tens FROM tx_time WHERE pc LIKE '81-%'),
      own AS (SELECT * FROM (WITH {_cells('pc').lstrip()} SELECT pc, ok AS area_ok, n_tx AS area_n FROM g)), up AS (SELECT * FROM (WITH {_cells('tens').lstrip()} SELECT tens, ok AS tens_ok, n_tx AS tens_n FROM g)),
      top AS (SELECT * FROM (WITH {_cells('').lstrip()} SELECT ok AS city_ok, n_tx AS city_n FROM g)), k AS (SELECT pc, tens, count(*) OVER (PARTITION BY tens) AS tens_codes, count(*) OVER () AS city_codes FROM (SELECT DISTINCT pc, tens FROM tx))
      SELECT pc, CASE WHEN area_ok THEN 'area' WHEN tens_ok THEN 'tens' WHEN city_ok THEN 'city' END AS source,
        round(CASE WHEN area_ok THEN area_n::DOUBLE WHEN tens_ok THEN tens_n / tens_codes::DOUBLE WHEN city_ok THEN city_n / city_codes::DOUBLE END, 6) AS volume FROM k JOIN own USING (pc) JOIN up USING (tens), top""",
    "attribute_share": f"""{_A}, {_W[5:]}, b AS (SELECT m.di, m.n, m.base, coalesce(shore >= 0.5, false) AS held FROM matched m JOIN axis USING (ci) LEFT JOIN s USING (code) WHERE ci >= 1)
      SELECT di, CAST(sum(n) AS BIGINT) AS n, round(coalesce(sum(n) FILTER (WHERE held), 0) / CAST(sum(n) AS DOUBLE), 6) AS share, CASE WHEN count(base) = count(*) AND sum(base) <> 0 THEN round(coalesce(sum(base) FILTER (WHERE held), 0) / sum(base), 6) END AS base_share FROM b GROUP BY di""",
    "area_uplift": f"""{_W}, d AS (SELECT ci, di, sum(n)::DOUBLE AS n, CASE WHEN count(base) = count(*) THEN sum(base) END AS base FROM matched WHERE ci >= 1 GROUP BY ci, di), e AS (SELECT * FROM d WHERE base > 0)
      SELECT ci, di, round(n / base - 1, 6) AS rel, round(n / base - sum(n) OVER (PARTITION BY di) / sum(base) OVER (PARTITION BY di), 6) AS over_city FROM e""",
    "hourly_profile": f"""{_W}, x AS (SELECT h, count(*) AS n, count(*) FILTER (WHERE tm <> '000000') AS known FROM placed GROUP BY h)
      SELECT h, n, known, round((SELECT sum(n) FROM x WHERE h BETWEEN 11 AND 15) / (SELECT CAST(sum(n) AS DOUBLE) FROM x), 6) AS n_share, (SELECT h FROM x ORDER BY n DESC, h LIMIT 1) AS n_peak,
        round((SELECT sum(known) FROM x WHERE h BETWEEN 11 AND 15) / (SELECT CAST(sum(known) AS DOUBLE) FROM x), 6) AS known_share, (SELECT h FROM x ORDER BY known DESC, h LIMIT 1) AS known_peak FROM x""",
    "top_area": f"{_W}, x AS (SELECT di, ci, CAST(sum(n) AS BIGINT) AS n FROM cells WHERE ci >= 1 GROUP BY di, ci), r AS (SELECT *, row_number() OVER (PARTITION BY di ORDER BY n DESC, ci) AS r, sum(n) OVER (PARTITION BY di) AS t FROM x) SELECT di, ci, n, round(n / CAST(t AS DOUBLE), 6) AS share FROM r WHERE r = 1",
    "day_strip": f"{_W}, x AS (SELECT ci, di, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY ci, di) SELECT ci, di, n, lag(n) OVER w AS before, lead(n) OVER w AS after FROM x WINDOW w AS (PARTITION BY ci ORDER BY di)",
    "issuer_mix": f"{_W}, x AS (SELECT di, {_BUCKET} AS bucket, count(*) AS n FROM placed GROUP BY 1, 2) SELECT di, bucket, n, CAST(n * 10000 // sum(n) OVER (PARTITION BY di) AS BIGINT) AS basis_points FROM x",
    "hierarchy_rollup": f"{_W}, t AS (SELECT *, substr(pc, 1, 5) AS tens FROM tx_time WHERE pc LIKE '81-%') SELECT 'area' AS level, pc AS unit, count(*) AS n, count(DISTINCT card) AS cards FROM t GROUP BY pc UNION ALL SELECT 'tens', tens, count(*), count(DISTINCT card) FROM t GROUP BY tens UNION ALL SELECT 'city', 'all', count(*), count(DISTINCT card) FROM t",
    "event_uplift": f"{_UP} SELECT * FROM up",
    "events_for": f"{_UP} SELECT * FROM up WHERE percent >= 2",
    "interpolated": f"{_W}, x AS (SELECT ci, di, h, sum(n) OVER (PARTITION BY ci ORDER BY di * 24 + h ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n3 FROM dense) SELECT ci, di, h, CAST((n3 + coalesce(lead(n3) OVER (PARTITION BY ci ORDER BY di * 24 + h), n3)) / 2.0 AS DOUBLE) AS half FROM x",
}
