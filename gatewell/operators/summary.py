"""The panel's summary of a city event, and the lookups around it: events by day, premises by area, weather by hour, and the units of the hierarchy.

Events, areas, premises and hours of weather are dimensions. An event's window is spread to its hours, so every lookup is an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatewell.operators.baseline import DAYS_SQL, with_weekday
from gatewell.operators.cube import ISSUERS, code_axis, compact, cube_dense, nat_cells
from gatewell.operators.gates import _cells, gate
from gatewell.session import stored, table
from gatewell.sources.adapters import tx_time

CITY = -1


def city_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event, first and last day, start and end hour (24 and more: past midnight), and the area it is asked for (`CITY`: all). Nations stand for events."""
    k = F.col("n_nationkey")
    start, end = 10 + k * 5 % 13, (12 + k * 5 % 13 + k % 5) % 24
    out = table(spark, sf_dir, "nation").select(F.col("n_name").alias("event"), (25 + k % 5).alias("first"), (25 + k % 5 + k % 3).alias("last"), start.alias("start"), end.alias("end"), F.when(k % 2 == 0, CITY).otherwise(1 + k % 30).alias("ci"))
    return out.withColumn("end", F.when(F.col("end") <= F.col("start"), F.col("end") + 24).otherwise(F.col("end")))


def event_days(events: DataFrame) -> DataFrame:
    """di, event, spill: every day of the event's range; and the day after it, as a spill, if its hours run past midnight."""
    days = F.sequence("first", F.col("last") + F.when(F.col("end") > 24, 1).otherwise(0))
    return events.select("event", "last", F.explode(days).alias("di")).select("di", "event", (F.col("di") > F.col("last")).alias("spill"))


def event_hours(events: DataFrame) -> DataFrame:
    """events with di, h: the hours from one before the start to the end, on the first day and the night after it."""
    out = events.withColumn("at", F.explode(F.sequence(F.greatest(F.lit(0), F.col("start") - 1), F.col("end"))))
    return out.withColumns({"di": F.col("first") + F.floor(F.col("at") / 24).cast("int"), "h": F.col("at") % 24}).drop("at")


def _whole(c: str) -> Column:
    """A sum that is null unless every row has a value."""
    return F.when(F.count(c) == F.count("*"), F.sum(c))


def with_bases(tx: DataFrame) -> DataFrame:
    """ci, di, h, n, amount, and the means of both over the last four same weekdays, for areas and, as `CITY`, all of them."""
    rows = compact(tx)
    w = Window.partitionBy("ci", "h", "dow").orderBy("di").rowsBetween(-4, -1)
    dense = with_weekday(cube_dense(rows), rows).filter("ci >= 1").withColumn("amount", F.col("amount").cast("double"))
    mean = lambda c: F.when(F.count("n").over(w) == 4, F.avg(c).over(w))
    areas = dense.select("ci", "di", "h", "n", "amount", mean("n").alias("base"), mean("amount").alias("base_amount"))
    city = areas.groupBy("di", "h").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"), _whole("base").alias("base"), _whole("base_amount").alias("base_amount"))
    return areas.unionByName(city.withColumn("ci", F.lit(CITY)))


def event_summary(tx: DataFrame, events: DataFrame) -> DataFrame:
    """Each event's hours in its scope: volume and amount against their bases, tickets, the peak hour, the days around, and the hottest tens of the city.

    An area that may not be shown is never replaced by the city: the event is `blocked`, with the reason, and has no figures.
    Hours past the axis count as nothing; a base is null if one of the hours has none.
    """
    rows = compact(tx)
    cells, axis = stored(with_bases(rows), "bases"), stored(code_axis(rows), "axis")  # read by all that follows
    shown = gate(tx.filter("pc is not null"), ["pc"]).select(F.col("pc").alias("code"), "ok", "reason").join(axis, "code").select("ci", "ok", "reason")
    scope = events.join(F.broadcast(shown), "ci", "left")  # a few areas
    open_ = (F.col("ci") == CITY) | F.coalesce("ok", F.lit(False))
    scope = scope.withColumns({"blocked": ~open_, "why": F.when(~open_, F.coalesce("reason", F.lit("no_data")))}).drop("ok", "reason")
    hours = event_hours(scope)
    zero = lambda c: F.coalesce(c, F.lit(0))
    held = hours.join(cells, ["ci", "di", "h"], "left").withColumns({"n": zero("n"), "amount": zero("amount")})
    peak = F.max_by(F.struct("di", "h"), F.struct("n", -(F.col("di") * 24 + F.col("h"))))
    sums = held.groupBy("event", "ci", "blocked", "why").agg(F.count("*").alias("hours"), F.sum("n").alias("n"), F.sum("amount").alias("amount"), _whole("base").alias("base"), _whole("base_amount").alias("base_amount"), peak.alias("peak"))
    around = events.select("event", "ci", "first", F.explode(F.sequence(F.col("first") - 1, F.col("first") + 1)).alias("di")).join(cells.select("ci", "di", F.col("n").alias("m")), ["ci", "di"])
    strip = around.groupBy("event").agg(*[F.sum(F.when(F.col("di") - F.col("first") == d, F.col("m"))).alias(c) for d, c in ((-1, "day_before"), (0, "day"), (1, "day_after"))])
    tens = cells.join(F.broadcast(axis), "ci").select("di", "h", "n", F.substring("code", 1, 5).alias("tens"))
    by_tens = hours.select("event", "di", "h").join(tens, ["di", "h"]).groupBy("event", "tens").agg(F.sum("n").alias("n"))
    ranked = by_tens.groupBy("event").agg(F.min_by("tens", F.struct(-F.col("n"), "tens")).alias("hot"), F.max("n").alias("m"), F.sum("n").alias("s")).filter("m > 0")
    x = sums.join(strip, "event", "left").join(ranked, "event", "left")
    show = lambda c, digits=None: F.when(~F.col("blocked"), c if digits is None else F.round(c, digits))
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    figures = {
        "n": show(F.col("n")), "amount": show(F.col("amount"), 2), "base": show(F.col("base"), 4), "ticket": show(ratio("amount", "n"), 4), "base_ticket": show(ratio("base_amount", "base"), 4), "uplift": show(ratio("n", "base") - 1, 6),
        "peak_di": show(F.col("peak.di")), "peak_h": show(F.col("peak.h")), "day_before": show(F.col("day_before")), "day": show(F.col("day")), "day_after": show(F.col("day_after")), "hot": show(F.col("hot")), "hot_share": show(ratio("m", "s"), 6),
    }
    return x.select("event", "ci", "hours", "blocked", F.col("why").alias("reason"), *[c.alias(k) for k, c in figures.items()])


def event_issuers(tx: DataFrame, events: DataFrame) -> DataFrame:
    """Shares of the issuers' buckets in each event's hours, and in the same hours of the four weeks before; weeks before the axis are left out."""
    hours = event_hours(events).select("event", "h", "di", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("w")).withColumn("di", F.col("di") - 7 * F.col("w"))
    part = lambda now: F.sum(F.when((F.col("w") == 0) == F.lit(now), F.col("n")).otherwise(0))
    out = hours.join(nat_cells(tx), ["di", "h"]).groupBy("event", "bucket").agg(part(True).alias("n"), part(False).alias("before"))
    w = Window.partitionBy("event")  # six buckets
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c).cast("double"), F.sum(c).over(w)), F.lit(0.0)), 6)
    return out.select("event", "bucket", "n", "before", share("n").alias("share"), share("before").alias("share_before"))


def premises_by_area(axis: DataFrame, premises: DataFrame) -> DataFrame:
    """How many of the premises of (id, within), an array of codes, each area has; codes that are no area's are left out, areas without any have 0."""
    placed = premises.select("id", F.explode("within").alias("code")).groupBy("code").agg(F.count("*").alias("premises"))
    return axis.filter("ci >= 1").join(placed, "code", "left").select("code", F.coalesce("premises", F.lit(0)).alias("premises"))


def activity_by_weather(tx: DataFrame, weather: DataFrame) -> DataFrame:
    """The city's hours, volume and mean temperature by weather, which is a series (i, temp, cond) by the hours since the axis' start; hours past its end have none."""
    hours = cube_dense(tx).filter("ci >= 1").groupBy("di", "h").agg(F.sum("n").alias("n")).withColumn("i", F.col("di") * 24 + F.col("h"))
    icon = F.when(F.col("cond") == 2, "rain").when(F.col("cond") == 0, "sun").when(F.col("cond").isNotNull(), "cloud")
    return hours.join(weather, "i", "left").groupBy(icon.alias("icon")).agg(F.count("*").alias("hours"), F.sum("n").alias("n"), F.round(F.avg("temp"), 6).alias("temp"))


def _keys(axis: DataFrame) -> DataFrame:
    """code, tens, fives of each area."""
    tens = F.substring("code", 1, 5)
    half = F.when(F.substring("code", 6, 1).cast("int") < 5, "a").otherwise("b")
    return axis.filter("ci >= 1").select("code", F.concat(tens, F.lit("x")).alias("tens"), F.concat(tens, half).alias("fives"))


def hierarchy_units(axis: DataFrame) -> DataFrame:
    """Every unit from the city to the codes, with its parent, label, codes and children; a code is its own child."""
    level = lambda name, key, parent, child: F.struct(F.lit(name).alias("level"), key.alias("unit"), parent.alias("parent"), child.alias("child"))
    code, tens, fives = (F.col(c) for c in ("code", "tens", "fives"))
    rows = _keys(axis).select("code", F.explode(F.array(level("city", F.lit("city"), F.lit(None).cast("string"), tens), level("tens", tens, F.lit("city"), fives), level("fives", fives, tens, code), level("code", code, fives, code))).alias("u"))
    out = rows.select("code", "u.*").groupBy("level", "unit", "parent").agg(F.count("*").alias("codes"), F.countDistinct("child").alias("children"))
    label = F.when(F.col("level") == "fives", F.concat(F.substring("unit", 1, 5), F.when(F.col("unit").endswith("a"), "0–4").otherwise("5–9"))).otherwise(F.col("unit"))
    return out.withColumn("label", label)


def drill_targets(axis: DataFrame) -> DataFrame:
    """Where a click on an area leads from the city: to its tens, or, past units with one child, to the first that has several, or to the code; and the way there."""
    keys = _keys(axis)
    n = keys.groupBy("tens").agg(F.countDistinct("fives").alias("halves")).join(keys.groupBy("tens", "fives").agg(F.count("*").alias("codes")), "tens")
    x = keys.join(n, ["tens", "fives"])
    target = F.when(F.col("halves") > 1, F.col("tens")).when(F.col("codes") > 1, F.col("fives")).otherwise(F.col("code"))
    return x.select("code", F.concat_ws(" > ", "tens", "fives", "code").alias("path"), target.alias("target"))


# queries


def events_on_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_days(city_events(spark, sf_dir))


def event_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_summary(tx_time(spark, sf_dir), city_events(spark, sf_dir))


def event_issuer_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_issuers(tx_time(spark, sf_dir), city_events(spark, sf_dir))


def premises_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for premises."""
    k = F.col("c_custkey")
    code = lambda n: F.concat(F.lit("81-7"), F.lpad(n.cast("string"), 2, "0"))
    premises = table(spark, sf_dir, "customer").select(k.alias("id"), F.array(code(k % 24), code(k * 7 % 30)).alias("within"))
    return premises_by_area(code_axis(tx_time(spark, sf_dir)), premises)


def weather_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for hours of weather, by their number."""
    weather = table(spark, sf_dir, "orders").select((F.col("o_orderkey") - 1).alias("i"), (F.col("o_custkey") % 35).alias("temp"), (F.col("o_orderkey") % 3).alias("cond"))
    return activity_by_weather(tx_time(spark, sf_dir), weather)


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy_units(code_axis(tx_time(spark, sf_dir)))


def drill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drill_targets(code_axis(tx_time(spark, sf_dir)))


QUERIES = {"events_on_day": events_on_day, "event_summary": event_summaries, "event_issuers": event_issuer_mix, "premises_join": premises_join, "weather_lookup": weather_lookup, "hierarchy_units": hierarchy, "drill_targets": drill}

_W = f"WITH {DAYS_SQL}"
_BUCKET = "CASE issuer " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(ISSUERS)) + " ELSE 5 END"
_EV = """ev AS (SELECT event, first, last, start, CASE WHEN stop <= start THEN stop + 24 ELSE stop END AS stop, ci FROM (SELECT n_name AS event, 25 + n_nationkey % 5 AS first, 25 + n_nationkey % 5 + n_nationkey % 3 AS last,
  10 + n_nationkey * 5 % 13 AS start, (12 + n_nationkey * 5 % 13 + n_nationkey % 5) % 24 AS stop, CASE WHEN n_nationkey % 2 = 0 THEN -1 ELSE 1 + n_nationkey % 30 END AS ci FROM nation)),
eh AS (SELECT event, ci, first, CAST(first + hr // 24 AS INTEGER) AS di, CAST(hr % 24 AS INTEGER) AS h FROM (SELECT event, ci, first, unnest(range(greatest(0, start - 1), stop + 1)) AS hr FROM ev))"""
_KEYS = "k AS (SELECT code, substr(code, 1, 5) || 'x' AS tens, substr(code, 1, 5) || CASE WHEN CAST(substr(code, 6, 1) AS INTEGER) < 5 THEN 'a' ELSE 'b' END AS fives FROM axis WHERE ci >= 1)"

ORACLES = {
    "events_on_day": f"WITH {_EV}, d AS (SELECT event, last, unnest(range(first, last + 1 + CASE WHEN stop > 24 THEN 1 ELSE 0 END)) AS di FROM ev) SELECT CAST(di AS INTEGER) AS di, event, di > last AS spill FROM d",
    "event_summary": f"""{_W}, {_EV}, mine AS (SELECT dense.ci, dense.di, dense.h, dense.n, CAST(dense.amount AS DOUBLE) AS amount, CAST(isodow(start + dense.di) AS INTEGER) AS dow FROM dense, days WHERE dense.ci >= 1),
      a AS (SELECT ci, di, h, n, amount, CASE WHEN count(n) OVER w = 4 THEN avg(n) OVER w END AS base, CASE WHEN count(n) OVER w = 4 THEN avg(amount) OVER w END AS base_amount FROM mine WINDOW w AS (PARTITION BY ci, h, dow ORDER BY di ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
      cell AS (SELECT * FROM a UNION ALL SELECT -1, di, h, sum(n), sum(amount), CASE WHEN count(base) = count(*) THEN sum(base) END, CASE WHEN count(base_amount) = count(*) THEN sum(base_amount) END FROM a GROUP BY di, h),
      shown AS (SELECT axis.ci, ok, reason FROM (WITH tx AS (SELECT * FROM tx_time WHERE pc IS NOT NULL), {_cells('pc').lstrip()} SELECT pc, ok, reason FROM g) JOIN axis ON pc = code),
      s AS (SELECT ev.*, ev.ci <> -1 AND NOT coalesce(ok, false) AS blocked, CASE WHEN ev.ci <> -1 AND NOT coalesce(ok, false) THEN coalesce(shown.reason, 'no_data') END AS reason FROM ev LEFT JOIN shown ON ev.ci = shown.ci),
      f AS (SELECT event, eh.di, eh.h, coalesce(n, 0) AS n, coalesce(amount, 0) AS amount, base, base_amount FROM eh LEFT JOIN cell ON eh.ci = cell.ci AND eh.di = cell.di AND eh.h = cell.h),
      t AS (SELECT event, count(*) AS hours, sum(n) AS n, sum(amount) AS amount, CASE WHEN count(base) = count(*) THEN sum(base) END AS base, CASE WHEN count(base_amount) = count(*) THEN sum(base_amount) END AS base_amount FROM f GROUP BY event),
      p AS (SELECT event, di, h FROM f QUALIFY row_number() OVER (PARTITION BY event ORDER BY n DESC, di, h) = 1),
      d AS (SELECT event, sum(n) FILTER (WHERE cell.di = first - 1) AS b, sum(n) FILTER (WHERE cell.di = first) AS o, sum(n) FILTER (WHERE cell.di = first + 1) AS e FROM ev JOIN cell ON ev.ci = cell.ci AND cell.di BETWEEN first - 1 AND first + 1 GROUP BY event),
      q AS (SELECT event, substr(code, 1, 5) AS tens, sum(n) AS n FROM eh JOIN a ON eh.di = a.di AND eh.h = a.h JOIN axis ON a.ci = axis.ci GROUP BY 1, 2),
      hot AS (SELECT event, tens, n, sum(n) OVER (PARTITION BY event) AS s FROM q QUALIFY row_number() OVER (PARTITION BY event ORDER BY n DESC, tens) = 1)
      SELECT s.event, s.ci, hours, blocked, s.reason, CASE WHEN NOT blocked THEN CAST(t.n AS BIGINT) END AS n, CASE WHEN NOT blocked THEN round(amount, 2) END AS amount, CASE WHEN NOT blocked THEN round(base, 4) END AS base,
        CASE WHEN NOT blocked AND t.n > 0 THEN round(amount / t.n, 4) END AS ticket, CASE WHEN NOT blocked AND base > 0 THEN round(base_amount / base, 4) END AS base_ticket, CASE WHEN NOT blocked AND base > 0 THEN round(t.n / base - 1, 6) END AS uplift,
        CASE WHEN NOT blocked THEN p.di END AS peak_di, CASE WHEN NOT blocked THEN p.h END AS peak_h, CASE WHEN NOT blocked THEN CAST(b AS BIGINT) END AS day_before, CASE WHEN NOT blocked THEN CAST(o AS BIGINT) END AS day, CASE WHEN NOT blocked THEN CAST(e AS BIGINT) END AS day_after,
        CASE WHEN NOT blocked AND hot.n > 0 THEN tens END AS hot, CASE WHEN NOT blocked AND hot.n > 0 THEN round(hot.n / CAST(hot.s AS DOUBLE), 6) END AS hot_share
      FROM s JOIN t USING (event) JOIN p USING (event) LEFT JOIN d USING (event) LEFT JOIN hot USING (event)""",
    "event_issuers": f"""{_W}, {_EV}, nat AS (SELECT di, h, {_BUCKET} AS bucket, count(*) AS n FROM placed GROUP BY 1, 2, 3), w AS (SELECT event, h, di - 7 * w AS di, w FROM eh, (SELECT unnest(range(5)) AS w)),
      x AS (SELECT event, bucket, CAST(coalesce(sum(n) FILTER (WHERE w = 0), 0) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (WHERE w > 0), 0) AS BIGINT) AS before FROM w JOIN nat USING (di, h) GROUP BY event, bucket)
      SELECT event, bucket, n, before, round(coalesce(n / nullif(CAST(sum(n) OVER e AS DOUBLE), 0), 0), 6) AS share, round(coalesce(before / nullif(CAST(sum(before) OVER e AS DOUBLE), 0), 0), 6) AS share_before FROM x WINDOW e AS (PARTITION BY event)""",
    "premises_join": f"{_W}, p AS (SELECT '81-7' || lpad(CAST(c_custkey % 24 AS VARCHAR), 2, '0') AS code FROM customer UNION ALL SELECT '81-7' || lpad(CAST(c_custkey * 7 % 30 AS VARCHAR), 2, '0') FROM customer), c AS (SELECT code, count(*) AS n FROM p GROUP BY code) SELECT code, coalesce(n, 0) AS premises FROM axis LEFT JOIN c USING (code) WHERE ci >= 1",
    "weather_lookup": f"""{_W}, c AS (SELECT di, h, sum(n) AS n FROM dense WHERE ci >= 1 GROUP BY di, h), o AS (SELECT o_orderkey - 1 AS i, o_custkey % 35 AS temp, o_orderkey % 3 AS cond FROM orders)
      SELECT CASE cond WHEN 2 THEN 'rain' WHEN 0 THEN 'sun' WHEN 1 THEN 'cloud' END AS icon, count(*) AS hours, CAST(sum(n) AS BIGINT) AS n, round(avg(temp), 6) AS temp FROM c LEFT JOIN o ON i = di * 24 + h GROUP BY 1""",
    "hierarchy_units": f"""{_W}, {_KEYS} SELECT 'city' AS level, 'city' AS unit, CAST(NULL AS VARCHAR) AS parent, count(*) AS codes, count(DISTINCT tens) AS children, 'city' AS label FROM k HAVING count(*) > 0
      UNION ALL SELECT 'tens', tens, 'city', count(*), count(DISTINCT fives), tens FROM k GROUP BY tens
      UNION ALL SELECT 'fives', fives, tens, count(*), count(*), substr(fives, 1, 5) || CASE WHEN fives LIKE '%a' THEN '0–4' ELSE '5–9' END FROM k GROUP BY fives, tens UNION ALL SELECT 'code', code, fives, 1, 1, code FROM k""",
    "drill_targets": f"{_W}, {_KEYS}, t AS (SELECT tens, count(DISTINCT fives) AS halves FROM k GROUP BY tens), f AS (SELECT fives, count(*) AS codes FROM k GROUP BY fives) SELECT code, tens || ' > ' || fives || ' > ' || code AS path, CASE WHEN halves > 1 THEN tens WHEN codes > 1 THEN fives ELSE code END AS target FROM k JOIN t USING (tens) JOIN f USING (fives)",
}
