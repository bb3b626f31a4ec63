"""Baselines over the dense cube: same-weekday means, weekday-blind means, and the gap between them.

Windows run within (area, hour) series of the dense cube, so zero hours count, and a missing history is null, not an average of what there is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatewell.operators.cube import CUBE_SQL, compact, cube_dense, day_axis
from gatewell.operators.checks import _LOCAL
from gatewell.functions.scalar import local_time
from gatewell.sources.adapters import tx_time


def with_weekday(cells: DataFrame, tx: DataFrame) -> DataFrame:
    """cells with dow, the ISO weekday of di."""
    start = day_axis(tx).select("start")  # one row
    return cells.crossJoin(F.broadcast(start)).withColumn("dow", F.weekday(F.expr("date_add(start, di)")) + 1).drop("start")


def matched_baseline(tx: DataFrame) -> DataFrame:
    """The mean of the last four same weekdays, null unless all four are there, and its support, how many of them are."""
    w = Window.partitionBy("ci", "h", "dow").orderBy("di").rowsBetween(-4, -1)
    tx = compact(tx)
    dense = with_weekday(cube_dense(tx).select("ci", "di", "h", "n"), tx)
    return dense.select("ci", "di", "h", "n", F.when(F.count("n").over(w) == 4, F.avg("n").over(w)).alias("base"), F.count("n").over(w).alias("support"))


def blind_baseline(tx: DataFrame) -> DataFrame:
    """The mean of up to 30 days before, whatever their weekday; null on the first day."""
    w = Window.partitionBy("ci", "h").orderBy("di").rangeBetween(-30, -1)
    return cube_dense(tx).select("ci", "di", "h", "n", F.avg("n").over(w).alias("base"))


def baseline_table(tx: DataFrame) -> DataFrame:
    """The mean of each area, weekday and hour over the whole period, zeros included."""
    tx = compact(tx)
    return with_weekday(cube_dense(tx), tx).groupBy("ci", "dow", "h").agg(F.round(F.avg("n"), 3).alias("mean"))


def d1_gap(tx: DataFrame, least: float = 3.0, first: int = 35, sampled: int = 120) -> DataFrame:
    """How far the blind baseline is off the matched one, by weekday: mean, 5th and 95th percentile, and the worst cell, over cells of areas whose
    matched base is at least `least`, on about `sampled` days evenly spaced from `first` on. Both baselines come from one pass over the cube."""
    tx = compact(tx)
    axis = day_axis(tx).select("start", "days")  # one row
    dense = cube_dense(tx).select("ci", "di", "h", "n").crossJoin(F.broadcast(axis)).withColumn("dow", F.weekday(F.expr("date_add(start, di)")) + 1)
    same = Window.partitionBy("ci", "h", "dow").orderBy("di").rowsBetween(-4, -1)
    any_ = Window.partitionBy("ci", "h").orderBy("di").rangeBetween(-30, -1)
    both = dense.withColumn("blind", F.avg("n").over(any_)).withColumn("base", F.when(F.count("n").over(same) == 4, F.avg("n").over(same)))
    step = F.greatest(F.lit(1), F.floor((F.col("days") - first) / sampled).cast("int"))
    kept = both.filter((F.col("ci") >= 1) & (F.col("base") >= least) & F.col("blind").isNotNull() & (F.col("di") >= first) & ((F.col("di") - first) % step == 0))
    gap = kept.withColumn("gap", F.col("blind") / F.col("base") - 1)
    worst = F.max_by(F.struct(F.round("gap", 6).alias("gap"), "ci", "di", "h"), F.struct(F.round(F.abs("gap"), 6), -F.col("ci"), -F.col("di"), -F.col("h")))
    out = gap.groupBy("dow").agg(F.count("*").alias("cells"), *[F.round(e, 6).alias(k) for k, e in (("mean", F.avg("gap")), ("p05", F.percentile("gap", 0.05)), ("p95", F.percentile("gap", 0.95)))], worst.alias("w"))
    return out.select("dow", "cells", "mean", "p05", "p95", F.col("w.gap").alias("worst"), F.col("w.ci").alias("worst_ci"), F.col("w.di").alias("worst_di"), F.col("w.h").alias("worst_h"))


def weekday_index(tx: DataFrame) -> DataFrame:
    """Each weekday's transactions against a seventh of all."""
    days = tx.groupBy((F.weekday("day") + 1).alias("dow")).agg(F.count("*").alias("n"))
    total = days.agg(F.sum("n").alias("total"))
    return days.crossJoin(F.broadcast(total)).select("dow", "n", F.round(F.col("n") * 7 / F.col("total"), 6).alias("index"))


def weekday_index_from_cube(tx: DataFrame) -> DataFrame:
    """The same from the cube's local days, beside that of the facts, and whether they agree within what days held at the axis' ends may shift."""
    cells = compact(tx)
    facts = weekday_index(tx).select("dow", F.col("index").alias("of_facts"))
    days = with_weekday(cube_dense(cells), cells).groupBy("dow").agg(F.sum("n").alias("n"))
    total = days.agg(F.sum("n").alias("total"))
    moved = cells.agg(F.sum(F.when(F.col("local_day") != F.col("day"), F.col("n")).otherwise(0)).alias("moved"))
    x = days.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(moved)).join(facts, "dow", "left")  # one row each
    index = F.round(F.col("n") * 7 / F.col("total"), 6)
    return x.select("dow", "n", index.alias("index"), (F.abs(index - F.coalesce("of_facts", F.lit(0.0))) <= 7 * F.col("moved") / F.col("total") + 1e-6).alias("agrees"))


def daily_totals(tx: DataFrame) -> DataFrame:
    return cube_dense(tx).groupBy("di").agg(F.sum("n").alias("n"))


def distinct_hours_hist(tx: DataFrame) -> DataFrame:
    """How many local days have how many distinct local hours, rows of the unknown time included."""
    at = local_time(F.col("day"), F.col("tm"))
    days = tx.select(at.cast("date").alias("day"), F.hour(at).alias("h")).distinct().groupBy("day").agg(F.count("*").alias("hours"))
    return days.groupBy("hours").agg(F.count("*").alias("days"))


def window3(tx: DataFrame) -> DataFrame:
    """Sums over three hours around each, across midnight."""
    w = Window.partitionBy("ci").orderBy("at").rowsBetween(-1, 1)
    return cube_dense(tx).withColumn("at", F.col("di") * 24 + F.col("h")).select("ci", "di", "h", F.sum("n").over(w).alias("n3"))


def _d1(tx: DataFrame) -> DataFrame:
    """Over the tables' thirty days of events, so from the first day with a matched base on."""
    return d1_gap(tx, least=1.0, first=28)


def _q(f):
    return lambda spark, sf_dir: f(tx_time(spark, sf_dir))


QUERIES = {k: _q(f) for k, f in {
    "matched_baseline": matched_baseline, "blind_baseline": blind_baseline, "baseline_table": baseline_table, "d1_gap": _d1,
    "weekday_index": weekday_index, "weekday_index_from_cube": weekday_index_from_cube, "daily_totals": daily_totals, "distinct_hours_hist": distinct_hours_hist, "window3": window3,
}.items()}

DAYS_SQL = f"""{CUBE_SQL}, wk AS (SELECT dense.*, CAST(isodow(start + CAST(di AS INTEGER)) AS INTEGER) AS dow FROM dense, days),
matched AS (SELECT ci, di, h, n, dow, CASE WHEN count(n) OVER w = 4 THEN avg(n) OVER w END AS base, count(n) OVER w AS support FROM wk WINDOW w AS (PARTITION BY ci, h, dow ORDER BY di ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
blind AS (SELECT ci, di, h, n, avg(n) OVER (PARTITION BY ci, h ORDER BY di RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING) AS base FROM dense)"""
_W = f"WITH {DAYS_SQL}"

ORACLES = {
    "matched_baseline": f"{_W} SELECT ci, di, h, n, base, support FROM matched",
    "blind_baseline": f"{_W} SELECT ci, di, h, n, base FROM blind",
    "baseline_table": f"{_W} SELECT ci, dow, h, round(avg(n), 3) AS mean FROM wk GROUP BY ci, dow, h",
    "d1_gap": f"""{_W}, g AS (SELECT m.dow, m.ci, m.di, m.h, b.base / m.base - 1 AS gap FROM matched m JOIN blind b USING (ci, di, h), days WHERE m.base >= 1 AND ci >= 1 AND di >= 28 AND b.base IS NOT NULL AND (di - 28) % greatest(1, (days - 28) // 120) = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY dow ORDER BY round(abs(gap), 6) DESC, ci, di, h) AS r FROM g)
      SELECT dow, count(*) AS cells, round(avg(gap), 6) AS mean, round(quantile_cont(gap, 0.05), 6) AS p05, round(quantile_cont(gap, 0.95), 6) AS p95, max(CASE WHEN r = 1 THEN round(gap, 6) END) AS worst, max(CASE WHEN r = 1 THEN ci END) AS worst_ci, max(CASE WHEN r = 1 THEN di END) AS worst_di, max(CASE WHEN r = 1 THEN h END) AS worst_h FROM r GROUP BY dow""",
    "weekday_index": f"{_W} SELECT CAST(isodow(day) AS INTEGER) AS dow, count(*) AS n, round(count(*) * 7 / CAST((SELECT count(*) FROM tx_time) AS DOUBLE), 6) AS index FROM tx_time GROUP BY 1",
    "weekday_index_from_cube": f"""{_W}, d AS (SELECT dow, CAST(sum(n) AS BIGINT) AS n FROM wk GROUP BY dow), f AS (SELECT CAST(isodow(day) AS INTEGER) AS dow, count(*) AS k FROM tx_time GROUP BY 1),
      t AS (SELECT count(*)::DOUBLE AS total, count(*) FILTER (WHERE CAST({_LOCAL} AS DATE) <> day) AS moved FROM tx_time)
      SELECT d.dow, d.n, round(d.n * 7 / total, 6) AS index, abs(round(d.n * 7 / total, 6) - round(coalesce(k, 0) * 7 / total, 6)) <= 7 * moved / total + 1e-6 AS agrees FROM d LEFT JOIN f ON f.dow = d.dow, t""",
    "daily_totals": f"{_W} SELECT di, CAST(sum(n) AS BIGINT) AS n FROM dense GROUP BY di",
    "distinct_hours_hist": f"{_W} SELECT hours, count(*) AS days FROM (SELECT CAST({_LOCAL} AS DATE) AS day, count(DISTINCT hour({_LOCAL})) AS hours FROM tx_time GROUP BY 1) GROUP BY hours",
    "window3": f"{_W} SELECT ci, di, h, CAST(sum(n) OVER (PARTITION BY ci ORDER BY di * 24 + h ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS n3 FROM dense",
}
