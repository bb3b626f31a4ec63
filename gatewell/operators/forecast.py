"""Daily forecasts from the past alone, and their walk-forward evaluation.

The daily series is a few thousand rows whatever the number of facts, so its windows may run in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatewell.session import table

FIRST_ORIGIN = 56


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """di, day, y: orders of each day on a dense axis."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("y"))
    axis = counts.agg(F.min("day").alias("a"), F.max("day").alias("b")).select("a", F.explode(F.expr("sequence(a, b)")).alias("day"))
    return axis.join(counts, "day", "left").select(F.datediff("day", "a").alias("di"), "day", F.coalesce("y", F.lit(0)).alias("y"))


def daily_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily series with its amount and covariates. The tables have no weather: means of the day's shipments stand for rain, temperature and wind, and their number for listed events."""
    day = F.col("l_shipdate").cast("date").alias("day")
    lines = table(spark, sf_dir, "lineitem").groupBy(day).agg(F.avg("l_discount").alias("rain"), F.avg("l_quantity").alias("temp"), F.avg("l_tax").alias("wind"), F.count("*").alias("events"))
    amount = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("amount"))
    out = daily_series(spark, sf_dir).join(lines, "day", "left").join(amount, "day", "left")
    return out.select("di", "day", "y", F.coalesce("amount", F.lit(0.0)).alias("amount"), *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("rain", "temp", "wind")], F.coalesce("events", F.lit(0)).alias("events"))


class Past:
    """What a candidate may look at on a day: the days before it."""

    def __init__(self):
        self._order = Window.orderBy("di")

    def lag(self, k: int) -> Column:
        """y of k days before; null before the first day."""
        if k < 1:
            raise ValueError("a forecast looks at earlier days alone")
        return F.lag("y", k).over(self._order)

    def over(self, f, n: int) -> Column:
        """f of y over the n days before; null unless all of them are there."""
        if n < 1:
            raise ValueError("a forecast looks at earlier days alone")
        w = self._order.rowsBetween(-n, -1)
        return F.when(F.count("y").over(w) == n, f("y").over(w))


def _same_weekdays(past: Past) -> list[Column]:
    return [past.lag(7 * k) for k in range(1, 5)]


def mean4sw(past: Past) -> Column:
    a, b, c, d = _same_weekdays(past)
    return F.when(d.isNotNull(), (a + b + c + d) / 4)


def median4sw(past: Past) -> Column:
    four = F.array_sort(F.array(*_same_weekdays(past)))
    return F.when(past.lag(28).isNotNull(), (four[1] + four[2]) / 2)


def mean7(past: Past) -> Column:
    return past.over(F.avg, 7)


def snaive(past: Past) -> Column:
    return past.lag(7).cast("double")


Candidate = Callable[[Past], Column]
#: Forecasts of a day by name. More may be given to `forecasts`, `backtest_of` and the experiment of `regress`.
CANDIDATES: dict[str, Candidate] = {"mean4sw": mean4sw, "median4sw": median4sw, "mean7": mean7, "snaive": snaive}


def forecasts(days: DataFrame, candidates: dict[str, Candidate] = CANDIDATES) -> DataFrame:
    """di, day, y and each candidate's forecast: mean and median of the last four same weekdays, mean of seven days, and the value a week ago, or what is given instead."""
    past = Past()
    return days.select("di", "day", "y", *[f(past).alias(k) for k, f in candidates.items()])


def require_past_only(days: DataFrame, candidates: dict[str, Candidate], origin: int = FIRST_ORIGIN) -> dict[str, Candidate]:
    """The candidates, if none of their forecasts up to the origin changes when the days from it on do; else an error with their names."""
    other = days.withColumn("y", F.when(F.col("di") >= origin, -7 * F.col("y") - 1).otherwise(F.col("y")))
    a, b = (forecasts(d, candidates).filter(F.col("di") <= origin).select("di", *[F.col(k).alias(f"{k}_{s}") for k in candidates]) for d, s in ((days, "a"), (other, "b")))
    off = a.join(b, "di").agg(*[F.count_if(~F.col(f"{k}_a").eqNullSafe(F.col(f"{k}_b"))).alias(k) for k in candidates]).first()
    if early := sorted(k for k in candidates if off[k]):
        raise ValueError(f"candidates that look ahead: {', '.join(early)}")
    return candidates


def metrics(y: Column, f: Column, naive: Column) -> dict[str, Column]:
    """MAPE over days of at least 10, MAE, WAPE, bias, and the scaled errors against the seasonal naive forecast."""
    off = F.abs(y - f)
    return {
        "n": F.count("*"),
        "mape": F.round(100 * F.avg(F.when(y >= 10, off / y)), 4),
        "mae": F.round(F.avg(off), 4),
        "wape": F.round(100 * F.sum(off) / F.sum(y), 4),
        "bias": F.round(F.avg(f - y) / F.avg(y), 6),
        "mase_std": F.round(F.avg(off) / F.avg(F.abs(y - naive)), 6),
        "mase": F.round(F.sum(off) / (F.count("*") / (F.count("*") - 7) * F.sum(F.abs(y - naive))), 6),
    }


def _long(days: DataFrame, candidates: dict[str, Candidate]) -> DataFrame:
    f = forecasts(days, {"__naive": snaive, **candidates}).filter(F.col("di") >= FIRST_ORIGIN)
    return f.select("di", "y", "__naive", F.explode(F.array(*[F.struct(F.lit(c).alias("candidate"), F.col(c).alias("f")) for c in candidates])).alias("c")).select("di", "y", "__naive", "c.*")


def backtest_of(days: DataFrame, candidates: dict[str, Candidate] = CANDIDATES) -> DataFrame:
    """The metrics of each candidate, against the seasonal naive forecast."""
    return _long(days, candidates).groupBy("candidate").agg(*[e.alias(k) for k, e in metrics(F.col("y"), F.col("f"), F.col("__naive")).items()])


def expanding_interval_of(days: DataFrame) -> DataFrame:
    """The 10th and 90th percentile of past ratios to the forecast, times the forecast; with fewer than 30 ratios, half and one and a half."""
    f = forecasts(days).withColumn("r", F.when((F.col("mean4sw") > 0) & (F.col("di") >= 35), F.col("y") / F.col("mean4sw")))
    past = Window.orderBy("di").rowsBetween(Window.unboundedPreceding, -1)
    few = F.count("r").over(past) < 30
    bound = lambda p, d: F.round(F.col("mean4sw") * F.when(few, d).otherwise(F.percentile("r", p).over(past)), 6)
    return f.filter("mean4sw is not null").select("di", "y", bound(0.1, 0.5).alias("lo"), bound(0.9, 1.5).alias("hi"))


def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest_of(daily_series(spark, sf_dir))


def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate of the least MAPE; of equal ones the first by name."""
    return backtest(spark, sf_dir).agg(F.min_by("candidate", F.struct("mape", "candidate")).alias("candidate"), F.min("mape").alias("mape"))


def candidate_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts(daily_series(spark, sf_dir))


def expanding_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expanding_interval_of(daily_series(spark, sf_dir))


def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the day is within its interval, and how wide that is against the mean level."""
    x = expanding_interval(spark, sf_dir).filter(F.col("di") >= FIRST_ORIGIN)
    return x.agg(F.count("*").alias("n"), F.round(F.avg(F.col("y").between(F.col("lo"), F.col("hi")).cast("double")), 6).alias("picp"), F.round(F.avg(F.col("hi") - F.col("lo")) / F.avg("y"), 4).alias("mpiw"))


def tails(days: DataFrame, low: int = 140, high: int = 123) -> DataFrame:
    """The days of fewest and of most events, ties by date, with `tail`."""
    r = days.withColumns({"r": F.row_number().over(Window.orderBy("events", "di")), "of": F.count("*").over(Window.partitionBy())})
    return r.withColumn("tail", F.when(F.col("r") <= low, "low").when(F.col("r") > F.col("of") - high, "high")).filter("tail is not null").drop("r", "of")


def event_quantile_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tails(daily_covariates(spark, sf_dir)).select("di", "events", "tail")


QUERIES = {
    "daily_series": daily_series, "daily_covariates": daily_covariates, "candidate_forecasts": candidate_forecasts, "backtest": backtest, "best_candidate": best_candidate,
    "expanding_interval": expanding_interval, "interval_coverage": interval_coverage, "event_quantile_days": event_quantile_days,
}

DAILY_SQL = """counts AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS y FROM orders GROUP BY 1), ends AS (SELECT min(day) AS a, max(day) AS b FROM counts),
daily AS (SELECT CAST(i AS INTEGER) AS di, a + CAST(i AS INTEGER) AS day, coalesce(y, 0) AS y FROM (SELECT a, unnest(range(datediff('day', a, b) + 1)) AS i FROM ends) LEFT JOIN counts ON counts.day = a + CAST(i AS INTEGER))"""
COVARIATES_SQL = f"""{DAILY_SQL},
ship AS (SELECT CAST(l_shipdate AS DATE) AS day, avg(l_discount) AS rain, avg(l_quantity) AS temp, avg(l_tax) AS wind, count(*) AS events FROM lineitem GROUP BY 1),
money AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders GROUP BY 1),
panel AS (SELECT di, day, y, coalesce(amount, 0.0::DOUBLE) AS amount, round(coalesce(rain, 0.0::DOUBLE), 6) AS rain, round(coalesce(temp, 0.0::DOUBLE), 6) AS temp, round(coalesce(wind, 0.0::DOUBLE), 6) AS wind, coalesce(events, 0) AS events
  FROM daily LEFT JOIN ship USING (day) LEFT JOIN money USING (day))"""
_F = f"""WITH {DAILY_SQL},
lagged AS (SELECT *, lag(y, 7) OVER o AS l1, lag(y, 14) OVER o AS l2, lag(y, 21) OVER o AS l3, lag(y, 28) OVER o AS l4, avg(y) OVER w AS m7, count(y) OVER w AS c7 FROM daily WINDOW o AS (ORDER BY di), w AS (ORDER BY di ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
f AS (SELECT di, day, y, CASE WHEN l4 IS NOT NULL THEN (l1 + l2 + l3 + l4) / 4.0 END AS mean4sw, CASE WHEN l4 IS NOT NULL THEN (list_sort([l1, l2, l3, l4])[2] + list_sort([l1, l2, l3, l4])[3]) / 2.0 END AS median4sw,
  CASE WHEN c7 = 7 THEN m7 END AS mean7, CAST(l1 AS DOUBLE) AS snaive FROM lagged),
long AS (SELECT * FROM (SELECT di, y, snaive, 'mean4sw' AS candidate, CAST(mean4sw AS DOUBLE) AS f FROM f UNION ALL SELECT di, y, snaive, 'median4sw', median4sw FROM f UNION ALL SELECT di, y, snaive, 'mean7', mean7 FROM f UNION ALL SELECT di, y, snaive, 'snaive', snaive FROM f) WHERE di >= 56),
scored AS (SELECT candidate, count(*) AS n, round(100 * avg(CASE WHEN y >= 10 THEN abs(y - f) / y END), 4) AS mape, round(avg(abs(y - f)), 4) AS mae, round(100 * sum(abs(y - f)) / sum(y), 4) AS wape, round(avg(f - y) / avg(y), 6) AS bias,
  round(avg(abs(y - f)) / avg(abs(y - snaive)), 6) AS mase_std, round(sum(abs(y - f)) / (count(*) / CAST(count(*) - 7 AS DOUBLE) * sum(abs(y - snaive))), 6) AS mase FROM long GROUP BY candidate),
ratio AS (SELECT *, CASE WHEN mean4sw > 0 AND di >= 35 THEN y / CAST(mean4sw AS DOUBLE) END AS r FROM f),
band AS (SELECT di, y, round(mean4sw * CASE WHEN count(r) OVER p < 30 THEN 0.5 ELSE quantile_cont(r, 0.1) OVER p END, 6) AS lo, round(mean4sw * CASE WHEN count(r) OVER p < 30 THEN 1.5 ELSE quantile_cont(r, 0.9) OVER p END, 6) AS hi, mean4sw
  FROM ratio WINDOW p AS (ORDER BY di ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
interval_ AS (SELECT di, y, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi FROM band WHERE mean4sw IS NOT NULL)"""

ORACLES = {
    "daily_series": f"{_F} SELECT di, day, y FROM daily",
    "candidate_forecasts": f"{_F} SELECT di, day, y, CAST(mean4sw AS DOUBLE) AS mean4sw, CAST(median4sw AS DOUBLE) AS median4sw, mean7, snaive FROM f",
    "backtest": f"{_F} SELECT * FROM scored",
    "daily_covariates": f"WITH {COVARIATES_SQL} SELECT * FROM panel",
    "best_candidate": f"{_F} SELECT candidate, mape FROM scored ORDER BY mape, candidate LIMIT 1",
    "expanding_interval": f"{_F} SELECT * FROM interval_",
    "interval_coverage": f"{_F} SELECT count(*) AS n, round(avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 6) AS picp, round(avg(hi - lo) / avg(y), 4) AS mpiw FROM interval_ WHERE di >= 56",
    "event_quantile_days": f"WITH {COVARIATES_SQL} SELECT di, events, CASE WHEN r <= 140 THEN 'low' ELSE 'high' END AS tail FROM (SELECT di, events, row_number() OVER (ORDER BY events, di) AS r, count(*) OVER () AS n FROM panel) WHERE r <= 140 OR r > n - 123",
}
