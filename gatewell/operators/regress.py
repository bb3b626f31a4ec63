"""Driver regressions on the daily series: least squares, a negative binomial model, walk-forward models, and the control for season.

Least squares needs X'X and X'y alone, which Spark sums; the driver solves a system of a few columns. The negative binomial fit
repeats that by iteratively reweighted steps, each one grouped sum over the stored series. A walk-forward model is refitted for each day
from the sums of the days before, each of them a running window of its own; the small systems are solved in batches of days.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatewell.operators.forecast import COVARIATES_SQL, FIRST_ORIGIN, Candidate, daily_covariates, forecasts, mean4sw, metrics, snaive, tails
from gatewell.session import stored

CALENDAR = (*(f"month_{m}" for m in range(2, 13)), *(f"dow_{w}" for w in range(2, 8)))
WEATHER, DRIVERS = ("rain", "temp", "wind"), ("rain", "temp", "wind", "events")


def design(days: DataFrame) -> DataFrame:
    """The daily series with an intercept and month and weekday dummies, of which January and Monday are the base."""
    dummies = {f"month_{m}": (F.month("day") == m).cast("double") for m in range(2, 13)} | {f"dow_{w}": (F.weekday("day") + 1 == w).cast("double") for w in range(2, 8)}
    return days.withColumns({"intercept": F.lit(1.0), **dummies})


COLUMNS = ("intercept", *CALENDAR, *DRIVERS)


def _moments(df: DataFrame, columns: tuple[str, ...], y: Column, weight: Column) -> tuple[np.ndarray, np.ndarray, int, float, float]:
    """Weighted X'X and X'y, the number of rows, and the weighted sum of y and of its squares, in one pass."""
    k, pairs = len(columns), [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = [F.sum(weight * F.col(columns[i]) * F.col(columns[j])) for i, j in pairs] + [F.sum(weight * F.col(c) * y) for c in columns]
    r = df.agg(F.count("*"), F.sum(weight * y), F.sum(weight * y * y), *sums).first()
    xx = np.zeros((k, k))
    for (i, j), v in zip(pairs, r[3 : 3 + len(pairs)], strict=True):
        xx[i, j] = xx[j, i] = v or 0.0
    return xx, np.array([v or 0.0 for v in r[3 + len(pairs) :]]), r[0], r[1] or 0.0, r[2] or 0.0


def t_quantile(df: int, z: float = 1.959963984540054) -> float:
    """The two-sided 95 % quantile of Student's t, by the expansion around the normal one (Abramowitz and Stegun 26.7.5)."""
    return z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * df**3)


def ols(df: DataFrame, columns: tuple[str, ...], y: Column) -> list[tuple]:
    """(term, beta, se, t, low, high, effect in percent) of ordinary least squares, with classical errors; and the R squared as a last row."""
    xx, xy, n, total, squares = _moments(df, columns, y, F.lit(1.0))
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    rest = max(0.0, squares - beta @ xy)
    freedom = max(1, n - len(columns))
    se = np.sqrt(np.maximum(np.diag(inverse) * rest / freedom, 0))
    q = t_quantile(freedom)
    rows = [(c, float(b), float(s), float(b / s) if s else None, float(b - q * s), float(b + q * s), float(100 * np.expm1(b))) for c, b, s in zip(columns, beta, se, strict=True)]
    spread = squares - total**2 / max(1, n)
    return [*rows, ("r_squared", float(1 - rest / spread) if spread else None, None, None, None, None, None)]


@dataclass
class NB2:
    beta: np.ndarray
    se: np.ndarray
    alpha: float
    rounds: int
    deviance: float


def nb2_fit(df: DataFrame, columns: tuple[str, ...], y: str, rounds: int = 60, tolerance: float = 1e-9) -> NB2:
    """A negative binomial model with log link, with variance mu + alpha mu^2. Alpha starts at 0.05 and each fifth round takes its moment estimate,
    the sum of (y - mu)^2 - mu over that of mu^2; errors are those of the model."""
    mean = df.agg(F.avg(y)).first()[0] or 1.0
    beta, alpha, i = np.zeros(len(columns)), 0.05, 0
    beta[0] = np.log(max(mean, 1e-9))

    def at(beta: np.ndarray) -> DataFrame:
        eta = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, columns, strict=True)), F.lit(0.0))))
        return df.select("*", eta.alias("eta"), F.exp(eta).alias("mu"))

    for i in range(rounds):
        step = at(beta)
        xx, xy, *_ = _moments(step, columns, F.col("eta") + (F.col(y) - F.col("mu")) / F.col("mu"), F.col("mu") / (1 + alpha * F.col("mu")))
        new = np.linalg.pinv(xx) @ xy
        if i % 5 == 0:
            a = step.agg(F.sum(F.pow(F.col(y) - F.col("mu"), 2) - F.col("mu")), F.sum(F.pow("mu", 2))).first()
            alpha = max(1e-8, a[0] / a[1]) if a[1] else 1e-8
        done = np.abs(new - beta).max() < tolerance
        beta = new
        if done:
            break
    last = at(beta)
    xx, *_ = _moments(last, columns, F.lit(0.0), F.col("mu") / (1 + alpha * F.col("mu")))
    off = F.col(y) * F.ln(F.greatest(F.col(y).cast("double"), F.lit(1e-12)) / F.col("mu")) - (F.col(y) - F.col("mu"))
    deviance = last.agg(2 * F.sum(off)).first()[0] or 0.0
    return NB2(beta, np.sqrt(np.maximum(np.diag(np.linalg.pinv(xx)), 0)), alpha, i + 1, deviance)


def nb2(df: DataFrame, columns: tuple[str, ...], y: str) -> tuple[np.ndarray, float]:
    """Coefficients and dispersion alone."""
    fit = nb2_fit(df, columns, y)
    return fit.beta, fit.alpha


TERMS = "spec string, term string, beta double, se double, t double, low double, high double, effect double"


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(design(daily_covariates(spark, sf_dir)), "daily")


def ols_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three specifications: log counts on calendar and drivers; the same without months; and the log ratio to the four-week mean on drivers alone. Days without orders are left out."""
    days = _series(spark, sf_dir)
    logs = days.filter("y > 0").withColumn("ln", F.ln("y"))
    ratio = days.join(forecasts(days).select("di", "mean4sw"), "di").filter((F.col("di") >= FIRST_ORIGIN) & (F.col("mean4sw") > 0) & (F.col("y") > 0)).withColumn("ln", F.ln(F.col("y") / F.col("mean4sw")))
    specs = (("primary", logs, COLUMNS), ("no_month", logs, tuple(c for c in COLUMNS if not c.startswith("month_"))), ("uplift", ratio, ("intercept", *DRIVERS)))
    return spark.createDataFrame([(name, *row) for name, df, columns in specs for row in ols(df, columns, F.col("ln"))], TERMS)


def nb2_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = nb2_fit(_series(spark, sf_dir), COLUMNS, "y")
    rows = [(c, float(b), float(s), float(b / s) if s else None) for c, b, s in zip(COLUMNS, fit.beta, fit.se, strict=True)]
    return spark.createDataFrame([*rows, ("alpha", fit.alpha, None, None), ("deviance", float(fit.deviance), None, None), ("rounds", float(fit.rounds), None, None)], "term string, beta double, se double, t double")


def running_moments(rows: DataFrame) -> DataFrame:
    """rows of (model, di, t, x) with what all earlier days of the model add up to: n, and moments, the upper triangle of X'X by rows and then X'y.

    Each moment of each model is a sum by itself over an expanding window, so no task needs a whole model; days without a target add nothing.
    """
    k = F.size("x")
    line = lambda i: F.transform(F.slice("x", i + 1, k - i), lambda v: v * F.get("x", i))
    products = F.concat(F.flatten(F.transform(F.sequence(F.lit(0), k - 1), line)), F.transform("x", lambda v: v * F.col("t")))
    none = F.transform(products, lambda _: F.lit(0.0))
    held = F.col("t").isNotNull() & ~F.isnan("t")
    each = rows.select("model", "di", held.cast("long").alias("one"), F.posexplode(F.when(held, products).otherwise(none)).alias("pos", "v"))
    w = Window.partitionBy("model", "pos").orderBy("di").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select("model", "di", "pos", F.coalesce(F.sum("v").over(w), F.lit(0.0)).alias("v"), F.coalesce(F.sum("one").over(w), F.lit(0)).alias("n"))
    sums = before.groupBy("model", "di").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda m: m["v"]).alias("moments"))
    return rows.join(sums, ["model", "di"])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """moments, z and whether there are enough days -> the growth exp(beta z), 1 if there are not."""
    for batch in batches:
        growth = []
        for moments, z, enough in zip(*(batch.column(c).to_pylist() for c in ("moments", "z", "enough")), strict=True):
            k = len(z)
            upper = np.triu_indices(k)
            xx = np.zeros((k, k))
            xx[upper] = moments[: len(upper[0])]
            beta = np.linalg.pinv(xx + np.triu(xx, 1).T, rcond=1e-12, hermitian=True) @ moments[len(upper[0]) :] if enough else np.zeros(k)
            growth.append(float(np.exp(np.dot(z, beta))))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("model", "di", "y", "base")), pa.array(growth, pa.float64())], ["model", "di", "y", "base", "growth"])


def walk_forward(rows: DataFrame, first: int = FIRST_ORIGIN, least: int = 1) -> DataFrame:
    """(model, di, y, f) from `first` on, over rows of model, di, y, t (the target of the fit; null if the day takes no part), x (its regressors), z (those of
    the forecast) and base: f is base times exp(beta z), with beta fitted on all earlier days of the model; with fewer than `least` of them, base.

    (model, di) is one row. The systems are solved in batches of days, wherever these are.
    """
    days = running_moments(rows).filter(F.col("di") >= first)
    ready = days.select("model", F.col("di").cast("int").alias("di"), F.col("y").cast("long").alias("y"), "base", "z", "moments", (F.col("n") >= least).alias("enough"))
    solved = ready.mapInArrow(_solve, "model string, di int, y long, base double, growth double")
    return solved.select("model", "di", "y", (F.col("base") * F.col("growth")).alias("f"))


#: The forecasts that drivers are put on.
BASES: dict[str, Candidate] = {"snaive": snaive, "mean4sw": mean4sw}


def models(days: DataFrame, bases: dict[str, Candidate] = BASES) -> DataFrame:
    """The rows of all walk-forward models: log counts by calendar, with weather, and with events too; and each base times its drivers."""
    d = days.join(forecasts(days, bases).select("di", *bases), "di")
    numbers = lambda columns: F.array(*[F.col(c).cast("double") for c in columns])
    ln = F.when(F.col("y") > 0, F.ln("y"))
    out = []
    for name, extra in (("ols_logcount", ()), ("ols_logcount_weather", WEATHER), ("ols_logcount_weather_events", DRIVERS)):
        x = numbers(("intercept", *CALENDAR, *extra))
        out.append(F.struct(F.lit(name).alias("model"), ln.alias("t"), x.alias("x"), x.alias("z"), F.lit(1.0).alias("base")))
    for base in bases:
        ratio = F.when((F.col("di") >= 28) & (F.col(base) > 0) & (F.col("y") > 0), F.ln(F.col("y") / F.col(base)))
        for name, extra in (("weather", WEATHER), ("weather_events", DRIVERS)):
            x = numbers(("intercept", *extra))
            z = F.concat(F.array(F.lit(0.0)), F.slice(x, 2, len(extra)))  # the intercept takes no part in the forecast
            out.append(F.struct(F.lit(f"drivers_on_{base}_{name}").alias("model"), ratio.alias("t"), x.alias("x"), z.alias("z"), F.col(base).cast("double").alias("base")))
    return d.select("di", "y", F.explode(F.array(*out)).alias("m")).select("di", "y", "m.*")


def _forecast(days: DataFrame, *names: str, bases: dict[str, Candidate] = BASES) -> DataFrame:
    rows = models(days, bases)
    rows = rows.filter(F.col("model").isin(*names)) if names else rows
    drivers = F.col("model").startswith("drivers")
    return walk_forward(rows.filter(drivers), least=30).unionByName(walk_forward(rows.filter(~drivers)))


def walk_forward_ols_logcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forecast(_series(spark, sf_dir), "ols_logcount_weather_events").select("di", "y", F.round("f", 4).alias("f"))


def driver_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forecast(_series(spark, sf_dir), "drivers_on_mean4sw_weather_events").select("di", "y", F.round("f", 4).alias("f"))


def weather_events_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment(_series(spark, sf_dir))


def experiment(days: DataFrame, bases: dict[str, Candidate] = BASES) -> DataFrame:
    """Whether weather and events help: the metrics of each walk-forward model, and how often its 80 % interval holds the day. days are those of `design`."""
    f = _forecast(days, bases=bases).join(days.select((F.col("di") + 7).alias("di"), F.col("y").alias("naive")), "di")
    past = Window.partitionBy("model").orderBy("di").rowsBetween(Window.unboundedPreceding, -1)
    f = f.withColumn("r", F.col("y") / F.greatest("f", F.lit(1e-9)))
    few = F.count("r").over(past) < 30
    bound = lambda p, d: F.col("f") * F.when(few, d).otherwise(F.percentile("r", p).over(past))
    held = f.withColumn("held", F.col("y").between(bound(0.1, 0.5), bound(0.9, 1.5)))
    return held.groupBy("model").agg(*[e.alias(k) for k, e in metrics(F.col("y"), F.col("f"), F.col("naive")).items()], F.round(F.avg(F.col("held").cast("double")), 4).alias("picp"))


def season_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How days of few and of many events are off the mean of their weekday, and off what month and weekday together explain of that; by fixed tails and by deciles."""
    d = _series(spark, sf_dir).withColumn("uplift", F.col("y") / F.avg("y").over(Window.partitionBy(F.weekday("day"))) - 1)
    columns = ("intercept", *CALENDAR)
    xx, xy, n, *_ = _moments(d, columns, F.col("uplift"), F.lit(1.0))
    beta = np.linalg.pinv(xx) @ xy
    d = d.withColumn("residual", F.col("uplift") - sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, columns, strict=True)), F.lit(0.0)))
    tenth = max(1, round(0.1 * n))
    both = tails(d).withColumn("split", F.lit("tails")).unionByName(tails(d, tenth, tenth).withColumn("split", F.lit("deciles")))
    return both.groupBy("split", "tail").agg(F.count("*").alias("days"), F.min("events").alias("least_events"), F.max("events").alias("most_events"), F.round(F.avg("uplift"), 6).alias("uplift"), F.round(F.avg("residual"), 6).alias("residual"))


def season_uplift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of `season_control` that is no fit: how far days of few and of many events are off the mean of their weekday."""
    d = daily_covariates(spark, sf_dir).withColumn("uplift", F.col("y") / F.avg("y").over(Window.partitionBy(F.weekday("day"))) - 1)
    return tails(d).groupBy("tail").agg(F.count("*").alias("days"), F.min("events").alias("least_events"), F.max("events").alias("most_events"), F.round(F.avg("uplift"), 6).alias("uplift"))


QUERIES = {
    "season_uplift": season_uplift,
    "ols_drivers": ols_drivers, "nb2_drivers": nb2_drivers, "season_control": season_control, "driver_multiplier": driver_multiplier,
    "walk_forward_ols_logcount": walk_forward_ols_logcount, "weather_events_experiment": weather_events_experiment,
}

#: Fits of several regressors can't be put in SQL; the tests hold them against plain refits.
ORACLES: dict[str, str] = {
    "season_uplift": f"""WITH {COVARIATES_SQL}, u AS (SELECT *, y / avg(y) OVER (PARTITION BY isodow(day)) - 1 AS uplift, row_number() OVER (ORDER BY events, di) AS r, count(*) OVER () AS n FROM panel)
      SELECT CASE WHEN r <= 140 THEN 'low' ELSE 'high' END AS tail, count(*) AS days, min(events) AS least_events, max(events) AS most_events, round(avg(uplift), 6) AS uplift FROM u WHERE r <= 140 OR r > n - 123 GROUP BY 1"""
}
