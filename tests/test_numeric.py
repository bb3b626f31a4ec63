import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewell.functions.scalar import format_share, haversine_km
from gatewell.operators.cube import packed, unpacked, whole_units
from gatewell.operators.forecast import forecasts, metrics
from gatewell.operators.regress import nb2, nb2_fit, ols, season_control, t_quantile, walk_forward


def days(spark, y):
    return spark.createDataFrame([(i, v) for i, v in enumerate(y)], "di int, y long").withColumn("day", F.expr("date_add(date '2024-01-01', di)"))


def test_hand_made_metrics(spark):
    df = spark.createDataFrame([(10.0, 12.0, 9.0), (20.0, 18.0, 19.0)], "y double, f double, b double")
    r = df.agg(*[e.alias(k) for k, e in metrics(F.col("y"), F.col("f"), F.col("b")).items()]).first()
    assert (r.mape, r.mae, r.bias) == (15.0, 2.0, 0.0) and math.isclose(r.wape, 13.3333) and r.mase_std == 2.0


def test_forecasts_need_their_whole_history(spark):
    f = {r.di: r for r in forecasts(days(spark, range(100))).collect()}
    assert f[27].mean4sw is None and f[28].mean4sw == np.mean([21, 14, 7, 0]) and f[28].median4sw == 10.5
    assert f[6].mean7 is None and f[7].mean7 == 3.0 and f[7].snaive == 0.0


def test_least_squares_find_planted_slope(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    df = spark.createDataFrame([(1.0, float(a), float(2 + 0.5 * a + e)) for a, e in zip(x, rng.normal(scale=0.1, size=400))], "one double, x double, y double")
    rows = {r[0]: r for r in ols(df, ("one", "x"), F.col("y"))}
    assert abs(rows["x"][1] - 0.5) < 0.02 and rows["x"][4] < 0.5 < rows["x"][5] and rows["r_squared"][1] > 0.9


def test_negative_binomial_finds_planted_slope(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    mu = np.exp(2 + 0.4 * x)
    y = rng.negative_binomial(5, 5 / (5 + mu))
    df = spark.createDataFrame([(1.0, float(a), int(b)) for a, b in zip(x, y)], "one double, x double, y long")
    beta, alpha = nb2(df, ("one", "x"), "y")
    assert abs(beta[1] - 0.4) < 0.15 and alpha > 0


def test_quantile_of_t():
    assert abs(t_quantile(10) - 2.2281) < 1e-3 and abs(t_quantile(1000) - 1.9623) < 1e-3


def test_packed_series_round_trip(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([0, 1, 255, 256, 65534])], "k string, i int, n long")
    rows = packed(df, "k", "i", F.col("n"))
    assert [r.n for r in unpacked(rows, "k").orderBy("i").collect()] == [0, 1, 255, 256, 65534]
    assert packed(df.unionAll(spark.createDataFrame([("a", 9, 65535)], df.schema)), "k", "i", F.col("n")).first().image is None


@pytest.mark.parametrize(("largest", "width"), [(65534, 2), (65535, 4), (67398, 4), (2**32 - 2, 4), (2**32 - 1, 8), (2**40 + 5, 8)])
def test_wide_series_round_trip(spark, largest, width):
    rows = packed(spark.createDataFrame([("a", i, v) for i, v in enumerate([0, 1, 256, largest])], "k string, i int, n long"), "k", "i", F.col("n"), wide=True)
    assert rows.first().width == width
    assert [r.n for r in unpacked(rows, "k").orderBy("i").collect()] == [0, 1, 256, largest]


def test_busy_days_are_packed_as_in_sql(spark, tmp_path):
    """70,000 events without an area on one day, and 65,535 on the next."""
    import duckdb

    from gatewell.plans import registry

    q = "SELECT i AS event_id, TIMESTAMP '2024-01-01 10:00:00' + CASE WHEN i < 70000 THEN INTERVAL 0 DAY ELSE INTERVAL 1 DAY END AS ts, CASE WHEN i % 5 = 0 AND i > 135000 THEN 4 ELSE 0 END AS user_id, 'a' AS event_type, 1.0 AS value, '{}' AS props FROM range(135535 + 1000) t(i)"
    duckdb.sql(f"COPY ({q}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name, columns in (("packed_series", "ci, image"), ("packed_roundtrip", "ci, di, n"), ("packed_order", '"order", total, expected')):
        found = registry.queries()[name](spark, str(tmp_path)).selectExpr(*[c.strip().replace('"', "`") for c in columns.split(",")])
        assert sorted(tuple(r) for r in found.collect()) == sorted(con.execute(f"SELECT {columns} FROM ({registry.oracle_sql()[name]})").fetchall())


def test_amounts_round_half_to_even(spark):
    df = spark.createDataFrame([(2.5, 100.0), (3.5, 100.0), (70000.0, 70000.0)], "a double, m double")
    assert [r[0] for r in df.select(whole_units(F.col("a"), F.col("m"))).collect()] == [2, 4, 7000]


def test_shares_are_exact(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (1, 200_00), (0, 7)], "n long, d long")
    assert [r[0] for r in df.select(format_share(F.col("n"), F.col("d"))).collect()] == ["33.33%", "66.67%", "0.01%", "0.00%"]
    assert [r[0] for r in df.select(format_share(F.col("n"), F.col("d"), 1)).collect()] == ["33.3%", "66.7%", "0.0%", "0.0%"]
    assert [r[0] for r in df.select(format_share(F.col("n"), F.col("d"), 0)).collect()] == ["33%", "67%", "0%", "0%"]
    big = spark.createDataFrame([(10**15 - 1, 10**15), (1, 0), (7, 7)], "n long, d long")
    assert [r[0] for r in big.select(format_share(F.col("n"), F.col("d"), 6)).collect()] == ["100.000000%", None, "100.000000%"]


def test_distance(spark):
    r = spark.range(1).select(haversine_km(F.lit(54.0), F.lit(18.0), F.lit(55.0), F.lit(18.0)).alias("d")).first()
    assert abs(r.d - 111.19) < 0.02


def test_negative_binomial_agrees_with_plain_scoring(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=250)
    y = rng.negative_binomial(4, 4 / (4 + np.exp(1.5 - 0.3 * x)))
    a = np.column_stack([np.ones(250), x])
    beta, alpha = np.array([np.log(y.mean()), 0.0]), 0.05
    for i in range(60):
        mu = np.exp(a @ beta)
        w = mu / (1 + alpha * mu)
        new = np.linalg.solve(a.T @ (a * w[:, None]), a.T @ (w * (a @ beta + (y - mu) / mu)))
        if i % 5 == 0:
            alpha = ((y - mu) ** 2 - mu).sum() / (mu**2).sum()
        done, beta = np.abs(new - beta).max() < 1e-9, new
        if done:
            break
    mu = np.exp(a @ beta)
    se = np.sqrt(np.diag(np.linalg.inv(a.T @ (a * (mu / (1 + alpha * mu))[:, None]))))
    fit = nb2_fit(spark.createDataFrame([(1.0, float(p), int(q)) for p, q in zip(x, y)], "one double, x double, y long"), ("one", "x"), "y")
    assert np.allclose(fit.beta, beta, atol=1e-6) and np.allclose(fit.se, se, atol=1e-6) and math.isclose(fit.alpha, alpha, abs_tol=1e-6) and fit.rounds == i + 1
    assert math.isclose(fit.deviance, 2 * (y * np.log(np.maximum(y, 1e-12) / mu) - (y - mu)).sum(), rel_tol=1e-6)


def test_walk_forward_agrees_with_refits(spark):
    rng = np.random.default_rng(4)
    n = 90
    x = np.column_stack([np.ones(n), rng.normal(size=n), rng.integers(0, 2, n)])
    t = x @ [1.0, 0.5, -0.2] + rng.normal(scale=0.1, size=n)
    t[[5, 40]] = np.nan
    rows = [(m, i, 7, None if np.isnan(t[i]) else float(t[i]), x[i].tolist(), x[i].tolist(), 2.0) for m in "ab" for i in range(n)]
    df = spark.createDataFrame(rows, "model string, di int, y long, t double, x array<double>, z array<double>, base double")
    found = {(r.model, r.di): r.f for r in walk_forward(df, first=30, least=35).collect()}
    assert set(found) == {(m, i) for m in "ab" for i in range(30, n)}
    for i in range(30, n):
        past = np.flatnonzero(np.isfinite(t[:i]))
        expected = 2 * np.exp(x[i] @ np.linalg.lstsq(x[past], t[past], rcond=None)[0]) if len(past) >= 35 else 2.0
        assert math.isclose(found["a", i], expected, rel_tol=1e-6) and found["a", i] == found["b", i]


def test_season_control_is_the_residual_of_additive_dummies(spark):
    import pandas as pd

    from gatewell.operators.forecast import daily_covariates

    d = daily_covariates(spark, "/root/testdata/sf0.01").toPandas().sort_values("di")
    day = pd.to_datetime(d["day"])
    u = d["y"] / d.groupby(day.dt.weekday.to_numpy())["y"].transform("mean") - 1
    x = np.column_stack([np.ones(len(d)), *[(day.dt.month == m) for m in range(2, 13)], *[(day.dt.weekday == w) for w in range(1, 7)]]).astype(float)
    rest = u.to_numpy() - x @ np.linalg.lstsq(x, u.to_numpy(), rcond=None)[0]
    order = np.argsort(d["events"].to_numpy(), kind="stable")
    found = {(r.split, r.tail): r for r in season_control(spark, "/root/testdata/sf0.01").collect()}
    k = round(0.1 * len(d))
    for key, held in {("tails", "low"): order[:140], ("tails", "high"): order[-123:], ("deciles", "low"): order[:k], ("deciles", "high"): order[-k:]}.items():
        assert found[key].days == len(held) and abs(found[key].uplift - u.to_numpy()[held].mean()) < 1e-5 and abs(found[key].residual - rest[held].mean()) < 1e-5


def test_candidates_of_ones_own(spark):
    from gatewell.operators.forecast import CANDIDATES, backtest_of, daily_covariates, require_past_only
    from gatewell.operators.regress import BASES, design, experiment

    days = daily_covariates(spark, "/root/testdata/sf0.001").filter("di < 200")
    mine = {"yesterday": lambda past: past.lag(1).cast("double"), "mean14": lambda past: past.over(F.avg, 14)}
    found = {r.candidate: r for r in backtest_of(days, require_past_only(days, CANDIDATES | mine)).collect()}
    assert set(found) == {*CANDIDATES, *mine}
    y = [r.y for r in days.orderBy("di").collect()]
    off = [abs(y[i] - y[i - 1]) for i in range(56, len(y))]
    assert math.isclose(found["yesterday"].mae, sum(off) / len(off), abs_tol=1e-4)
    ahead = {"tomorrow": lambda past: F.lead("y", 1).over(past._order).cast("double"), "today": lambda past: F.col("y").cast("double")}
    with pytest.raises(ValueError, match="today, tomorrow"):
        require_past_only(days, CANDIDATES | ahead)
    for bad in (lambda past: past.lag(0), lambda past: past.over(F.avg, 0)):
        with pytest.raises(ValueError):
            backtest_of(days, {"bad": bad})
    names = {r.model for r in experiment(design(days), BASES | {"mean14": mine["mean14"]}).collect()}
    assert {"drivers_on_mean14_weather", "drivers_on_mean14_weather_events", "drivers_on_snaive_weather"} <= names
