"""The k-anonymised sample: area x day rows of at least k transactions and merchants, in released areas alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewell.operators.forecast import COVARIATES_SQL, daily_covariates
from gatewell.operators.gates import _cells, gate_columns
from gatewell.session import dealt, stored
from gatewell.sources.adapters import SENTINEL, TX_AREA_SQL, tx_area


def cells_and_pairs(tx: DataFrame) -> DataFrame:
    """A row for each area (paired is false, day null: what its gates need) and one for each area and day (paired), from one pass over the transactions; stored, and no larger than areas times days.

    Transactions are dealt once, by (area, merchant, card), and counted there by (area, merchant, card) and by (area, merchant, card, day); the latter are merged to (area, day, merchant) where those are counted.
    Nothing is combined or doubled before it is dealt, as cards hardly repeat within a merchant; cards are counted by themselves for the area.
    """
    keys = ["pc", "merchant", "card"]
    rows = dealt(tx.filter("pc is not null").select(*keys, F.col("day").alias("each_day"), (F.col("tm") != SENTINEL).alias("known"), "amount"), *keys, times=2)
    twice = rows.withColumn("paired", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("day", F.when(F.col("paired"), F.col("each_day")))
    rows = twice.groupBy(*keys, "paired", "day").agg(F.count("*").alias("n"), F.count_if("known").alias("d"), F.sum("amount").alias("a"))
    kind = F.explode(F.when(F.col("paired"), F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1))))
    each = rows.select("pc", "paired", "day", "n", "d", "a", F.col("merchant").alias("m"), F.col("card").alias("c"), kind.alias("kind"))
    each = each.withColumns({"merchant": F.when(F.col("kind") != 1, F.col("m")), "card": F.when(F.col("kind") == 1, F.col("c"))})
    parts = each.groupBy("pc", "paired", "day", "kind", "merchant", "card").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.sum("a").alias("a"), F.count("c").alias("cards"))
    of = lambda k, c: F.when(F.col("kind") == k, c if not isinstance(c, str) else F.col(c))
    out = parts.groupBy("pc", "paired", "day").agg(
        F.count(of(1, "card")).alias("n_cards"), F.coalesce(F.sum(of(1, "n")), F.lit(0)).alias("n_tx"), F.count(of(0, "merchant")).alias("n_merchants"), F.max(of(0, "n")).alias("top_volume"), F.max(of(0, "cards")).alias("top_cards"),
        F.sum(of(2, "n")).alias("transactions"), F.sum(of(2, "d")).alias("transactions_dated"), F.sum(of(2, "a")).cast("double").alias("amount"), F.count_if(F.col("kind") == 2).alias("merchants"),
    )
    return stored(out, "sample")


def _cells_of(both: DataFrame) -> DataFrame:
    return gate_columns(both.filter("not paired").select("pc", "n_cards", "n_tx", "n_merchants", "top_volume", "top_cards"))


def _pairs_of(both: DataFrame) -> DataFrame:
    return both.filter("paired").select("pc", "day", "transactions", "transactions_dated", "amount", "merchants")


def sample_rows(tx: DataFrame, k: int = 3, covariates: DataFrame | None = None) -> DataFrame:
    """The published rows; with the day's temp, rain, wind and number of events from covariates (by day), rounded as they are published."""
    both = cells_and_pairs(tx)
    kept = _pairs_of(both).join(_cells_of(both).filter("ok").select("pc"), "pc", "left_semi").filter((F.col("transactions") >= k) & (F.col("merchants") >= k))
    out = kept.withColumns({"weekday_iso": F.weekday("day") + 1, "month": F.month("day")})
    if covariates is None:
        return out
    return out.join(covariates.select("day", F.round("temp", 1).alias("temp"), F.round("rain", 4).alias("rain"), F.round("wind", 2).alias("wind"), F.col("events").alias("events_on_day")), "day", "left")


def _fates(both: DataFrame, k: int) -> DataFrame:
    marked = _pairs_of(both).join(_cells_of(both).filter("ok").select("pc", F.lit(True).alias("open")), "pc", "left")
    fate = F.when(F.col("open").isNull(), "area").when((F.col("transactions") < k) | (F.col("merchants") < k), "small").otherwise("kept")
    return marked.groupBy(fate.alias("fate")).agg(F.count("*").alias("pairs"), F.sum("transactions").alias("transactions"))


def pair_counts(tx: DataFrame, k: int = 3) -> DataFrame:
    """How many pairs are kept, are too small, or lie in areas held back."""
    return _fates(cells_and_pairs(tx), k)


def sample_manifest(tx: DataFrame, k: int = 3) -> DataFrame:
    """One row of what a published sample says of itself: areas by both readings of the share gate, and pairs published and held back."""
    both = cells_and_pairs(tx)
    loose = F.col("g1") & F.col("g2") & F.col("g3_volume")
    areas = _cells_of(both).agg(F.count("*").alias("areas"), F.count_if(loose).alias("passed_volume_only"), F.count_if("ok").alias("passed_volume_and_cards"), F.count_if(loose & ~F.col("ok")).alias("held_by_card_share"))
    of = lambda *fates: F.coalesce(F.sum(F.when(F.col("fate").isin(*fates), F.col("pairs"))), F.lit(0))
    pairs = _fates(both, k).agg(of("kept", "small").alias("pairs_in_released"), of("kept").alias("published"), of("small").alias("below_k"), of("area").alias("pairs_elsewhere"))
    return areas.crossJoin(pairs)  # one row each


def _tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    tm = F.when(F.col("l_orderkey") % 10 == 0, SENTINEL).otherwise("120000")
    return tx_area(spark, sf_dir).select(F.col("area").cast("string").alias("pc"), "day", "merchant", "card", "amount", tm.alias("tm"))


def _q(f):
    return lambda spark, sf_dir: f(_tx(spark, sf_dir))


QUERIES = {"sample_rows": lambda spark, sf_dir: sample_rows(_tx(spark, sf_dir), covariates=daily_covariates(spark, sf_dir)), "sample_pair_counts": _q(pair_counts), "sample_manifest": _q(sample_manifest)}

_W = f"""WITH {TX_AREA_SQL}, tx AS (SELECT CAST(area AS VARCHAR) AS pc, day, merchant, card, amount, CASE WHEN l_orderkey % 10 = 0 THEN '000000' ELSE '120000' END AS tm FROM tx_area), {_cells('pc').lstrip()},
pairs AS (SELECT pc, day, count(*) AS transactions, count(*) FILTER (WHERE tm <> '000000') AS transactions_dated, CAST(sum(amount) AS DOUBLE) AS amount, count(DISTINCT merchant) AS merchants FROM tx GROUP BY pc, day)"""
ORACLES = {
    "sample_rows": f"{_W}, {COVARIATES_SQL} SELECT round(temp, 1) AS temp, round(rain, 4) AS rain, round(wind, 2) AS wind, panel.events AS events_on_day, pairs.*, CAST(isodow(day) AS INTEGER) AS weekday_iso, CAST(month(day) AS INTEGER) AS month FROM pairs JOIN (SELECT pc FROM g WHERE ok) USING (pc) LEFT JOIN panel USING (day) WHERE transactions >= 3 AND merchants >= 3",
    "sample_pair_counts": f"{_W} SELECT CASE WHEN NOT ok THEN 'area' WHEN transactions < 3 OR merchants < 3 THEN 'small' ELSE 'kept' END AS fate, count(*) AS pairs, CAST(sum(transactions) AS BIGINT) AS transactions FROM pairs JOIN g USING (pc) GROUP BY 1",
    "sample_manifest": f"""{_W}, f AS (SELECT CASE WHEN NOT ok THEN 'area' WHEN transactions < 3 OR merchants < 3 THEN 'small' ELSE 'kept' END AS fate FROM pairs JOIN g USING (pc))
      SELECT count(*) AS areas, count(*) FILTER (WHERE g1 AND g2 AND g3_volume) AS passed_volume_only, count(*) FILTER (WHERE ok) AS passed_volume_and_cards, count(*) FILTER (WHERE g1 AND g2 AND g3_volume AND NOT ok) AS held_by_card_share,
        (SELECT count(*) FROM f WHERE fate <> 'area') AS pairs_in_released, (SELECT count(*) FROM f WHERE fate = 'kept') AS published, (SELECT count(*) FROM f WHERE fate = 'small') AS below_k, (SELECT count(*) FROM f WHERE fate = 'area') AS pairs_elsewhere FROM g""",
}
