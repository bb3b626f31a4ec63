"""The privacy report: gates of areas, of areas by month and daypart, of their parents and of the city, all from one pass, and what the source holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewell.functions.scalar import daypart, local_time
from gatewell.operators.gates import REASONS, Rules, answered, gates_at, reason
from gatewell.sources.adapters import SENTINEL, TX_TIME_SQL, tx_time

#: Keys of each level of the report.
LEVELS = {"postcode": ["pc"], "month_daypart": ["pc", "month", "daypart"], "parent": ["tens"], "city": []}


def report_view(tx: DataFrame) -> DataFrame:
    """Transactions with local day, month and daypart beside the stored ones; no label is null. Rows of the unknown time have no month or daypart."""
    at, sentinel = local_time(F.col("day"), F.col("tm")), F.col("tm") == SENTINEL
    known = lambda c: F.when(~sentinel, c)
    return tx.select(
        F.coalesce(F.nullif(F.upper(F.trim("pc")), F.lit("")), F.lit("(none)")).alias("label"),
        "day",
        "card",
        "merchant",
        "issuer",
        sentinel.alias("sentinel"),
        at.cast("date").alias("local_day"),
        F.date_format(at, "yyyyMM").alias("local_month"),
        F.date_format("day", "yyyyMM").alias("stored_month"),
        known(F.date_format(at, "yyyyMM")).alias("month"),
        known(daypart(F.hour(at))).alias("daypart"),
    )


def source_facts(tx: DataFrame) -> DataFrame:
    """One row: rows, those of the unknown time, without a postcode, whose local day or month is another than the stored one; distinct labels, merchants, cards, months; the span of days."""
    v = report_view(tx)
    return v.agg(
        F.count("*").alias("rows"),
        F.count_if("sentinel").alias("sentinel_rows"),
        F.count_if(F.col("local_day") != F.col("day")).alias("local_day_rollover"),
        F.count_if(F.col("local_month") != F.col("stored_month")).alias("local_month_differs"),
        F.count_if(F.col("label") == "(none)").alias("no_postcode_rows"),
        *[F.countDistinct(c).alias(k) for c, k in (("label", "labels"), ("merchant", "merchants"), ("card", "cards"), ("local_month", "local_months"), ("stored_month", "stored_months"))],
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.array_join(F.array_sort(F.collect_set("issuer")), ",").alias("issuers"),  # codes of countries
    )


def report_cells(tx: DataFrame, rules: Rules = Rules(differencing=True)) -> DataFrame:
    """The cells of all LEVELS with their gates; the bucket without a postcode is no area, the unknown time no daypart, and both count for the city."""
    v = report_view(tx).withColumn("pc", F.nullif("label", F.lit("(none)"))).withColumn("tens", F.substring("pc", 1, 5))
    cells = gates_at(v, LEVELS, rules)
    has = {"postcode": F.col("pc").isNotNull(), "month_daypart": F.col("pc").isNotNull() & F.col("daypart").isNotNull(), "parent": F.col("tens").isNotNull(), "city": F.lit(True)}
    held = F.lit(False)
    for name, c in has.items():
        held = held | (F.col("level") == name) & c
    return cells.filter(held)


def report_summary(cells: DataFrame) -> DataFrame:
    """By level: cells, transactions, how many pass each gate, three and all four, and by the volume reading alone; the volume that each releases, in percent too."""
    g3, loose = F.col("g3_volume") & F.col("g3_cards"), F.col("g1") & F.col("g2") & F.col("g3_volume")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n_tx"))), F.lit(0))
    out = cells.groupBy("level").agg(
        F.count("*").alias("cells"), F.sum("n_tx").alias("n_tx"), F.count_if("g1").alias("g1_pass"), F.count_if("g2").alias("g2_pass"), F.count_if(g3).alias("g3_pass"), F.count_if("ok3").alias("three_pass"),
        F.count_if("g4").alias("g4_pass"), F.count_if("ok").alias("four_pass"), n(F.col("ok3")).alias("three_volume"), n(F.col("ok")).alias("four_volume"), F.count_if(loose).alias("volume_only_pass"), n(loose).alias("volume_only_volume"),
    )
    return out.withColumns({f"{k}_pct": F.round(100 * F.col(f"{k}_volume") / F.col("n_tx"), 2) for k in ("three", "four", "volume_only")})


def report_reasons(cells: DataFrame, rules: Rules = Rules(differencing=True)) -> DataFrame:
    """(level, gates, reason, cells): how often each reason is given by three gates and by four."""
    three = reason(cells.drop("g4"), rules).select("level", F.lit("three").alias("gates"), "reason")
    four = answered(cells, [], rules).select("level", F.lit("four").alias("gates"), "reason")
    return three.unionByName(four).groupBy("level", "gates", "reason").agg(F.count("*").alias("cells"))


# queries


def month_daypart_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = report_cells(tx_time(spark, sf_dir)).filter("level = 'month_daypart'")
    return answered(cells, [], Rules(differencing=True)).select("pc", "month", "daypart", "n_tx", "n_cards", "n_merchants", "top_volume", "top_cards", "g4", "ok", "reason")


QUERIES = {
    "source_facts": lambda spark, sf_dir: source_facts(tx_time(spark, sf_dir)),
    "month_daypart_gates": month_daypart_gates,
    "privacy_levels": lambda spark, sf_dir: report_summary(report_cells(tx_time(spark, sf_dir))),
    "privacy_reasons": lambda spark, sf_dir: report_reasons(report_cells(tx_time(spark, sf_dir))),
}

_AT = "timezone('Europe/Warsaw', (day + CAST(substr(tm,1,2) || ':' || substr(tm,3,2) || ':' || substr(tm,5,2) AS TIME)) AT TIME ZONE 'UTC')"
_V = f"""WITH {TX_TIME_SQL}, timed AS (SELECT *, {_AT} AS t FROM tx_time),
v AS (SELECT *, coalesce(nullif(upper(trim(pc)), ''), '(none)') AS label, tm = '000000' AS sentinel, CAST(t AS DATE) AS local_day, strftime(t, '%Y%m') AS local_month, strftime(day, '%Y%m') AS stored_month,
  CASE WHEN hour(t) <= 5 THEN 'night' WHEN hour(t) <= 11 THEN 'morning' WHEN hour(t) <= 17 THEN 'afternoon' ELSE 'evening' END AS daypart FROM timed)"""
_G = f"""{_V}, lv AS (SELECT 'postcode' AS level, pc, NULL AS month, NULL AS daypart, merchant, card FROM v WHERE label <> '(none)'
  UNION ALL SELECT 'month_daypart', pc, local_month, daypart, merchant, card FROM v WHERE label <> '(none)' AND NOT sentinel
  UNION ALL SELECT 'parent', substr(pc, 1, 5), NULL, NULL, merchant, card FROM v WHERE label <> '(none)' UNION ALL SELECT 'city', NULL, NULL, NULL, merchant, card FROM v),
u AS (SELECT level, concat_ws('|', pc, month, daypart) AS unit, pc, month, daypart, merchant, card FROM lv),
m AS (SELECT level, unit, merchant, count(*) AS volume, count(DISTINCT card) AS cards FROM u GROUP BY ALL),
t AS (SELECT level, unit, any_value(pc) AS pc, any_value(month) AS month, any_value(daypart) AS daypart, count(*) AS n_tx, count(DISTINCT card) AS n_cards, count(DISTINCT merchant) AS n_merchants FROM u GROUP BY level, unit),
p AS (SELECT level, unit, max(volume) AS top_volume, max(cards) AS top_cards FROM m GROUP BY level, unit),
x AS (SELECT level, unit, merchant, count(*) AS gone FROM (SELECT level, unit, card, min(merchant) AS merchant FROM u GROUP BY level, unit, card HAVING count(DISTINCT merchant) = 1) GROUP BY ALL),
r AS (SELECT a.level, a.unit, t.n_cards - coalesce(x.gone, 0) AS c, t.n_merchants - 1 AS k, t.n_tx - a.volume AS n, coalesce(max(b.volume), 0) AS tv, coalesce(max(b.cards), 0) AS tc
  FROM m a JOIN t USING (level, unit) LEFT JOIN x ON x.level = a.level AND x.unit = a.unit AND x.merchant = a.merchant LEFT JOIN m b ON b.level = a.level AND b.unit = a.unit AND b.merchant <> a.merchant GROUP BY a.level, a.unit, a.merchant, t.n_cards, x.gone, t.n_merchants, t.n_tx, a.volume),
d AS (SELECT level, unit, bool_and(c >= 30 AND k >= 3 AND n > 0 AND c > 0 AND 4 * tv <= 3 * n AND 4 * least(tc, c) <= 3 * c) AS g4 FROM r GROUP BY level, unit),
g AS (SELECT *, n_cards >= 30 AS g1, n_merchants >= 3 AS g2, 4 * top_volume <= 3 * n_tx AS gv, 4 * top_volume <= 3 * n_tx AND 4 * top_cards <= 3 * n_cards AS g3 FROM t JOIN p USING (level, unit) JOIN d USING (level, unit)),
f AS (SELECT *, g1 AND g2 AND g3 AS ok3, g1 AND g2 AND g3 AND g4 AS ok, list_filter([CASE WHEN NOT g1 THEN '{REASONS[0]}' END, CASE WHEN NOT g2 THEN '{REASONS[1]}' END, CASE WHEN NOT g3 THEN '{REASONS[2]}' END, CASE WHEN NOT g4 THEN '{REASONS[3]}' END], lambda y: y IS NOT NULL) AS why FROM g)"""
_WHY = "CASE len({w}) WHEN 0 THEN 'ok' WHEN 1 THEN {w}[1] ELSE 'multi' END"
_THREE = f"list_filter(why, lambda y: y <> '{REASONS[3]}')"

ORACLES = {
    "source_facts": f"""{_V} SELECT count(*) AS rows, count(*) FILTER (WHERE sentinel) AS sentinel_rows, count(*) FILTER (WHERE local_day <> day) AS local_day_rollover, count(*) FILTER (WHERE local_month <> stored_month) AS local_month_differs,
      count(*) FILTER (WHERE label = '(none)') AS no_postcode_rows, count(DISTINCT label) AS labels, count(DISTINCT merchant) AS merchants, count(DISTINCT card) AS cards, count(DISTINCT local_month) AS local_months, count(DISTINCT stored_month) AS stored_months,
      min(day) AS first_day, max(day) AS last_day, array_to_string(list_sort(list(DISTINCT issuer)), ',') AS issuers FROM v""",
    "month_daypart_gates": f"{_G} SELECT pc, month, daypart, n_tx, n_cards, n_merchants, top_volume, top_cards, g4, ok, {_WHY.format(w='why')} AS reason FROM f WHERE level = 'month_daypart'",
    "privacy_levels": f"""{_G} SELECT level, count(*) AS cells, CAST(sum(n_tx) AS BIGINT) AS n_tx, count(*) FILTER (WHERE g1) AS g1_pass, count(*) FILTER (WHERE g2) AS g2_pass, count(*) FILTER (WHERE g3) AS g3_pass, count(*) FILTER (WHERE ok3) AS three_pass,
      count(*) FILTER (WHERE g4) AS g4_pass, count(*) FILTER (WHERE ok) AS four_pass, CAST(coalesce(sum(n_tx) FILTER (WHERE ok3), 0) AS BIGINT) AS three_volume, CAST(coalesce(sum(n_tx) FILTER (WHERE ok), 0) AS BIGINT) AS four_volume, count(*) FILTER (WHERE g1 AND g2 AND gv) AS volume_only_pass,
      CAST(coalesce(sum(n_tx) FILTER (WHERE g1 AND g2 AND gv), 0) AS BIGINT) AS volume_only_volume, round(100.0::DOUBLE * coalesce(sum(n_tx) FILTER (WHERE ok3), 0) / sum(n_tx), 2) AS three_pct, round(100.0::DOUBLE * coalesce(sum(n_tx) FILTER (WHERE ok), 0) / sum(n_tx), 2) AS four_pct,
      round(100.0::DOUBLE * coalesce(sum(n_tx) FILTER (WHERE g1 AND g2 AND gv), 0) / sum(n_tx), 2) AS volume_only_pct FROM f GROUP BY level""",
    "privacy_reasons": f"{_G} SELECT level, 'three' AS gates, {_WHY.format(w=_THREE)} AS reason, count(*) AS cells FROM f GROUP BY ALL UNION ALL SELECT level, 'four', {_WHY.format(w='why')}, count(*) FROM f GROUP BY ALL",
}
