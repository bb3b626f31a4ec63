"""Adapters: the transaction model over the driver's tables.

`tx_area` has an area, its parent, a merchant, a card, an amount and a day for each line item; `tx_time` has a UTC time
code, a raw postcode and an issuer country for each event. Both are plain projections, so filters and columns reach the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewell.session import table

#: The civic time zone, and the sentinel that stands for an unknown time.
ZONE, SENTINEL = "Europe/Warsaw", "000000"

TX_AREA_SQL = """tx_area AS (
  SELECT s_nationkey AS area, n_regionkey AS parent, l_suppkey AS merchant, o_custkey AS card,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(l_shipdate AS DATE) AS day, l_orderkey, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""

TX_TIME_SQL = """tx_time AS (
  SELECT *, CASE WHEN pc_raw IS NULL OR pc_raw = '' THEN NULL WHEN length(pc_raw) = 6 THEN pc_raw
                 WHEN length(pc_raw) = 5 THEN substr(pc_raw, 1, 2) || '-' || substr(pc_raw, 3, 3) END AS pc FROM (
  SELECT event_id, ts, user_id AS card, event_type AS merchant, CAST(value AS DECIMAL(18,2)) AS amount, CAST(ts AS DATE) AS day,
         CASE WHEN event_id % 10 = 0 THEN '000000' ELSE strftime(ts, '%H%M%S') END AS tm,
         CASE WHEN user_id % 11 = 0 THEN NULL WHEN user_id % 11 = 1 THEN '' WHEN user_id % 11 = 2 THEN '00-00' || CAST(user_id % 10 AS VARCHAR)
              WHEN user_id % 11 = 3 THEN '817' || lpad(CAST(user_id % 24 AS VARCHAR), 2, '0')
              ELSE '81-7' || lpad(CAST(user_id % 24 AS VARCHAR), 2, '0') END AS pc_raw,
         CASE user_id % 7 WHEN 0 THEN '616' WHEN 1 THEN '276' WHEN 2 THEN '826' WHEN 3 THEN '752' WHEN 4 THEN '578' ELSE '840' END AS issuer
  FROM events))"""


def tx_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and nations are dimensions; which side is broadcast is left to their measured sizes."""
    supplier = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_regionkey")
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").alias("area"),
        F.col("n_regionkey").alias("parent"),
        F.col("l_suppkey").alias("merchant"),
        F.col("o_custkey").alias("card"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
        F.col("l_shipdate").cast("date").alias("day"),
        "l_orderkey",
        "l_linenumber",
    )


def postcode(raw):
    """Null and empty give null; six characters stay; five get a hyphen; other shapes are unhandled and give null."""
    return F.when(F.length(raw) == 6, raw).when(F.length(raw) == 5, F.concat(F.substring(raw, 1, 2), F.lit("-"), F.substring(raw, 3, 3)))


def tx_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    two = F.lpad((u % 24).cast("string"), 2, "0")
    raw = F.when(u % 11 == 0, F.lit(None)).when(u % 11 == 1, "").when(u % 11 == 2, F.concat(F.lit("00-00"), (u % 10).cast("string"))).when(u % 11 == 3, F.concat(F.lit("817"), two)).otherwise(F.concat(F.lit("81-7"), two))
    issuers = F.array(*[F.lit(x) for x in ("616", "276", "826", "752", "578", "840", "840")])
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        u.alias("card"),
        F.col("event_type").alias("merchant"),
        F.col("value").cast("decimal(18,2)").alias("amount"),
        F.col("ts").cast("date").alias("day"),
        F.when(F.col("event_id") % 10 == 0, SENTINEL).otherwise(F.date_format("ts", "HHmmss")).alias("tm"),
        raw.alias("pc_raw"),
        F.get(issuers, (u % 7).cast("int")).alias("issuer"),
    ).withColumn("pc", postcode(F.col("pc_raw")))
