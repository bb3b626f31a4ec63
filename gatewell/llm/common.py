"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewell.session import stored  # noqa: F401

#: Characters that separate words, as in the contracts: space and \t \n \v \f \r.
SEPARATORS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; null counts as the remainder 0 of n + 1, which is no fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % n, F.lit(-1))


def bounded_sample(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """At most `rows` rows of df, the same ones each time: those of the smallest hash of `keys`."""
    return df.orderBy(F.xxhash64(F.lit("sample"), *keys), *keys).limit(rows)


def small_batches(spark: SparkSession) -> None:
    """Long texts go to Python in batches of bounded bytes, unless the session says otherwise."""
    for key, default in (("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20)), ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")):
        if key not in _explicit(spark):
            spark.conf.set(key, default)


def _explicit(spark: SparkSession) -> set[str]:
    return {k for k, _ in spark.sparkContext.getConf().getAll()}
