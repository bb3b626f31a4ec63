"""Tumbling windows over the event stream: an addition of ours, as the model itself is a batch.

A window is given out once the watermark has passed its end, so a privacy gate sees closed windows alone.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type; rows later than `late` are dropped by the watermark."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    w = F.window("at", length)
    out = stamped.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("value"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "value")


def _folder(spark: SparkSession) -> str:
    """A new folder under the shared one; only a local session without one gets a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="gatewell-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def run_available(spark: SparkSession, out: DataFrame) -> DataFrame:
    """The stream over all that is there now, to a table in the shared folder, read back."""
    at = _folder(spark)
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start(f"{at}/rows")
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/rows")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return run_available(spark, tumbling(events)).withColumn("value", F.col("value").cast("double"))


QUERIES = {"stream_windows": stream_windows}
ORACLES = {
    "stream_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY 1, 2",
}
