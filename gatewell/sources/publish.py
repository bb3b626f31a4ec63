"""Publishing: several outputs and a manifest of them, in a folder that appears whole or not at all; and day lists of titles from JSON payloads."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewell.operators.gates import _AREA, _cells, REASONS, Rules, answered, gates_at, with_month
from gatewell.session import shared_dir, stored, table
from gatewell.sources.adapters import tx_area
from gatewell.sources.files import file_digests, write_csv


def publish(spark: SparkSession, outputs: dict[str, tuple[DataFrame, list[str]]], target: str, facts: dict | None = None, most: int = 100_000) -> dict:
    """Writes each output (rows, and the columns that order them) as one CSV file, and manifest.json: file, rows, bytes, SHA-256 and columns of each, and what else is told of them.

    All is written beside the target and renamed into place as the last step, so readers see everything or nothing; a run that fails leaves nothing behind. The target must not exist. Outputs are
    published aggregates: one of more than `most` rows is refused. Equal rows give equal files, and a manifest without times, so two runs agree byte for byte.
    """
    jvm = spark._jvm
    path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join(parts))
    store = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(path(target)):
        raise FileExistsError(target)
    draft = f"{target}.{uuid.uuid4().hex}.draft"
    try:
        told = []
        for name, (df, order) in sorted(outputs.items()):
            write_csv(df, f"{draft}/{name}", order)
            [part] = [f.getPath() for f in store.listStatus(path(draft, name)) if f.getPath().getName().startswith("part-")] or [None]
            if part is None:
                raise ValueError(f"{name} was not written")
            store.rename(part, path(draft, f"{name}.csv"))
            store.delete(path(draft, name), True)
            rows = spark.read.option("header", True).csv(f"{draft}/{name}.csv").count()
            if rows > most:
                raise ValueError(f"{name} has {rows} rows; at most {most} are published")
            told.append({"file": f"{name}.csv", "rows": rows, "columns": [{"name": c.name, "type": c.dataType.simpleString()} for c in df.schema]})
        found = {r.file: r for r in file_digests(spark, draft, "*.csv").collect()}
        manifest = {**(facts or {}), "outputs": [{**t, "bytes": found[t["file"]].bytes, "sha256": found[t["file"]].sha256} for t in told]}
        out = store.create(path(draft, "manifest.json"))
        out.write(bytearray((json.dumps(manifest, sort_keys=True, ensure_ascii=False, indent=2) + "\n").encode()))
        out.close()
        if not store.rename(path(draft), path(target)):
            raise OSError(f"{target} could not be put in place")
    except BaseException:
        store.delete(path(draft), True)
        raise
    return manifest


def read_manifest(spark: SparkSession, target: str) -> DataFrame:
    """A row for each output: file, rows, bytes, sha256, columns."""
    schema = "outputs array<struct<file: string, rows: long, bytes: long, sha256: string, columns: array<struct<name: string, type: string>>>>"
    out = spark.read.schema(schema).option("multiLine", True).json(f"{target}/manifest.json").select(F.explode("outputs").alias("o")).select("o.*")
    return out.withColumn("columns", F.array_join(F.transform("columns", lambda c: c["name"]), ","))


def altered(spark: SparkSession, target: str) -> list[str]:
    """Files of a published folder that are missing or aren't what its manifest says."""
    told, found = {r.file: r.sha256 for r in read_manifest(spark, target).collect()}, {r.file: r.sha256 for r in file_digests(spark, target, "*.csv").collect()}
    return sorted(f for f in {*told, *found} if told.get(f) != found.get(f))


def titles_by_day(rows: DataFrame, day: Column, payload: Column, order: Column) -> DataFrame:
    """(day, titles, n_titles, payloads, malformed): the first list of titles of each day that is not empty, in the order of rows; how many payloads there are, and how many are no JSON array of strings.

    A day without such a list has null titles and n_titles 0. Null payloads are none; titles that repeat stay, in their order.
    """
    text = F.trim(payload)
    read = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    x = rows.select(day.alias("day"), text.alias("text"), read.alias("titles"), order.alias("o"))
    full = F.when(F.size("titles") > 0, F.struct("o", "titles"))
    out = x.groupBy("day").agg(F.min(full).alias("first"), F.count("text").alias("payloads"), F.count_if(F.col("text").isNotNull() & F.col("titles").isNull()).alias("malformed"))
    return out.select("day", F.col("first.titles").alias("titles"), F.coalesce(F.size("first.titles"), F.lit(0)).alias("n_titles"), "payloads", "malformed")


# queries


def publish_areas(spark: SparkSession, sf_dir: str, target: str) -> dict:
    """Released areas and months of areas, with the rules, how many cells each reading of the share gate holds back, and the evidence of each area, in the manifest."""
    rules = Rules()
    cells = stored(answered(gates_at(with_month(tx_area(spark, sf_dir)), {"area": ["area"], "month": ["area", "month"]}, rules), [], rules), "cells")
    columns = ["n_tx", "n_cards", "n_merchants"]
    by = lambda level: cells.filter((F.col("level") == level) & F.col("ok"))
    areas = cells.filter("level = 'area'")
    evidence = {str(r.area): {"n_cards": r.n_cards, "n_merchants": r.n_merchants, "reason": r.reason} for r in areas.collect()}  # areas are a dimension
    loose = F.col("g1") & F.col("g2") & F.col("g3_volume")
    variants = areas.agg(F.count("*").alias("considered"), F.count_if(loose).alias("volume_only"), F.count_if("ok").alias("volume_and_cards"), F.count_if(loose & ~F.col("ok")).alias("held_by_card_share")).first().asDict()
    outputs = {"areas": (by("area").select("area", *columns), ["area"]), "months": (by("month").select("area", "month", *columns), ["area", "month"])}
    return publish(spark, outputs, target, {"rules": asdict(rules), "gate_variants": variants, "areas": evidence, "reasons": list(REASONS)})


def published_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = f"{shared_dir(spark)}/published-{uuid.uuid4().hex}"
    publish_areas(spark, sf_dir, target)
    return read_manifest(spark, target)


def listed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of each day: of five events one has none, one an empty list, one two titles, one a list cut short, and one its payload, which is no list."""
    k = F.col("event_id")
    two = F.concat(F.lit('["'), "event_type", F.lit(' é", "u'), F.col("user_id").cast("string"), F.lit('"]'))
    payload = F.when(k % 5 == 1, "[]").when(k % 5 == 2, two).when(k % 5 == 3, '["cut').when(k % 5 == 4, F.col("props"))
    out = titles_by_day(table(spark, sf_dir, "events"), F.col("ts").cast("date"), payload, k)
    return out.withColumn("titles", F.array_join("titles", "|"))


QUERIES = {"published_areas": published_areas, "listed_titles": listed_titles}

_G = lambda grain: f"SELECT * FROM (WITH {_cells(grain).lstrip()} SELECT * FROM g WHERE ok)"
ORACLES = {
    "published_areas": f"""{_AREA} a AS ({_G('area')}), m AS ({_G('area, month')}), t AS (
        SELECT 'areas.csv' AS file, count(*) AS rows, 'area,n_tx,n_cards,n_merchants' AS columns, string_agg(concat_ws(',', area, n_tx, n_cards, n_merchants) || chr(10), '' ORDER BY area) AS body FROM a
        UNION ALL SELECT 'months.csv', count(*), 'area,month,n_tx,n_cards,n_merchants', string_agg(concat_ws(',', area, month, n_tx, n_cards, n_merchants) || chr(10), '' ORDER BY area, month) FROM m)
      SELECT file, rows, CAST(strlen(columns || chr(10) || coalesce(body, '')) AS BIGINT) AS bytes, sha256(columns || chr(10) || coalesce(body, '')) AS sha256, columns FROM t""",
    "listed_titles": """WITH e AS (SELECT event_id, CAST(ts AS DATE) AS day, CASE event_id % 5 WHEN 1 THEN '[]' WHEN 2 THEN '["' || event_type || ' é", "u' || user_id || '"]' WHEN 3 THEN '["cut' WHEN 4 THEN props END AS p, event_type || ' é|u' || user_id AS pair FROM events)
      SELECT day, arg_min(pair, event_id) FILTER (WHERE event_id % 5 = 2) AS titles, CAST(CASE WHEN count(*) FILTER (WHERE event_id % 5 = 2) > 0 THEN 2 ELSE 0 END AS INTEGER) AS n_titles, count(p) AS payloads, count(*) FILTER (WHERE event_id % 5 >= 3 AND p IS NOT NULL) AS malformed FROM e GROUP BY day""",
}
