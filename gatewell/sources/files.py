"""File sources and sinks: part files, digests, GeoJSON, CSV and JSON documents, and the reader of packed cubes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewell.operators.cube import byte_order, unpacked
from gatewell.session import table


def source_files(spark: SparkSession, folder: str, pattern: str = "*.parquet", least: int = 1) -> list[str]:
    """The files of a folder that match, in order of their names, by Spark's own listing; too few of them is an error."""
    found = sorted(r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path").collect())
    if len(found) < least:
        raise FileNotFoundError(f"{folder}/{pattern}: {len(found)} files, {least} expected")
    return found


def read_parts(spark: SparkSession, files: list[str], columns: list[str] | None = None) -> DataFrame:
    """All parts as one table, never deduplicated; other columns than expected, or in another order, are an error."""
    out = spark.read.parquet(*files)
    if columns is not None and out.columns != columns:
        raise ValueError(f"columns drifted: missing {sorted(set(columns) - set(out.columns))}, extra {sorted(set(out.columns) - set(columns))}, order {out.columns}")
    return out


def file_digests(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """file, bytes and SHA-256 of each file, computed where the files are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """A row for each feature: properties, and rings as arrays of arrays of (x, y), one for each part of a multipolygon."""
    schema = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    features = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    flat = features.select("f.properties", "f.geometry.type", "f.geometry.coordinates")
    multi = F.from_json("coordinates", "array<array<array<array<double>>>>")
    single = F.array(F.from_json("coordinates", "array<array<array<double>>>"))
    return flat.select("properties", "type", F.when(F.col("type") == "MultiPolygon", multi).otherwise(single).alias("parts"))


def geojson_edges(features: DataFrame, name: str) -> DataFrame:
    """area, x1, y1, x2, y2 of every edge, as `geo.inside` takes them; rings may be closed or open."""
    rings = features.select(F.col("properties")[name].alias("area"), F.explode("parts").alias("part")).select("area", F.explode("part").alias("ring"))
    points = F.when(F.element_at("ring", 1) == F.element_at("ring", -1), F.slice("ring", 1, F.size("ring") - 1)).otherwise(F.col("ring"))
    turned = rings.select("area", points.alias("a")).withColumn("b", F.concat(F.slice("a", 2, F.size("a")), F.slice("a", 1, 1)))
    sides = turned.select("area", F.explode(F.arrays_zip("a", "b")).alias("s"))
    return sides.select("area", *[F.col(f"s.{p}")[i].alias(n) for n, p, i in (("x1", "a", 0), ("y1", "a", 1), ("x2", "b", 0), ("y2", "b", 1))])


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """One CSV file with a header, in a fixed order: for results that are small by their nature, as a gated sample is."""
    df.repartition(1).sortWithinPartitions(*order).write.option("header", True).option("lineSep", "\n").mode("overwrite").csv(path)


def document(df: DataFrame, order: list[str], most: int = 100_000) -> str:
    """Rows as a JSON document with sorted keys, byte for byte the same for the same rows. A document of more than `most` rows is refused."""
    rows = df.orderBy(*order).select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("j")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a document holds at most {most} rows")
    return json.dumps([json.loads(r.j) for r in rows], sort_keys=True, ensure_ascii=False, indent=2) + "\n"


_TYPES = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool}
#: Keywords of a schema, and when a value breaks each.
_BROKEN = {
    "const": lambda v, x: v != x,
    "enum": lambda v, x: v not in x,
    "pattern": lambda v, x: isinstance(v, str) and not re.search(x, v),
    "minItems": lambda v, x: isinstance(v, list) and len(v) < x,
    "maxItems": lambda v, x: isinstance(v, list) and len(v) > x,
    "minimum": lambda v, x: isinstance(v, (int, float)) and v < x,
    "exclusiveMinimum": lambda v, x: isinstance(v, (int, float)) and v <= x,
    "maximum": lambda v, x: isinstance(v, (int, float)) and v > x,
}


def broken_rules(value: object, schema: dict, at: str = "$") -> Iterator[str]:
    """Where a small document breaks a JSON schema (the keywords of `_BROKEN`, type, required, properties, additionalProperties and items), as `place: keyword`. A value of the wrong type is told of that alone."""
    kind = schema.get("type")
    if kind and (not isinstance(value, _TYPES[kind]) or isinstance(value, bool) and kind != "boolean"):
        yield f"{at}: type"
        return
    yield from (f"{at}: {k}" for k, broken in _BROKEN.items() if k in schema and broken(value, schema[k]))
    if isinstance(value, dict):
        known, rest = schema.get("properties", {}), schema.get("additionalProperties", {})
        yield from (f"{at}.{k}: required" for k in schema.get("required", []) if k not in value)
        for k, v in value.items():
            if k not in known and rest is False:
                yield f"{at}.{k}: unexpected"
            else:
                yield from broken_rules(v, known.get(k, rest if isinstance(rest, dict) else {}), f"{at}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from broken_rules(v, schema.get("items", {}), f"{at}[{i}]")


#: What a packed cube's document must hold.
CUBE_SCHEMA = {
    "type": "object", "required": ["version", "rows", "days", "series"],
    "properties": {
        "version": {"const": 1}, "rows": {"type": "integer", "minimum": 0}, "days": {"type": "integer", "exclusiveMinimum": 0},
        "series": {"type": "array", "items": {"type": "object", "required": ["ci", "image"], "properties": {"ci": {"type": "integer", "minimum": 0}, "image": {"type": "string"}}}},
    },
}


def load_cube(spark: SparkSession, path: str, schema: dict | None = None) -> DataFrame:
    """(ci, i, n) of a packed cube's document: checked against the schema, the length of each series and the sum of all; anything amiss is an error, and nothing takes its place."""
    [text] = [r.value for r in spark.read.text(path, wholetext=True).collect()]  # one document, small by its nature
    found = json.loads(text)
    if odd := list(broken_rules(found, schema or CUBE_SCHEMA)):
        raise ValueError(f"{path}: {len(odd)} rules broken: {'; '.join(odd[:4])}")
    images = spark.createDataFrame([(s["ci"], s["image"]) for s in found["series"]], "ci int, image string")
    if short := images.filter(F.length(F.unbase64("image")) != 2 * found["days"]).count():
        raise ValueError(f"{path}: {short} series are not of {found['days']} days")
    order = byte_order(images, "ci", spark.range(1).select(F.lit(found["rows"]).cast("long"))).first()
    if order.total != order.expected:
        raise ValueError(f"{path}: holds {order.total} rows, {order.expected} expected")
    return unpacked(images, "ci", order.order)


def digest(df: DataFrame) -> tuple[int, int]:
    """Rows and an order-free sum of their hashes: equal for two runs of a deterministic job."""
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("h")).first()
    return r.n, int(r.h or 0)


def dimension_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_digests(spark, sf_dir, "{region,nation,supplier}.parquet")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parts of a table: rows, distinct ids, ids in both, and the span of days."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderkey") % 2).alias("part"))
    by_id = o.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.countDistinct("part").alias("parts"), F.min("day").alias("a"), F.max("day").alias("b"))
    return by_id.agg(F.sum("n").alias("rows"), F.count("*").alias("ids"), F.count_if(F.col("parts") > 1).alias("in_both"), F.min("a").alias("first_day"), F.max("b").alias("last_day"))


def props_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' JSON payloads, parsed, by day."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), F.from_json("props", "k long").alias("p"))
    return e.groupBy("day").agg(F.count("p.k").alias("payloads"), F.sum("p.k").alias("k"), F.max("p.k").alias("largest"))


QUERIES = {"dimension_digests": dimension_digests, "manifest": manifest, "props_by_day": props_by_day}
ORACLES = {
    "manifest": "WITH i AS (SELECT o_orderkey, count(*) AS n, count(DISTINCT o_orderkey % 2) AS parts, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS ids, count(*) FILTER (WHERE parts > 1) AS in_both, min(a) AS first_day, max(b) AS last_day FROM i",
    "props_by_day": "WITH e AS (SELECT CAST(ts AS DATE) AS day, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT day, count(k) AS payloads, CAST(sum(k) AS BIGINT) AS k, max(k) AS largest FROM e GROUP BY day",
}
