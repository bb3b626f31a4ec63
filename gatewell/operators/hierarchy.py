"""The hierarchy of codes with its geometry: streets by weight, centroids by area and boxes, merged up from codes to fives, tens and the city; and lookups that fall back along a chain of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewell.operators.gates import _AREA, _cells, Rules, answered, gates_at
from gatewell.operators.geo import _P, points
from gatewell.session import stored, table
from gatewell.sources.adapters import tx_area

#: From the finest level to the coarsest.
LEVELS = ("code", "fives", "tens", "city")


def with_units(rows: DataFrame, code: str = "code") -> DataFrame:
    """rows once for each level, with level and unit: the code, its half of ten, its ten, and the city."""
    c = F.col(code)
    tens = F.substring(c, 1, 5)
    half = F.when(F.substring(c, 6, 1).cast("int") < 5, "a").otherwise("b")
    units = (c, F.concat(tens, half), F.concat(tens, F.lit("x")), F.lit("city"))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), u.alias("unit")) for k, u in zip(LEVELS, units, strict=True)]))
    return rows.select("*", pairs.alias("__u")).select("*", "__u.level", "__u.unit").drop("__u")


def sectors(places: DataFrame) -> DataFrame:
    """Of places (code, x, y, street, shore) each code's number of them, middle, box and its area, and mean nearness to the shore. Everything above is merged from these rows."""
    box = places.groupBy("code").agg(
        F.count("*").alias("addresses"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("shore").alias("shore"),
        *[f(c).alias(f"{k}_{c}") for k, f in (("min", F.min), ("max", F.max)) for c in "xy"],
    )
    return box.withColumn("area", (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")))


def street_weights(places: DataFrame) -> DataFrame:
    """(level, unit, street, weight, rank): addresses of each street by unit, largest first, then by name. Counts of codes add up to those of their units."""
    of_code = places.filter("street is not null and street != ''").groupBy("code", "street").agg(F.count("*").alias("weight"))
    merged = with_units(of_code).groupBy("level", "unit", "street").agg(F.sum("weight").alias("weight"))
    streets = merged.groupBy("level", "unit").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("less"), "street"))).alias("s"))  # a city has some hundred streets
    return streets.select("level", "unit", F.posexplode("s").alias("rank", "s")).select("level", "unit", "s.street", (-F.col("s.less")).alias("weight"), (F.col("rank") + 1).alias("rank"))


def unit_geometry(codes: DataFrame) -> DataFrame:
    """Units of all levels from `sectors`: codes, addresses, area, centroid and shore weighted by area, the box, and the middle of the largest code for a label. A unit without area has no centroid."""
    by_area = lambda c: F.try_divide(F.sum(F.col(c) * F.col("area")), F.sum("area")).alias(c)
    largest = F.min_by(F.struct("x", "y"), F.struct(-F.col("area"), F.col("code")))
    out = with_units(codes).groupBy("level", "unit").agg(
        F.count("*").alias("codes"), F.sum("addresses").alias("addresses"), F.sum("area").alias("area"), *[by_area(c) for c in ("x", "y", "shore")],
        *[f(f"{k}_{c}").alias(f"{k}_{c}") for k, f in (("min", F.min), ("max", F.max)) for c in "xy"], largest.alias("label"),
    )
    return out.select("*", F.col("label.x").alias("label_x"), F.col("label.y").alias("label_y")).drop("label")


def unit_names(geometry: DataFrame, streets: DataFrame) -> DataFrame:
    """geometry with the name of each unit: its first two streets, or that it has none."""
    first = streets.filter("rank <= 2").groupBy("level", "unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "street"))), lambda s: s["street"]), " · ").alias("name"))
    return geometry.join(first, ["level", "unit"], "left").withColumn("name", F.when(F.col("level") == "city", "the whole city").otherwise(F.coalesce("name", F.lit("no addresses"))))


def answered_by(rows: DataFrame, dimension: DataFrame, chain: list[str]) -> DataFrame:
    """rows with what the first key of the chain that the dimension (level, key, value) knows says: answer, and level, the key's column; both null if none is known.

    chain names columns from the finest to the coarsest, which are the dimension's levels. A dimension has one row for each level and key; which side is broadcast is left to its measured size.
    """
    out = rows
    for c in chain:
        known = dimension.filter(F.col("level") == c).select(F.col("key").alias(f"__k_{c}"), F.struct(F.lit(c).alias("level"), F.col("value").alias("answer")).alias(f"__a_{c}"))
        out = out.join(known, F.col(c) == F.col(f"__k_{c}"), "left")
    best = F.coalesce(*[F.col(f"__a_{c}") for c in chain])
    return out.withColumn("__best", best).select(*rows.columns, "__best.answer", "__best.level")


# queries


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for addresses: the nation is the code, the market segment the street, and the balance tells how near the shore is."""
    k = F.col("c_custkey")
    own = table(spark, sf_dir, "customer").select(k.alias("id"), F.concat(F.lit("81-7"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("code"), F.when(k % 13 > 0, F.concat("c_mktsegment", F.lit(" "), (k % 4).cast("string"))).alias("street"), F.greatest(F.lit(0.0), 1 - F.abs("c_acctbal") / 9000).alias("shore"))
    return own.join(points(spark, sf_dir), "id")


def hierarchy_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = addresses(spark, sf_dir)
    out = unit_names(unit_geometry(stored(sectors(a), "sectors")), street_weights(a))
    return out.select("level", "unit", "name", "codes", "addresses", *[F.round(c, 6).alias(c) for c in ("area", "x", "y", "shore", "min_x", "min_y", "max_x", "max_y", "label_x", "label_y")])


def street_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return street_weights(addresses(spark, sf_dir))


def part_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for activities: the size of the market that a part is compared with, which is that of its type within a brand if that has as many as such have on average, of its brand likewise, or of the brands of its first digit."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("activity"), F.col("p_brand").alias("trade"), F.substring("p_brand", 1, 7).alias("sector"))
    chain = ["activity", "trade", "sector"]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).alias("key")) for c in chain]))
    sizes = parts.select(pairs.alias("p")).groupBy("p.level", "p.key").agg(F.count("*").alias("value"))
    usual = sizes.groupBy("level").agg(F.avg("value").alias("usual"))  # three rows
    sizes = sizes.join(usual, "level").filter((F.col("value") >= F.col("usual")) | (F.col("level") == "sector")).drop("usual")
    return answered_by(parts, sizes, chain).select("p_partkey", "level", "answer")


def area_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of what is known of an area: name, whether it may be shown and why not, its largest merchant's share, and the middle and number of its addresses. An area that may not be shown keeps its place alone."""
    cells = answered(gates_at(tx_area(spark, sf_dir), {"area": ["area"]}), ["area"], Rules())
    code = F.concat(F.lit("81-7"), F.lpad(F.col("area").cast("string"), 2, "0"))
    a = addresses(spark, sf_dir)
    places = unit_names(unit_geometry(sectors(a)), street_weights(a)).filter("level = 'code'")
    show = lambda c: F.when(F.col("ok"), c)
    return cells.withColumn("code", code).join(places, F.col("code") == F.col("unit"), "left").select(
        F.col("code"), "name", "addresses", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "ok", "reason",
        show(F.round(F.col("top_volume") / F.col("n_tx"), 6)).alias("top1_share"), show(F.col("n_tx")).alias("n_tx"), show(F.col("n_merchants")).alias("n_merchants"),
        F.when(F.col("addresses") >= 100, "observed").when(F.col("addresses") >= 1, "inferred").otherwise("none").alias("confidence"),
    )


QUERIES = {"hierarchy_geometry": hierarchy_geometry, "street_order": street_order, "part_context": part_context, "area_meta": area_meta}

_A = f"""WITH {_P}, a AS (SELECT '81-7' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS code, x, y, CASE WHEN c_custkey % 13 > 0 THEN c_mktsegment || ' ' || CAST(c_custkey % 4 AS VARCHAR) END AS street, greatest(0.0::DOUBLE, 1 - abs(c_acctbal) / 9000) AS shore FROM customer JOIN p ON id = c_custkey),
s AS (SELECT code, count(*) AS addresses, avg(x) AS x, avg(y) AS y, avg(shore) AS shore, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, (max(x) - min(x)) * (max(y) - min(y)) AS area FROM a GROUP BY code),
k AS (SELECT DISTINCT code, unnest(['code', 'fives', 'tens', 'city']) AS level, unnest([code, substr(code, 1, 5) || CASE WHEN substr(code, 6, 1)::INT < 5 THEN 'a' ELSE 'b' END, substr(code, 1, 5) || 'x', 'city']) AS unit FROM s),
w AS (SELECT level, unit, street, count(*) AS weight, row_number() OVER (PARTITION BY level, unit ORDER BY count(*) DESC, street) AS rank FROM a JOIN k USING (code) WHERE street IS NOT NULL GROUP BY level, unit, street),
n AS (SELECT level, unit, string_agg(street, ' · ' ORDER BY rank) AS name FROM w WHERE rank <= 2 GROUP BY level, unit),
g AS (SELECT level, unit, count(*) AS codes, CAST(sum(addresses) AS BIGINT) AS addresses, sum(area) AS area, sum(x * area) / sum(area) AS x, sum(y * area) / sum(area) AS y, sum(shore * area) / sum(area) AS shore, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y,
  arg_max(x, area) AS label_x, arg_max(y, area) AS label_y FROM s JOIN k USING (code) GROUP BY level, unit),
h AS (SELECT g.*, CASE WHEN g.level = 'city' THEN 'the whole city' ELSE coalesce(name, 'no addresses') END AS name FROM g LEFT JOIN n ON n.level = g.level AND n.unit = g.unit)"""

ORACLES = {
    "hierarchy_geometry": f"{_A} SELECT level, unit, name, codes, addresses, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("area", "x", "y", "shore", "min_x", "min_y", "max_x", "max_y", "label_x", "label_y")) + " FROM h",
    "street_order": f"{_A} SELECT level, unit, street, weight, CAST(rank AS INTEGER) AS rank FROM w",
    "part_context": """WITH p AS (SELECT p_partkey, p_brand || '/' || p_type AS activity, p_brand AS trade, substr(p_brand, 1, 7) AS sector FROM part), a AS (SELECT activity, count(*) AS n FROM p GROUP BY activity), b AS (SELECT trade, count(*) AS n FROM p GROUP BY trade), c AS (SELECT sector, count(*) AS n FROM p GROUP BY sector)
      SELECT p_partkey, CASE WHEN a.n >= (SELECT avg(n) FROM a) THEN 'activity' WHEN b.n >= (SELECT avg(n) FROM b) THEN 'trade' ELSE 'sector' END AS level, CASE WHEN a.n >= (SELECT avg(n) FROM a) THEN a.n WHEN b.n >= (SELECT avg(n) FROM b) THEN b.n ELSE c.n END AS answer FROM p JOIN a USING (activity) JOIN b USING (trade) JOIN c USING (sector)""",
    "area_meta": f"""{_A}, z AS (SELECT * FROM ({_AREA} {_cells('area')} SELECT '81-7' || lpad(CAST(area AS VARCHAR), 2, '0') AS unit, * FROM g))
      SELECT z.unit AS code, name, addresses, round(h.x, 6) AS x, round(h.y, 6) AS y, ok, reason, CASE WHEN ok THEN round(top_volume / CAST(n_tx AS DOUBLE), 6) END AS top1_share, CASE WHEN ok THEN n_tx END AS n_tx, CASE WHEN ok THEN n_merchants END AS n_merchants,
        CASE WHEN addresses >= 100 THEN 'observed' WHEN addresses >= 1 THEN 'inferred' ELSE 'none' END AS confidence FROM z LEFT JOIN h ON h.unit = z.unit AND h.level = 'code'""",
}
