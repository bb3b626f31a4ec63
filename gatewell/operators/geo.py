"""Geometry as joins: point in polygon by edges, nearest area, shared and nearest edges, spans and points of areas, and a kernel field over a grid with its flow.

Areas are a dimension; here a supplier's premises stand for one, whose shape and place its key tells, so that there are more of them in larger tables.
Points meet polygons through a grid of cells that a polygon's box covers, an equi-join; then a point is inside if a ray from it crosses an odd number of edges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewell.functions.scalar import haversine_km
from gatewell.operators.gates import _AREA, _cells, gate
from gatewell.session import dealt, table
from gatewell.sources.adapters import tx_area

#: Areas as rings of (x, y): a square, one with a hole, one of two parts, and a C.
POLYGONS = {
    "square": [[(1, 1), (4, 1), (4, 4), (1, 4)]],
    "holed": [[(5, 1), (9, 1), (9, 5), (5, 5)], [(6, 2), (8, 2), (8, 4), (6, 4)]],
    "parts": [[(1, 6), (3, 6), (3, 8), (1, 8)], [(4, 6), (6, 6), (6, 8), (4, 8)]],
    "c": [[(7, 6), (10, 6), (10, 7), (8, 7), (8, 9), (10, 9), (10, 10), (7, 10)]],
}


def edge_rows() -> list[tuple[str, float, float, float, float]]:
    return [(name, float(x1), float(y1), float(x2), float(y2)) for name, rings in POLYGONS.items() for ring in rings for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True)]


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(edge_rows(), "area string, x1 double, y1 double, x2 double, y2 double")


def premises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sides of an area for each supplier: one of the shapes, scaled and moved by its key."""
    k, n = F.col("s_suppkey"), len(POLYGONS)
    shapes = F.array(*[F.lit(x) for x in sorted(POLYGONS)])
    grown, right, up = 1 + k % 5 / 4, k % 40 * 13, F.floor(k / 40) % 30 * 11
    out = table(spark, sf_dir, "supplier").withColumn("shape", F.get(shapes, (k % n).cast("int"))).join(edges(spark).withColumnRenamed("area", "shape"), "shape")
    return out.select(k.alias("area"), *[(F.col(c) * grown + (right if c[0] == "x" else up)).alias(c) for c in ("x1", "y1", "x2", "y2")])


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each customer, by its key, over a square of 11 by 11."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), ((k * 37 % 1100) / 100 + 0.003).alias("x"), ((k * 91 % 1097) / 100 + 0.007).alias("y"))


def inside(pts: DataFrame, sides: DataFrame) -> DataFrame:
    """(id, area) of each point inside an area, holes left out."""
    box = sides.groupBy("area").agg(F.floor(F.min(F.least("x1", "x2"))).alias("a"), F.floor(F.max(F.greatest("x1", "x2"))).alias("b"), F.floor(F.min(F.least("y1", "y2"))).alias("c"), F.floor(F.max(F.greatest("y1", "y2"))).alias("d"))
    cells = box.select("area", F.explode(F.sequence("a", "b")).alias("gx"), "c", "d").select("area", "gx", F.explode(F.sequence("c", "d")).alias("gy"))
    near = pts.withColumns({"gx": F.floor("x"), "gy": F.floor("y")}).join(cells, ["gx", "gy"]).join(sides, "area")
    # the slope of a level edge is never used, as such an edge is not crossed
    crosses = F.when((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y")), (F.col("x") < F.try_divide((F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")), F.col("y2") - F.col("y1")) + F.col("x1"))).otherwise(False)
    return near.groupBy("id", "area").agg(F.count_if(crosses).alias("k")).filter("k % 2 = 1").select("id", "area")


def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inside(points(spark, sf_dir), edges(spark))


def shared_edges(sides: DataFrame) -> DataFrame:
    """(a, b, x1, y1, x2, y2): edges that two areas have in common, whichever way round; areas beside each other are adjacent."""
    turned = (F.col("x1") > F.col("x2")) | (F.col("x1") == F.col("x2")) & (F.col("y1") > F.col("y2"))
    ends = [F.when(turned, F.col(t)).otherwise(F.col(o)).alias(o) for o, t in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))]
    whole = sides.select("area", *ends).groupBy("x1", "y1", "x2", "y2").agg(F.min("area").alias("a"), F.max("area").alias("b"))
    return whole.filter("a != b").select("a", "b", "x1", "y1", "x2", "y2")


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """From a point to a segment; a segment without length is a point."""
    dx, dy = x2 - x1, y2 - y1
    along = F.coalesce(F.try_divide((x - x1) * dx + (y - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.hypot(x - (x1 + t * dx), y - (y1 + t * dy))


def boundary_distance(pts: DataFrame, sides: DataFrame) -> DataFrame:
    """(id, area, distance) of each point of (id, area, x, y) to the nearest edge of its area."""
    d = segment_distance(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")])
    return pts.join(sides, "area").groupBy("id", "area").agg(F.min(d).alias("distance"))


def snapped(pts: DataFrame, samples: DataFrame, sides: DataFrame, distance=None, labels: DataFrame | None = None) -> DataFrame:
    """(id, area, x, y, snapped, moved): points of (id, area, x, y) that lie outside their area are moved to the nearest of its samples (area, x, y) that lie inside, or, if none does, to the area's label (area, x, y)
    if that lies inside; without any they stay. moved is how far, by `distance` of two points' x and y, which is the plain one unless another is given, as `degrees_km` is for longitudes and latitudes."""
    held = inside(pts.select("id", "x", "y"), sides).withColumn("held", F.lit(True))
    places = samples.select("area", "x", "y", F.lit(0).alias("rank"))
    if labels is not None:
        places = places.unionByName(labels.select("area", "x", "y", F.lit(1).alias("rank")))
    places = places.distinct().withColumn("id", F.struct("area", "rank", "x", "y"))
    good = places.join(inside(places.select("id", "x", "y").distinct(), sides), ["id", "area"], "left_semi").select("area", "rank", F.col("x").alias("sx"), F.col("y").alias("sy"))
    near = pts.join(held, ["id", "area"], "left").join(good, "area", "left")  # an area has a few samples
    gap = (distance or (lambda a, b, c, d: F.hypot(a - c, b - d)))(F.col("x"), F.col("y"), F.col("sx"), F.col("sy"))
    best = near.groupBy("id", "area").agg(F.max("held").alias("held"), F.first("x").alias("x"), F.first("y").alias("y"), F.min_by(F.struct("sx", "sy", gap.alias("gap")), F.struct("rank", gap, "sx", "sy")).alias("s"))
    moves = F.col("held").isNull() & F.col("s.sx").isNotNull()
    return best.select("id", "area", F.when(moves, F.col("s.sx")).otherwise(F.col("x")).alias("x"), F.when(moves, F.col("s.sy")).otherwise(F.col("y")).alias("y"), moves.alias("snapped"), F.when(moves, F.col("s.gap")).otherwise(0.0).alias("moved"))


def degrees_km(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Kilometres between points of longitude x and latitude y."""
    return haversine_km(y1, x1, y2, x2)


def spans(sides: DataFrame, lines: int = 8) -> DataFrame:
    """(area, y, x1, x2): the stretches of each area along `lines` level lines, evenly spaced within its height; holes part them."""
    box = sides.groupBy("area").agg(F.min(F.least("y1", "y2")).alias("low"), F.max(F.greatest("y1", "y2")).alias("high"))
    at = box.select("area", "low", "high", F.explode(F.sequence(F.lit(1), F.lit(lines))).alias("k")).select("area", (F.col("low") + (F.col("high") - F.col("low")) * F.col("k") / (lines + 1)).alias("y"))
    met = at.join(sides, "area").filter((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y")))
    x = F.col("x1") + (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1"))
    sorted_ = met.groupBy("area", "y").agg(F.array_sort(F.collect_list(x)).alias("xs"))  # as many as a line crosses edges
    pairs = F.explode(F.expr("transform(sequence(0, size(xs) div 2 - 1), i -> struct(xs[2 * i] AS x1, xs[2 * i + 1] AS x2))"))
    return sorted_.select("area", "y", pairs.alias("s")).select("area", "y", "s.x1", "s.x2").filter("x2 > x1")


def interior_points(sides: DataFrame, k: int = 1, apart: float = 0.0, lines: int = 200) -> DataFrame:
    """(area, rank, x, y, depth): up to k points inside each area, the deepest first, each at least `apart` from those before it.

    The candidates are the middles of all spans on `lines` level lines, and depth is the distance to the nearest edge, of holes too; of
    equally deep ones the lowest, then the leftmost is taken. An area that no line meets has no row. Edges are dealt by area once and joins merge:
    a planner takes an area's lines for as small as the area, and would send them whole through the driver.
    """
    sides = dealt(sides, "area").hint("merge")
    middles = spans(sides, lines).select("area", ((F.col("x1") + F.col("x2")) / 2).alias("x"), "y").withColumn("id", F.struct("x", "y"))
    depths = boundary_distance(middles, sides).select("area", "id.x", "id.y", F.col("distance").alias("depth"))
    order = F.array_sort(F.collect_list(F.struct((-F.round("depth", 9)).alias("less"), "y", "x", "depth")))  # lines and few spans on each, whatever the area

    def taken(chosen: Column, p: Column) -> Column:
        near = F.exists(chosen, lambda c: F.hypot(c["x"] - p["x"], c["y"] - p["y"]) < apart)
        return F.when((F.size(chosen) < k) & ~near, F.concat(chosen, F.array(p))).otherwise(chosen)

    none = F.expr("cast(array() as array<struct<less: double, y: double, x: double, depth: double>>)")
    best = depths.groupBy("area").agg(F.aggregate(order, none, taken).alias("p"))
    return best.select("area", F.posexplode("p").alias("rank", "p")).select("area", (F.col("rank") + 1).alias("rank"), "p.x", "p.y", "p.depth")


def confidence(both_agree: Column, support: Column, addresses: Column, polygon: Column | None = None) -> Column:
    """`none` for an area without a polygon, if it is told which have one; else how well a polygon is known, by how many sources agree, what share of it is supported (in percent), and how many addresses it has; unknown figures count as 0."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    rest = F.when(~polygon, "none") if polygon is not None else F
    return rest.when((zero(both_agree) >= 3) & (zero(support) >= 75), "observed").when((zero(addresses) >= 1) & (zero(support) >= 40), "inferred").otherwise("extrapolated")


def area_label(streets: Column, code: Column) -> Column:
    """The first of the streets, which semicolons part, after `ul. `; the code if there is none."""
    first = F.trim(F.substring_index(F.coalesce(streets, F.lit("")), ";", 1))
    return F.when(first != "", F.concat(F.lit("ul. "), first)).otherwise(code)


def edge_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How deep each point lies in its area."""
    p = points(spark, sf_dir)
    d = boundary_distance(p.join(inside(p, edges(spark)), "id"), edges(spark))
    return d.select("id", "area", F.round("distance", 6).alias("distance"))


def part_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three-way rule and the label over parts, whose size, price and key stand for the figures of polygons."""
    k, size, price = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", confidence(size % 7, price % 100, k % 3, k % 11 > 0).alias("confidence"), area_label(F.when(k % 5 > 0, F.concat("p_brand", F.lit(" ; "), "p_type")), k.cast("string")).alias("label"))


def centroids(spark: SparkSession) -> DataFrame:
    rows = [(n, 54.4 + sum(y for r in rings for _, y in r) / sum(map(len, rings)) / 100, 18.5 + sum(x for r in rings for x, _ in r) / sum(map(len, rings)) / 100) for n, rings in POLYGONS.items()]
    return spark.createDataFrame(rows, "area string, lat double, lng double")


def nearest_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area whose centre is nearest, if that is within 1.5 km; the few centres go to every point."""
    p = points(spark, sf_dir).select("id", (54.4 + F.col("y") / 100).alias("plat"), (18.5 + F.col("x") / 100).alias("plng"))
    d = p.crossJoin(F.broadcast(centroids(spark))).withColumn("km", haversine_km(F.col("plat"), F.col("plng"), F.col("lat"), F.col("lng")))  # four rows
    best = d.groupBy("id").agg(F.min_by("area", F.struct("km", "area")).alias("area"), F.round(F.min("km"), 6).alias("km"))
    return best.filter("km < 1.5")


def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return premises(spark, sf_dir).groupBy("area").agg(F.min("x1").alias("min_x"), F.max("x1").alias("max_x"), F.min("y1").alias("min_y"), F.max("y1").alias("max_y"), F.round(F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2, 6).alias("ring_area"))


def field(values: DataFrame, *columns: str) -> DataFrame:
    """(gx, gy, n, columns): at each grid cell the Gaussian-weighted means of points within two cells; points are bucketed, so the join is by cell."""
    reach = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    spread = values.select("x", "y", *columns, reach.alias("dx")).select("*", reach.alias("dy")).select("x", "y", *columns, (F.floor("x") + F.col("dx")).alias("gx"), (F.floor("y") + F.col("dy")).alias("gy"))
    w = F.exp(-(F.pow(F.col("gx") + 0.5 - F.col("x"), 2) + F.pow(F.col("gy") + 0.5 - F.col("y"), 2)) / 2)
    cells = spread.filter("gx between 0 and 10 and gy between 0 and 10").withColumn("w", w)
    return cells.groupBy("gx", "gy").agg(F.count("*").alias("n"), *[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in columns])


#: How far an area's samples reach, in km, by what is looked at.
SIGMA = {"city": 0.16, "unit": 0.12, "code": 0.09}


def smoothstep(x: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return t * t * (3 - 2 * t)


def gated_field(samples: DataFrame, values: DataFrame, level: str = "city", smoothing: float = 1.0, spacing: float = 0.11, step: float = 0.1) -> DataFrame:
    """(gx, gy, value, alpha, shade): a kernel field that withheld areas never colour.

    samples (area, x, y) spread over cells of width `step`, as far as their weight is above 2e-4; values (area, value) has released areas alone. A cell's value is the weighted mean of those; alpha
    fades it where samples are few against what `spacing` lets expect, and where those of withheld areas outweigh; shade is the value between the 2nd and the 98th percentile of cells
    with an alpha above 0.3. A cell that only withheld areas reach has no value, alpha 0 and no shade.
    """
    sigma = SIGMA[level] * smoothing
    reach = F.explode(F.sequence(F.lit(-math.ceil(4.2 * sigma / step)), F.lit(math.ceil(4.2 * sigma / step))))
    near = samples.select("area", "x", "y", reach.alias("dx")).select("*", reach.alias("dy"))
    near = near.select("area", "x", "y", (F.floor(F.col("x") / step) + F.col("dx")).alias("gx"), (F.floor(F.col("y") / step) + F.col("dy")).alias("gy"))
    w = F.exp(-(F.pow((F.col("gx") + 0.5) * step - F.col("x"), 2) + F.pow((F.col("gy") + 0.5) * step - F.col("y"), 2)) / (2 * sigma * sigma))
    known = near.withColumn("w", w).filter("w > 2e-4").join(values.filter("value is not null"), "area", "left")
    cells = known.groupBy("gx", "gy").agg(F.sum("w").alias("all"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("w"))), F.lit(0.0)).alias("open"), F.sum(F.col("w") * F.col("value")).alias("total"))
    seen = F.col("open") > 1e-5
    alpha = smoothstep(F.col("all") / (0.35 * 2 * math.pi * (sigma / spacing) ** 2)) * smoothstep((F.col("open") / F.col("all") - 0.15) / 0.7)
    out = cells.select("gx", "gy", F.when(seen, F.col("total") / F.col("open")).alias("value"), F.when(seen, alpha).otherwise(0.0).alias("alpha"))
    # the cells of a grid, a bounded number
    of = out.agg(F.array_sort(F.collect_list(F.when(F.col("alpha") > 0.3, F.col("value")))).alias("v"))
    at = lambda p, d: F.coalesce(F.get("v", F.floor(F.size("v") * p).cast("int")), F.lit(d))
    ends = of.select(at(0.02, 0.0).alias("low"), at(0.98, 1.0).alias("high"))
    return out.crossJoin(F.broadcast(ends)).select("gx", "gy", "value", "alpha", ((F.col("value") - F.col("low")) / F.greatest(F.lit(1e-6), F.col("high") - F.col("low"))).alias("shade"))


def flow(change: DataFrame, least: float = 0.12) -> DataFrame:
    """(gx, gy, dx, dy, strength): the gradient of a change over the grid (gx, gy, d) by central differences, where all four neighbours are known; strength is against the largest, and under `least` there is none."""
    toward = [(1, 0, -0.5, 0.0), (-1, 0, 0.5, 0.0), (0, 1, 0.0, -0.5), (0, -1, 0.0, 0.5)]
    given = F.explode(F.array(*[F.struct((F.col("gx") + i).alias("gx"), (F.col("gy") + j).alias("gy"), (F.col("d") * a).alias("dx"), (F.col("d") * b).alias("dy")) for i, j, a, b in toward]))
    met = change.filter("d is not null").select(given.alias("g")).select("g.*").groupBy("gx", "gy").agg(F.count("*").alias("k"), F.sum("dx").alias("dx"), F.sum("dy").alias("dy"))
    size = met.filter("k = 4").withColumn("size", F.hypot("dx", "dy")).filter("size > 0")
    largest = size.agg(F.max("size").alias("largest"))  # one row
    return size.crossJoin(F.broadcast(largest)).withColumn("strength", F.col("size") / F.col("largest")).filter(F.col("strength") >= least).select("gx", "gy", "dx", "dy", "strength")


def _balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances, and what stands for those of the hour after."""
    k = F.col("c_custkey")
    return points(spark, sf_dir).join(table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_acctbal").alias("v"), (F.col("c_acctbal") * (k % 5) / 2).alias("later")), "id")


def heat_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field(_balances(spark, sf_dir), "v").select("gx", "gy", "n", F.round("v", 4).alias("value"))


def heat_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the field will grow from, over the next hour."""
    change = field(_balances(spark, sf_dir), "v", "later").select("gx", "gy", (F.col("later") - F.col("v")).alias("d"))
    return flow(change).select("gx", "gy", *[F.round(c, 4).alias(c) for c in ("dx", "dy", "strength")])


def area_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two deepest points of each supplier's premises, at least half a unit apart."""
    return interior_points(premises(spark, sf_dir), 2, 0.5).select("area", "rank", *[F.round(c, 6).alias(c) for c in ("x", "y", "depth")])


def gated_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume of nations that may be shown, over the places of their customers, to a tenth of a unit."""
    place = lambda c: ((F.floor(F.col(c) * 2) * 0.5 + 0.25) / 10).alias(c)
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("area"))
    samples = points(spark, sf_dir).join(own, "id").select("area", place("x"), place("y")).distinct()
    values = gate(tx_area(spark, sf_dir), ["area"]).filter("ok").select("area", F.col("n_tx").cast("double").alias("value"))
    return gated_field(samples, values).select("gx", "gy", *[F.round(c, 4).alias(c) for c in ("value", "alpha", "shade")])


def presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named places with a declared area, for which nations stand: the declaration wins, so a place outside its area is moved to the nearest middle of a span of it."""
    k = F.col("n_nationkey")
    names = F.array(*[F.lit(n) for n in sorted(POLYGONS)])
    places = table(spark, sf_dir, "nation").select(k.alias("id"), F.get(names, k % len(POLYGONS)).alias("area"), (k * 0.43 + 0.1).alias("x"), (k * 7 % 25 * 0.41 + 0.1).alias("y"))
    samples = spans(edges(spark)).select("area", ((F.col("x1") + F.col("x2")) / 2).alias("x"), "y")
    return snapped(places, samples, edges(spark)).select("id", "area", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "snapped", F.round("moved", 6).alias("moved"))


def adjacent_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations stand for unit squares, five to a row: the sides that two of them share."""
    k = F.col("n_nationkey")
    corner = {"x": k % 5, "y": F.floor(k / 5)}
    side = lambda a, b, c, d: F.struct(*[(corner[n[0]] + v).cast("double").alias(n) for n, v in (("x1", a), ("y1", b), ("x2", c), ("y2", d))])
    squares = table(spark, sf_dir, "nation").select(F.col("n_name").alias("area"), F.explode(F.array(side(0, 0, 1, 0), side(1, 0, 1, 1), side(1, 1, 0, 1), side(0, 1, 0, 0))).alias("s")).select("area", "s.*")
    return shared_edges(squares)


QUERIES = {"point_in_polygon": point_in_polygon, "nearest_area": nearest_area, "bounding_boxes": bounding_boxes, "heat_field": heat_field, "heat_flow": heat_flow, "edge_distances": edge_distances, "part_confidence": part_confidence, "area_points": area_points, "presets": presets, "gated_heat": gated_heat, "adjacent_nations": adjacent_nations}

_E = "e AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)" for a, x1, y1, x2, y2 in edge_rows()) + ") v(area, x1, y1, x2, y2))"
_P = "p AS (SELECT c_custkey AS id, (c_custkey * 37 % 1100) / 100.0::DOUBLE + 0.003::DOUBLE AS x, (c_custkey * 91 % 1097) / 100.0::DOUBLE + 0.007::DOUBLE AS y, c_acctbal AS v FROM customer)"
_C = "c AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {54.4 + sum(y for r in rings for _, y in r) / sum(map(len, rings)) / 100!r}::DOUBLE, {18.5 + sum(x for r in rings for x, _ in r) / sum(map(len, rings)) / 100!r}::DOUBLE)" for n, rings in POLYGONS.items()) + ") v(area, lat, lng))"

_Q = f"""{_E.replace('e AS', 'shapes AS', 1)}, e AS (SELECT s_suppkey AS area, x1 * (1 + s_suppkey % 5 / 4.0::DOUBLE) + s_suppkey % 40 * 13 AS x1, y1 * (1 + s_suppkey % 5 / 4.0::DOUBLE) + s_suppkey // 40 % 30 * 11 AS y1,
      x2 * (1 + s_suppkey % 5 / 4.0::DOUBLE) + s_suppkey % 40 * 13 AS x2, y2 * (1 + s_suppkey % 5 / 4.0::DOUBLE) + s_suppkey // 40 % 30 * 11 AS y2 FROM supplier JOIN shapes ON area = ['c', 'holed', 'parts', 'square'][s_suppkey % 4 + 1])"""
_S = """box AS (SELECT area, min(least(y1, y2)) AS low, max(greatest(y1, y2)) AS high FROM e GROUP BY area),
      ln AS (SELECT area, low + (high - low) * k / {n} AS y FROM box, (SELECT unnest(range(1, {n})) AS k)),
      cr AS (SELECT ln.area, y, x1 + (x2 - x1) * (y - y1) / (y2 - y1) AS x FROM ln JOIN e USING (area) WHERE (y1 > y) <> (y2 > y)),
      nr AS (SELECT *, row_number() OVER (PARTITION BY area, y ORDER BY x) - 1 AS r FROM cr),
      sp AS (SELECT area, y, min(x) AS x1, max(x) AS x2 FROM nr GROUP BY area, y, r // 2)"""

ORACLES = {
    "adjacent_nations": """WITH s AS (SELECT n_name AS n, n_nationkey % 5 AS x, n_nationkey // 5 AS y FROM nation), t AS (SELECT a.n AS p, b.n AS q, b.x, b.y, b.x::DOUBLE AS x1, b.y::DOUBLE AS y1, b.x::DOUBLE AS x2, (b.y + 1)::DOUBLE AS y2 FROM s a JOIN s b ON b.x = a.x + 1 AND b.y = a.y
      UNION ALL SELECT a.n, b.n, b.x, b.y, b.x, b.y, b.x + 1, b.y FROM s a JOIN s b ON b.y = a.y + 1 AND b.x = a.x) SELECT least(p, q) AS a, greatest(p, q) AS b, x1, y1, x2, y2 FROM t""",
    "area_points": f"""WITH {_Q}, {_S.format(n=201)}, m AS (SELECT area, y, (x1 + x2) / 2 AS x FROM sp WHERE x2 > x1),
      t AS (SELECT m.area, m.x, m.y, x1, y1, x2, y2, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM m JOIN e USING (area)),
      d AS (SELECT area, x, y, min(sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2))) AS depth FROM t GROUP BY area, x, y),
      a AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY area ORDER BY round(depth, 9) DESC, y, x) = 1),
      b AS (SELECT d.* FROM d JOIN a USING (area) WHERE sqrt(pow(d.x - a.x, 2) + pow(d.y - a.y, 2)) >= 0.5 QUALIFY row_number() OVER (PARTITION BY d.area ORDER BY round(d.depth, 9) DESC, d.y, d.x) = 1)
      SELECT area, CAST(1 AS INTEGER) AS rank, round(x, 6) AS x, round(y, 6) AS y, round(depth, 6) AS depth FROM a UNION ALL SELECT area, 2, round(x, 6), round(y, 6), round(depth, 6) FROM b""",
    "gated_heat": f"""WITH {_P}, s AS (SELECT DISTINCT c_nationkey AS area, (floor(x * 2) * 0.5::DOUBLE + 0.25::DOUBLE) / 10 AS x, (floor(y * 2) * 0.5::DOUBLE + 0.25::DOUBLE) / 10 AS y FROM p JOIN customer ON c_custkey = id),
      v AS (SELECT * FROM ({_AREA} {_cells('area')} SELECT area, CAST(n_tx AS DOUBLE) AS value FROM g WHERE ok)),
      r AS (SELECT *, floor(x / 0.1::DOUBLE)::BIGINT + dx AS gx, floor(y / 0.1::DOUBLE)::BIGINT + dy AS gy FROM s, (SELECT unnest(range(-7, 8)) AS dx), (SELECT unnest(range(-7, 8)) AS dy)),
      w AS (SELECT gx, gy, value, exp(-(pow((gx + 0.5::DOUBLE) * 0.1::DOUBLE - x, 2) + pow((gy + 0.5::DOUBLE) * 0.1::DOUBLE - y, 2)) / (2 * 0.16::DOUBLE * 0.16::DOUBLE)) AS w FROM r LEFT JOIN v USING (area)),
      c AS (SELECT gx, gy, sum(w) AS "all", coalesce(sum(w) FILTER (WHERE value IS NOT NULL), 0) AS open, sum(w * value) AS total FROM w WHERE w > 2e-4 GROUP BY gx, gy),
      k AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, "all" / (0.35::DOUBLE * 2 * pi() * pow(0.16::DOUBLE / 0.11::DOUBLE, 2)))) AS a, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (open / "all" - 0.15::DOUBLE) / 0.7::DOUBLE)) AS b FROM c),
      f AS (SELECT gx, gy, CASE WHEN open > 1e-5 THEN total / open END AS value, CASE WHEN open > 1e-5 THEN a * a * (3 - 2 * a) * b * b * (3 - 2 * b) ELSE 0.0::DOUBLE END AS alpha FROM k),
      z AS (SELECT list_sort(list(value) FILTER (WHERE alpha > 0.3 AND value IS NOT NULL)) AS l FROM f),
      n AS (SELECT coalesce(l[floor(len(l) * 0.02)::INT + 1], 0.0::DOUBLE) AS low, coalesce(l[floor(len(l) * 0.98)::INT + 1], 1.0::DOUBLE) AS high FROM z)
      SELECT gx, gy, round(value, 4) AS value, round(alpha, 4) AS alpha, round((value - low) / greatest(1e-6, high - low), 4) AS shade FROM f, n""",
    "presets": f"""WITH {_E}, {_S.format(n=9)}, n AS (SELECT n_nationkey AS id, ['c', 'holed', 'parts', 'square'][n_nationkey % 4 + 1] AS area, n_nationkey * 0.43::DOUBLE + 0.1::DOUBLE AS x, n_nationkey * 7 % 25 * 0.41::DOUBLE + 0.1::DOUBLE AS y FROM nation),
      i AS (SELECT id FROM n JOIN e USING (area) WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY id HAVING count(*) % 2 = 1),
      m AS (SELECT id, (x1 + x2) / 2 AS sx, sp.y AS sy FROM n JOIN sp USING (area) QUALIFY row_number() OVER (PARTITION BY id ORDER BY sqrt(pow(x - (x1 + x2) / 2, 2) + pow(n.y - sp.y, 2)), (x1 + x2) / 2, sp.y) = 1)
      SELECT id, area, round(CASE WHEN i.id IS NULL THEN sx ELSE x END, 6) AS x, round(CASE WHEN i.id IS NULL THEN sy ELSE y END, 6) AS y, i.id IS NULL AS snapped, CASE WHEN i.id IS NULL THEN round(sqrt(pow(x - sx, 2) + pow(y - sy, 2)), 6) ELSE 0.0::DOUBLE END AS moved FROM n JOIN m USING (id) LEFT JOIN i USING (id)""",
    "heat_flow": f"""WITH {_P}, s AS (SELECT x, y, v, v * (id % 5) / 2 AS l, CAST(floor(x) AS BIGINT) + dx AS gx, CAST(floor(y) AS BIGINT) + dy AS gy FROM p, (SELECT unnest(range(-2, 3)) AS dx) a, (SELECT unnest(range(-2, 3)) AS dy) b),
      w AS (SELECT *, exp(-(pow(gx + 0.5 - x, 2) + pow(gy + 0.5 - y, 2)) / 2) AS w FROM s WHERE gx BETWEEN 0 AND 10 AND gy BETWEEN 0 AND 10), d AS (SELECT gx, gy, sum(w * l) / sum(w) - sum(w * v) / sum(w) AS d FROM w GROUP BY gx, gy),
      g AS (SELECT c.gx, c.gy, (r.d - l.d) / 2 AS dx, (b.d - t.d) / 2 AS dy FROM d c JOIN d r ON r.gx = c.gx + 1 AND r.gy = c.gy JOIN d l ON l.gx = c.gx - 1 AND l.gy = c.gy JOIN d b ON b.gx = c.gx AND b.gy = c.gy + 1 JOIN d t ON t.gx = c.gx AND t.gy = c.gy - 1),
      z AS (SELECT *, sqrt(dx * dx + dy * dy) AS size, max(sqrt(dx * dx + dy * dy)) OVER () AS largest FROM g) SELECT gx, gy, round(dx, 4) AS dx, round(dy, 4) AS dy, round(size / largest, 4) AS strength FROM z WHERE size > 0 AND size / largest >= 0.12""",
    "edge_distances": f"""WITH {_E}, {_P}, i AS (SELECT id, area, x, y FROM (SELECT id, area, x, y, count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) AS k FROM p, e GROUP BY id, area, x, y) WHERE k % 2 = 1),
      t AS (SELECT id, area, x, y, x1, y1, x2, y2, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM i JOIN e USING (area))
      SELECT id, area, round(min(sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2))), 6) AS distance FROM t GROUP BY id, area""",
    "part_confidence": """SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'none' WHEN p_size % 7 >= 3 AND p_retailprice % 100 >= 75 THEN 'observed' WHEN p_partkey % 3 >= 1 AND p_retailprice % 100 >= 40 THEN 'inferred' ELSE 'extrapolated' END AS confidence,
      CASE WHEN p_partkey % 5 > 0 THEN 'ul. ' || trim(p_brand) ELSE CAST(p_partkey AS VARCHAR) END AS label FROM part""",
    "point_in_polygon": f"WITH {_E}, {_P} SELECT id, area FROM p, e WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY id, area HAVING count(*) % 2 = 1",
    "nearest_area": f"""WITH {_C}, {_P}, d AS (SELECT id, area, 2 * 6371 * asin(sqrt(pow(sin(radians(lat - (54.4::DOUBLE + y / 100)) / 2), 2) + cos(radians(54.4::DOUBLE + y / 100)) * cos(radians(lat)) * pow(sin(radians(lng - (18.5::DOUBLE + x / 100)) / 2), 2))) AS km FROM p, c),
      r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, area) AS r FROM d) SELECT id, area, round(km, 6) AS km FROM r WHERE r = 1 AND round(km, 6) < 1.5""",
    "bounding_boxes": f"WITH {_Q} SELECT area, min(x1) AS min_x, max(x1) AS max_x, min(y1) AS min_y, max(y1) AS max_y, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 6) AS ring_area FROM e GROUP BY area",
    "heat_field": f"""WITH {_P}, s AS (SELECT x, y, v, CAST(floor(x) AS BIGINT) + dx AS gx, CAST(floor(y) AS BIGINT) + dy AS gy FROM p, (SELECT unnest(range(-2, 3)) AS dx) a, (SELECT unnest(range(-2, 3)) AS dy) b),
      w AS (SELECT *, exp(-(pow(gx + 0.5 - x, 2) + pow(gy + 0.5 - y, 2)) / 2) AS w FROM s WHERE gx BETWEEN 0 AND 10 AND gy BETWEEN 0 AND 10) SELECT gx, gy, count(*) AS n, round(sum(w * v) / sum(w), 4) AS value FROM w GROUP BY gx, gy""",
}
