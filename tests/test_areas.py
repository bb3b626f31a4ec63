"""Interior points, the gated field, the hierarchy and gates at several grains, against their definitions in plain Python."""

import math

import pytest

from gatewell.operators.gates import Rules, by_card_at, gate, gates_at
from gatewell.operators.geo import POLYGONS, edge_rows, gated_field, inside, interior_points
from gatewell.operators.hierarchy import answered_by, sectors, street_weights, unit_geometry, unit_names


def sides(spark, rows=None):
    return spark.createDataFrame(rows or edge_rows(), "area string, x1 double, y1 double, x2 double, y2 double")


def away(p, e):
    x1, y1, x2, y2 = e
    dx, dy = x2 - x1, y2 - y1
    t = max(0.0, min(1.0, ((p[0] - x1) * dx + (p[1] - y1) * dy) / (dx * dx + dy * dy)))
    return math.hypot(p[0] - x1 - t * dx, p[1] - y1 - t * dy)


def points_of(edges, k, apart, lines):
    """One after the other, the candidate furthest from all edges and far enough from those chosen."""
    low, high = min(min(e[1], e[3]) for e in edges), max(max(e[1], e[3]) for e in edges)
    found = []
    for i in range(1, lines + 1):
        y = low + (high - low) * i / (lines + 1)
        xs = sorted(x1 + (x2 - x1) * (y - y1) / (y2 - y1) for x1, y1, x2, y2 in edges if (y1 > y) != (y2 > y))
        found += [((a + b) / 2, y) for a, b in zip(xs[::2], xs[1::2], strict=True) if b > a]
    chosen = []
    for _ in range(k):
        free = [p for p in found if all(math.hypot(p[0] - c[0], p[1] - c[1]) >= apart for c in chosen)]
        if not free:
            break
        chosen.append(min(free, key=lambda p: (-round(min(away(p, e) for e in edges), 9), p[1], p[0])))
    return chosen


@pytest.mark.parametrize(("k", "apart"), [(1, 0.0), (3, 1.0), (4, 2.5)])
def test_interior_points_are_the_deepest_that_stand_apart(spark, k, apart):
    found = {}
    for r in interior_points(sides(spark), k, apart, 40).orderBy("rank").collect():
        found.setdefault(r.area, []).append((r.x, r.y))
    for name in POLYGONS:
        expected = points_of([r[1:] for r in edge_rows() if r[0] == name], k, apart, 40)
        assert [(round(x, 9), round(y, 9)) for x, y in found[name]] == [(round(x, 9), round(y, 9)) for x, y in expected]


def test_interior_points_lie_inside_concave_holed_and_parted_areas(spark):
    p = interior_points(sides(spark), 2, 0.3).selectExpr("area owner", "concat(area, rank) id", "x", "y")
    held = {(r.id, r.area) for r in inside(p.select("id", "x", "y"), sides(spark)).collect()}
    assert {(r.id, r.owner) for r in p.collect()} <= held
    assert interior_points(sides(spark).limit(0)).count() == 0


def test_withheld_areas_never_colour_a_cell(spark):
    samples = spark.createDataFrame([("open", 0.1 * i, 0.15) for i in range(12)] + [("held", 0.1 * i, 1.95) for i in range(12)], "area string, x double, y double")
    with_secret, without = (gated_field(samples, spark.createDataFrame(v, "area string, value double")) for v in ([("open", 5.0), ("held", None)], [("open", 5.0)]))
    rows = {(r.gx, r.gy): (r.value, r.alpha, r.shade) for r in with_secret.collect()}
    assert rows == {(r.gx, r.gy): (r.value, r.alpha, r.shade) for r in without.collect()}
    assert {round(v, 9) for v, _, _ in rows.values() if v is not None} == {5.0}
    far = [v for (_, gy), v in rows.items() if gy >= 17]
    assert far and all(v == (None, 0.0, None) for v in far)
    assert max(a for _, a, _ in rows.values()) > 0.3


def test_field_is_the_weighted_mean(spark):
    pts = [("a", 0.1, 0.2), ("b", 0.35, 0.2), ("c", 0.2, 0.4)]
    values = {"a": 10.0, "b": 20.0}
    df = gated_field(spark.createDataFrame(pts, "area string, x double, y double"), spark.createDataFrame(list(values.items()), "area string, value double"), "code")
    s = lambda x: (lambda t: t * t * (3 - 2 * t))(max(0.0, min(1.0, x)))
    for r in df.collect():
        w = {n: e for n, x, y in pts if (e := math.exp(-((r.gx * 0.1 + 0.05 - x) ** 2 + (r.gy * 0.1 + 0.05 - y) ** 2) / (2 * 0.09**2))) > 2e-4}
        total, known = sum(w.values()), sum(e for n, e in w.items() if n in values)
        if known > 1e-5:
            assert math.isclose(r.value, sum(e * values[n] for n, e in w.items() if n in values) / known, rel_tol=1e-9)
            assert math.isclose(r.alpha, s(total / (0.35 * 2 * math.pi * (0.09 / 0.11) ** 2)) * s((known / total - 0.15) / 0.7), rel_tol=1e-9, abs_tol=1e-12)
        else:
            assert r.value is None and r.alpha == 0


def test_units_are_merged_from_codes(spark):
    rows = [("81-700", 0.0, 0.0, "Long", 0.5), ("81-700", 2.0, 1.0, "Long", 0.5), ("81-704", 4.0, 0.0, "Short", 1.0), ("81-704", 5.0, 4.0, "Short", 1.0), ("81-704", 4.5, 1.0, None, 1.0), ("81-705", 9.0, 9.0, "Alley", 0.0), ("81-711", 1.0, 1.0, "", 0.0)]
    a = spark.createDataFrame(rows, "code string, x double, y double, street string, shore double")
    units = {r.unit: r for r in unit_names(unit_geometry(sectors(a)), street_weights(a)).collect()}
    assert set(units) == {"81-700", "81-704", "81-705", "81-711", "81-70a", "81-70b", "81-71a", "81-70x", "81-71x", "city"}
    u = units["81-70a"]  # areas 2 and 4
    assert (u.codes, u.addresses, u.area, u.name) == (2, 5, 6.0, "Long · Short") and math.isclose(u.x, (1.0 * 2 + 4.5 * 4) / 6) and math.isclose(u.shore, (0.5 * 2 + 4) / 6)
    assert (u.min_x, u.max_y, u.label_x) == (0.0, 4.0, 4.5)
    assert units["81-71x"].x is None and units["81-71x"].name == "no addresses" and units["city"].codes == 4 and units["city"].name == "the whole city"
    assert [(r.street, r.weight, r["rank"]) for r in street_weights(a).filter("level = 'city'").orderBy("rank").collect()] == [("Long", 2, 1), ("Short", 2, 2), ("Alley", 1, 3)]


def test_the_first_known_key_answers(spark):
    rows = spark.createDataFrame([(1, "a1", "b1", "c1"), (2, "a2", "b1", "c1"), (3, "a2", "b2", "c1"), (4, None, None, None), (5, "a2", "b2", "c9")], "id int, pkd string, mcc string, grp string")
    dim = spark.createDataFrame([("pkd", "a1", 10), ("mcc", "b1", 20), ("grp", "c1", 30), ("grp", "b2", 99)], "level string, key string, value int")
    assert sorted((r.id, r.level, r.answer) for r in answered_by(rows, dim, ["pkd", "mcc", "grp"]).collect()) == [(1, "pkd", 10), (2, "mcc", 20), (3, "grp", 30), (4, None, None), (5, None, None)]


def test_gates_of_several_grains_are_those_of_each(spark):
    rows = [(i % 3, (i % 3) // 2, f"m{i * i % 5}", i * 7 % 61 if i % 17 else None) for i in range(400)] + [(None, 0, "m9", 5), (7, None, "m1", 2)]
    tx = spark.createDataFrame(rows, "area int, parent int, merchant string, card int")
    levels = {"area": ["area"], "parent": ["parent"], "both": ["area", "parent"], "city": []}
    for rules in (Rules(), Rules(differencing=True)):
        cells = gates_at(tx, levels, rules)
        for name, keys in levels.items():
            columns = [*keys, "n_tx", "n_cards", "n_merchants", "top_volume", "top_cards", "sum_cards", "ok"]
            alone = gate(tx, keys, rules)
            assert sorted(map(repr, cells.filter(cells.level == name).select(columns).collect())) == sorted(map(repr, alone.select(columns).collect()))
    with pytest.raises(ValueError):
        by_card_at(tx, {"a": ["area"], "b": ["area"]})
    asked = by_card_at(tx, {"city": []}, ["area", "parent"]).filter("level = 'asked'")
    assert {(r.area, r.parent) for r in asked.collect()} == {(a, p) for a, p, _, _ in rows}


def test_interior_points_are_never_broadcast(spark):
    """The lines of many areas were taken for a small side of a join, and sent whole through the driver."""
    many = sides(spark, [(f"{a}{k}", *e) for k in range(300) for a, *e in edge_rows()])
    points = interior_points(many, 2, 0.5)
    assert points.count() == 2 * 4 * 300
    assert "BroadcastHashJoin" not in points._jdf.queryExecution().executedPlan().toString()
    assert {(r.x, r.y) for r in points.filter("area like 'square%' and rank = 1").collect()} == {(r.x, r.y) for r in interior_points(sides(spark), 1).filter("area = 'square'").collect()}
