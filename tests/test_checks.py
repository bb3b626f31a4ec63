"""Checks that raise, and geometry by hand."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gatewell.operators import checks, geo, leaks, summary


def test_calendar_columns_are_compared(spark):
    rows = spark.sql("SELECT date '2024-12-30' day, 2024 y, 12 m, 1 dow, false we, '202412' id, '2025W01' w UNION ALL SELECT date '2024-12-29', 2025, 12, 7, true, '202412', '2024W52' UNION ALL SELECT null, null, null, null, null, null, null")
    found = checks.calendar_mismatch(rows, "day", {"year": "y", "month": "m", "isodow": "dow", "weekend": "we", "month_id": "id", "week": "w"})
    assert found.first().asDict() == {"year": 1, "month": 0, "isodow": 0, "weekend": 0, "month_id": 0, "week": 0}
    with pytest.raises(ValueError, match="year"):
        checks.require(found)
    checks.require(found, {"year": 1})


def test_leaks_are_exact(spark):
    found = spark.createDataFrame([("a", 2), ("b", 1)], "pc string, n long")
    assert checks.require_rows(found, "pc", "n", {"a": 2, "b": 1}) is found
    for expected in ({"a": 2}, {"a": 2, "b": 2}, {"a": 2, "b": 1, "c": 1}):
        with pytest.raises(ValueError):
            checks.require_rows(found, "pc", "n", expected)


def test_neighbours_share_edges(spark):
    sides = spark.createDataFrame([("l", 0.0, 0.0, 0.0, 1.0), ("l", 1.0, 0.0, 1.0, 1.0), ("r", 1.0, 1.0, 1.0, 0.0), ("r", 2.0, 0.0, 2.0, 1.0)], "area string, x1 double, y1 double, x2 double, y2 double")
    assert [tuple(r) for r in geo.shared_edges(sides).collect()] == [("l", "r", 1.0, 0.0, 1.0, 1.0)]


def test_points_are_moved_into_their_area(spark):
    sides = geo.edges(spark)
    samples = spark.createDataFrame([("square", 2.0, 2.0), ("square", 3.5, 3.5), ("square", 9.0, 9.0), ("holed", 7.0, 3.0)], "area string, x double, y double")
    pts = spark.createDataFrame([(1, "square", 1.5, 1.5), (2, "square", 5.0, 5.0), (3, "holed", 0.0, 0.0)], "id long, area string, x double, y double")
    assert {r.id: (r.x, r.y, r.snapped) for r in geo.snapped(pts, samples, sides).collect()} == {1: (1.5, 1.5, False), 2: (3.5, 3.5, True), 3: (0.0, 0.0, False)}
    assert {r.id: round(r.distance, 6) for r in geo.boundary_distance(pts.filter("id < 3"), sides).collect()} == {1: 0.5, 2: round(2**0.5, 6)}


def test_card_shaped_tokens_are_found_across_line_breaks(spark):
    card, own = "Ab1" * 15, "f" * 64
    texts = [f"a {card[:20]}\n{card[20:]} b", f"{own}", "a1" * 22, "x" * 45, "merchant_name: ACME", "merchant_name: acme", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert sorted(map(tuple, leaks.scan(rows).collect())) == [(0, 1, card, 0, 0), (2, 1, "a1" * 22, 0, 0), (4, 0, None, 0, 1)]


def test_points_of_areas_lie_inside_them(spark):
    sides = geo.edges(spark)
    found = geo.interior_points(sides)
    assert sorted(map(tuple, geo.inside(found.select(F.col("area").alias("id"), "x", "y"), sides).collect())) == sorted((a, a) for a in geo.POLYGONS)


def test_a_level_change_has_no_flow_and_a_slope_has_one(spark):
    grid = [(x, y) for x in range(4) for y in range(4)]
    frame = lambda f: spark.createDataFrame([(x, y, float(f(x, y))) for x, y in grid], "gx int, gy int, d double")
    assert geo.flow(frame(lambda x, y: 5)).count() == 0
    slope = [tuple(r) for r in geo.flow(frame(lambda x, y: 3 * x + 4 * y)).orderBy("gx", "gy").collect()]
    assert slope == [(x, y, 3.0, 4.0, 1.0) for x in (1, 2) for y in (1, 2)]


def test_an_event_past_midnight_spills_into_the_next_day(spark):
    events = spark.createDataFrame([("a", 3, 4, 22, 26, -1), ("b", 3, 3, 0, 2, -1)], "event string, first int, last int, start int, end int, ci int")
    assert sorted(map(tuple, summary.event_days(events).collect())) == [(3, "a", False), (3, "b", False), (4, "a", False), (5, "a", True)]
    assert sorted((r.event, r.di, r.h) for r in summary.event_hours(events).collect()) == [("a", 3, 21), ("a", 3, 22), ("a", 3, 23), ("a", 4, 0), ("a", 4, 1), ("a", 4, 2), ("b", 3, 0), ("b", 3, 1), ("b", 3, 2)]


def test_only_areas_that_may_be_shown_have_a_summary(spark):
    row = lambda pc, i, tm: (datetime.date(2024, 1, 10), tm, pc, Decimal(2), i, f"m{i % 4}")
    rows = [row("81-701", i, "120000") for i in range(40)] + [row("81-701", i, "130000") for i in range(10)] + [row("81-702", i, "120000") for i in range(5)]
    tx = spark.createDataFrame(rows, "day date, tm string, pc string, amount decimal(18,2), card int, merchant string")
    events = spark.createDataFrame([("open", 0, 0, 13, 15, 1), ("thin", 0, 0, 13, 15, 2), ("city", 0, 0, 13, 15, -1), ("none", 0, 0, 13, 15, 9)], "event string, first int, last int, start int, end int, ci int")
    found = {r.event: r for r in summary.event_summary(tx, events).collect()}
    shown = found["open"]
    assert (shown.blocked, shown.reason, shown.hours, shown.n, shown.amount, shown.ticket, shown.base, shown.uplift) == (False, None, 4, 50, 100.0, 2.0, None, None)
    assert (shown.peak_di, shown.peak_h, shown.day_before, shown.day, shown.day_after, shown.hot, shown.hot_share) == (0, 13, None, 50, None, "81-70", 1.0)
    assert (found["city"].blocked, found["city"].n) == (False, 55)
    assert [(found[k].blocked, found[k].reason, found[k].n, found[k].hot) for k in ("thin", "none")] == [(True, "lt_30_cards", None, None), (True, "no_data", None, None)]


def test_validation_tells_all_that_is_wrong(spark):
    import datetime

    day = datetime.date(2024, 5, 1)
    good = [(day, 5.0, "101500", "m1", 1, "81-701", "81-701"), (day, 2.0, "000000", "m2", 2, "81701", "81-701"), (day, 2.0, "235959", "m2", 2, None, None), (day, 1.0, "235959", "m2", 2, "", None)]
    schema = "day date, amount double, tm string, merchant string, card long, pc_raw string, pc string"
    tx = spark.createDataFrame(good, schema)
    report = {r.check: (r.found, r.ok) for r in checks.require_valid(tx, {"rows": 4, "cards": 2}).collect()}
    assert report["rows"] == (4, True) and report["merchants"] == (2, True) and report["unhandled"] == (0, True)
    bad = [(None, 0.0, "1015", "m1", 1, "8170", None), (day, 1.0, None, "m1", 1, "81 701", "81-701"), (day, 1.0, "101500", "m1", 1, "8170A", "81-70A"), (day, 1.0, "101500", "m3", 1, "81-701", "81-702")]
    with pytest.raises(ValueError) as e:
        checks.require_valid(tx.unionAll(spark.createDataFrame(bad, schema)), {"merchants": 2})
    assert str(e.value) == "bad_five: 1, 0 expected; bad_six: 1, 0 expected; bad_time: 2, 0 expected; merchants: 3, 2 expected; non_positive: 1, 0 expected; null_day: 1, 0 expected; raw_to_several: 1, 0 expected; several_to_code: 1, 0 expected; unhandled: 1, 0 expected"
    checks.require_normalised(spark.createDataFrame([(None, -1.0, "1", "m", 1, "81-701", "81-701")], schema))
    with pytest.raises(ValueError, match="unhandled"):
        checks.require_normalised(spark.createDataFrame(bad, schema))


def test_a_pin_without_a_sample_inside_goes_to_the_label(spark):
    sides = geo.edges(spark)
    pts = spark.createDataFrame([(1, "square", 0.0, 0.0), (2, "square", 2.0, 2.0), (3, "holed", 0.0, 0.0)], "id int, area string, x double, y double")
    none = spark.createDataFrame([("square", 9.0, 9.0)], "area string, x double, y double")
    labels = spark.createDataFrame([("square", 3.0, 3.0), ("holed", 7.0, 3.0)], "area string, x double, y double")
    found = {r.id: (r.x, r.y, r.snapped, round(r.moved)) for r in geo.snapped(pts, none, sides, geo.degrees_km, labels).collect()}
    assert found == {1: (3.0, 3.0, True, 472), 2: (2.0, 2.0, False, 0), 3: (0.0, 0.0, False, 0)}
