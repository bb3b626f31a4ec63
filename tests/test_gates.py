"""Golden cells of the gates, and what moving a threshold does."""

import pytest

from gatewell.operators.gates import Rules, cascade, differencing, gate, gate_columns, reason, release, require_released, residuals

CELLS = "id string, n_cards long, n_merchants long, n_tx long, top_volume long, top_cards long"
# id, cards, volumes by merchant, largest merchant's cards, reason
GOLDEN = [
    ("thirty cards", 30, (75, 15, 10), 10, "ok"),
    ("twenty-nine cards", 29, (75, 15, 10), 10, "lt_30_cards"),
    ("even", 90, (36, 30, 24), 36, "ok"),
    ("two merchants", 90, (100, 100), 45, "lt_3_merchants"),
    ("exactly three quarters", 40, (75, 20, 5), 20, "ok"),
    ("just over", 400, (751, 200, 49), 20, "top1_gt_75"),
    ("three gates", 12, (12,), 12, "multi"),
    ("one merchant", 5000, (9000,), 5000, "multi"),
    ("cards over", 100, (70, 20, 10), 76, "top1_gt_75"),
    ("millions, exact", 100, (3_000_000, 600_000, 400_000), 10, "ok"),
    ("millions, one over", 100, (3_000_001, 599_999, 400_000), 10, "top1_gt_75"),
    ("few cards, many merchants", 22, (5, 5, 5, 5, 5), 6, "lt_30_cards"),
]


def cells(spark, rows=GOLDEN):
    return spark.createDataFrame([(i, c, len(v), sum(v), max(v), k) for i, c, v, k, _ in rows], CELLS)


def reasons(spark, rules=Rules()):
    return {r.id: r.reason for r in reason(gate_columns(cells(spark), rules), rules).collect()}


def test_golden_cells(spark):
    assert reasons(spark) == {g[0]: g[4] for g in GOLDEN}


@pytest.mark.parametrize("rules", [Rules(min_cards=29), Rules(min_cards=31), Rules(min_merchants=2), Rules(min_merchants=4), Rules(share_num=74, share_den=100), Rules(share_num=76, share_den=100)])
def test_moving_a_threshold_changes_a_result(spark, rules):
    assert reasons(spark, rules) != {g[0]: g[4] for g in GOLDEN}


def test_rules_take_no_floats():
    with pytest.raises(TypeError):
        Rules(share_num=0.75)
    with pytest.raises(ValueError):
        Rules(share_num=5, share_den=4)


def tx(spark, merchants, area="a", parent="p"):
    """merchants: (name, cards) with a transaction for each card."""
    return spark.createDataFrame([(area, parent, m, c) for m, cs in merchants for c in cs], "area string, parent string, merchant string, card long")


def test_no_rows_is_no_cell(spark):
    assert gate(tx(spark, []), ["area"]).count() == 0


def test_differencing_finds_the_merchant_whose_removal_leaves_too_few(spark):
    rows = tx(spark, [("big", range(0, 25)), ("mid", range(20, 40)), ("small", range(30, 45)), ("tiny", range(40, 48))])
    base = gate(rows, ["area"]).first()
    assert base.reason == "ok"
    strict = gate(rows, ["area"], Rules(differencing=True)).first()
    assert strict.reason == "g4_differencing" and strict.g4_merchant == "big"


def test_residuals_match_recounting(spark):
    rows = tx(spark, [("x", range(0, 50)), ("y", range(30, 70)), ("z", [1, 1, 2, 80])])
    for measured in residuals(rows, ["area"]).collect():
        rest = rows.filter(rows.merchant != measured.merchant)
        assert (measured.n_cards, measured.n_tx, measured.n_merchants) == (rest.select("card").distinct().count(), rest.count(), rest.select("merchant").distinct().count())
    bound = {r.merchant: r.n_cards for r in residuals(rows, ["area"], measured=False).collect()}
    assert all(bound[r.merchant] <= r.n_cards for r in residuals(rows, ["area"]).collect())
    assert differencing(rows, ["area"]).first().g4 is False


def test_cascade_goes_to_the_parent_and_the_city(spark):
    good = [("m1", range(0, 40)), ("m2", range(20, 60)), ("m3", range(50, 80))]
    rows = tx(spark, good, "a", "p").unionAll(tx(spark, [("m4", range(3))], "b", "p")).unionAll(tx(spark, [("m5", [1])], "c", "q"))
    found = {r.area: (r.level, r.escalated) for r in cascade(rows, ["area"], ["parent"]).collect()}
    assert found == {"a": ("cell", False), "b": ("parent", True), "c": ("city", True)}
    assert cascade(tx(spark, [("m", [1])]), ["area"], ["parent"]).first().reason == "all_levels_failed"


def test_more_cards_never_hurt_the_first_gates(spark):
    grid = [(f"{c}-{m}", c, (1,) * m, 1, "") for c in range(27, 34) for m in range(1, 6)]
    ok = {r.id: r.g1 and r.g2 for r in gate_columns(cells(spark, grid)).collect()}
    for c in range(27, 33):
        for m in range(1, 5):
            assert ok[f"{c}-{m}"] <= ok[f"{c + 1}-{m}"] and ok[f"{c}-{m}"] <= ok[f"{c}-{m + 1}"]


def test_unknown_cards_and_areas(spark):
    some = tx(spark, [("m1", range(0, 10)), ("m2", range(10, 20)), ("m3", [*range(20, 29), None])])
    r = gate(some, ["area"]).first()
    assert (r.n_cards, r.n_tx, r.reason) == (29, 30, "lt_30_cards")
    nowhere = tx(spark, [("m1", range(0, 14)), ("m2", range(14, 28)), ("m3", range(28, 40))], area=None)
    r = gate(nowhere, ["area"], Rules(differencing=False)).first()
    assert r.area is None and r.n_cards == 40 and r.ok
    assert gate(nowhere, ["area"], Rules(differencing=True)).first().reason == "g4_differencing"


def test_asked_cells_without_data_or_with_a_thin_base(spark):
    rows = tx(spark, [("m1", range(0, 20)), ("m2", range(10, 30)), ("m3", range(20, 40))])
    asked = spark.createDataFrame([("a", "p", 5), ("x", "p", 50)], "area string, parent string, thin_tx long")
    assert {r.area: r.reason for r in gate(rows, ["area"], asked=asked.drop("parent")).collect()} == {"a": "thin_base", "x": "no_data"}
    found = {r.area: r for r in cascade(rows, ["area"], ["parent"], asked=asked).collect()}
    assert {k: (r.reason, r.level, len(r.trace)) for k, r in found.items()} == {"a": ("thin_base", None, 0), "x": ("no_data", None, 0)}


def test_cascade_tells_its_trace_and_missing_levels(spark):
    rows = tx(spark, [("m1", range(0, 3))], "b", None).unionAll(tx(spark, [("m1", range(0, 40)), ("m2", range(20, 60)), ("m3", range(50, 80))], "a", "p"))
    r = {x.area: x for x in cascade(rows, ["area"], ["parent"]).collect()}["b"]
    assert (r.level, r.levels_missing, [t.level for t in r.trace]) == ("city", ["parent"], ["cell", "city"])
    locked = cascade(tx(spark, [("m", [1])]), ["area"], ["parent"]).first()
    assert locked.failures == ["lt_30_cards", "lt_3_merchants", "top1_gt_75"] and [t.level for t in locked.trace] == ["cell", "parent", "city"]


def test_cascade_honours_differencing_at_every_level(spark):
    # the city passes the first three gates, but not without its largest merchant
    rows = tx(spark, [("big", range(0, 25)), ("mid", range(20, 40)), ("small", range(30, 45)), ("tiny", range(40, 48))])
    assert cascade(rows, ["area"], ["parent"]).first().level == "cell"
    strict = cascade(rows, ["area"], ["parent"], Rules(differencing=True)).first()
    assert strict.level is None and strict.failures == ["g4_differencing"]


def test_rules_from_a_document():
    assert Rules.from_mapping({"minCards": 29, "maxShare": "74/100"}) == Rules(min_cards=29, share_num=74, share_den=100)
    assert Rules.from_mapping({"maxShare": [3, 4], "requireDifferencing": True}) == Rules(differencing=True)
    for bad in (0.75, [0.75, 1]):
        with pytest.raises(TypeError):
            Rules.from_mapping({"maxShare": bad})
    assert Rules().fingerprint() == Rules.from_mapping({}).fingerprint() != Rules(min_cards=29).fingerprint()


def test_only_what_these_rules_released_goes_out(spark):
    held = gate_columns(cells(spark))
    out = require_released(release(held, Rules()), Rules())
    assert {r.id for r in out.collect()} == {g[0] for g in GOLDEN if g[4] == "ok"}
    for bad in (held, release(held, Rules(min_cards=29)), held.selectExpr("*", f"'{Rules().fingerprint()}' rules")):
        with pytest.raises(ValueError):
            require_released(bad, Rules())


EVIDENCE_CASES = {
    # n_cards, n_tx, merchants (volume, cards, residual)
    "sound": (5, 9, [(4, 3, 2), (3, 2, 3), (2, 1, 4)], []),
    "no evidence": (5, 9, [(4, None, None), (5, None, None)], []),
    "some cards known": (9, 9, [(4, 1, None), (5, None, None)], []),
    "no count": (None, 9, [(9, None, None)], ["missing"]),
    "below zero": (-1, 9, [(9, None, None)], ["negative"]),
    "more cards than rows": (10, 9, [(9, None, None)], ["cards_gt_tx"]),
    "a merchant without rows": (5, 9, [(9, None, None), (0, None, None)], ["phantom"]),
    "parts that don't add up": (5, 9, [(4, None, None), (4, None, None)], ["partition"]),
    "cards of a stranger": (5, 9, [(9, 5, None), (None, 1, None)], ["cards_of_no_merchant"]),
    "a merchant with no card": (5, 9, [(4, 0, None), (5, 5, None)], ["cards_lt_1"]),
    "more cards than its rows": (5, 9, [(1, 2, None), (8, 5, None)], ["cards_gt_volume"]),
    "rest of a stranger": (5, 9, [(9, None, None), (None, None, 2)], ["residual_of_no_merchant"]),
    "rest too small": (5, 9, [(2, None, 2), (7, None, 0)], ["residual_out_of_bounds"]),
    "rest at its bound": (5, 9, [(2, None, 3), (7, None, 0)], []),
    "rest too large": (5, 9, [(2, None, 6), (7, None, 5)], ["residual_out_of_bounds"]),
    "more cards than the cell": (5, 9, [(8, 6, None), (1, 1, None)], ["merchant_cards_gt_cards"]),
    "cards that don't cover the cell": (5, 9, [(4, 2, None), (5, 2, None)], ["sum_cards_lt_cards"]),
    "an empty cell": (0, 0, [], []),
    "nobody in it": (3, 3, [], ["partition"]),
}


def test_evidence_by_name(spark):
    from gatewell.operators.gates import EVIDENCE, evidence_violations

    cells = spark.createDataFrame([(k, c, n) for k, (c, n, _, _) in EVIDENCE_CASES.items()], "id string, n_cards long, n_tx long")
    parts = spark.createDataFrame([(k, str(i), *m) for k, (_, _, ms, _) in EVIDENCE_CASES.items() for i, m in enumerate(ms)], "id string, merchant string, volume long, cards long, residual long")
    found = {r.id: r.checks for r in evidence_violations(cells, parts, ["id"]).collect()}
    assert found == {k: v[3] for k, v in EVIDENCE_CASES.items()}
    assert {x for v in found.values() for x in v} == set(EVIDENCE)


def test_cards_of_the_rest_are_told_or_withheld(spark):
    from gatewell.operators.gates import residual_cards

    rows = [("a", "x", 6, 4, 9, None), ("a", "y", 5, 5, 9, 3), ("a", "z", 2, 2, 9, None), ("b", "x", 9, 9, 9, None), ("c", "x", 3, 2, 4, None), ("c", "y", 4, 0, 4, None), ("d", "x", 4, 1, 4, 1), ("d", "y", 2, None, 4, None)]
    df = spark.createDataFrame(rows, "id string, merchant string, volume long, cards long, n_cards long, exclusive long")
    found = {(r.id, r.merchant): (r.low, r.high, r.rest, r.top_cards) for r in residual_cards(df, ["id"]).collect()}
    assert found == {
        ("a", "x"): (3, 9, 3, 3), ("a", "y"): (4, 9, 6, 4), ("a", "z"): (7, 9, 7, 5), ("b", "x"): (0, 9, 0, None),
        ("c", "x"): (1, 4, 1, None), ("c", "y"): (0, 4, 0, None), ("d", "x"): (0, 4, 3, None), ("d", "y"): (2, 4, 2, None),
    }


def test_unknown_cards_of_merchants_leave_the_volume(spark):
    from gatewell.operators.gates import evaluated, gate_block

    df = spark.createDataFrame([("m", 40, 3, 100, 60, 35), ("u", 40, 3, 100, 60, None), ("v", 29, 2, 100, 76, None), ("z", 0, 0, 0, 0, 0)], CELLS.replace("n_tx long, top_volume", "n_tx long, top_volume"))
    assert {r.id: (r.reason, r.ok) for r in reason(gate_columns(df)).collect()} == {"m": ("top1_gt_75", False), "u": ("ok", True), "v": ("multi", False), "z": ("no_data", False)}
    told = {r.id: (r.codes, r.detail) for r in evaluated(df).collect()}
    assert told["m"] == (["G3_SHARE"], ["share of cards 35/40 > 3/4"]) and told["u"] == ([], ["cards of merchants unknown: share by volume alone"])
    assert told["v"][0] == ["G1_CARDS", "G2_ENTITIES", "G3_SHARE"] and len(told["v"][1]) == 4
    blocks = {r.id: tuple(r.gates) for r in gate_block(df.na.fill(0)).collect()}
    assert blocks == {"m": (True, True, False, False), "u": (True, True, True, True), "v": (False, False, False, False), "z": (False, False, False, False)}
