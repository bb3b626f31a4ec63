"""Groups of the facts are spread over all parts that the session shuffles to, however few bytes they take, and no transaction is shuffled twice for the sample."""

import datetime
import random
from collections import defaultdict
from decimal import Decimal

from pyspark.sql import functions as F

from gatewell.operators import sample
from gatewell.operators.gates import by_card, cell_totals, halves, merchant_profile
from gatewell.session import dealt


def _largest_share(df):
    rows = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(rows) / sum(rows)


def test_by_card_rows_are_not_merged_by_their_bytes(spark):
    """The step of month_gates, gate_report, privacy_funnel, cell_violations, released_months and residual_maps."""
    tx = spark.range(4000).select((F.col("id") % 5).alias("area"), (F.col("id") % 12).cast("string").alias("month"), (F.col("id") % 40).alias("merchant"), (F.col("id") % 1999).alias("card"))
    grain = ["area", "month"]
    found = by_card(tx, grain)
    assert found.count() == tx.distinct().count() and found.agg(F.sum("n")).first()[0] == 4000
    assert _largest_share(found) < 1 / 4  # 8 parts; one part before they were dealt
    assert halves(tx, grain).filter("by_card").agg(F.sum("n")).first()[0] == 4000


def test_a_sample_deals_each_transaction_once(spark, monkeypatch):
    draw = random.Random(5)
    days = [datetime.date(2024, 3, 1) + datetime.timedelta(k) for k in range(4)]
    of = lambda *xs: draw.choice(xs)
    rows = [(of("a", "b", None), of(*days, None), of(1, 2, 3, None), of(*range(60), None), Decimal(draw.randrange(9999)) / 100, of("000000", "120000", None)) for _ in range(3000)]
    tx = spark.createDataFrame(rows, "pc string, day date, merchant long, card long, amount decimal(18,2), tm string")
    seen = []

    def watched(df, *keys, **how):
        seen.append((df, dealt(df, *keys, **how)))
        return seen[-1][1]

    monkeypatch.setattr(sample, "dealt", watched)
    both = sample.cells_and_pairs(tx).collect()
    known = [r for r in rows if r[0] is not None]
    assert [x.count() for x, _ in seen] == [len(known)]
    assert _largest_share(seen[0][1]) < 1 / 4

    cells, pairs = defaultdict(list), defaultdict(list)
    for r in known:
        cells[r[0]].append(r)
        pairs[r[0], r[1]].append(r)
    assert len(both) == len(cells) + len(pairs)
    for x in both:
        if x.paired:
            mine = pairs[x.pc, x.day]
            assert (x.transactions, x.transactions_dated) == (len(mine), sum(r[5] == "120000" for r in mine))
            assert x.merchants == len({r[2] for r in mine}) and x.amount == float(sum(r[4] for r in mine))
        else:
            mine = cells[x.pc]
            by = {m: [r for r in mine if r[2] == m] for m in (1, 2, 3, None)}
            assert (x.n_tx, x.n_cards, x.n_merchants) == (len(mine), len({r[3] for r in mine} - {None}), 3)
            assert (x.top_volume, x.top_cards) == (max(map(len, by.values())), max(len({r[3] for r in b} - {None}) for b in by.values()))


def _odd(spark):
    """Unknown areas, merchants and cards; cards of one merchant, of several, and of one besides an unknown one; repeated rows."""
    rows = [(a, m, c) for a in (1, 2, None) for m, c in ((1, 10), (1, 10), (1, 11), (2, 11), (None, 12), (3, 12), (None, 13), (3, None), (3, None), (None, None), (2, 14))] + [(4, 9, None)]
    return spark.createDataFrame(rows, "area long, merchant long, card long")


def test_cells_count_cards_without_a_second_shuffle_by_card(spark, capsys):
    """The step of month_gates, gate_report, privacy_funnel, cell_violations and residual_maps; cards went through two shuffles before, doubled in the second."""
    for f in (cell_totals, merchant_profile):
        f(_odd(spark), ["area"]).explain()
        dealt = [x for x in capsys.readouterr().out.splitlines() if "Exchange hashpartitioning(" in x and "card" in x.split("hashpartitioning(")[1].split(")")[0]]
        assert len(dealt) == 1, dealt


def test_cells_equal_those_of_rows_by_card(spark):
    tx = _odd(spark)
    for grain in (["area"], []):
        for f in (cell_totals, merchant_profile):
            found, wanted = (f(x, grain) for x in (tx, by_card(tx, grain)))
            assert sorted(map(str, found.select(*wanted.columns).collect())) == sorted(map(str, wanted.collect()))
    one = cell_totals(tx, ["area"]).filter("area = 1").first()
    assert (one["n_tx"], one["n_cards"], one["n_merchants"], one["top_volume"], one["top_cards"], one["sum_cards"]) == (11, 5, 3, 3, 2, 7)
    alone = merchant_profile(tx, ["area"]).filter("area = 1 and not whole and exclusive > 0")
    assert {(r["merchant"], r["exclusive"]) for r in alone.collect()} == {(1, 1), (2, 1), (None, 1)}
    none = cell_totals(tx.limit(0), []).first()
    assert (none["n_tx"], none["n_cards"], none["n_merchants"], none["top_volume"]) == (0, 0, 0, None)
