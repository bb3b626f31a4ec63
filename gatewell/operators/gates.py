"""Privacy gates: may an aggregate be released?

G1: at least 30 distinct cards. G2: at least 3 merchants. G3: no merchant above 3/4 of the volume, nor of the cards; shares
are compared as integers, never divided. G4: the cell without any one merchant must still pass G1 to G3. Cards don't add
up across cells, so every grain counts its own. Transactions of an unknown card count for the volume alone; a null key of a
grain is a cell like any other.
"""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatewell.session import dealt, stored
from gatewell.sources.adapters import TX_AREA_SQL, tx_area

#: Reason codes, in their canonical order.
REASONS = ("lt_30_cards", "lt_3_merchants", "top1_gt_75", "g4_differencing")


@dataclass(frozen=True)
class Rules:
    """max_share is the exact fraction share_num / share_den."""

    min_cards: int = 30
    min_merchants: int = 3
    share_num: int = 3
    share_den: int = 4
    differencing: bool = False
    thin_base: int = 12

    def __post_init__(self):
        if not all(isinstance(x, int) for x in (self.min_cards, self.min_merchants, self.share_num, self.share_den, self.thin_base)):
            raise TypeError("rules are integers; a share is a pair of them")
        if not 0 < self.share_num <= self.share_den:
            raise ValueError("max_share is above 0 and at most 1")

    @classmethod
    def from_mapping(cls, mapping: dict) -> Rules:
        """From a JSON document's names; a share is a string `n/d` or a pair of integers, never a float."""
        share = mapping.get("maxShare", (3, 4))
        if isinstance(share, str):
            share = share.split("/") if "/" in share else (share, 1)
        elif not isinstance(share, (list, tuple)) or any(isinstance(x, float) for x in share):
            raise TypeError("maxShare is 'n/d' or a pair of integers")
        num, den = map(int, share)
        whole = {"min_cards": "minCards", "min_merchants": "minMerchants", "thin_base": "thinBaseTransactions"}
        given = {k: mapping[v] for k, v in whole.items() if v in mapping}
        return cls(share_num=num, share_den=den, differencing=bool(mapping.get("requireDifferencing", False)), **given)

    def fingerprint(self) -> str:
        """Which rules these are: a digest of all their values."""
        return hashlib.sha256(repr(sorted(asdict(self).items())).encode()).hexdigest()[:16]


def by_card(tx: DataFrame, grain: list[str]) -> DataFrame:
    """(grain, merchant, card, n), from transactions or from such rows of a finer grain: all that the gates of this grain and of coarser ones need. Such rows of this very grain stay as they are."""
    if set(tx.columns) == {*grain, "merchant", "card", "n"}:
        return tx
    n = F.sum("n") if "n" in tx.columns else F.count("*")
    # cards hardly repeat within a merchant, so combining before the shuffle would only fill memory
    keys = [*grain, "merchant", "card"]
    return dealt(tx.select(*keys, *(["n"] if "n" in tx.columns else [])), *keys).groupBy(*keys).agg(n.alias("n"))


def joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a with b's columns, by keys of which nulls are equal; without keys b is one row."""
    mine = {k: f"__{k}" for k in keys}
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(v)) for k, v in mine.items()), F.lit(True))
    return a.join(b.withColumnsRenamed(mine), same, how).drop(*mine.values())


def cell_merchants(tx: DataFrame, grain: list[str]) -> DataFrame:
    """Volume and distinct cards of each merchant in each cell; cards are counted from (cell, merchant, card) rows, so a hot cell is spread over its cards."""
    return by_card(tx, grain).groupBy(*grain, "merchant").agg(F.sum("n").alias("volume"), F.count("card").alias("cards"))


def exclusive_cards(tx: DataFrame, grain: list[str]) -> DataFrame:
    """Cards that one merchant alone has in a cell, counted by that merchant: cards of the rest = all cards - these."""
    lone = by_card(tx, grain).filter("card is not null").groupBy(*grain, "card").agg(F.count("*").alias("m"), F.min("merchant").alias("merchant")).filter("m = 1")
    return lone.groupBy(*grain, "merchant").agg(F.count("*").alias("exclusive"))


def by_card_at(tx: DataFrame, levels: dict[str, list[str]], asked: list[str] | None = None) -> DataFrame:
    """`by_card` of several grains from one pass over the transactions: (level, keys of all levels, merchant, card, n).

    Transactions are dealt by merchant and card once, so that every level's groups are whole where its rows are told apart, without another shuffle; keys that a level hasn't got are null there. `asked` adds
    a level of that name with the values of these keys, which may repeat; its merchants and cards are null.
    """
    if len({frozenset(v) for v in levels.values()}) < len(levels) or "asked" in levels:
        raise ValueError("levels have different keys, and none is named `asked`")
    sets = levels | ({"asked": asked} if asked else {})
    keys = list(dict.fromkeys(k for v in sets.values() for k in v))
    types = dict(tx.select(*keys).dtypes)
    of = lambda name, v: F.struct(F.lit(name).alias("level"), *[(F.col(k) if k in v else F.lit(None).cast(types[k])).alias(k) for k in keys])
    rows = dealt(tx.select(*keys, "merchant", "card", *(["n"] if "n" in tx.columns else [])), "merchant", "card", times=len(sets))
    n = F.sum("n") if "n" in tx.columns else F.count("*")
    each = rows.select("merchant", "card", *(["n"] if "n" in tx.columns else []), F.explode(F.array(*[of(k, v) for k, v in sets.items()])).alias("s")).select("s.*", "merchant", "card", *(["n"] if "n" in tx.columns else []))
    out = each.groupBy("level", *keys, "merchant", "card").agg(n.alias("n"))
    told = lambda c: F.when(F.col("level") != "asked", F.col(c)).alias(c)
    return out.select("level", *keys, told("merchant"), told("card"), "n")


def halves(tx: DataFrame, grain: list[str]) -> DataFrame:
    """Each cell's rows by merchant and by card, from one pass over its (merchant, card) rows: n; by merchant cards; by card rows (its merchants) and lone (the least of them)."""
    each = by_card(tx, grain).select(*grain, "n", F.col("merchant").alias("m"), F.col("card").alias("c"), F.explode(F.array(F.lit(False), F.lit(True))).alias("by_card"))
    each = each.withColumns({"merchant": F.when(~F.col("by_card"), F.col("m")), "card": F.when(F.col("by_card"), F.col("c"))})
    return each.groupBy(*grain, "by_card", "merchant", "card").agg(F.sum("n").alias("n"), F.count("c").alias("cards"), F.count("*").alias("rows"), F.min("m").alias("lone"))


def counted(tx: DataFrame, grain: list[str]) -> DataFrame:
    """What each transaction adds: volume; cards, if it is the first of its card and merchant in the cell; n_cards, if the first of its card there; exclusive, if the card has no other merchant there.

    Transactions of a cell and card meet in a part, those of an unknown card by their merchants. They are sorted there, which takes less memory than groups by merchant and by card, and no second shuffle by card.
    """
    rows = tx.select(*grain, "merchant", "card", (F.col("n") if "n" in tx.columns else F.lit(1)).cast("long").alias("volume"), F.when(F.col("card").isNull(), F.col("merchant")).alias("__of"))
    w = Window.partitionBy(*grain, "card", "__of").orderBy("merchant")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known, first = F.col("card").isNotNull(), F.row_number().over(w) == 1
    another = ~F.col("merchant").eqNullSafe(F.lag("merchant").over(w))
    lone = F.first("merchant").over(whole).eqNullSafe(F.last("merchant").over(whole))
    adds = {"cards": known & (first | another), "n_cards": known & first, "exclusive": known & first & lone}
    return dealt(rows, *grain, "card", "__of").select(*grain, "merchant", "volume", *[c.cast("long").alias(k) for k, c in adds.items()])


def cell_totals(tx: DataFrame, grain: list[str]) -> DataFrame:
    """Transactions, cards and merchants of each cell, and its largest merchant's volume and cards; no join, and cards counted by themselves at this grain."""
    if set(tx.columns) != {*grain, "merchant", "card", "n"}:
        each = counted(tx, grain).groupBy(*grain, "merchant").agg(*[F.sum(c).alias(c) for c in ("volume", "cards", "n_cards")])
        return each.groupBy(*grain).agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("n_cards", "n_cards"), ("volume", "n_tx"))],
            F.count("merchant").alias("n_merchants"),
            *[F.max(c).alias(a) for c, a in (("volume", "top_volume"), ("cards", "top_cards"))],
            F.sum("cards").alias("sum_cards"),
        )
    card, merchant = F.col("by_card"), ~F.col("by_card")
    return halves(tx, grain).groupBy(*grain).agg(
        F.count_if(card & F.col("card").isNotNull()).alias("n_cards"),
        F.coalesce(F.sum(F.when(card, F.col("n"))), F.lit(0)).alias("n_tx"),
        F.count_if(merchant & F.col("merchant").isNotNull()).alias("n_merchants"),
        F.max(F.when(merchant, F.col("n"))).alias("top_volume"),
        F.max(F.when(merchant, F.col("cards"))).alias("top_cards"),
        F.sum(F.when(merchant, F.col("cards"))).alias("sum_cards"),
    )


def merchant_profile(tx: DataFrame, grain: list[str]) -> DataFrame:
    """A row for each cell and merchant (volume, cards, exclusive: cards that it alone has there) and one for each cell (whole: n_cards, n_tx). It is as small as the cells' merchants are few; what needs it more than once stores it."""
    none = F.lit(0).cast("long")
    slot = lambda whole, merchant, **have: F.struct(F.lit(whole).alias("whole"), merchant.alias("merchant"), *[have.get(c, none).alias(c) for c in ("volume", "cards", "exclusive", "n_cards", "n_tx")])
    no_one = lambda c: F.when(F.lit(False), F.col(c))
    if set(tx.columns) != {*grain, "merchant", "card", "n"}:
        both = counted(tx, grain)
        slots = F.array(slot(True, no_one("merchant"), n_cards=F.col("n_cards"), n_tx=F.col("volume")), slot(False, F.col("merchant"), **{c: F.col(c) for c in ("volume", "cards", "exclusive")}))
    else:
        both = halves(tx, grain)
        known = F.col("card").isNotNull()
        by_card_slots = F.array(slot(True, no_one("lone"), n_cards=known.cast("long"), n_tx=F.col("n")), F.when(known & (F.col("rows") == 1), slot(False, F.col("lone"), exclusive=none + 1)))
        slots = F.when(F.col("by_card"), by_card_slots).otherwise(F.array(slot(False, F.col("merchant"), volume=F.col("n"), cards=F.col("cards"))))
    each = both.select(*grain, F.explode(slots).alias("s")).filter("s is not null").select(*grain, "s.*")
    return each.groupBy(*grain, "whole", "merchant").agg(*[F.sum(c).alias(c) for c in ("volume", "cards", "exclusive", "n_cards", "n_tx")])


def totals_of(profile: DataFrame, grain: list[str]) -> DataFrame:
    """`cell_totals` from a merchant_profile."""
    one = ~F.col("whole")
    return profile.groupBy(*grain).agg(
        F.sum("n_cards").alias("n_cards"),
        F.sum("n_tx").alias("n_tx"),
        F.count_if(one & F.col("merchant").isNotNull()).alias("n_merchants"),
        *[F.max(F.when(one, F.col(c))).alias(a) for c, a in (("volume", "top_volume"), ("cards", "top_cards"))],
        F.sum("cards").alias("sum_cards"),
    )


def within_share(top: Column, total: Column, rules: Rules) -> Column:
    """top / total <= share, exactly; a total of zero or less fails."""
    return (total > 0) & (F.lit(rules.share_den) * top <= F.lit(rules.share_num) * total)


def gate_columns(cells: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """cells with g1, g2, g3_volume, g3_cards and ok (all of them). If merchants' cards aren't known (top_cards is null), the share is judged by volume alone."""
    out = cells.withColumns(
        {
            "g1": F.col("n_cards") >= rules.min_cards,
            "g2": F.col("n_merchants") >= rules.min_merchants,
            "g3_volume": within_share(F.col("top_volume"), F.col("n_tx"), rules),
            "g3_cards": F.col("top_cards").isNull() | within_share(F.col("top_cards"), F.col("n_cards"), rules),
        }
    )
    return out.withColumn("ok", F.col("g1") & F.col("g2") & F.col("g3_volume") & F.col("g3_cards"))


#: The gates' names in blocks of other documents.
BLOCK_CODES = {"lt_30_cards": "G1_CARDS", "lt_3_merchants": "G2_ENTITIES", "top1_gt_75": "G3_SHARE", "g4_differencing": "G4_DIFFERENCING"}


def gate_block(cells: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """cells (n_cards, n_merchants, n_tx, top_volume, top_cards) with gates, a struct of g1_cards, g2_merchants, g3_share and all; top_cards of 0 means that cards weren't measured."""
    held = gate_columns(cells.withColumn("top_cards", F.nullif("top_cards", F.lit(0))), rules)
    share = F.col("g3_volume") & F.col("g3_cards")
    return held.select(
        *[F.coalesce("top_cards", F.lit(0)).alias(c) if c == "top_cards" else F.col(c) for c in cells.columns],
        F.struct(F.col("g1").alias("g1_cards"), F.col("g2").alias("g2_merchants"), share.alias("g3_share"), (F.col("g1") & F.col("g2") & share).alias("all")).alias("gates"),
    )


def reason(cells: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """cells with failures, in canonical order, and reason: ok, no_data, thin_base, the one failure, or multi. A missing g4 counts as passed."""
    g4 = F.coalesce(F.col("g4"), F.lit(True)) if "g4" in cells.columns else F.lit(True)
    failed = [F.when(~F.col("g1"), REASONS[0]), F.when(~F.col("g2"), REASONS[1]), F.when(~(F.col("g3_volume") & F.col("g3_cards")), REASONS[2]), F.when(~g4, REASONS[3])]
    out = cells.withColumn("failures", F.filter(F.array(*failed), lambda x: x.isNotNull()))
    thin = F.col("thin_tx") < rules.thin_base if "thin_tx" in cells.columns else F.lit(False)
    return out.withColumn(
        "reason",
        F.when(F.col("n_tx") <= 0, "no_data").when(thin, "thin_base").when(F.size("failures") == 0, "ok").when(F.size("failures") == 1, F.col("failures")[0]).otherwise("multi"),
    )


def residuals(tx: DataFrame, grain: list[str], measured: bool = True) -> DataFrame:
    """Each cell without each of its merchants: its cards, merchants, volume and largest remaining merchant.

    Measured: cards left are all cards less those that this merchant alone has. Bound: less min(volume, all cards).
    The largest remaining merchant is the cell's second if the first is taken out, and else the first.
    """
    return residuals_of(stored(merchant_profile(tx, grain), "profile"), grain, measured)


def residuals_of(profile: DataFrame, grain: list[str], measured: bool = True) -> DataFrame:
    """`residuals` from a merchant_profile. A cell's merchants, not its transactions, meet in a task here."""
    w = Window.partitionBy(*grain)
    ranked = profile.withColumns(
        {f"by_{c}": F.row_number().over(w.orderBy("whole", F.desc(c), "merchant")) for c in ("volume", "cards")}
        | {f"{c}_all": F.max(F.when(F.col("whole"), F.col(c))).over(w) for c in ("n_cards", "n_tx")}
        | {"n_all": F.count_if(~F.col("whole")).over(w)}
    )
    tops = {f"{c}{k}": F.max(F.when(~F.col("whole") & (F.col(f"by_{c}") == k), F.col(c))).over(w) for c in ("volume", "cards") for k in (1, 2)}
    out = ranked.withColumns(tops).filter("not whole")
    gone = F.col("exclusive") if measured else F.least("volume", "n_cards_all")
    rest = F.greatest(F.col("n_cards_all") - gone, F.lit(0))
    top = lambda c: F.coalesce(F.when(F.col(f"by_{c}") == 1, F.col(f"{c}2")).otherwise(F.col(f"{c}1")), F.lit(0))
    return out.select(*grain, "merchant", rest.alias("n_cards"), (F.col("n_all") - 1).alias("n_merchants"), (F.col("n_tx_all") - F.col("volume")).alias("n_tx"), top("volume").alias("top_volume"), F.least(top("cards"), rest).alias("top_cards"))


def fails_without_one(residual: DataFrame, grain: list[str], rules: Rules) -> DataFrame:
    held = gate_columns(residual, rules)
    return held.groupBy(*grain).agg(F.bool_and("ok").alias("g4"), F.min(F.when(~F.col("ok"), F.col("merchant"))).alias("g4_merchant"))


def differencing(tx: DataFrame, grain: list[str], rules: Rules = Rules(), measured: bool = True) -> DataFrame:
    """g4 of each cell: whether all its residuals pass; and the first merchant, by id, whose residual fails."""
    return fails_without_one(residuals(tx, grain, measured), grain, rules)


def gated(tx: DataFrame, grain: list[str], rules: Rules = Rules()) -> DataFrame:
    """The cells of a grain with their gates; ok takes in g4 if the rules ask for it. Transactions may come by card already."""
    if not rules.differencing:
        return gate_columns(cell_totals(tx, grain), rules)
    profile = stored(merchant_profile(tx, grain), "profile")
    cells = joined(gate_columns(totals_of(profile, grain), rules), fails_without_one(residuals_of(profile, grain), grain, rules), grain, "left")
    return cells.withColumns({"ok3": F.col("ok"), "ok": F.col("ok") & F.coalesce("g4", F.lit(False))})


def answered(cells: DataFrame, grain: list[str], rules: Rules, asked: DataFrame | None = None) -> DataFrame:
    """Cells of `gated` with their reasons; see `gate` for `asked`."""
    cells = cells.drop("ok3")
    if asked is not None:
        cells = joined(asked, cells, grain, "left")
        none = {c: F.coalesce(c, F.lit(False)) for c in ("g1", "g2", "g3_volume", "g3_cards", "ok")} | {c: F.coalesce(c, F.lit(0)) for c in ("n_cards", "n_tx", "n_merchants")}
        cells = cells.withColumns(none)
    out = reason(cells, rules)
    return out.withColumn("ok", F.col("ok") & (F.col("reason") == "ok"))


def gate(tx: DataFrame, grain: list[str], rules: Rules = Rules(), asked: DataFrame | None = None) -> DataFrame:
    """The cells of a grain with their gates and reasons. `asked` names cells to answer for, those without rows as no_data; its column thin_tx,
    if there, is how many transactions a cell's base has, and a thin one is refused before any gate. Transactions may come by card already."""
    return answered(gated(tx, grain, rules), grain, rules, asked)


def gates_at(tx: DataFrame, levels: dict[str, list[str]], rules: Rules = Rules(), asked: list[str] | None = None) -> DataFrame:
    """`gated` of several grains from one pass: level, the keys of all levels (null where a level hasn't got them) and the gates. Every level counts its own cards."""
    rows = by_card_at(tx, levels, asked)
    return gated(rows, [c for c in rows.columns if c not in ("merchant", "card", "n")], rules)


def cascade(tx: DataFrame, cell: list[str], parent: list[str], rules: Rules = Rules(), asked: DataFrame | None = None) -> DataFrame:
    """For each cell the first level of cell, parent and city that passes all gates of the rules, or none; every level counts its own cards.

    A cell without data or with a thin base is refused at once, whatever its ancestors are. trace has the failures of each level looked
    at; failures all of them, if none passes; levels_missing the levels that a cell hasn't got, as a parent that isn't known.
    `asked` has the keys of cells to answer for (and their parents'), and thin_tx at will; else all cells of tx are.
    """
    keys = list(dict.fromkeys([*cell, *parent]))
    # one pass over the transactions serves all levels; what is stored are cells
    cells = stored(gates_at(tx, {"cell": cell, "parent": parent, "city": []}, rules, keys if asked is None else None), "cells")
    of = lambda name, grain: cells.filter(F.col("level") == name).drop("level", *[k for k in keys if k not in grain])
    asked = of("asked", keys).select(*keys) if asked is None else asked
    own = answered(of("cell", cell), cell, rules, asked.drop(*[k for k in parent if k not in cell]))
    own = own.select(*cell, F.col("ok").alias("cell_ok"), F.col("reason").alias("cell_reason"), F.col("failures").alias("cell_failures"))
    level = lambda grain, name: answered(of(name, grain), grain, rules).select(*grain, F.col("ok").alias(f"{name}_ok"), F.col("failures").alias(f"{name}_failures"))
    out = joined(joined(joined(asked.select(*keys), own, cell), level(parent, "parent"), parent, "left"), level([], "city"), [], "left")
    missing = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in parent if k not in cell), F.lit(False)) | F.col("parent_ok").isNull()
    stopped = F.col("cell_reason").isin("no_data", "thin_base")
    passes = lambda name: F.coalesce(F.col(f"{name}_ok"), F.lit(False))
    chosen = F.when(stopped, None).when(F.col("cell_ok"), "cell").when(~missing & passes("parent"), "parent").when(passes("city"), "city")
    step = lambda name: F.struct(F.lit(name).alias("level"), F.col(f"{name}_failures").alias("failures"))
    looked = [F.when(~stopped, step("cell")), F.when(~stopped & ~F.col("cell_ok") & ~missing, step("parent")), F.when(~stopped & ~F.col("cell_ok") & (missing | ~passes("parent")), step("city"))]
    out = out.withColumns({"level": chosen, "trace": F.filter(F.array(*looked), lambda x: x.isNotNull()), "levels_missing": F.when(missing, F.array(F.lit("parent"))).otherwise(F.array().cast("array<string>"))})
    locked = F.col("level").isNull()
    every = F.flatten(F.transform("trace", lambda x: x["failures"]))
    return out.select(
        *keys,
        "cell_reason",
        "level",
        (~F.col("cell_ok") & ~locked).alias("escalated"),
        F.when(stopped, F.col("cell_reason")).when(locked, "all_levels_failed").otherwise("ok").alias("reason"),
        F.when(locked & ~stopped, F.filter(F.array(*[F.lit(r) for r in REASONS]), lambda r: F.array_contains(every, r))).otherwise(F.array().cast("array<string>")).alias("failures"),
        "trace",
        "levels_missing",
    )


def release(cells: DataFrame, rules: Rules) -> DataFrame:
    """The cells that pass, marked with the rules that passed them."""
    return cells.filter("ok").withColumn("rules", F.lit(rules.fingerprint()))


def require_released(cells: DataFrame, rules: Rules) -> DataFrame:
    """cells, if they come from `release` under these very rules and all pass; else an error."""
    if "rules" not in cells.columns or "ok" not in cells.columns:
        raise ValueError("cells that no gate has released")
    if not cells.filter(~F.col("ok") | F.col("ok").isNull() | ~F.col("rules").eqNullSafe(F.lit(rules.fingerprint()))).isEmpty():
        raise ValueError("cells that fail, or that other rules released")
    return cells


def evaluated(cells: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """cells with codes, the failures of the first three gates by BLOCK_CODES in canonical order, and detail, a line for each and one more if cards weren't measured. No one merchant is named."""
    held = gate_columns(cells, rules)
    share = F.col("g3_volume") & F.col("g3_cards")
    failed = [(~F.col("g1"), REASONS[0]), (~F.col("g2"), REASONS[1]), (~share, REASONS[2])]
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    limit = f" > {rules.share_num}/{rules.share_den}"
    lines = [
        F.when(~F.col("g1"), text("n_cards=", F.col("n_cards"), f" < {rules.min_cards}")),
        F.when(~F.col("g2"), text("n_merchants=", F.col("n_merchants"), f" < {rules.min_merchants}")),
        F.when(~F.col("g3_volume"), text("share of volume ", F.col("top_volume"), "/", F.col("n_tx"), limit)),
        F.when(~F.col("g3_cards"), text("share of cards ", F.col("top_cards"), "/", F.col("n_cards"), limit)),
        F.when(F.col("top_cards").isNull(), F.lit("cards of merchants unknown: share by volume alone")),
    ]
    known = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    return held.select(*cells.columns, known([F.when(c, BLOCK_CODES[k]) for c, k in failed]).alias("codes"), known(lines).alias("detail"))


#: What is impossible in a cell, and in the evidence on its merchants.
EVIDENCE = (
    "missing", "negative", "cards_gt_tx", "phantom", "partition", "cards_of_no_merchant", "cards_lt_1", "cards_gt_volume",
    "residual_of_no_merchant", "residual_out_of_bounds", "merchant_cards_gt_cards", "sum_cards_lt_cards",
)


def evidence_violations(cells: DataFrame, merchants: DataFrame, key: list[str]) -> DataFrame:
    """(key, checks): which of EVIDENCE each cell breaks, in that order; cells that break none have an empty list.

    cells: key, n_cards, n_tx. merchants: key, merchant, volume, cards and residual; a null volume means that the merchant is in no partition of the cell, null cards or residual that there is no
    such evidence. A residual lies between all cards less the merchant's volume, at most, and all cards. Cards of merchants must cover the cell's only if all merchants have them.
    """
    both = joined(merchants, cells, key, "left")
    v, c, r, n = (F.col(x) for x in ("volume", "cards", "residual", "n_cards"))
    member = v.isNotNull()
    hit = lambda x: F.coalesce(F.bool_or(x), F.lit(False))
    by = both.groupBy(*key).agg(
        F.coalesce(F.sum("volume"), F.lit(0)).alias("__volume"),
        F.coalesce(F.sum(F.when(member, c)), F.lit(0)).alias("__cards"),
        (F.count_if(member & c.isNull()) == 0).alias("__all"),
        F.count("cards").alias("__some"),
        hit(v <= 0).alias("phantom"),
        hit(~member & c.isNotNull()).alias("cards_of_no_merchant"),
        hit(c < 1).alias("cards_lt_1"),
        hit(c > v).alias("cards_gt_volume"),
        hit(~member & r.isNotNull()).alias("residual_of_no_merchant"),
        hit(member & ((r < n - F.least(v, n)) | (r > n))).alias("residual_out_of_bounds"),
        hit(member & (c > n)).alias("merchant_cards_gt_cards"),
    )
    x = joined(cells, by, key, "left")
    no = lambda k: F.coalesce(k, F.lit(False))
    checks = {
        "missing": F.col("n_cards").isNull() | F.col("n_tx").isNull(),
        "negative": no((F.col("n_cards") < 0) | (F.col("n_tx") < 0)),
        "cards_gt_tx": no(F.col("n_cards") > F.col("n_tx")),
        "partition": no(F.coalesce("__volume", F.lit(0)) != F.col("n_tx")),
        "sum_cards_lt_cards": no(F.col("__all") & (F.col("__some") > 0) & (F.col("__cards") < F.col("n_cards"))),
    }
    named = [F.when(checks[k] if k in checks else no(F.col(k)), k) for k in EVIDENCE]
    return x.select(*key, F.filter(F.array(*named), lambda y: y.isNotNull()).alias("checks"))


def residual_cards(merchants: DataFrame, key: list[str]) -> DataFrame:
    """merchants of (key, merchant, volume, cards, n_cards, exclusive) with low and high, the bounds of the cards that are left without each, rest (measured if exclusive is known, else the lower
    bound), and top_cards, the most that another merchant may have of them; null, so withheld, if there is no other, or if one of them would be left with none."""
    n = F.col("n_cards")
    low = F.greatest(F.lit(0), n - F.least("volume", n))
    rest = F.coalesce(n - F.col("exclusive"), low)
    w = Window.partitionBy(*key)
    out = merchants.withColumns({"low": low, "high": n, "rest": rest})
    first, second = (F.max(F.when(F.col("__r") == k, F.col("cards"))).over(w) for k in (1, 2))
    least, next_ = (F.max(F.when(F.col("__s") == k, F.col("cards"))).over(w) for k in (1, 2))
    out = out.withColumns({"__r": F.row_number().over(w.orderBy(F.desc("cards"), "merchant")), "__s": F.row_number().over(w.orderBy("cards", "merchant"))})
    out = out.withColumns({"__top": F.when(F.col("__r") == 1, second).otherwise(first), "__min": F.when(F.col("__s") == 1, next_).otherwise(least), "__known": F.count("cards").over(w) == F.count("*").over(w)})
    fits = F.col("__known") & (F.least("__min", "rest") >= 1)
    return out.withColumn("top_cards", F.when(fits, F.least("__top", "rest"))).drop("__r", "__s", "__top", "__min", "__known")


def with_month(tx: DataFrame) -> DataFrame:
    return tx.withColumn("month", F.date_format("day", "yyyyMM"))


def violations(cells: DataFrame) -> DataFrame:
    """Impossible cells: more cards than transactions, a largest merchant above the total, cards of merchants below the cell's, and so on."""
    checks = {
        "negative": (F.col("n_cards") < 0) | (F.col("n_tx") < 0) | (F.col("n_merchants") < 0),
        "cards_gt_tx": F.col("n_cards") > F.col("n_tx"),
        "merchants_gt_tx": F.col("n_merchants") > F.col("n_tx"),
        "top_volume_gt_tx": F.col("top_volume") > F.col("n_tx"),
        "top_cards_gt_cards": F.col("top_cards") > F.col("n_cards"),
        "sum_cards_lt_cards": F.col("sum_cards") < F.col("n_cards"),
        "cards_without_merchants": (F.col("n_merchants") == 0) & (F.col("n_cards") > 0),
    }
    return cells.agg(*[F.coalesce(F.count_if(c), F.lit(0)).cast("long").alias(k) for k, c in checks.items()], F.count("*").alias("cells"))


# queries


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_month(tx_area(spark, sf_dir))


def area_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate(tx_area(spark, sf_dir), ["area"]).drop("failures", "sum_cards")


def area_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_totals(tx_area(spark, sf_dir), ["area"]).select("area", "n_tx", "n_cards", "n_merchants")


def area_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_totals(tx_area(spark, sf_dir), ["area"]).select("area", "top_volume", "top_cards")


def month_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate(_monthly(spark, sf_dir), ["area", "month"]).drop("failures", "sum_cards")


def cell_merchant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_merchants(tx_area(spark, sf_dir), ["area"])


def exclusive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exclusive_cards(tx_area(spark, sf_dir), ["area"])


def gates_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate(tx_area(spark, sf_dir), ["area"], Rules(differencing=True)).select("area", "ok", "g4", "g4_merchant", "reason")


def residual_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residuals(tx_area(spark, sf_dir), ["area"], measured=False)


def gate_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = with_month(tx_area(spark, sf_dir))
    return cascade(tx, ["area", "month"], ["parent", "month"]).select("area", "month", "parent", "cell_reason", "level", "escalated", "reason")


def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells, and how much volume, have each reason."""
    cells = gate(_monthly(spark, sf_dir), ["area", "month"])
    return cells.groupBy("reason").agg(F.count("*").alias("cells"), F.sum("n_tx").alias("volume"))


def privacy_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and volume left after each gate in turn."""
    cells = gate(_monthly(spark, sf_dir), ["area", "month"])
    steps = [("all", F.lit(True)), ("g1", F.col("g1")), ("g1_g2", F.col("g1") & F.col("g2")), ("g1_g2_g3", F.col("ok"))]
    staged = cells.select("n_tx", F.explode(F.array(*[F.struct(F.lit(k).alias("step"), c.alias("held")) for k, c in steps])).alias("s"))
    return staged.filter("s.held").groupBy(F.col("s.step").alias("step")).agg(F.count("*").alias("cells"), F.sum("n_tx").alias("volume"))


def cell_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(cell_totals(_monthly(spark, sf_dir), ["area", "month"]))


def gated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both readings of the share gate: volume alone, and volume and cards."""
    cells = gate_columns(cell_totals(tx_area(spark, sf_dir), ["area"]))
    return cells.select("area", (F.col("g1") & F.col("g2") & F.col("g3_volume")).alias("volume_only"), F.col("ok").alias("strict"))


def codes_between_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas that the volume alone would release and the strict reading holds back."""
    codes = gated_codes(spark, sf_dir)
    return codes.filter("volume_only").select("area").exceptAll(codes.filter("strict").select("area"))


def released_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return require_released(release(gate(_monthly(spark, sf_dir), ["area", "month"]), Rules()), Rules()).select("area", "month", "n_tx", "n_cards", "n_merchants")


def gate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and codes of each area; of every other one the cards of merchants count as unmeasured."""
    cells = cell_totals(tx_area(spark, sf_dir), ["area"]).withColumn("top_cards", F.when(F.col("area") % 2 == 1, F.col("top_cards")).otherwise(0))
    out = evaluated(gate_block(cells).withColumn("top_cards", F.nullif("top_cards", F.lit(0))))
    return out.select("area", "gates.*", F.array_join("codes", ",").alias("codes"), F.array_join("detail", "; ").alias("detail"))


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cells of area and month and their merchants, as measured but for errors that are planted by the cell's number, so that each check has something to find."""
    key = ["area", "month"]
    profile = stored(merchant_profile(_monthly(spark, sf_dir), key), "profile")
    k = F.col("area") * 7 + F.col("month").cast("int") % 100
    plant = lambda i, of=29: k % of == i
    cells = profile.filter("whole").select(*key, F.when(plant(1), -1).when(~plant(0), F.col("n_cards")).alias("n_cards"), F.when(plant(2), 0).when(plant(3), F.col("n_tx") + 1).otherwise(F.col("n_tx")).alias("n_tx"))
    n = profile.filter("whole").select(*key, F.col("n_cards").alias("n"))
    m = joined(profile.filter("not whole").select(*key, "merchant", "volume", "cards", "exclusive"), n, key)
    first = F.col("merchant") % 2 == 0
    parts = m.select(
        *key, "merchant",
        F.when(plant(4) & first, 0).when(plant(5) & first, None).when(plant(6) & first, None).otherwise(F.col("volume")).alias("volume"),
        F.when(plant(7) & first, 0).when(plant(8) & first, F.col("volume") + 1).when(plant(9), F.col("n") + 1).when(plant(10), 1).when(plant(6) & first, None).otherwise(F.col("cards")).alias("cards"),
        F.when(plant(11) & first, F.col("n") + 1).when(plant(12), -1).when(plant(5) & first, None).otherwise(F.col("n") - F.col("exclusive")).alias("residual"),
    )
    return cells, parts


def evidence_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells break each check."""
    cells, parts = _evidence(spark, sf_dir)
    broken = evidence_violations(cells, parts, ["area", "month"])
    return broken.select(F.explode_outer("checks").alias("check")).groupBy(F.coalesce("check", F.lit("none")).alias("check")).agg(F.count("*").alias("cells"))


def residual_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each month of an area without each merchant, by the lower bound alone, and whether the cards of the others may be told."""
    key = ["area", "month"]
    profile = stored(merchant_profile(_monthly(spark, sf_dir), key), "profile")
    n = profile.filter("whole").select(*key, "n_cards")
    m = joined(profile.filter("not whole").select(*key, "merchant", "volume", "cards", F.lit(None).cast("long").alias("exclusive")), n, key)
    return residual_cards(m, key).select(*key, "merchant", "low", "high", "rest", "top_cards")


QUERIES = {
    "gate_blocks": gate_blocks, "evidence_checks": evidence_checks, "residual_maps": residual_maps,
    "codes_between_readings": codes_between_readings, "released_months": released_months, "area_gates": area_gates, "area_stats": area_stats, "area_top1": area_top1, "month_gates": month_gates, "cell_merchants": cell_merchant_rows,
    "exclusive_cards": exclusive_rows, "gates_differencing": gates_differencing, "residual_bounds": residual_bounds, "gate_cascade": gate_cascade,
    "gate_report": gate_report, "privacy_funnel": privacy_funnel, "cell_violations": cell_violations, "gated_codes": gated_codes,
}


def _cells(grain: str, source: str = "tx") -> str:
    """CTEs m (merchants), c (cells with gates) and g (with reasons) over a grain."""
    group = f"GROUP BY {grain}" if grain else ""
    sep = ", " if grain else ""
    join = f"USING ({grain})" if grain else "ON true"
    return f"""
m AS (SELECT {grain}{sep}merchant, count(*) AS volume, count(DISTINCT card) AS cards FROM {source} GROUP BY {grain}{sep}merchant),
t AS (SELECT {grain}{sep}count(*) AS n_tx, count(DISTINCT card) AS n_cards, count(DISTINCT merchant) AS n_merchants FROM {source} {group}),
p AS (SELECT {grain}{sep}max(volume) AS top_volume, max(cards) AS top_cards, CAST(sum(cards) AS BIGINT) AS sum_cards FROM m {group}),
c AS (SELECT *, n_cards >= 30 AS g1, n_merchants >= 3 AS g2, 4 * top_volume <= 3 * n_tx AS g3_volume, 4 * top_cards <= 3 * n_cards AS g3_cards FROM t JOIN p {join}),
g AS (SELECT *, g1 AND g2 AND g3_volume AND g3_cards AS ok,
  CASE WHEN g1 AND g2 AND g3_volume AND g3_cards THEN 'ok'
       WHEN (CASE WHEN g1 THEN 0 ELSE 1 END) + (CASE WHEN g2 THEN 0 ELSE 1 END) + (CASE WHEN g3_volume AND g3_cards THEN 0 ELSE 1 END) > 1 THEN 'multi'
       WHEN NOT g1 THEN 'lt_30_cards' WHEN NOT g2 THEN 'lt_3_merchants' ELSE 'top1_gt_75' END AS reason FROM c)"""


_AREA = f"WITH {TX_AREA_SQL}, tx AS (SELECT *, strftime(day, '%Y%m') AS month FROM tx_area),"
_GATES = "n_tx, n_cards, n_merchants, top_volume, top_cards, g1, g2, g3_volume, g3_cards, ok, reason"
_REST = """
x AS (SELECT area, merchant, count(*) AS exclusive FROM (SELECT area, card, min(merchant) AS merchant FROM tx GROUP BY area, card HAVING count(DISTINCT merchant) = 1) GROUP BY area, merchant),
r AS (SELECT a.area, a.merchant, t.n_cards - {gone} AS n_cards, t.n_merchants - 1 AS n_merchants, t.n_tx - a.volume AS n_tx,
        coalesce((SELECT max(b.volume) FROM m b WHERE b.area = a.area AND b.merchant <> a.merchant), 0) AS top_volume,
        coalesce((SELECT max(b.cards) FROM m b WHERE b.area = a.area AND b.merchant <> a.merchant), 0) AS top_cards0
      FROM m a JOIN t USING (area) LEFT JOIN x USING (area, merchant)),
rr AS (SELECT *, least(top_cards0, n_cards) AS top_cards FROM r)"""

_K = "(area * 7 + CAST(month AS INTEGER) % 100) % 29"
_MONTHS = f"""{_AREA} {_cells('area, month')}, x AS (SELECT area, month, merchant, count(*) AS exclusive FROM (SELECT area, month, card, min(merchant) AS merchant FROM tx GROUP BY area, month, card HAVING count(DISTINCT merchant) = 1) GROUP BY ALL),
a AS (SELECT m.*, coalesce(exclusive, 0) AS exclusive, n_cards AS n, {_K} AS k, merchant % 2 = 0 AS f FROM m JOIN t USING (area, month) LEFT JOIN x USING (area, month, merchant))"""

ORACLES = {
    "gate_blocks": f"""{_AREA} {_cells('area')}, k AS (SELECT *, area % 2 = 1 AS cards FROM g), h AS (SELECT *, g3_volume AND (NOT cards OR g3_cards) AS g3 FROM k)
      SELECT area, g1 AS g1_cards, g2 AS g2_merchants, g3 AS g3_share, g1 AND g2 AND g3 AS "all", concat_ws(',', CASE WHEN NOT g1 THEN 'G1_CARDS' END, CASE WHEN NOT g2 THEN 'G2_ENTITIES' END, CASE WHEN NOT g3 THEN 'G3_SHARE' END) AS codes,
        concat_ws('; ', CASE WHEN NOT g1 THEN 'n_cards=' || n_cards || ' < 30' END, CASE WHEN NOT g2 THEN 'n_merchants=' || n_merchants || ' < 3' END, CASE WHEN NOT g3_volume THEN 'share of volume ' || top_volume || '/' || n_tx || ' > 3/4' END,
          CASE WHEN cards AND NOT g3_cards THEN 'share of cards ' || top_cards || '/' || n_cards || ' > 3/4' END, CASE WHEN NOT cards THEN 'cards of merchants unknown: share by volume alone' END) AS detail FROM h""",
    "evidence_checks": f"""{_MONTHS}, cc AS (SELECT area, month, CASE WHEN {_K} = 1 THEN -1 WHEN {_K} <> 0 THEN n_cards END AS nc, CASE {_K} WHEN 2 THEN 0 WHEN 3 THEN n_tx + 1 ELSE n_tx END AS nt FROM t),
      q AS (SELECT area, month, merchant, CASE WHEN f AND k = 4 THEN 0 WHEN f AND k IN (5, 6) THEN NULL ELSE volume END AS v, CASE WHEN f AND k = 7 THEN 0 WHEN f AND k = 8 THEN volume + 1 WHEN k = 9 THEN n + 1 WHEN k = 10 THEN 1 WHEN f AND k = 6 THEN NULL ELSE cards END AS c,
        CASE WHEN f AND k = 11 THEN n + 1 WHEN k = 12 THEN -1 WHEN f AND k = 5 THEN NULL ELSE n - exclusive END AS r FROM a),
      z AS (SELECT area, month, nc, nt, list_filter([CASE WHEN nc IS NULL OR nt IS NULL THEN 'missing' END, CASE WHEN nc < 0 OR nt < 0 THEN 'negative' END, CASE WHEN nc > nt THEN 'cards_gt_tx' END, CASE WHEN coalesce(sum(v), 0) <> nt THEN 'partition' END,
          CASE WHEN bool_or(v <= 0) THEN 'phantom' END, CASE WHEN bool_or(v IS NULL AND c IS NOT NULL) THEN 'cards_of_no_merchant' END, CASE WHEN bool_or(c < 1) THEN 'cards_lt_1' END, CASE WHEN bool_or(c > v) THEN 'cards_gt_volume' END,
          CASE WHEN bool_or(v IS NULL AND r IS NOT NULL) THEN 'residual_of_no_merchant' END, CASE WHEN bool_or(r < nc - least(v, nc) OR r > nc AND v IS NOT NULL) THEN 'residual_out_of_bounds' END, CASE WHEN bool_or(v IS NOT NULL AND c > nc) THEN 'merchant_cards_gt_cards' END,
          CASE WHEN count(*) FILTER (WHERE v IS NOT NULL AND c IS NULL) = 0 AND count(c) > 0 AND coalesce(sum(c) FILTER (WHERE v IS NOT NULL), 0) < nc THEN 'sum_cards_lt_cards' END], lambda y: y IS NOT NULL) AS l FROM cc JOIN q USING (area, month) GROUP BY area, month, nc, nt)
      SELECT "check", count(*) AS cells FROM (SELECT unnest(CASE WHEN len(l) = 0 THEN ['none'] ELSE l END) AS "check" FROM z) GROUP BY 1""",
    "residual_maps": f"""{_MONTHS}, o AS (SELECT a.area, a.month, a.merchant, a.n, greatest(0, a.n - least(a.volume, a.n)) AS low, max(b.cards) AS top, min(b.cards) AS least_ FROM a LEFT JOIN a b ON b.area = a.area AND b.month = a.month AND b.merchant <> a.merchant GROUP BY a.area, a.month, a.merchant, a.n, a.volume)
      SELECT area, month, merchant, low, n AS high, low AS rest, CASE WHEN least(least_, low) >= 1 AND least_ IS NOT NULL THEN least(top, low) END AS top_cards FROM o""",
    "codes_between_readings": f"{_AREA} {_cells('area')} SELECT area FROM g WHERE g1 AND g2 AND g3_volume EXCEPT SELECT area FROM g WHERE ok",
    "released_months": f"{_AREA} {_cells('area, month')} SELECT area, month, n_tx, n_cards, n_merchants FROM g WHERE ok",
    "area_gates": f"{_AREA} {_cells('area')} SELECT area, {_GATES} FROM g",
    "area_stats": f"{_AREA} {_cells('area')} SELECT area, n_tx, n_cards, n_merchants FROM t",
    "area_top1": f"{_AREA} {_cells('area')} SELECT area, top_volume, top_cards FROM p",
    "month_gates": f"{_AREA} {_cells('area, month')} SELECT area, month, {_GATES} FROM g",
    "cell_merchants": f"{_AREA} {_cells('area')} SELECT area, merchant, volume, cards FROM m",
    "exclusive_cards": f"{_AREA} {_cells('area')}, {_REST.format(gone='0')} SELECT area, merchant, exclusive FROM x",
    "residual_bounds": f"{_AREA} {_cells('area')}, {_REST.format(gone='least(a.volume, t.n_cards)')} SELECT area, merchant, n_cards, n_merchants, n_tx, top_volume, top_cards FROM rr",
    "gates_differencing": f"""{_AREA} {_cells('area')}, {_REST.format(gone='coalesce(x.exclusive, 0)')},
      d AS (SELECT area, bool_and(fine) AS g4, min(CASE WHEN NOT fine THEN merchant END) AS g4_merchant FROM (
        SELECT area, merchant, n_cards >= 30 AND n_merchants >= 3 AND n_tx > 0 AND n_cards > 0 AND 4 * top_volume <= 3 * n_tx AND 4 * top_cards <= 3 * n_cards AS fine FROM rr) GROUP BY area)
      SELECT area, ok AND g4 AS ok, g4, g4_merchant, CASE WHEN g4 THEN reason WHEN ok THEN 'g4_differencing' ELSE 'multi' END AS reason FROM g JOIN d USING (area)""",
    "gate_cascade": f"""{_AREA} own AS (SELECT * FROM (WITH {_cells('area, month').lstrip()} SELECT area, month, ok AS cell_ok, reason AS cell_reason FROM g)),
      up AS (SELECT * FROM (WITH {_cells('parent, month').lstrip()} SELECT parent, month, ok AS parent_ok FROM g)),
      city AS (SELECT * FROM (WITH {_cells('').lstrip()} SELECT ok AS city_ok FROM g)),
      k AS (SELECT DISTINCT area, month, parent FROM tx),
      l AS (SELECT *, CASE WHEN cell_ok THEN 'cell' WHEN parent_ok THEN 'parent' WHEN city_ok THEN 'city' END AS level FROM k JOIN own USING (area, month) JOIN up USING (parent, month), city)
      SELECT area, month, parent, cell_reason, level, NOT cell_ok AND level IS NOT NULL AS escalated, CASE WHEN level IS NULL THEN 'all_levels_failed' ELSE 'ok' END AS reason FROM l""",
    "gate_report": f"{_AREA} {_cells('area, month')} SELECT reason, count(*) AS cells, CAST(sum(n_tx) AS BIGINT) AS volume FROM g GROUP BY reason",
    "privacy_funnel": f"""{_AREA} {_cells('area, month')} SELECT step, count(*) AS cells, CAST(sum(n_tx) AS BIGINT) AS volume FROM (
      SELECT 'all' AS step, n_tx FROM g UNION ALL SELECT 'g1', n_tx FROM g WHERE g1 UNION ALL SELECT 'g1_g2', n_tx FROM g WHERE g1 AND g2 UNION ALL SELECT 'g1_g2_g3', n_tx FROM g WHERE ok) GROUP BY step""",
    "cell_violations": f"""{_AREA} {_cells('area, month')} SELECT count(*) FILTER (WHERE n_cards < 0) AS negative, count(*) FILTER (WHERE n_cards > n_tx) AS cards_gt_tx,
      count(*) FILTER (WHERE n_merchants > n_tx) AS merchants_gt_tx, count(*) FILTER (WHERE top_volume > n_tx) AS top_volume_gt_tx, count(*) FILTER (WHERE top_cards > n_cards) AS top_cards_gt_cards,
      count(*) FILTER (WHERE sum_cards < n_cards) AS sum_cards_lt_cards, count(*) FILTER (WHERE n_merchants = 0 AND n_cards > 0) AS cards_without_merchants, count(*) AS cells FROM c""",
    "gated_codes": f"{_AREA} {_cells('area')} SELECT area, g1 AND g2 AND g3_volume AS volume_only, ok AS strict FROM g",
}
