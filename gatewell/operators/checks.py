"""Ingest and validation checks: each gives counts as rows; what is named `require` raises where they are not as they should be."""

from __future__ import annotations

from itertools import zip_longest

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewell.functions.scalar import daypart, entity_key, format_share, iso_week, local_time
from gatewell.session import table
from gatewell.sources.adapters import ZONE, SENTINEL, TX_TIME_SQL, tx_time

FOREIGN = tuple(f"00-00{i}" for i in range(10))


def scan_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parts of a table, united by position and never deduplicated."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return lines.filter("l_orderkey % 2 = 0").unionAll(lines.filter("l_orderkey % 2 = 1"))


def overlap_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that two parts share: none on disjoint parts."""
    lines = table(spark, sf_dir, "lineitem")
    a, b = lines.filter("l_shipdate < timestamp_ntz '1995-06-01'"), lines.filter("l_shipdate >= timestamp_ntz '1995-01-01'")
    shared = lambda *c: a.select(*c).intersect(b.select(*c)).agg(F.count("*").alias("n"))
    return shared("l_orderkey", "l_linenumber").select(F.lit("line").alias("key"), "n").unionAll(shared("l_orderkey").select(F.lit("order").alias("key"), "n"))


def span(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.agg(F.count("*").alias("rows"), F.countDistinct("o_orderkey").alias("ids"), F.min("o_orderkey").alias("min_id"), F.max("o_orderkey").alias("max_id"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.countDistinct(day).alias("days"))


EXPECTED = ("event_id", "ts", "user_id", "event_type", "value", "props")


def check_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns in their pinned order against what the file has; a row for each that is missing, extra or moved."""
    return drift(spark, list(EXPECTED), table(spark, sf_dir, "events").columns).agg(F.count("*").alias("drifted"))


def drift(spark: SparkSession, expected: list[str], found: list[str]) -> DataFrame:
    """(position, expected, found) of each column that isn't where it should be."""
    pairs = enumerate(zip_longest(expected, found))
    return spark.createDataFrame([(i, a, b) for i, (a, b) in pairs if a != b], "position int, expected string, found string")


def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' columns against the customers', prefixes aside: two layouts that do differ."""
    bare = lambda name: [c.split("_", 1)[1] for c in table(spark, sf_dir, name).columns]
    return drift(spark, bare("customer"), bare("supplier"))


def rederive_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored values against what is derived again from their text; null equals null. `chars` holds the documents' stored lengths against their texts."""
    e = table(spark, sf_dir, "events")
    stored = e.select(F.col("ts").cast("date").alias("d"), F.col("value").cast("decimal(38,10)").alias("v"), F.date_format("ts", "HHmmss").alias("t"), "ts")
    again = stored.select("*", F.to_date(F.date_format("ts", "yyyyMMdd"), "yyyyMMdd").alias("d2"), F.col("v").cast("string").cast("decimal(38,10)").alias("v2"), F.lpad((F.hour("ts") * 10000 + F.minute("ts") * 100 + F.second("ts")).cast("string"), 6, "0").alias("t2"))
    out = again.agg(*[F.count_if(~F.col(c).eqNullSafe(F.col(c + "2"))).alias(n) for c, n in (("d", "date"), ("v", "amount"), ("t", "time"))])
    docs = table(spark, sf_dir, "documents").agg(F.count_if(~F.col("n_chars").eqNullSafe(F.length("text"))).alias("chars"), F.sum(F.length("text")).alias("all_chars"))
    return out.crossJoin(docs)  # one row each


def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    days = table(spark, sf_dir, "orders").select(day.alias("day")).distinct()
    d = F.col("day")
    return days.select("day", F.year(d).alias("year"), F.month(d).alias("month"), (F.weekday(d) + 1).alias("isodow"), (F.weekday(d) >= 5).alias("weekend"), F.date_format(d, "yyyyMM").alias("month_id"), iso_week(d).alias("week"))


def status_vocabularies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("o_orderstatus", "o_orderpriority")])).alias("x")).select("x.*").distinct()


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain figures of the facts in one pass."""
    tx = tx_time(spark, sf_dir)
    return tx.agg(
        F.count("*").alias("rows"),
        F.countDistinct("day").alias("days"),
        F.count_if(F.col("day").isNull()).alias("null_day"),
        F.countDistinct("pc").alias("codes"),
        F.countDistinct("pc_raw").alias("raw_codes"),
        F.count_if(F.col("pc").isNull()).alias("null_pc"),
        F.count_if(F.col("amount") <= 0).alias("non_positive"),
        F.count_if(F.length("tm") != 6).alias("bad_time"),
        F.countDistinct("card").alias("cards"),
        F.countDistinct("merchant").alias("merchants"),
        F.countDistinct("issuer").alias("issuers"),
        F.min("amount").cast("double").alias("min_amount"),
        F.max("amount").cast("double").alias("max_amount"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
    )


def postcode_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx_time(spark, sf_dir).groupBy("pc_raw", "pc").agg(F.count("*").alias("n"))


def postcode_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, n = F.col("pc_raw"), F.length("pc_raw")
    empty = raw.isNull() | (raw == "")
    return tx_time(spark, sf_dir).agg(F.count_if(empty).alias("empty"), F.count_if(n == 6).alias("six"), F.count_if(n == 5).alias("five"), F.count_if(~empty & ~n.isin(5, 6)).alias("unhandled"))


def shape_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, n = F.col("pc_raw"), F.length("pc_raw")
    return tx_time(spark, sf_dir).agg(F.count_if((n == 6) & ~raw.rlike(r"^\d{2}-\d{3}$")).alias("six"), F.count_if((n == 5) & ~raw.rlike(r"^\d{5}$")).alias("five"))


def reference_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw postcodes that map to more than one normalised code, and the other way round."""
    pairs = tx_time(spark, sf_dir).select("pc_raw", "pc").distinct()
    broken = lambda a, b: pairs.filter(F.col(a).isNotNull()).groupBy(a).agg(F.countDistinct(b).alias("n")).filter("n > 1").agg(F.count("*").alias("n"))
    return broken("pc_raw", "pc").select(F.lit("raw_to_pc").alias("direction"), "n").unionAll(broken("pc", "pc_raw").select(F.lit("pc_to_raw").alias("direction"), "n"))


def city_label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.agg(F.count_if(F.upper(F.trim("n_name")).startswith("N")).alias("matched"), F.count("*").alias("all"))


def leaked_postcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = tx_time(spark, sf_dir)
    return tx.filter(~F.col("pc").like("81-%")).groupBy("pc").agg(F.count("*").alias("n"))


def zero_timecode_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unknown time: its rows and their share, how many of them a status flags (errors stand for a status that isn't valid), and the real rows of the hours around it."""
    tx, sentinel = tx_time(spark, sf_dir), F.col("tm") == SENTINEL
    out = tx.agg(F.count_if(sentinel).alias("sentinel"), F.count_if(sentinel & (F.col("merchant") == "error")).alias("flagged"), F.count("*").alias("rows"), F.count_if(~sentinel & F.col("tm").startswith("00")).alias("hour0"), F.count_if(F.col("tm").startswith("01")).alias("hour1"))
    return out.withColumns({"share": format_share(F.col("sentinel"), F.col("rows")), "sentinel_share": F.round(F.try_divide("sentinel", "rows"), 6)})


def excluded(pc="pc", tm="tm"):
    """Rows that no area may have: no postcode, a foreign one, or an unknown time."""
    return F.col(pc).isNull() | F.col(pc).isin(*FOREIGN) | (F.col(tm) == SENTINEL)


def excluded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = F.col("pc").isNull(), F.col("pc").isin(*FOREIGN), F.col("tm") == SENTINEL
    return tx_time(spark, sf_dir).agg(F.count_if(a).alias("no_pc"), F.count_if(F.coalesce(b, F.lit(False))).alias("foreign"), F.count_if(c).alias("sentinel"), F.count_if(c & (a | b)).alias("overlap"), F.count_if(excluded()).alias("bucket"))


def fd_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that should be one for each key: those keys that have several."""
    tx = tx_time(spark, sf_dir)
    return tx.groupBy("card").agg(F.countDistinct("issuer").alias("k")).agg(F.count_if(F.col("k") > 1).alias("broken"), F.count("*").alias("keys"))


def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = tx_time(spark, sf_dir).filter(F.col("tm") != SENTINEL)
    at = local_time(F.col("day"), F.col("tm"))
    return tx.select("event_id", at.cast("date").alias("local_day"), F.hour(at).alias("local_hour"))


def daypart_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local_times(spark, sf_dir).groupBy(daypart(F.col("local_hour")).alias("daypart")).agg(F.count("*").alias("n"))


def dst_transition_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the years that orders span, the local days that haven't 24 hours, because clocks change: how many they have, and how often it is two o'clock."""
    ends = table(spark, sf_dir, "orders").agg(F.date_trunc("year", F.min("o_orderdate")).cast("timestamp_ntz").alias("a"), F.date_trunc("year", F.max("o_orderdate")).cast("timestamp_ntz").alias("b"))  # one row
    hours = ends.select(F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("t"))
    at = F.convert_timezone(F.lit("UTC"), F.lit(ZONE), F.col("t"))
    days = hours.groupBy(at.cast("date").alias("day")).agg(F.count("*").alias("hours"), F.count_if(F.hour(at) == 2).alias("at_two"))
    return days.filter("hours between 23 and 25 and hours != 24")


def entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", entity_key("salt", F.col("s_suppkey")).alias("entity"))


def calendar_mismatch(rows: DataFrame, day: str, stored: dict[str, str]) -> DataFrame:
    """How many rows' stored calendar columns differ from what their day gives; stored names the columns for year, month, isodow, weekend, month_id and week. Null equals null."""
    d = F.col(day)
    again = {"year": F.year(d), "month": F.month(d), "isodow": F.weekday(d) + 1, "weekend": F.weekday(d) >= 5, "month_id": F.date_format(d, "yyyyMM"), "week": iso_week(d)}
    return rows.agg(*[F.count_if(~F.col(c).eqNullSafe(again[k])).alias(k) for k, c in stored.items()])


def require(checks: DataFrame, expected: dict | None = None) -> DataFrame:
    """The one row of checks, if each column has the value expected of it, 0 unless said otherwise; else an error that names the columns."""
    row = checks.first().asDict()
    wrong = {k: v for k, v in row.items() if v != (expected or {}).get(k, 0)}
    if wrong:
        raise ValueError(f"checks failed: {wrong}")
    return checks


def require_rows(found: DataFrame, key: str, count: str, expected: dict) -> DataFrame:
    """found, if its keys and counts are those expected, no more and no fewer; they are few, as codes that leaked are."""
    rows = {r[0]: r[1] for r in found.select(key, count).limit(len(expected) + 1).collect()}
    if rows != expected:
        raise ValueError(f"unexpected rows: {sorted(set(rows.items()) ^ set(expected.items()), key=str)}")
    return found


#: Counts that must be 0 in a table that is valid, and in one whose postcodes are normalised.
VALID, NORMALISED = ("null_day", "non_positive", "bad_time"), ("unhandled", "bad_six", "bad_five", "raw_to_several", "several_to_code")


def validation(tx: DataFrame, pins: dict[str, int] | None = None) -> DataFrame:
    """(check, found, expected, ok): each of VALID and NORMALISED, of which none is expected, and rows, days, merchants, cards and raw_codes, expected as pinned (null: not pinned, and ok).

    One pass over the transactions, besides their distinct pairs of raw and normalised postcodes: a raw code has one normal form, and a normal form one raw code with a hyphen and one without, at most.
    """
    raw, n = F.col("pc_raw"), F.length("pc_raw")
    shape = lambda k, x: F.count_if((n == k) & ~raw.rlike(x))
    one = tx.agg(
        F.count("*").alias("rows"), *[F.countDistinct(c).alias(k) for c, k in (("day", "days"), ("merchant", "merchants"), ("card", "cards"), ("pc_raw", "raw_codes"))],
        F.count_if(F.col("day").isNull()).alias("null_day"), F.count_if(F.col("amount") <= 0).alias("non_positive"), F.count_if(F.coalesce(F.length("tm") != 6, F.lit(True))).alias("bad_time"),
        F.count_if((raw != "") & ~n.isin(5, 6)).alias("unhandled"), shape(6, r"^\d{2}-\d{3}$").alias("bad_six"), shape(5, r"^\d{5}$").alias("bad_five"),
    )
    pairs = tx.filter("pc_raw is not null and pc is not null").select("pc_raw", "pc").distinct()
    several = lambda key, of, name: pairs.groupBy(key).agg(of.alias("n")).agg(F.count_if(F.col("n") > 1).alias(name))
    hyphens = F.greatest(F.count_if(F.col("pc_raw").contains("-")), F.count_if(~F.col("pc_raw").contains("-")))
    row = one.crossJoin(several("pc_raw", F.count("*"), "raw_to_several")).crossJoin(several("pc", hyphens, "several_to_code"))  # one row each
    expected = dict.fromkeys((*VALID, *NORMALISED), 0) | (pins or {})
    checks = F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("found"), F.lit(expected.get(c)).cast("long").alias("expected")) for c in row.columns])
    return row.select(F.explode(checks).alias("c")).select("c.*", (F.col("c.expected").isNull() | (F.col("c.found") == F.col("c.expected"))).alias("ok"))


def require_valid(tx: DataFrame, pins: dict[str, int] | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """The report of `validation`, if all of its checks (or `only` these) hold; else an error that tells each that doesn't."""
    report = validation(tx, pins)
    wrong = [r for r in report.filter("not ok").collect() if only is None or r.check in only]  # a dozen rows
    if wrong:
        raise ValueError("; ".join(f"{r.check}: {r.found}, {r.expected} expected" for r in sorted(wrong)))
    return report


def require_normalised(tx: DataFrame) -> DataFrame:
    """`require_valid` of postcodes alone."""
    return require_valid(tx, only=NORMALISED)


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation(tx_time(spark, sf_dir), {"merchants": 4})


def area_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct cards by area as a report shows them: blank and unknown areas under one label."""
    label = F.coalesce(F.nullif(F.upper(F.trim("pc")), F.lit("")), F.lit("(none)"))
    return tx_time(spark, sf_dir).groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.countDistinct("card").alias("cards"))


QUERIES = {
    "validation_report": validation_report, "area_report": area_report, "scan_union_all": scan_union_all, "overlap_intersect": overlap_intersect, "span": span, "check_schema": check_schema, "schema_drift": schema_drift, "rederive_mismatch": rederive_mismatch,
    "calendar_features": calendar_features, "status_vocabularies": status_vocabularies, "domains": domains, "postcode_normalise": postcode_normalise,
    "postcode_partition": postcode_partition, "shape_violations": shape_violations, "reference_membership": reference_membership, "city_label_filter": city_label_filter,
    "leaked_postcodes": leaked_postcodes, "zero_timecode_stats": zero_timecode_stats, "excluded_counts": excluded_counts, "fd_check": fd_check, "local_time": local_times,
    "daypart_counts": daypart_counts, "dst_transition_hours": dst_transition_hours, "entity_keys": entity_keys,
}

_TX = f"WITH {TX_TIME_SQL}"
_FOREIGN = "pc LIKE '00-00_'"
_LOCAL = "timezone('Europe/Warsaw', (day + CAST(substr(tm,1,2) || ':' || substr(tm,3,2) || ':' || substr(tm,5,2) AS TIME)) AT TIME ZONE 'UTC')"

ORACLES = {
    "validation_report": rf"""{_TX}, d AS (SELECT DISTINCT pc_raw, pc FROM tx_time WHERE pc_raw IS NOT NULL AND pc IS NOT NULL), c AS (
        SELECT 'rows' AS "check", count(*) AS found, NULL AS expected FROM tx_time UNION ALL SELECT 'days', count(DISTINCT day), NULL FROM tx_time UNION ALL SELECT 'merchants', count(DISTINCT merchant), 4 FROM tx_time UNION ALL SELECT 'cards', count(DISTINCT card), NULL FROM tx_time
        UNION ALL SELECT 'raw_codes', count(DISTINCT pc_raw), NULL FROM tx_time UNION ALL SELECT 'null_day', count(*) FILTER (WHERE day IS NULL), 0 FROM tx_time UNION ALL SELECT 'non_positive', count(*) FILTER (WHERE amount <= 0), 0 FROM tx_time
        UNION ALL SELECT 'bad_time', count(*) FILTER (WHERE coalesce(length(tm) <> 6, true)), 0 FROM tx_time UNION ALL SELECT 'unhandled', count(*) FILTER (WHERE pc_raw <> '' AND length(pc_raw) NOT IN (5, 6)), 0 FROM tx_time
        UNION ALL SELECT 'bad_six', count(*) FILTER (WHERE length(pc_raw) = 6 AND NOT regexp_matches(pc_raw, '^\d{{2}}-\d{{3}}$')), 0 FROM tx_time UNION ALL SELECT 'bad_five', count(*) FILTER (WHERE length(pc_raw) = 5 AND NOT regexp_matches(pc_raw, '^\d{{5}}$')), 0 FROM tx_time
        UNION ALL SELECT 'raw_to_several', count(*) FILTER (WHERE n > 1), 0 FROM (SELECT count(*) AS n FROM d GROUP BY pc_raw) UNION ALL SELECT 'several_to_code', count(*) FILTER (WHERE n > 1), 0 FROM (SELECT greatest(count(*) FILTER (WHERE pc_raw LIKE '%-%'), count(*) FILTER (WHERE pc_raw NOT LIKE '%-%')) AS n FROM d GROUP BY pc))
      SELECT "check", found, CAST(expected AS BIGINT) AS expected, expected IS NULL OR found = expected AS ok FROM c""",
    "area_report": f"{_TX} SELECT coalesce(nullif(upper(trim(pc)), ''), '(none)') AS label, count(*) AS n, count(DISTINCT card) AS cards FROM tx_time GROUP BY 1",
    "scan_union_all": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 2 = 0 UNION ALL SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 2 = 1",
    "overlap_intersect": """WITH a AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01'), b AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01')
      SELECT 'line' AS key, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM a INTERSECT SELECT l_orderkey, l_linenumber FROM b)
      UNION ALL SELECT 'order', count(*) FROM (SELECT l_orderkey FROM a INTERSECT SELECT l_orderkey FROM b)""",
    "span": "SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS ids, min(o_orderkey) AS min_id, max(o_orderkey) AS max_id, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders",
    "check_schema": f"WITH e AS (SELECT row_number() OVER () - 1 AS i, n FROM (SELECT unnest([{', '.join(repr(c) for c in EXPECTED)}]) AS n)), f AS (SELECT row_number() OVER (ORDER BY column_index) - 1 AS i, column_name AS n FROM duckdb_columns() WHERE table_name = 'events') SELECT count(*) FILTER (WHERE e.n IS DISTINCT FROM f.n) AS drifted FROM e FULL JOIN f USING (i)",
    "schema_drift": "WITH c AS (SELECT table_name AS t, row_number() OVER (PARTITION BY table_name ORDER BY column_index) - 1 AS i, substr(column_name, 3) AS n FROM duckdb_columns() WHERE table_name IN ('customer', 'supplier')) SELECT CAST(i AS INTEGER) AS position, a.n AS expected, b.n AS found FROM (SELECT i, n FROM c WHERE t = 'customer') a FULL JOIN (SELECT i, n FROM c WHERE t = 'supplier') b USING (i) WHERE a.n IS DISTINCT FROM b.n",
    "rederive_mismatch": "SELECT count(*) FILTER (WHERE CAST(ts AS DATE) IS DISTINCT FROM CAST(strptime(strftime(ts, '%Y%m%d'), '%Y%m%d') AS DATE)) AS date, count(*) FILTER (WHERE CAST(value AS DECIMAL(38,10)) IS DISTINCT FROM CAST(CAST(CAST(value AS DECIMAL(38,10)) AS VARCHAR) AS DECIMAL(38,10))) AS amount, count(*) FILTER (WHERE strftime(ts, '%H%M%S') IS DISTINCT FROM lpad(CAST(hour(ts) * 10000 + minute(ts) * 100 + second(ts) AS VARCHAR), 6, '0')) AS time, (SELECT count(*) FILTER (WHERE n_chars IS DISTINCT FROM length(text)) FROM documents) AS chars, (SELECT CAST(sum(length(text)) AS BIGINT) FROM documents) AS all_chars FROM events",
    "calendar_features": "SELECT day, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, CAST(isodow(day) AS INTEGER) AS isodow, isodow(day) >= 6 AS weekend, strftime(day, '%Y%m') AS month_id, strftime(day, '%GW%V') AS week FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)",
    "status_vocabularies": "SELECT DISTINCT 'o_orderstatus' AS field, o_orderstatus AS value FROM orders UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders",
    "domains": f"{_TX} SELECT count(*) AS rows, count(DISTINCT day) AS days, count(*) FILTER (WHERE day IS NULL) AS null_day, count(DISTINCT pc) AS codes, count(DISTINCT pc_raw) AS raw_codes, count(*) FILTER (WHERE pc IS NULL) AS null_pc, count(*) FILTER (WHERE amount <= 0) AS non_positive, count(*) FILTER (WHERE length(tm) <> 6) AS bad_time, count(DISTINCT card) AS cards, count(DISTINCT merchant) AS merchants, count(DISTINCT issuer) AS issuers, CAST(min(amount) AS DOUBLE) AS min_amount, CAST(max(amount) AS DOUBLE) AS max_amount, min(day) AS first_day, max(day) AS last_day FROM tx_time",
    "postcode_normalise": f"{_TX} SELECT pc_raw, pc, count(*) AS n FROM tx_time GROUP BY pc_raw, pc",
    "postcode_partition": f"{_TX} SELECT count(*) FILTER (WHERE pc_raw IS NULL OR pc_raw = '') AS empty, count(*) FILTER (WHERE length(pc_raw) = 6) AS six, count(*) FILTER (WHERE length(pc_raw) = 5) AS five, count(*) FILTER (WHERE pc_raw <> '' AND length(pc_raw) NOT IN (5, 6)) AS unhandled FROM tx_time",
    "shape_violations": f"{_TX} SELECT count(*) FILTER (WHERE length(pc_raw) = 6 AND NOT regexp_matches(pc_raw, '^[0-9]{{2}}-[0-9]{{3}}$')) AS six, count(*) FILTER (WHERE length(pc_raw) = 5 AND NOT regexp_matches(pc_raw, '^[0-9]{{5}}$')) AS five FROM tx_time",
    "reference_membership": f"{_TX} SELECT 'raw_to_pc' AS direction, count(*) AS n FROM (SELECT pc_raw FROM tx_time WHERE pc_raw IS NOT NULL GROUP BY pc_raw HAVING count(DISTINCT pc) > 1) UNION ALL SELECT 'pc_to_raw', count(*) FROM (SELECT pc FROM tx_time WHERE pc IS NOT NULL GROUP BY pc HAVING count(DISTINCT pc_raw) > 1)",
    "city_label_filter": "SELECT count(*) FILTER (WHERE starts_with(upper(trim(n_name)), 'N')) AS matched, count(*) AS \"all\" FROM nation",
    "leaked_postcodes": f"{_TX} SELECT pc, count(*) AS n FROM tx_time WHERE pc NOT LIKE '81-%' GROUP BY pc",
    "zero_timecode_stats": f"{_TX}, s AS (SELECT count(*) FILTER (WHERE tm = '000000') AS sentinel, count(*) FILTER (WHERE tm = '000000' AND merchant = 'error') AS flagged, count(*) AS rows, count(*) FILTER (WHERE tm <> '000000' AND tm LIKE '00%') AS hour0, count(*) FILTER (WHERE tm LIKE '01%') AS hour1 FROM tx_time) SELECT *, printf('%d.%02d%%', (sentinel * 20000 + rows) // (2 * rows) // 100, (sentinel * 20000 + rows) // (2 * rows) % 100) AS share, round(sentinel / CAST(rows AS DOUBLE), 6) AS sentinel_share FROM s",
    "excluded_counts": f"{_TX} SELECT count(*) FILTER (WHERE pc IS NULL) AS no_pc, count(*) FILTER (WHERE {_FOREIGN}) AS \"foreign\", count(*) FILTER (WHERE tm = '000000') AS sentinel, count(*) FILTER (WHERE tm = '000000' AND (pc IS NULL OR {_FOREIGN})) AS overlap, count(*) FILTER (WHERE pc IS NULL OR {_FOREIGN} OR tm = '000000') AS bucket FROM tx_time",
    "fd_check": f"{_TX} SELECT count(*) FILTER (WHERE k > 1) AS broken, count(*) AS keys FROM (SELECT card, count(DISTINCT issuer) AS k FROM tx_time GROUP BY card)",
    "local_time": f"{_TX} SELECT event_id, CAST({_LOCAL} AS DATE) AS local_day, CAST(hour({_LOCAL}) AS INTEGER) AS local_hour FROM tx_time WHERE tm <> '000000'",
    "daypart_counts": f"{_TX}, h AS (SELECT hour({_LOCAL}) AS h FROM tx_time WHERE tm <> '000000') SELECT CASE WHEN h <= 5 THEN 'night' WHEN h <= 11 THEN 'morning' WHEN h <= 17 THEN 'afternoon' ELSE 'evening' END AS daypart, count(*) AS n FROM h GROUP BY 1",
    "dst_transition_hours": "WITH e AS (SELECT date_trunc('year', min(o_orderdate))::TIMESTAMP AS a, date_trunc('year', max(o_orderdate))::TIMESTAMP AS b FROM orders), t AS (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS t FROM e), l AS (SELECT timezone('Europe/Warsaw', t AT TIME ZONE 'UTC') AS l FROM t) SELECT CAST(l AS DATE) AS day, count(*) AS hours, count(*) FILTER (WHERE hour(l) = 2) AS at_two FROM l GROUP BY 1 HAVING count(*) BETWEEN 23 AND 25 AND count(*) <> 24",
    "entity_keys": "SELECT s_suppkey, substr(sha256('salt' || CAST(s_suppkey AS VARCHAR)), 1, 20) AS entity FROM supplier",
}
