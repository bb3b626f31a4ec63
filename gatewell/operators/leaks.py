"""A scan of published text for what must not leave: card-shaped tokens, also across line breaks and within base64 runs, and merchants' names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewell.session import table

#: A card is 40 to 64 characters; 64 of hex are a digest of ours.
CARD_SHAPED, DIGEST, HEX, RUN = r"[A-Za-z0-9_\-]{40,64}", 64, "^[0-9a-f]+$", r"[A-Za-z0-9+/]{200,}"
#: A merchant's name where data stand: after its column's name and a separator.
MERCHANT = r"{column}\s*[,=:]\s*[A-Z]{{3,}}"


def suspects(text: Column) -> Column:
    """The distinct card-shaped tokens of a text, in order, also of tokens that a line break splits: plain hex but for digests, or capitals, small letters and digits together."""
    find = lambda t: F.regexp_extract_all(t, F.lit(CARD_SHAPED), F.lit(0))
    rejoined = F.regexp_replace(text, r"(?<=[A-Za-z0-9_\-])\n(?=[A-Za-z0-9_\-])", "")
    mixed = lambda t: t.rlike("[A-Z]") & t.rlike("[a-z]") & t.rlike("[0-9]")
    return F.filter(F.array_sort(F.array_union(find(rejoined), find(text))), lambda t: F.when(t.rlike(HEX), F.length(t) != DIGEST).otherwise(mixed(t)))


def merchants_named(text: Column, column: str = "merchant_name") -> Column:
    """How often a text holds a merchant's name in a data position."""
    return F.size(F.regexp_extract_all(text, F.lit(MERCHANT.format(column=column)), F.lit(0)))


def decoded(text: Column) -> Column:
    """What base64 runs of 200 and more hold, as text; runs that aren't base64 hold nothing."""
    whole = lambda r: F.substring(r, F.lit(1), (F.floor(F.length(r) / 4) * 4).cast("int"))
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda r: F.coalesce(F.decode(F.call_function("try_to_binary", whole(r), F.lit("base64")), "ISO-8859-1"), F.lit(""))), " ")


def scan(docs: DataFrame, merchant_column: str = "merchant_name") -> DataFrame:
    """doc_id, tokens, first, hidden (tokens within base64) and merchants of each text that holds any."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", suspects(text).alias("s"), F.size(suspects(decoded(text))).alias("hidden"), merchants_named(text, merchant_column).alias("merchants"))
    return found.select("doc_id", F.size("s").alias("tokens"), F.get("s", F.lit(0)).alias("first"), "hidden", "merchants").filter("tokens > 0 or hidden > 0 or merchants > 0")


def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In these tables `token` stands for the merchants' column."""
    return scan(table(spark, sf_dir, "documents"), "token")


def license_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published claims by whole line: how many documents carry each licence line."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(F.lower("line").contains("licen")).select("doc_id", F.regexp_replace("line", " ", " ").alias("line")).distinct().groupBy("line").agg(F.count("*").alias("documents"))


QUERIES = {"leak_scan": leak_scan, "license_lines": license_lines}
ORACLES = {
    "leak_scan": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(regexp_replace(coalesce(text, ''), '([A-Za-z0-9_-])\n([A-Za-z0-9_-])', '\1\2', 'g'), '([A-Za-z0-9_-])\n([A-Za-z0-9_-])', '\1\2', 'g') AS joined FROM documents),
      f AS (SELECT doc_id, list_sort(list_distinct(list_concat(regexp_extract_all(joined, '[A-Za-z0-9_-]{40,64}'), regexp_extract_all(text, '[A-Za-z0-9_-]{40,64}')))) AS s, len(regexp_extract_all(text, 'token\s*[,=:]\s*[A-Z]{3,}')) AS merchants FROM t),
      g AS (SELECT doc_id, list_filter(s, lambda x: CASE WHEN regexp_matches(x, '^[0-9a-f]+$') THEN len(x) <> 64 ELSE regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]') END) AS s, merchants FROM f)
      SELECT doc_id, CAST(len(s) AS INTEGER) AS tokens, s[1] AS first, CAST(0 AS INTEGER) AS hidden, CAST(merchants AS INTEGER) AS merchants FROM g WHERE len(s) > 0 OR merchants > 0""",
    "license_lines": "SELECT line, count(*) AS documents FROM (SELECT DISTINCT doc_id, replace(line, chr(160), ' ') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(lower(line), 'licen')) GROUP BY line",
}
