"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's documents.

Stages, in order: the quality classifier drops poor documents, the n-gram join keeps one document of each group of near
copies, decontamination drops those that hold a benchmark item, PII is replaced by surrogates, and the sources are mixed
to their target weights. All but the last return the columns of documents; the last adds those of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewell.llm import decontamination, mixing, ngram_join, pii, quality
from gatewell.llm.common import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6, fitted on the labels of the corpus; documents scored under one half go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7; of each component the row with the least doc_id stays, nulls last, and of rows that share it the one with the least hash; equal rows are one."""
    odd = docs.select("doc_id").groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if odd.isEmpty():
        kept = ngram_join.link_documents(docs).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__key"))
        return docs.join(kept, docs["doc_id"] == kept["__key"], "left_semi")
    # ids don't tell rows apart: rows are linked by a key of id and text
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    keyed = docs.withColumn("__key", key)
    groups = ngram_join.link_documents(keyed.select(F.col("__key").alias("doc_id"), "text")).select(F.col("doc_id").alias("__key"), "component_id").distinct()
    ids = keyed.select("__key", "doc_id").distinct()
    least = ids.join(groups, "__key").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__key")).alias("row"))
    return keyed.join(least.select("row.__key"), "__key", "left_semi").drop("__key").dropDuplicates(["doc_id", "text"]).select(docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1; n_chars, if there, follows the new text."""
    out = pii.replace_pii(docs, "gatewell")[0].drop("__n")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: doc_id, source, size, source_size, target and taken, how many of a document's words the mix takes, for each document."""
    return mixing.mix(docs)[0].drop("row")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_copy),
    ("benchmark decontamination", drop_benchmark),
    ("PII surrogates", replace_pii),
    ("mixing to target weights", mix_sources),
]

#: Trained scores and similarity joins can't be put in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each stored in the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
