"""Publishing as a whole or not at all, and titles by day."""

import pytest
from pyspark.sql import functions as F

from gatewell.sources.publish import altered, publish, read_manifest, titles_by_day


def outputs(spark, n=40):
    a = spark.range(n).select((F.col("id") % 7).alias("k"), F.col("id"), F.concat(F.lit("é, \""), "id").alias("t"))
    return {"a": (a.repartition(5), ["k", "id"]), "b": (a.groupBy("k").count(), ["k"])}


def left(folder):
    return sorted(p.name for p in folder.iterdir())


def test_two_runs_agree_byte_for_byte(spark, tmp_path):
    made = [publish(spark, outputs(spark), str(tmp_path / x), {"rules": {"k": 3}}) for x in ("one", "two")]
    assert made[0] == made[1] and left(tmp_path) == ["one", "two"]
    for f in ("a.csv", "b.csv", "manifest.json"):
        assert (tmp_path / "one" / f).read_bytes() == (tmp_path / "two" / f).read_bytes()
    rows = {r.file: (r.rows, r.columns) for r in read_manifest(spark, str(tmp_path / "one")).collect()}
    assert rows == {"a.csv": (40, "k,id,t"), "b.csv": (7, "k,count")} and altered(spark, str(tmp_path / "one")) == []
    assert [c["type"] for c in made[0]["outputs"][0]["columns"]] == ["bigint", "bigint", "string"]
    more = tmp_path / "two" / "b.csv"
    (tmp_path / "two" / ".b.csv.crc").unlink(missing_ok=True)
    more.write_text(more.read_text() + "9,9\n")
    assert altered(spark, str(tmp_path / "two")) == ["b.csv"]


def test_a_run_that_fails_leaves_nothing(spark, tmp_path):
    bad = outputs(spark) | {"c": (spark.range(3).select(F.raise_error(F.lit("no")).alias("x")), ["x"])}
    with pytest.raises(Exception, match="no"):
        publish(spark, bad, str(tmp_path / "x"))
    with pytest.raises(ValueError, match="at most 39"):
        publish(spark, outputs(spark), str(tmp_path / "x"), most=39)
    assert left(tmp_path) == []
    publish(spark, outputs(spark), str(tmp_path / "x"))
    with pytest.raises(FileExistsError):
        publish(spark, outputs(spark), str(tmp_path / "x"))
    assert left(tmp_path) == ["x"]


def test_an_empty_output_has_its_header(spark, tmp_path):
    publish(spark, {"none": (spark.range(0), ["id"])}, str(tmp_path / "x"))
    assert [r.rows for r in read_manifest(spark, str(tmp_path / "x")).collect()] == [0]


def test_titles_of_days(spark):
    rows = [(1, 1, None), (1, 2, "[]"), (1, 3, ' ["b", "b", "a"]'), (1, 4, '["later"]'), (2, 1, '{"k": 1}'), (2, 2, '["cut'), (2, 3, "nonsense"), (3, 1, "[]"), (4, 1, None), (5, 1, '["é, \\"x\\""]')]
    df = spark.createDataFrame(rows, "d int, o int, p string")
    found = {r.day: (r.titles, r.n_titles, r.payloads, r.malformed) for r in titles_by_day(df, F.col("d"), F.col("p"), F.col("o")).collect()}
    assert found == {1: (["b", "b", "a"], 3, 3, 0), 2: (None, 0, 3, 3), 3: (None, 0, 1, 0), 4: (None, 0, 0, 0), 5: (['é, "x"'], 1, 1, 0)}
