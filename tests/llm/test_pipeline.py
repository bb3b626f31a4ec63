"""The stages of the pipeline against what each should keep, on rows of their own."""

import pyarrow.dataset as ds

import corpus_pipeline
from tests.llm.test_ops import linked

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.select("doc_id", "text").collect()
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "test")
        after = docs.collect()
        kept.append((name, len(before), len(after)))
        if i < 4:
            assert docs.columns == columns
        if i == 1:
            groups = linked([(r.doc_id, r.text) for r in before])
            assert {r.doc_id for r in after} == {c for d, n, c in groups}
        if i == 2:
            items = ds.dataset(f"{SF}/benchmark.parquet").to_table()["text"].to_pylist()
            assert not [r for r in after if any(x in r.text for x in items)]
            clean = {r.doc_id for r in before if not any(x[:40].lower() in " ".join(r.text.lower().split()) for x in items)}
            assert clean <= {r.doc_id for r in after}
        if i in (3, 4):
            assert len(after) == len(before)
    poor = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
    assert not poor & {r.doc_id for r in after}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, after))


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda k, tag="w": " ".join([*(w.replace("w", tag) for w in base), f"end{k}"])
    rows = [(None, near(0)), (None, near(1)), (None, near(1)), (None, "a text of its own stands here")]  # a group of null ids alone
    rows += [(5, near(0, "x")), (5, near(1, "x")), (3, near(2, "x")), (None, near(3, "x"))]  # 3 is least
    rows += [(5, "quite another text that shares the id"), (7, near(0, "y")), (7, near(1, "y")), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    after = corpus_pipeline.keep_one_copy(spark, docs, SF)
    assert after.columns == docs.columns
    kept = [(r.doc_id, (r.text or "")[:2]) for r in after.collect()]
    assert sorted(kept, key=repr) == sorted([(None, "w0"), (None, "a "), (3, "x0"), (5, "qu"), (7, "y0"), (8, ""), (9, "")], key=repr)
