from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_pass_on_what_they_keep(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns and 0 < out.count() <= before, name
            before = out.count()
        docs = out
    assert docs.select("doc_id").distinct().count() == before
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "packing"]


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_stages_take_odd_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts, repeated rows and clashing columns pass through every stage."""
    from collections import Counter

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = docs.filter("length(text) between 300 and 2000").orderBy("doc_id").first()
    low = docs.agg({"doc_id": "min"}).first()[0]
    odd = [(low - 1, None), (low - 2, ""), (low - 3, " \n"), (None, one.text), (one.doc_id, one.text), (one.doc_id, "a clean text of its own about rivers and hills " * 3), (None, None)]
    extra = spark.createDataFrame([(d, t, "en", "web", len(t or "")) for d, t in odd], docs.schema).union(docs)
    for c in ("score", "node", "root", "t1", "kept", "label", "bands"):
        extra = extra.withColumn(c, F.lit("x"))
    columns, before = extra.columns, extra
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns, name
            fewer = Counter((r.doc_id, r.text) for r in out.select("doc_id", "text").collect())
            assert not fewer - Counter((r.doc_id, r.text) for r in before.select("doc_id", "text").collect()), name
            if name == "near_dedup":
                assert fewer[(one.doc_id, one.text)] <= 1 and fewer[(None, one.text)] == 0
            before = out
    assert out.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
