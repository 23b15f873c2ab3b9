import re

import corpus_pipeline
from kohort.llm import queries


def test_stages_on_the_smallest_tables(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == columns
        if i < 3:
            assert 0 < docs.count() <= before
            before = docs.count()
        if i == 1:
            texts = [re.sub("[A-Z]", lambda m: m[0].lower(), r.text) for r in docs.select("text").collect()]
            assert len(texts) == len(set(texts))
    assert docs.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


def test_registered():
    import __spark_entry__ as entry

    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())
    assert sum(bool(re.match(r"op\d+_", q)) for q in entry.queries()) == 10


def test_clean_documents_pass_the_mix_once(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    poor = labels.where("quality = 0").select("doc_id")
    docs = corpus_pipeline.drop_copies(spark, docs.join(poor, "doc_id", "left_anti").select(docs.columns), sf)
    toxic = labels.where("quality = 1").groupBy("doc_id").agg({"toxic": "max"}).withColumnRenamed("max(toxic)", "toxic")
    out = corpus_pipeline.mix_sources(spark, docs, sf).groupBy("doc_id").count()
    found = docs.select("doc_id").join(toxic, "doc_id", "left").join(out, "doc_id", "left").fillna(0, ["count"]).toPandas()
    assert found["count"].max() == 1
    assert (found["count"][found["toxic"] == 0] == 1).all()
    assert (found["count"][found["toxic"] == 1]).mean() < 0.5
