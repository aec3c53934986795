"""The pipeline's stages and what each decides."""

import corpus_pipeline
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "quality_rules", "jaccard_join", "secret_scans", "best_fit_packing"]
    docs = spark.read.parquet(f"{DIR}/documents.parquet").cache()
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, DIR).cache()
        assert out.columns == docs.columns
        assert out.select("doc_id").distinct().count() == out.count() and out.join(left, "doc_id", "left_anti").count() == 0
        if name != "secret_scans":
            assert out.join(docs, docs.columns, "left_anti").count() == 0  # rows stay as they are
        left = out
    got = corpus_pipeline.run(spark, DIR).cache()
    assert set(r.doc_id for r in got.select("doc_id").distinct().collect()) == set(r.doc_id for r in left.collect())
    fill = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert fill.where("n > 2048 or n <> end").count() == 0


def test_one_document_of_each_group_stays(spark):
    docs = spark.createDataFrame([(3, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, "", "en", "s", 0), (None, "x", "en", "s", 1), (4, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    out = [r.doc_id for r in corpus_pipeline.jaccard_join(spark, docs, DIR).collect()]
    assert sorted(out, key=str) == [1, 2, 4, None]


def test_repeated_and_null_keys_are_decided_by_text(spark):
    a, b, c = ("one two three four five six", "six seven eight nine ten", "red green blue white black")
    rows = [(1, a), (1, b), (1, b), (None, a), (None, c), (None, c), (None, None), (None, None), (2, b), (3, ""), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = [(r.doc_id, r.text) for r in corpus_pipeline.jaccard_join(spark, docs, DIR).collect()]
    assert sorted(out, key=str) == sorted([(1, a), (1, b), (None, c), (None, None), (3, ""), (3, None)], key=str)


def test_entry_has_the_corpus_queries():
    import __spark_entry__ as e

    assert {f"op{n}_" for n in range(1, 14)} == {"_".join(q.split("_")[:1]) + "_" for q in e.queries() if q.startswith("op")} and "pipeline" in e.queries()
