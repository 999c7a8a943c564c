"""The pipeline over an empty table, null rows and columns whose names its stages use inside."""

import contextvars

from pyspark.sql import functions as F

import corpus_pipeline
from netloom.llm import shared

CLASHING = ("n_words", "kept", "h", "piece", "component_id", "row", "value", "__row", "score", "n_removed")


def through(spark, docs, folder, last=5):
    """docs after each stage, written and read again."""
    for k, (name, work) in enumerate(corpus_pipeline.STAGES[:last]):
        out = work(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns, name
        path = f"{folder}/stage-{k}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs


def labels(spark, folder):
    spark.createDataFrame([(1, 0, 1)] + [(k, 1, 0) for k in range(2, 40)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")


def test_empty_table(spark, tmp_path):
    labels(spark, tmp_path)
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert contextvars.copy_context().run(through, spark, docs, str(tmp_path)).count() == 0


def test_nulls_and_clashing_names(spark, tmp_path):
    labels(spark, tmp_path)
    words = [f"plain{k % 97} text{k % 89} of{k % 83} many{k % 79} words{k % 73}" for k in range(400)]
    rows = [(k, " ".join(words[6 * k : 6 * k + 6]) + f" ending number {k}", "en" if k % 2 else None) for k in range(60)] + [(None, None, None), (None, " ".join(words[370:380]), None), (7, None, "en"), (8, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for k, name in enumerate(CLASHING):
        docs = docs.withColumn(name, F.when(F.col("doc_id") % 3 == 0, F.lit(k)) if k % 2 else F.lit(f"own {k}"))
    kept = contextvars.copy_context().run(through, spark, docs, str(tmp_path), 4)
    assert kept.columns == docs.columns and kept.count() > 0
    assert all(r["kept"] == 1 if r.doc_id is not None and r.doc_id % 3 == 0 else r["kept"] is None for r in kept.collect())
    assert kept.where("n_words = 'own 0' AND h = 'own 2'").count() == kept.count()


def test_runs_remove_their_own_tables_only(spark):
    """What one context wrote is noted there; another context's notes do not hold it."""

    def one(name):
        notes = []
        token = shared.noted.set(notes)
        try:
            shared.written(spark.range(3), name)
        finally:
            shared.noted.reset(token)
        return notes

    a, b = contextvars.copy_context().run(one, "a"), contextvars.copy_context().run(one, "b")
    assert len(a) == len(b) == 1 and a != b
    shared.remove_written(spark, a)
    assert spark.read.parquet(b[0]).count() == 3
    shared.remove_written(spark, b)
    assert shared.noted.get() is None
