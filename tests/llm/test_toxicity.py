import zlib

import numpy as np

from groundwork.llm import toxicity

S = "doc_id long, text string, score double, toxic string, id int"


def test_features():
    def slow(text):
        t = " " + " ".join((text or "").lower().split()) + " "
        return {t[i : i + n] for n in toxicity.SIZES for i in range(len(t) - n + 1)}

    for t in ["", None, "a", "abc", "Ab\n\tcd É  漢字 x" * 3]:
        assert len(toxicity.features(t)) == len(slow(t))
    assert set(toxicity.features("AB cd")) == set(toxicity.features("ab\ncd"))


def test_fit_separates():
    ratio = np.array([2.0, -2.0, 0.5, 1.0])
    y = np.array([1, 0] * 20)
    ids = np.array([0, 2, 1, 2] * 20)
    m = toxicity._fit(ids, np.repeat(np.arange(40), 2), y, ratio)
    assert m.score(np.array([0, 2])) > 0.9 and m.score(np.array([1, 2])) < 0.1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = toxicity.query(spark, sf).collect()
    assert len(got) == 1000
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    test = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    toxic = [p for y, p in test if y]
    assert sum(y == p for y, p in test) >= 0.93 * len(test)
    assert sum(toxic) >= 0.6 * len(toxic)


def test_labels_of_held_out_rows_are_not_read(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out("doc_id"), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_edges(spark):
    rows = [(1, None, None, None, None), (2, "", 1.0, "", 1), (None, "x y", 0.0, "", 2), (2, "", 1.0, "", 1)]
    docs = spark.createDataFrame(rows, S)
    labels = spark.createDataFrame([(2, 1), (None, 0), (7, 5), (8, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 4 and len({r.score for r in got}) == 1
    assert toxicity.toxicity(spark.createDataFrame([], S), labels).count() == 0
    kept = toxicity.clean(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert kept.columns == docs.columns and kept.count() == 4
