import random

import pytest
from pyspark.sql import functions as F

from ionsieve.llm import quality


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(500):
        good = i % 3 > 0
        text = " ".join(rng.choices(words, k=60))
        rows.append((i, text if good else text.upper().replace(" ", "!! ")))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_documents_are_told_apart(corpus):
    docs, labels = corpus
    found = quality.quality_scores(docs, labels).join(labels, "doc_id").collect()
    held = [x for x in found if x.held_out]
    assert len(found) == 500 and 80 < len(held) < 170
    assert sum(x.predicted == x.quality for x in held) / len(held) > 0.98
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in found)


def test_labels_of_held_out_rows_change_nothing(corpus):
    docs, labels = corpus
    turned = labels.withColumn("quality", F.when(quality.is_held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    order = lambda frame: frame.orderBy("doc_id").collect()
    assert order(quality.quality_scores(docs, labels)) == order(quality.quality_scores(docs, turned))


def test_odd_rows(spark, corpus, odd_docs, no_docs):
    labels = corpus[1]
    found = quality.quality_scores(odd_docs.unionByName(corpus[0], allowMissingColumns=True), labels)
    assert found.count() == odd_docs.count() + 500
    odd = quality.quality_scores(odd_docs, labels.where("false")).collect()
    assert {x.score for x in odd} == {0.5} and not any(x.held_out for x in odd if x.doc_id is None)
    only_good = spark.createDataFrame([(1, 1), (5, 1), (6, None), (None, 0), (7, 9)], "doc_id long, quality int")
    scores = {x.score for x in quality.quality_scores(odd_docs, only_good).collect()}
    assert len(scores) == 1 and scores.pop() > 0.5
    assert quality.quality_scores(no_docs, labels).count() == 0
    kept = quality.accepted(odd_docs, labels.where("false"), accept=0.4)
    assert kept.schema == odd_docs.schema and kept.count() == odd_docs.count()
    assert quality.accepted(odd_docs, labels.where("false")).count() == 0
