import re

import corpus_pipeline
from ionsieve.llm import mixing, ngram_join
from ionsieve.llm.tables import written
from pyspark.sql import functions as F

from test_ngram_join import plain


def test_stages_in_turn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], sf_dir), "stage"))
    _, scored, apart, clean, mixed, files = kept
    assert all(x.columns == columns and x.dtypes == docs.dtypes for x in kept[:-1])
    ids = lambda frame: {x.doc_id for x in frame.select("doc_id").collect()}
    texts = {x.doc_id: x.text for x in scored.collect()}
    assert ids(apart) == {i for i, (_, least) in plain(list(texts.items())).items() if i == least}
    items = [x.text.lower().split() for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    joined = lambda words: " " + " ".join(words) + " "
    holds = lambda text: any(joined(item) in joined(text.lower().split()) for item in items)
    assert ids(apart) - ids(clean) == {i for i in ids(apart) if holds(texts[i])}
    words = lambda frame: frame.select(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert abs(words(mixed) - 1.5 * words(clean)) <= 20
    assert files.count() == mixed.count() and files.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_odd_rows_go_through(spark, odd_docs, no_docs, tmp_path):
    full = lambda docs: docs.withColumns({"lang": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    text = "Some plain words of a short text that nothing else repeats, one after another."
    spark.createDataFrame([(1, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, re.sub("plain", "odd", text))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (full(odd_docs), full(no_docs)):
        full_count = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, str(tmp_path)), "stage")
        assert (docs.count() > 0) == (full_count > 0)
