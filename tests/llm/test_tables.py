import os
import time
from pathlib import Path

from pyspark.sql import functions as F

from ionsieve.llm import compact_windows, tables


def _shuffles(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {name for top in folders for _, _, names in os.walk(top) for name in names if name.startswith("shuffle_")}


def test_shuffle_files_go_with_the_write(spark):
    keys, before = spark.range(10_000).groupBy((F.col("id") % 100).alias("key")).count(), _shuffles(spark)
    joined = keys.join(spark.range(50).hint("merge"), F.col("key") == F.col("id"))
    setting = spark.conf.get(tables.SHUFFLES_GO)
    found = tables.written(joined, "joined")
    assert spark.conf.get(tables.SHUFFLES_GO) == setting
    ends = time.time() + 10  # executors delete them on their own
    while (left := _shuffles(spark) - before) and time.time() < ends:
        time.sleep(0.1)
    assert not left
    assert found.count() == joined.count() == 50
    assert tables.written(joined, "again").agg(F.sum("count")).first()[0] == 5000


def test_consumed_tables_of_repeated_passages_go(spark):
    words = [f"w{i}" for i in range(1000)]
    # The least document holds the first 48 of 60 words only, so that finer keys are made.
    texts = [words[:48] + words[100:200], words[200:300] + words[:60], words[300:400] + words[:60]]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    folder = Path(tables.shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("*"))
    rows = compact_windows.repeated_passages(docs)
    held = {x.name.rsplit("-", 1)[0] for x in set(folder.glob("*")) - before}
    assert held == {"passages"}
    assert {(x.doc_id, x.first_doc_id, x.end_word - x.start_word) for x in rows.collect()} == {(2, 1, 60)}
