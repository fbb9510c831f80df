import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from ionsieve.llm import queries, rule_cascade

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    base = (len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(covered))
    letters = [x for x in text if x.isalpha()]
    n = len(words)
    base_failed = n < 10 or 100 * len(covered) > 20 * n
    rejected = (
        base_failed or base[1] < 2 * n or base[1] > 15 * n or 100 * base[2] > 30 * n or 100 * (base[3] - 2) > 30 * len(lines)
        or 100 * sum(x.isupper() for x in letters) > 40 * len(letters) or 100 * sum(any(c.isalpha() for c in w) for w in words) < 50 * n
    )
    return (*base, base_failed, not rejected)


def test_every_document(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {x.doc_id: x.text for x in docs.collect()}
    found = rule_cascade.judged(docs).collect()
    assert sorted(x.doc_id for x in found) == sorted(texts)
    assert [tuple(x)[1:] for x in found] == [plain(texts[x.doc_id]) for x in found]


def test_same_rows_as_sql(spark, sf_dir):
    found = queries.QUERIES["op11_rule_cascade"](spark, sf_dir)
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet*')")
    rows = duck.execute(queries.ORACLES["op11_rule_cascade"])
    assert [x[0] for x in rows.description] == found.columns
    assert sorted(map(tuple, found.collect())) == sorted(rows.fetchall())


def test_order_is_by_rejections_per_second(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = rule_cascade.measure(docs, rows=100)
    assert {x.rule for x in found} == set(rule_cascade.RULES)
    gains = [x.gain for x in found]
    assert gains == sorted(gains, reverse=True) and all(0 <= x.rejected <= 1 for x in found)


def test_any_order_keeps_the_same_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = []
    for rules in (rule_cascade.RULES, rule_cascade.RULES[::-1]):
        found = rule_cascade.cascade(docs, rules, sample_rows=50)
        kept.append(sorted(x.doc_id for x in found.where("rejected_by is null").collect()))
    assert kept[0] == kept[1] and 0 < len(kept[0]) < docs.count()


def test_later_rules_are_not_computed_for_rejected_rows(spark):
    """A rule that would fail on a row is never reached by a row that an earlier one rejects."""
    fails = rule_cascade.Rule("fails", ("n_words",), lambda n: F.when(n > 1, F.raise_error(F.lit("reached"))).otherwise(False))
    all_go = rule_cascade.Rule("all_go", ("n_words",), lambda n: n > 0)
    rows = spark.createDataFrame([("a b",)] * 3, "text string")
    found = rows.select("text", F.when(rule_cascade._rejects(all_go, F.col("text"), {}), "all_go").when(rule_cascade._rejects(fails, F.col("text"), {}), "fails").alias("by"))
    assert {x.by for x in found.collect()} == {"all_go"}
    assert "ArrowEvalPython" not in rule_cascade.cascade(rows)._jdf.queryExecution().toString()


@pytest.mark.parametrize("text,repeated", [("a b c d e", 0), ("a b c d e f a b c d e", 10), ("x " * 9, 9), ("a b c d", 0), ("", 0), (None, 0)])
def test_repeated_words(spark, text, repeated):
    one = spark.createDataFrame([(text,)], "text string")
    assert rule_cascade.statistics(one, ["n_repeat_words"]).first().n_repeat_words == repeated


def test_odd_rows(spark, odd_docs, no_docs):
    named = odd_docs.withColumn("n_words", F.lit("other")).withColumn("rejected_by", F.lit("other"))
    found = rule_cascade.judged(named).collect()
    texts = [(x.doc_id, x.text) for x in named.collect()]
    key = lambda x: str(x)
    assert sorted((tuple(x) for x in found), key=key) == sorted(((i, *plain(t)) for i, t in texts), key=key)
    assert rule_cascade.judged(no_docs).count() == 0
    cascaded = rule_cascade.cascade(named)
    assert cascaded.columns == named.columns and cascaded.where("rejected_by = 'other'").count() == 0
