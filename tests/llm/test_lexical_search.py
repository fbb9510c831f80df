import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ionsieve.llm import lexical_search, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(docs, items, top=lexical_search.TOP):
    """[(item_id, rank, doc_id, score)] by scoring every document for every item."""
    counts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    holders = Counter(t for _, c in counts for t in c)
    for item, text in items:
        terms = {t for t in TERM.findall((text or "").translate(LOWER)) if holders[t]}
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders[t] + 1))) for t in terms}
        scores = []
        for (doc, c), n in zip(counts, sizes):
            m = 100 - 50 + (50 * n * n_docs) // max(n_terms, 1)
            score = sum(w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in weights.items() if c[t])
            if score > 0:
                scores.append((-score, doc is not None, doc))
        for rank, (score, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1):
            yield item, rank, doc, -score


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in {"BLOCK_DOCS": 37, "STRIP": 4, "SLICE": 1500, "FIRST_BLOCKS": 2}.items():
        monkeypatch.setattr(lexical_search, name, value)


def test_every_item_by_brute_force_over_many_blocks(spark, sf_dir, small_blocks):
    docs, items = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    expected = plain([(x.doc_id, x.text) for x in docs.collect()], [(x.item_id, x.text) for x in items.collect()])
    assert rows(lexical_search.search(docs, items)) == sorted(expected)


def test_same_rows_as_sql(spark, sf_dir):
    found = queries.QUERIES["op12_pair_bound_search"](spark, sf_dir)
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet*')")
    expected = duck.execute(queries.ORACLES["op12_pair_bound_search"])
    assert [x[0] for x in expected.description] == found.columns
    assert rows(found) == sorted(expected.fetchall())


def test_odd_rows_and_passes(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(lexical_search, "QUERIES_PER_PASS", 2)
    texts = [(1, "SOME words, some other"), (2, None), (3, "  ,."), (4, "word1x1 word2x2 é"), (4, "x"), (None, "text plain"), (7, "nowhere"), (8, "one")]
    items = spark.createDataFrame(texts, "item_id long, text string").withColumn("doc_id", F.lit("other")).withColumn("rank", F.lit("other"))
    found = lexical_search.search(odd_docs, items)
    expected = plain([(x.doc_id, x.text) for x in odd_docs.collect()], texts)
    assert Counter(map(tuple, found.collect())) == Counter(expected)
    assert lexical_search.search(no_docs, items).count() == 0
    assert lexical_search.search(odd_docs, items.where("false")).count() == 0


def test_terms_do_not_hang_on_slices():
    text = ("ab cdé " * 50 + "x" * 400 + " y").encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, 3, len(text)])
    whole = [x for part in lexical_search.terms_of(data, offsets) for x in zip(part.text.tolist(), part.hashes.tolist())]
    assert len({h for _, h in whole}) == 4 and len(whole) == 102
    for size in (1, 7, 100):
        assert b"".join(text[a:b] for a, b in lexical_search.cut_slices(data, size)) == text
        assert all(text[a - 1 : a + 1].strip(b" ") != text[a - 1 : a + 1] for a, _ in lexical_search.cut_slices(data, size) if a)


def test_pair_bounds_leave_out_what_single_ones_would_not():
    """Two strong terms that never meet: their joint bound stays below the two together."""
    lists = lexical_search._Lists(
        np.arange(256),
        {0: (np.arange(0, 100), np.full(100, 60)), 1: (np.arange(128, 228), np.full(100, 60))},
        {0: np.array([60, 0]), 1: np.array([60, 60])},
        {},
    )
    query = lexical_search.Query(0, np.array([0, 1]), np.array([0]))
    assert len(lexical_search.search_block(query, lists, 61)[0]) == 0
    _, bounds = lexical_search._units(query, lists, 0)
    assert np.sum(bounds, axis=0).tolist() == [60, 60]
    assert np.sum(lexical_search._units(query, lists, 1)[1], axis=0).tolist() == [120, 60]
    assert len(lexical_search.search_block(query, lists, 60)[0]) == 50
