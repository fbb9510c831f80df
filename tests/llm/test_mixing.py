from math import comb

import pytest
from pyspark.sql import functions as F

from ionsieve.llm import mixing


def plain_targets(sizes):
    """Share by weight, stop at twice the size, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weights = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * weights[s] for s in open_}
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "w " * (i * 37 % 211), None if i % 9 == 0 else f"s{min(i % 7, 3)}é"[: 2 + i % 2]) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_taken_words(docs):
    sizes: dict = {}
    rows = docs.collect()
    for x in rows:
        sizes[x.source] = sizes.get(x.source, 0) + len(x.text.split())
    target, source = plain_targets(sizes), {x.doc_id: x.source for x in rows}
    found = mixing.taken_words(docs).collect()
    assert sorted(x.doc_id for x in found) == sorted(source)
    taken: dict = {}
    for x in found:
        s = source[x.doc_id]
        assert x.source_size == sizes[s] and x.target == pytest.approx(target[s]) and 0 <= x.taken <= 2 * x.size
        taken[s] = taken.get(s, 0) + x.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert sorted(found) == sorted(mixing.taken_words(docs).collect())


def test_pieces_are_disjoint_and_shards_even(docs):
    sizes, _, pieces = mixing.mix_pieces(docs, shard_words=2048)
    rows = pieces.collect()
    spans: dict = {}
    for x in rows:
        spans.setdefault((x.row_id, x.turn), []).append((x.first_word, x.last_word))
    assert all(a[1] <= b[0] for s in spans.values() for a, b in zip(sorted(s), sorted(s)[1:]))
    size = {x.row_id: x.size for x in sizes.collect()}
    assert all(0 <= a < b <= size[row] for (row, _), s in spans.items() for a, b in s)
    words: dict = {}
    for x in rows:
        words[x.shard] = words.get(x.shard, 0) + x.last_word - x.first_word
    assert len(words) == 64 and max(words.values()) - min(words.values()) <= 6 * mixing.BLOCK_WORDS
    places = sorted(x.place for x in rows if x.shard == 3)
    assert places == list(range(1, len(places) + 1))


def test_tree_keeps_counts_and_halves(spark):
    one = spark.sql("select array(1000L, 37L, 0L, 5L) as quotas")
    rows = mixing.split_quotas(one, 3).orderBy("shard").collect()
    assert [sum(q) for q in zip(*(r.quotas for r in rows))] == [1000, 37, 0, 5]
    assert [r.shard for r in rows] == list(range(8)) and {sum(r.quotas) for r in rows} <= {130, 131}
    assert all(q >= 0 for r in rows for q in r.quotas)


def test_draw_has_the_hypergeometric_distribution(spark):
    n = 20_000
    draw = mixing.hypergeometric("12", "30", "9", f"((id + 0.5) / {n})")
    counts = {r.x: r["count"] for r in spark.range(n).select(F.expr(draw).alias("x")).groupBy("x").count().collect()}
    for k in range(10):
        assert counts.get(k, 0) / n == pytest.approx(comb(12, k) * comb(30, 9 - k) / comb(42, 9), abs=2e-4)
    ends = spark.sql("select 1D as u").select(
        *(F.expr(mixing.hypergeometric(*x, "u")).alias(f"c{k}") for k, x in enumerate([("0", "5", "3"), ("5", "0", "3"), ("4", "4", "8"), ("3", "2", "0")]))
    )
    assert tuple(ends.first()) == (0, 3, 4, 0)


def test_odd_rows(spark, odd_docs, no_docs):
    found = mixing.taken_words(odd_docs).collect()
    assert len(found) == odd_docs.count() and all(x.taken <= 2 * x.size for x in found)
    assert mixing.taken_words(no_docs).count() == 0
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    words = mixed.select(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert words == sum(x.taken for x in found)
    assert mixing.mixed_documents(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert [(x.size, x.taken) for x in mixing.taken_words(blank).collect()] == [(0, 0), (0, 0)]


def test_cut_words(spark):
    row = spark.sql("select '  a b\n\nc  d ' as t, 1 as x, 3 as y, cast(null as string) as z")
    assert tuple(row.select(mixing.cut_words(F.col("t"), F.col("x"), F.col("y")), mixing.cut_words(F.col("z"), F.col("x"), F.col("y"))).first()) == ("b\n\nc", None)
