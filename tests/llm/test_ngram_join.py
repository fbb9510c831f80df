import random
import re

import numpy as np
from pyspark.sql import functions as F

from ionsieve.llm import ngram_join
from ionsieve.llm.components import components


def plain(rows):
    """doc_id -> (shingles, least doc_id that links reach), all pairs compared."""
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    least = {i: i for i in sets}
    changed = True
    links = [
        (a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return {i: (len(sets[i]), least[i]) for i in sets}


def corpus():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of"] * 60
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = [text(rng.choice([1, 2, 3, 4, 5, 6, 9, 40, 120])) for _ in range(120)]
    base = text(150)
    for _ in range(60):  # copies of one text, most too far from each other
        copy = base.copy()
        for place in rng.sample(range(150), rng.choice([1, 2, 3, 5, 7])):
            copy[place] = rng.choice(vocabulary)
        rows.append(copy)
    chain = text(80)
    for _ in range(25):  # each near the one before it only
        chain = chain[2:] + text(2)
        rows.append(chain)
    rows += [base, base, text(6) + base[:9], ["The", "OF", "w1"], ["the", "of", "W1"], [], []]
    passage = text(60)
    rows += [passage + text(70) for _ in range(40)]  # share a passage, but do not link
    rng.shuffle(rows)
    return [(i * 7 + 3, " ".join(words)) for i, words in enumerate(rows)]


def test_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.similar_components(docs).collect()}
    assert found == plain(rows)
    assert len({c for _, c in found.values()}) < len(rows) - 60


def test_linked_sets_share_a_key_whatever_the_classes():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(2, 200))
        tokens = np.sort(rng.integers(0, 2**63, 2 * n + 8).astype(np.uint64))
        split = np.uint64(rng.choice([0, 2**61, 2**62, 2**63]))
        one = np.sort(rng.permutation(tokens)[:n])
        # Exchange as many tokens as still leave 3/4: shared / (2n - shared).
        out = next(m for m in range(n, -1, -1) if 100 * (n - m) >= 75 * (n + m))
        other = np.sort(np.concatenate([rng.permutation(one)[out:], np.setdiff1d(tokens, one)[:out]]))
        grown = int(rng.integers(0, n // 4 + 1)) if out == 0 else 0
        other = np.sort(np.concatenate([other, np.setdiff1d(tokens, other)[:grown]])) if grown * 3 <= n else other
        shared = len(np.intersect1d(one, other))
        if 100 * shared >= 75 * len(np.union1d(one, other)):
            keys = [ngram_join.prefix_keys(x, split) for x in (one, other)]
            assert len(np.intersect1d(*keys)), (n, out, split)


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(100):
        a, b = (np.unique(rng.integers(0, 500, rng.integers(1, 300))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in "ab")
        bound = ngram_join.least_difference(ngram_join.parity_bitmap(a), ngram_join.parity_bitmap(b))
        assert 0 <= bound <= len(np.setxor1d(a, b))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 7), (9, 9), (7, 5), (300, 20), (301, 20), (301, 299)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {i: 100 for i in range(100, 161)} | {5: 5, 7: 5, 9: 5, 20: 20, 299: 20, 300: 20, 301: 20}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd_docs, no_docs):
    found = sorted(map(tuple, ngram_join.similar_components(odd_docs).collect()), key=str)
    assert len(found) == odd_docs.count()
    assert {x for x in found if x[0] is None} == {(None, 12, None), (None, 0, None)}
    assert [x[1:] for x in found if x[0] == 1] == [(10, 1), (10, 1)]
    assert [x[1:] for x in found if x[0] in (2, 3, 4)] == [(0, 2), (0, 3), (0, 4)]
    assert ngram_join.similar_components(no_docs).count() == 0
    assert ngram_join.similar_components(odd_docs.where(F.col("text").isNull())).count() == 2
