import random

import numpy as np
import pytest

from ionsieve.llm import decontamination


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 8)))
    text = lambda n: [word() for _ in range(n)]
    items = [text(n) for n in (3, 5, 8, 20, 20, 35, 60)]
    docs, expected = [], {}
    for i in range(60):
        item, filler = items[i % 7], text(100)
        if i < 21:  # whole items, in other case and white space
            docs.append(filler[:30] + [w.upper() for w in item] + filler[30:])
            if len(item) >= 5:
                expected[i] = (i % 7, 30)
        elif i < 35 and len(item) >= 35:  # one word exchanged
            changed = item.copy()
            changed[2] = word()
            docs.append(changed + filler)
            expected[i] = (i % 7, 0)
        elif len(item) >= 20:  # a third of an item
            docs.append(filler + item[: len(item) // 3])
        else:
            docs.append(filler)
    docs.append(items[6])
    expected[60] = (6, 0)
    docs.append(text(9000) + items[5] + text(50))  # the item begins in a later stretch
    expected[61] = (5, 9000)
    docs = spark.createDataFrame([(i, " \n".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"), expected


def test_planted_items_are_found_and_clean_documents_left_alone(tables):
    docs, items, expected = tables
    found = {x.doc_id: (x.item_id, x.start_word) for x in decontamination.find_leaks(docs, items).collect()}
    assert found == expected
    kept = {x.doc_id for x in decontamination.without_leaks(docs, items).collect()}
    assert kept == {i for i in range(62) if i not in expected}


def test_items_in_several_passes(tables):
    docs, items, expected = tables
    passes = list(decontamination.item_passes(items, limit=2))
    assert len(passes) == 4 and {x.n for x in passes} == {7}
    assert sum(len(x) for p in passes for x in p.lengths.values()) == 7


def test_passes_change_no_row(spark, monkeypatch):
    rng = random.Random(66)
    common = [f"c{k}" for k in range(30)]  # a run that several items share, so that its shingles weigh little
    items = [common[k % 7 :][:20] + [f"i{k}w{j}" for j in range(12)] for k in range(12)]
    docs = []
    for k in range(48):
        words = items[k % 12].copy()
        for _ in range(k % 4):
            words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
        docs.append([f"f{rng.randrange(999)}" for _ in range(9)] + words)
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    passes = decontamination.item_passes
    found = []
    for limit in (20_000, 2):
        monkeypatch.setattr(decontamination, "item_passes", lambda rows, limit=limit: passes(rows, limit))
        found.append(sorted(decontamination.find_leaks(docs, items).collect()))
    assert found[0] == found[1] and len(found[0]) > 12  # more than the unchanged ones


def test_closest_windows_are_those_of_every_window_times_every_item(spark):
    """Every window of every document against every item; what lies within the radius must be reported as it is."""
    rng = random.Random(3)
    items = [[f"w{rng.randrange(40)}" for _ in range(n)] for n in (6, 9, 14, 14, 25, 40)]
    docs = []
    for k in range(40):
        words = items[k % 6].copy()
        if k % 3 == 1:
            words[rng.randrange(len(words))] = "other"
        docs.append([f"w{rng.randrange(40)}" for _ in range(k)] + words + [f"w{rng.randrange(40)}" for _ in range(20)])
    rows = [(i, " ".join(x)) for i, x in enumerate(items)]
    held = [{tuple(x[j : j + 5]) for j in range(len(x) - 4)} for x in items]
    weight = lambda s: np.log1p(len(items) / max(1, sum(s in h for h in held)))
    total = lambda shingles: sum(map(weight, shingles))
    best = {}
    for i, words in enumerate(docs):
        for j, item in enumerate(items):
            for start in range(len(words) - len(item) + 1):
                own = {tuple(words[x : x + 5]) for x in range(start, start + len(item) - 4)}
                similarity = total(own & held[j]) / total(own | held[j])
                if similarity >= 0.75 and similarity > best.get((i, j), 0) + 1e-9:
                    best[i, j] = similarity
    table = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    benchmark = spark.createDataFrame(rows, "item_id long, text string")
    found = {(x.doc_id, x.item_id): x.similarity for x in decontamination.find_leaks(table, benchmark).collect()}
    assert set(found) <= set(best) and all(found[x] == pytest.approx(best[x]) for x in found)
    # Equal items are always within the radius; of those that just pass, about one in 20 is not.
    assert {x for x in best if best[x] == 1} <= set(found) and len(found) >= 0.9 * len(best)


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.uint64(rng.integers(0, 2**63))
        flips = rng.choice(64, rng.integers(0, decontamination.RADIUS + 1), replace=False)
        b = a ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64), initial=np.uint64(0))
        blocks = decontamination.blocks_of(np.array([a, b]))
        assert (blocks[0] == blocks[1]).any()


def test_odd_rows(spark, odd_docs, no_docs):
    text = odd_docs.where("doc_id = 1").first().text
    rows = [(1, text), (1, text), (2, None), (None, text), (3, ""), (4, "one")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    found = sorted((x.doc_id or 0, x.item_id, round(x.similarity, 3)) for x in decontamination.find_leaks(odd_docs, items).collect())
    assert [x[:2] for x in found] == [(0, 1), (1, 1), (1, 1), (6, 4)]
    kept = decontamination.without_leaks(odd_docs, items)
    assert kept.schema == odd_docs.schema and kept.count() == odd_docs.count() - 4
    assert decontamination.find_leaks(no_docs, items).count() == 0
    assert decontamination.find_leaks(odd_docs, items.where("false")).count() == 0
    assert decontamination.without_leaks(odd_docs, items.where("false")).count() == odd_docs.count()
