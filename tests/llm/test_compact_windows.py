import random

import numpy as np
import pyarrow as pa
import pytest

from ionsieve.llm import compact_windows


def test_windows_against_plain_search():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = rng.integers(0, 60, 3)
        first = np.concatenate([[0], np.cumsum(lengths)])
        values = rng.integers(0, 25, first[-1]).astype(np.uint64)
        size, expected = int(rng.integers(1, 8)), []
        for begin, end in zip(first, first[1:]):
            for at in range(begin, end):
                left = right = at
                while left > begin and values[left - 1] > values[at]:
                    left -= 1
                while right < end - 1 and values[right + 1] >= values[at]:
                    right += 1
                if right - left + 1 >= size:
                    expected.append((at, left, right))
        found = compact_windows.compact_windows(values, first, size)
        assert list(zip(*(x.tolist() for x in found))) == expected


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(8)
    text = lambda n: ["".join(rng.choices("abcdefghij", k=4)) for _ in range(n)]
    passages = [text(n) for n in (51, 60, 140)]
    docs, holders = [], {}
    for i in range(90):
        body = text(rng.randrange(0, 400))
        if i % 3 == 0:
            at = rng.randrange(len(body) + 1)
            body[at:at] = passages[i // 3 % 3]
            holders[i] = (i // 3 % 3, at)
        docs.append(body)
    near = passages[2].copy()
    near[70] = "changed"
    docs.append(text(100) + near)
    docs.append(passages[1][:40])
    docs += [text(30) * 5]  # repeats only inside itself
    return spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"), holders, passages


def test_repeated_passages_are_found(planted):
    docs, holders, passages = planted
    rows = compact_windows.repeated_passages(docs).collect()
    firsts = {p: min(i for i, (q, _) in holders.items() if q == p) for p in range(3)}
    found = {(x.doc_id, x.first_doc_id): x for x in rows}
    expected = {(i, firsts[p]) for i, (p, _) in holders.items() if i != firsts[p]} | {(90, firsts[2])}
    assert set(found) == expected
    for (i, _), x in found.items():
        begin, size = (100, 140) if i == 90 else (holders[i][1], len(passages[holders[i][0]]))
        assert abs(x.start_word - begin) <= 1 and abs(x.end_word - begin - size) <= 1 and x.similarity >= 0.75


def test_odd_rows(spark, odd_docs, no_docs):
    assert compact_windows.repeated_passages(no_docs).count() == 0
    assert compact_windows.repeated_passages(odd_docs).count() == 0
    long = odd_docs.where("doc_id = 5").first().text
    more = spark.createDataFrame([(8, long), (9, None), (8, long)], "doc_id long, text string")
    found = compact_windows.repeated_passages(odd_docs.unionByName(more, allowMissingColumns=True)).collect()
    assert {(x.doc_id, x.first_doc_id) for x in found} == {(8, 5)}
    assert max(x.end_word - x.start_word for x in found) == 60_000


def test_quotes_in_lesser_documents_hide_no_passage(spark):
    rng = random.Random(5)
    text = lambda n: ["".join(rng.choices("abcdefghij", k=4)) for _ in range(n)]
    docs, expected = [], set()
    for i in range(120):
        passage, at = text(60), rng.randrange(20)
        quote = passage[at : at + 40]
        near = [w if k % 12 else "x" + w for k, w in enumerate(passage)]  # below the similarity asked for
        docs.append((i, " ".join(text(60) + (quote if i % 2 else near) + text(60) + quote)))
        for k in (1000, 2000):
            docs.append((k + i, " ".join(text(80) + passage + text(80))))
        expected.add((2000 + i, 1000 + i))
    rows = compact_windows.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(x.doc_id, x.first_doc_id) for x in rows if x.first_doc_id >= 1000} == expected
    assert [x for x in rows if x.first_doc_id < 1000] == []
    assert len(rows) == len(expected) and all(x.similarity == 1 for x in rows)
    assert all(abs(x.start_word - 80) <= 1 and abs(x.end_word - 140) <= 1 for x in rows)


def test_runs_with_too_few_hits_are_not_looked_at(monkeypatch):
    rng = np.random.default_rng(2)
    runs = compact_windows._best_run
    looked_at = []

    def counted(hits, penalty):
        looked_at.append(len(hits))
        return runs(hits, penalty)

    def plain(x, y, size):
        """As verified(), with each run judged."""
        todo, found = [(0, len(x), 0)], []
        while todo:
            a, b, level = todo.pop()
            if b - a < size:
                continue
            begin, end = (a + k for k in runs(np.isin(x[a:b], y), compact_windows.PENALTIES[level]))
            similarity = 0.0
            if end - begin >= size:
                todo += [(a, begin, level), (end, b, level)]
                low, high = runs(np.isin(y, x[begin:end]), compact_windows.PENALTIES[level])
                if high - low >= size:
                    similarity = len(np.intersect1d(x[begin:end], y[low:high])) / len(np.union1d(x[begin:end], y[low:high]))
                if similarity >= compact_windows.SIMILARITY:
                    found.append((begin, end, low, high, similarity))
                    continue
                a, b = begin, end
            if level + 1 < len(compact_windows.PENALTIES):
                todo.append((a, b, level + 1))
        return found

    monkeypatch.setattr(compact_windows, "_best_run", counted)
    for size, wide in ((4, 30), (10, 200), (46, 100_000)):
        for _ in range(100):
            x = rng.integers(0, wide, rng.integers(0, 150)).astype(np.uint64)
            y = rng.integers(0, wide, rng.integers(0, 150)).astype(np.uint64)
            n, at = int(rng.integers(0, 90)), int(rng.integers(0, 50))
            y[at : at + n] = x[:n][: len(y[at : at + n])] if len(x[:n]) >= len(y[at : at + n]) else y[at : at + n]
            y[rng.random(len(y)) < 0.03] = 7
            assert list(compact_windows.verified(x, y, size)) == plain(x, y, size)
    looked_at.clear()
    assert not list(compact_windows.verified(np.arange(300, dtype=np.uint64), np.arange(270, 500, dtype=np.uint64), 46))
    assert not looked_at


def _rows(batches, kind):
    rows = [compact_windows._unpacked(batch.column(1).to_pylist(), kind) for batch in batches if batch.num_rows]
    return np.sort(np.concatenate([np.zeros(0, kind), *rows]))


def test_texts_of_a_slice_are_taken_at_once(monkeypatch):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choices("abc", k=2)) for _ in range(n))
    texts = [words(rng.choice((0, 3, 30, 80))) for _ in range(60)]
    texts += [None, "a " * 90, texts[-1]]
    ids = [*range(len(texts) - 1), 5]  # rows of equal ids
    size, calls = 8, {"least_places": 0, "run_hashes": 0}
    documents = lambda at: pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[at : at + 1], pa.int64()), "text": pa.array(texts[at : at + 1], pa.string())})
    every = pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())})
    single = [list(compact_windows._windows(size, 4, 2)(iter([documents(i)]))) for i in range(len(texts))]
    alone = [batch for found in single for batch in found]

    def listed(i):
        found = _rows(single[i], compact_windows.WINDOW)
        return [found["key"].astype(np.int64), found["left"], found["at"], found["right"], found["at"] % 2 == 0]

    def asked(batch, rows):
        parts = [listed(i) for i in rows]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
        lists = [pa.array([part[k].tolist() for part in parts], pa.list_(kind)) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*batch.columns, *lists], names=["doc_id", "text", "key", "left", "at", "right", "open"])

    monkeypatch.setattr(compact_windows, "_useful", lambda windows: windows)
    finer = [b for i in range(len(texts)) for b in compact_windows._finer(size, 2)(iter([asked(documents(i), [i])]))]
    for name in calls:

        def counted(*given, name=name, plain=getattr(compact_windows, name)):
            calls[name] += 1
            return plain(*given)

        monkeypatch.setattr(compact_windows, name, counted)
    together = asked(every, range(len(texts)))
    assert _rows(compact_windows._windows(size, 4, 2)(iter([every])), compact_windows.WINDOW).tolist() == _rows(alone, compact_windows.WINDOW).tolist()
    assert _rows(compact_windows._finer(size, 2)(iter([together])), compact_windows.FINER).tolist() == _rows(finer, compact_windows.FINER).tolist()
    # Arrow may hand on a part of a batch.
    part = _rows(compact_windows._finer(size, 2)(iter([together.slice(0, 20), together.slice(20)])), compact_windows.FINER)
    assert part.tolist() == _rows(finer, compact_windows.FINER).tolist()
    assert calls == {"least_places": 1, "run_hashes": 3}


def test_least_of_ranges():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 1 << 60, (3, 50)).astype(np.uint64)
    begin = rng.integers(0, 50, 200)
    end = np.minimum(begin + rng.integers(0, 50, 200), 49)
    expected = np.array([[row[a : b + 1].min() for a, b in zip(begin, end)] for row in values])
    assert (compact_windows._least_of(values, begin, end) == expected).all()
    assert compact_windows._least_of(values, begin[:0], end[:0]).shape == (3, 0)
