import numpy as np
import pytest

from ionsieve.llm import neighbour_graph


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16)) * rng.uniform(0.5, 1.5, (3000, 1))
    x[100:400] = x[99]  # many copies of one vector
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def best(x, i, k):
    scores = x @ x[i]
    scores[i] = -np.inf
    order = np.lexsort((np.arange(len(x)), -np.round(scores, 9)))
    return order[:k].tolist()


def test_recall_and_ties(vectors):
    x, frame = vectors
    found = neighbour_graph.nearest(frame, frame.where("vec_id % 20 = 0"), 20).toPandas()
    lists = {i: g.sort_values("rank") for i, g in found.groupby("query_id")}
    assert sorted(lists) == list(range(0, 3000, 20)) and all(g["rank"].tolist() == list(range(1, 21)) for g in lists.values())
    hits = [len(set(g.vec_id) & set(best(x, i, 20))) for i, g in lists.items()]
    assert sum(hits) / (20 * len(hits)) >= 0.95
    for i, g in lists.items():
        assert np.allclose(g.score, x[g.vec_id] @ x[i], rtol=0, atol=1e-12) and i not in set(g.vec_id)
        if 100 <= i < 400:
            assert g.vec_id.tolist() == best(x, i, 20)  # copies in the order of their ids


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (40, None), (60, [0.0, 0.0]), (80, [None, 1.0]), (100, [nan, 1.0]), (120, [inf, 1.0]),
        (140, []), (None, [1.0, 1.0]), (3, [-1.0, 0.0]), (5, [2.0]), (7, [0.5, 0.5, 0.5]),
    ]
    frame = spark.createDataFrame([(i, v, 0, 0, 0) for i, v in rows], "vec_id long, embedding array<double>, id int, vec int, score int")
    found = neighbour_graph.nearest(frame, frame.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect()
    assert [tuple(x) for x in found if x.query_id == 0] == [(0, 1, 5, 2.0), (0, 2, 20, 1.0), (0, 3, 7, 0.5), (0, 4, 3, -1.0)]
    assert {x.query_id for x in found} == {0, 20} and len(found) == 8
    one = frame.where("vec_id = 0")
    assert neighbour_graph.nearest(one, one, 20).count() == 0
    none = frame.where("false")
    assert neighbour_graph.nearest(none, none, 20).count() == 0
    integers = spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "vec_id long, embedding array<int>")
    assert [tuple(x) for x in neighbour_graph.nearest(integers, integers.where("vec_id = 0"), 1).collect()] == [(0, 1, 1, 11.0)]
