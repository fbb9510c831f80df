"""Tests, boxes and distances against direct calculation."""

import itertools
import math
import random
import re

import numpy as np
import pytest

import plain_pvalues as pvalues
from ionsieve.functions import distributions
from ionsieve.functions.scoring import p_text, significance_label
from ionsieve.operators import clustering, distance, metric_index, ordering, stats
from plan_text import plan_of
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def table():
    rng = random.Random(11)
    return {
        name: {f"s{i:03}": round(rng.gauss(5 + shift, 1), digits) for i in range(count)}
        for name, shift, digits, count in (("a", 0, 6, 30), ("b", 0.4, 6, 33), ("c", 0.2, 1, 30))
    }


@pytest.fixture(scope="module")
def values(spark, table):
    rows = [("abc".index(m), m, s, v) for m, samples in table.items() for s, v in samples.items()]
    return spark.createDataFrame(rows, "target_id int, molecule string, file_id string, value double")


@pytest.fixture(scope="module")
def pairs(spark):
    names = spark.createDataFrame([(0, "a", 5), (1, "b", 9), (2, "c", 12)], "target_id int, molecule string, ord int")
    return stats.all_pairs(names, "ord")


def ranks(values):
    return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]


def test_all_pairs(pairs):
    assert {tuple(row) for row in pairs.collect()} == {(0, 1, "a", "b"), (0, 2, "a", "c"), (1, 2, "b", "c")}


def test_targets_of_one_name_stay_apart(spark):
    rows = [(t, "same", f"s{i}", float(i * t)) for t in (1, 2, 3) for i in range(9)]
    values = spark.createDataFrame(rows, "target_id long, molecule string, file_id string, value double")
    pairs = stats.all_pairs(values.select("target_id", "molecule").distinct(), "target_id")
    assert pairs.count() == 3
    found = {(r.target_1, r.target_2): r.n for r in stats.signed_rank(values, pairs).collect()}
    assert found == {(1, 2): 8, (1, 3): 8, (2, 3): 8}
    assert {r.target_id: r.median for r in stats.box_statistics(values).collect()} == {1: 4.0, 2: 8.0, 3: 12.0}


def test_signed_rank(values, pairs, table):
    for row in stats.signed_rank(values, pairs).collect():
        one, two = table[row.name_1], table[row.name_2]
        moved = [one[s] - two[s] for s in one if s in two and one[s] != two[s]]
        order = ranks([abs(d) for d in moved])
        assert row.n == len(moved)
        assert row.statistic == sum(r for r, d in zip(order, moved) if d > 0)
        assert 0 < row.p <= 1


def test_rank_sum(values, pairs, table):
    for row in stats.rank_sum(values, pairs).collect():
        one, two = list(table[row.name_1].values()), list(table[row.name_2].values())
        order = ranks(one + two)
        assert row.statistic == sum(order[: len(one)]) - len(one) * (len(one) + 1) / 2
        assert (row.n_1, row.n_2) == (len(one), len(two))


def test_t(values, pairs, table):
    for row in stats.paired_t(values, pairs).collect():
        one, two = table[row.name_1], table[row.name_2]
        d = np.array([one[s] - two[s] for s in one if s in two])
        assert row.statistic == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(len(d))))
        assert row.df == len(d) - 1
    for row in stats.welch_t(values, pairs).collect():
        one, two = (np.array(list(table[n].values())) for n in (row.name_1, row.name_2))
        e1, e2 = one.var(ddof=1) / len(one), two.var(ddof=1) / len(two)
        assert row.statistic == pytest.approx((one.mean() - two.mean()) / math.sqrt(e1 + e2))
        df = (e1 + e2) ** 2 / (e1**2 / (len(one) - 1) + e2**2 / (len(two) - 1))
        assert row.df == pytest.approx(df)


def test_unpaired_count(values, pairs):
    found = {(r.name_1, r.name_2): r.n_unpaired for r in stats.unpaired_samples(values, pairs).collect()}
    assert found == {("a", "b"): 3, ("a", "c"): 0, ("b", "c"): 3}


def test_compare(values, pairs):
    for test, paired in itertools.product(("wilcox.test", "t.test"), (True, False)):
        found = stats.compare(values, pairs, test, paired).collect()
        assert len(found) == 3 and all(0 <= row.p <= 1 for row in found)
    with pytest.raises(ValueError):
        stats.compare(values, pairs, "sign.test")


def test_exact_distributions_by_enumeration():
    for n in (1, 3, 6):
        sums = [sum(r for r, up in zip(range(1, n + 1), signs) if up) for signs in itertools.product((0, 1), repeat=n)]
        assert list(pvalues.signed_rank_counts(n)) == [sums.count(k) for k in range(n * (n + 1) // 2 + 1)]
    for m, n in ((1, 1), (2, 3), (4, 3)):
        us = [sum(c) - m * (m + 1) // 2 for c in itertools.combinations(range(1, m + n + 1), m)]
        assert list(pvalues.rank_sum_counts(m, n)) == [us.count(k) for k in range(m * n + 1)]


def test_known_p_values():
    # Student t: 2 sided tail of 2.228139 at 10 degrees of freedom is 5%.
    assert pvalues.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, rel=1e-9)
    assert pvalues.t_two_sided(12.706204736432095, 1) == pytest.approx(0.05, rel=1e-9)
    assert pvalues.t_two_sided(0.0, 5) == 1.0
    assert pvalues.t_two_sided(1.0, 1) == pytest.approx(0.5)
    assert pvalues.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    # All of 5 differences positive: 2 of 32 sign patterns are as extreme.
    assert pvalues.signed_rank_p(15, 5, 0, 0) == pytest.approx(2 / 32)
    assert pvalues.rank_sum_p(0, 3, 3, 0) == pytest.approx(2 / 20)
    # Ties switch to the normal approximation with continuity correction.
    z = (15 - 7.5 - 0.5) / math.sqrt(5 * 6 * 11 / 24 - 6 / 48)
    assert pvalues.signed_rank_p(15, 5, 0, 6) == pytest.approx(math.erfc(z / math.sqrt(2)))
    assert math.isnan(pvalues.signed_rank_p(0, 0, 4, 0))


def test_labels(spark):
    ps = [1e-17, 5e-5, 5e-4, 0.005, 0.05, 0.2, None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double").orderBy("i")
    shown = df.select(significance_label(F.col("p")), p_text(F.col("p"))).collect()
    assert [row[0] for row in shown] == ["****", "****", "***", "**", "*", "ns", None]
    assert [row[1] for row in shown][:2] == ["p < 2.2e-16", "p = 5e-05"]
    assert shown[5][1] == "p = 0.2"


def test_box(spark):
    data = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 50.0]
    rows = [(1, "m", str(i), v) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "target_id int, molecule string, file_id string, value double")
    row = stats.box_statistics(df).first()
    assert (row.q1, row.median, row.q3) == tuple(np.quantile(data, [0.25, 0.5, 0.75]))
    assert (row.whisker_low, row.whisker_high, row.n_outliers, row.n) == (1.0, 7.0, 1, 8)


@pytest.fixture(scope="module")
def cells(spark):
    """700 samples over 3 molecules; a third of the samples are copies of one profile."""
    rng = random.Random(5)
    profiles = {f"s{i:04}": (0.0, 0.0, 0.0) if i % 3 == 0 else tuple(rng.uniform(0, 9) for _ in range(3)) for i in range(700)}
    rows = [(s, m, v) for s, profile in profiles.items() for m, v in zip("abc", profile)]
    return spark.createDataFrame(rows, "sample string, molecule string, v double"), profiles


def test_distances(cells):
    df, profiles = cells
    found = distance.pairwise_distances(distance.profile_chunks(df, "sample", "molecule", "v")).collect()
    assert len(found) == 700 * 699 // 2
    for row in found[::997]:
        wanted = math.dist(profiles[row.item_1], profiles[row.item_2])
        assert row.item_1 < row.item_2 and row.distance == pytest.approx(wanted)


def test_distances_over_several_chunks(cells):
    df, profiles = cells
    found = distance.pairwise_distances(distance.profile_chunks(df, "molecule", "sample", "v")).collect()
    assert len(found) == 3
    for row in found:
        i, j = "abc".index(row.item_1), "abc".index(row.item_2)
        wanted = math.sqrt(sum((p[i] - p[j]) ** 2 for p in profiles.values()))
        assert row.distance == pytest.approx(wanted)


def test_pairs_are_not_exchanged(cells):
    df, _ = cells
    plan = plan_of(distance.pairwise_distances(distance.profile_chunks(df, "sample", "molecule", "v")))
    assert re.match(r"[^a-zA-Z]*AdaptiveSparkPlan[^\n]*\n[^a-zA-Z]*Project[^\n]*\n[^a-zA-Z]*SortMergeJoin", plan.split("==\n")[1])


@pytest.mark.parametrize("strip,spelled", [(1, 16), (64, 0)])
def test_distances_over_strips_and_blocks(cells, monkeypatch, strip, spelled):
    """Blocks and strips change no distance."""
    for name, value in {"CHUNK": 1, "STRIP": strip, "SPELLED_OUT": spelled, "BLOCK": 7, "BLOCKS": 8, "TASK_PAIRS": 1000}.items():
        monkeypatch.setattr(distance, name, value)
    df, profiles = cells
    some = dict(sorted(profiles.items())[:90])
    found = distance.pairwise_distances(distance.profile_chunks(df.where(F.col("sample").isin(list(some))), "sample", "molecule", "v")).collect()
    assert {(r.item_1, r.item_2): r.distance for r in found} == {(a, b): pytest.approx(math.dist(some[a], some[b])) for a in some for b in some if a < b}
    assert len(found) == 90 * 89 // 2


def test_nearest(cells):
    df, profiles = cells
    names = sorted(profiles)
    found = distance.nearest_profiles(distance.profile_chunks(df, "sample", "molecule", "v")).collect()
    assert len(found) == 700
    for row in found:
        best = min(
            (math.dist(profiles[row.item], profiles[other]), other) for other in names if other != row.item
        )
        assert row.distance == pytest.approx(best[0], abs=1e-12)
        assert row.nearest == best[1]


def test_nearest_over_several_chunks(cells):
    df, _ = cells
    chunks = distance.profile_chunks(df, "molecule", "sample", "v")
    full = {(r.item_1, r.item_2): r.distance for r in distance.pairwise_distances(chunks).collect()}
    for row in distance.nearest_profiles(chunks).collect():
        mine = {(set(pair) - {row.item}).pop(): d for pair, d in full.items() if row.item in pair}
        assert row.nearest == min(mine, key=mine.get)


def test_incomplete_profiles(spark, monkeypatch):
    """Missing cells are zeros, in items, dimensions and whole chunks."""
    monkeypatch.setattr(distance, "CHUNK", 4)
    rng = random.Random(3)
    profiles = {f"i{i:02}": {d: rng.choice([0.0, rng.uniform(1, 9)]) for d in range(11) if rng.random() < 0.4} for i in range(30)}
    profiles |= {"x": {0: 3.0}, "y": {1: 3.0}, "zero": {5: 0.0}}
    rows = [(item, d, v) for item, cells in profiles.items() for d, v in cells.items()]
    chunks = distance.profile_chunks(spark.createDataFrame(rows, "item string, d int, v double"), "item", "d", "v")
    away = lambda a, b: math.dist(*([profiles[i].get(d, 0.0) for d in range(11)] for i in (a, b)))
    known = {item for item, cells in profiles.items() if cells}
    found = {(r.item_1, r.item_2): r.distance for r in distance.pairwise_distances(chunks).collect()}
    assert found == {(a, b): pytest.approx(away(a, b)) for a in known for b in known if a < b}
    assert found["x", "y"] == pytest.approx(18**0.5)
    for row in distance.nearest_profiles(chunks).collect():
        best = min(away(row.item, other) for other in known if other != row.item)
        assert row.distance == pytest.approx(best, abs=1e-12) == away(row.item, row.nearest)


def test_wide(cells):
    df, profiles = cells
    wide = distance.wide_matrix(df, ["sample"], "molecule", "v", ["a", "c", "none"])
    row = wide.where("sample = 's0001'").first()
    assert (row.a, row.c, row.none) == (profiles["s0001"][0], profiles["s0001"][2], 0.0)


def test_nearest_meets_few_blocks(spark, monkeypatch):
    """Small blocks: far fewer meetings than block pairs, the same partners, both ways of ordering."""
    monkeypatch.setattr(distance, "BLOCK", 16)
    rng = random.Random(9)
    profiles = {f"p{i:03}": [10 ** rng.uniform(0, 4), rng.uniform(0, 1)] for i in range(320)}
    rows = [(i, name, 0, v) for i, (name, v) in enumerate(sorted(profiles.items()))]
    chunks = spark.createDataFrame(rows, "idx long, item string, chunk long, v array<double>")
    wanted = {
        name: min((math.dist(v, w), other) for other, w in profiles.items() if other != name)
        for name, v in profiles.items()
    }
    for bound in (65_536, 20):
        monkeypatch.setattr(ordering, "ROWS_PER_CELL", bound)
        seen = []
        inner = distance._visits
        monkeypatch.setattr(distance, "_visits", lambda *a: seen.append(inner(*a)) or seen[-1])
        found = {r.item: (r.distance, r.nearest) for r in distance.nearest_profiles(chunks).collect()}
        monkeypatch.setattr(distance, "_visits", inner)
        assert {k: v[1] for k, v in found.items()} == {k: v[1] for k, v in wanted.items()}
        assert seen[0].count() < 320 * 20 / 3


def test_workers_need_no_package(tmp_path):
    """Task functions load where the package cannot be imported."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    functions = [distance._best_inside, distance._best_across, metric_index._distances, clustering._one_by_one]
    (tmp_path / "functions.bin").write_bytes(cloudpickle.dumps(functions))
    script = (
        "import pickle; f = pickle.load(open('functions.bin', 'rb'));"
        "import sys; assert 'ionsieve' not in sys.modules; import numpy; print(f[2](numpy.zeros((1, 2)), numpy.array([[3.0, 4.0]]))[0, 0])"
    )
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.split()[0] == "5.0", done.stderr


def test_tails_in_expressions(spark):
    """Against plain Python, into far tails: relative errors."""
    zs = [(z / 7.0, ) for z in range(-20, 250)]
    for z, p in spark.createDataFrame(zs, "z double").select("z", distributions.normal_two_sided(F.col("z"))).collect():
        assert p == pytest.approx(pvalues.normal_two_sided(z), rel=1e-11, abs=1e-300)
    ts = [(t / 3.0, df) for t in (0, 1, 2, 5, 9, 40, 300, -7) for df in (1.0, 1.5, 2.0, 7.3, 30.0, 999.0, 20_000.0)] + [(None, 3.0), (float("nan"), 3.0)]
    for t, df, p in spark.createDataFrame(ts, "t double, df double").select("t", "df", distributions.t_two_sided(F.col("t"), F.col("df"))).collect():
        if t is None or math.isnan(t):
            assert p is None
        else:
            assert p == pytest.approx(pvalues.t_two_sided(t, df), rel=1e-8, abs=1e-300)


def test_exact_tables_are_built_by_spark(spark):
    for row in distributions.signed_rank_table(spark).where("n in (1, 2, 7, 30, 49)").collect():
        counts = pvalues.signed_rank_counts(row.n)
        assert row.counts == pytest.approx(list(counts[: len(row.counts)])) and row.ways == counts.sum()
        assert len(row.counts) == row.n * (row.n + 1) // 4 + 1
    sizes = [(1, 1), (1, 9), (9, 1), (3, 4), (4, 3), (12, 20), (49, 49)]
    for row in distributions.rank_sum_table(spark.createDataFrame(sizes, "n_1 long, n_2 long")).collect():
        counts = pvalues.rank_sum_counts(row.n_1, row.n_2)
        assert row.counts == pytest.approx(list(counts[: len(row.counts)]), rel=1e-9)
        assert row.ways == pytest.approx(math.comb(row.n_1 + row.n_2, row.n_1)) and len(row.counts) == row.n_1 * row.n_2 // 2 + 1


def test_p_values_of_rank_tests_need_no_python(spark):
    rows = [(15.0, 5, 0, 0.0), (15.0, 5, 0, 6.0), (0.0, 0, 4, 0.0), (100.0, 30, 2, 0.0), (400.0, 60, 0, 0.0), (3.0, 49, 0, 0.0), (1.0, 1, 0, 0.0)]
    found = distributions.with_signed_rank_p(spark.createDataFrame(rows, "statistic double, n long, zeros long, ties double"))
    for v, n, zeros, ties, p in found.collect():
        expected = pvalues.signed_rank_p(v, n, zeros, ties)
        assert p is None if math.isnan(expected) else p == pytest.approx(expected, rel=1e-9)
    assert "Python" not in plan_of(found)
    rows = [(0.0, 3, 3, 0.0), (4.0, 3, 3, 0.0), (4.5, 3, 3, 6.0), (7.0, 0, 3, 0.0), (700.0, 49, 40, 0.0), (900.0, 50, 40, 0.0), (0.0, 1, 1, 6.0)]
    table = spark.createDataFrame(rows, "statistic double, n_1 long, n_2 long, ties double")
    # Pairs of one size come many times, with columns of their own.
    sizes = table.unionByName(table).select("n_1", "n_2", F.monotonically_increasing_id().alias("pair"))
    found = distributions.with_rank_sum_p(table, sizes)
    assert found.count() == len(rows)
    for w, m, n, ties, p in found.collect():
        expected = pvalues.rank_sum_p(w, m, n, ties)
        assert p is None if math.isnan(expected) else p == pytest.approx(expected, rel=1e-9)
    assert "Python" not in plan_of(found)
