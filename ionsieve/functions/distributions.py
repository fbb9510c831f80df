"""Two-sided p-values in Spark's own expressions: tails of the normal and the t distribution, and exact rank tests.

The counts behind the exact tests are a table that Spark builds, one row for each pair of sizes that occurs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sample sizes below this use the exact distribution if nothing is tied.
EXACT_BELOW = 50

# Terms of the series and the continued fractions below; more change nothing in double precision.
SERIES, FRACTION, BETA_FRACTION = 60, 80, 400
# From here on the continued fraction of erfc is the better one.
SPLIT = 2.0
# Stirling's series is taken so far up, and its coefficients.
RAISED = 15
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with `value` computed once."""
    return F.transform(F.array(value), body)[0]


def erfc(x: Column) -> Column:
    """The complementary error function for x >= 0."""

    def by_series(x: Column) -> Column:
        # Terms x * (2 x^2)^k / (1 * 3 * ... * (2 k + 1)), all positive.
        term = F.struct(x.alias("term"), x.alias("sum"))
        next_term = lambda t, k: t.getField("term") * 2 * x * x / (2 * k + 1)
        step = lambda t, k: F.struct(next_term(t, k).alias("term"), (t.getField("sum") + next_term(t, k)).alias("sum"))
        found = F.aggregate(F.sequence(F.lit(1), F.lit(SERIES)), term, step)
        return 1 - found.getField("sum") * F.exp(-x * x) * F.lit(2 / math.sqrt(math.pi))

    def by_fraction(x: Column) -> Column:
        tail = F.aggregate(F.sequence(F.lit(FRACTION), F.lit(1)), F.lit(0.0), lambda t, k: k / F.lit(2.0) / (x + t))
        return F.exp(-x * x) / F.lit(math.sqrt(math.pi)) / (x + tail)

    return F.when(x < SPLIT, let(x, by_series)).otherwise(let(x, by_fraction))


def normal_two_sided(z: Column) -> Column:
    return erfc(F.abs(z) / F.lit(math.sqrt(2.0)))


def log_gamma(x: Column) -> Column:
    """For x > 0: Stirling's series at x + RAISED, brought back down."""
    z = x + RAISED
    series = (z - 0.5) * F.ln(z) - z + F.lit(0.5 * math.log(2 * math.pi))
    for k, coefficient in enumerate(STIRLING):
        series = series + F.lit(coefficient) / F.pow(z, F.lit(2 * k + 1))
    return series - F.aggregate(F.sequence(F.lit(0), F.lit(RAISED - 1)), F.lit(0.0), lambda total, i: total + F.ln(x + i))


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) as a regularised incomplete beta function."""
    half = df / 2
    of = F.struct(half.alias("a"), F.lit(0.5).alias("b"), (df / (df + t * t)).alias("x"), (t * t / (df + t * t)).alias("rest"))

    def beta(of: Column) -> Column:
        # Beyond its mean the function is taken from its other end, where the fraction settles sooner.
        swapped = of.x > (of.a + 1) / (of.a + of.b + 2)
        pick = lambda one, other: F.when(swapped, other).otherwise(one)
        turned = F.struct(pick(of.a, of.b).alias("a"), pick(of.b, of.a).alias("b"), pick(of.x, of.rest).alias("x"), pick(of.rest, of.x).alias("rest"))
        part = let(turned, lower)
        return F.when(of.x <= 0, 0.0).when(of.x >= 1, 1.0).when(swapped, 1 - part).otherwise(part)

    def lower(of: Column) -> Column:
        a, b, x = of.a, of.b, of.x
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(of.rest))

        def step(tail: Column, m: Column) -> Column:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return even / (1 + odd / (1 + tail))

        tail = F.aggregate(F.sequence(F.lit(BETA_FRACTION), F.lit(1)), F.lit(0.0), lambda total, m: step(total, m.cast("double")))
        first = -(a + b) * x / (a + 1)
        return front / a / (1 + first / (1 + tail))

    return F.when(~F.isnan(t) & ~F.isnan(df), let(of, beta))


def _moved(counts: Column, by: Column) -> Column:
    """The list with `by` zeros in front, as long as before."""
    return F.slice(F.concat(F.array_repeat(F.lit(0.0), by), counts), F.lit(1), F.size(counts))


def _added(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def signed_rank_table(spark: SparkSession) -> DataFrame:
    """n, counts, ways: how many sign patterns of ranks 1..n give each positive rank sum up to half of the largest one."""
    size = (F.col("n") * (F.col("n") + 1) / 4).cast("int") + 1
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), size - 1))
    counts = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), start, lambda c, rank: _added(c, _moved(c, rank)))
    sizes = spark.range(1, EXACT_BELOW).select(F.col("id").alias("n"))
    return sizes.select("n", counts.alias("counts"), F.pow(F.lit(2.0), F.col("n")).alias("ways"))


def rank_sum_table(sizes: DataFrame) -> DataFrame:
    """n_1, n_2, counts, ways for each row of `sizes` (n_1, n_2): how many choices of n_1 of n_1 + n_2 ranks give each U up to half
    of the largest one.

    The counts are the coefficients of the product of (1 - q^(n_2 + k)) / (1 - q^k) over k up to n_1. Dividing by 1 - q^k is
    multiplying by 1 + q^k, 1 + q^2k, 1 + q^4k and so on.
    """
    m, n = F.col("n_1").cast("int"), F.col("n_2").cast("int")
    size = (F.col("n_1") * F.col("n_2") / 2).cast("int") + 1

    def step(counts: Column, k: Column) -> Column:
        less = F.zip_with(counts, _moved(counts, n + k), lambda a, b: a - b)
        doubled = F.filter(F.transform(F.sequence(F.lit(0), F.lit(EXACT_BELOW.bit_length() * 2)), lambda j: (k * F.pow(F.lit(2.0), j)).cast("int")), lambda s: s < F.size(counts))
        return F.aggregate(doubled, less, lambda c, s: _added(c, _moved(c, s)))

    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), size - 1))
    counts = F.aggregate(F.sequence(F.lit(1), m), start, step)
    ways = F.aggregate(F.sequence(F.lit(1), m), F.lit(1.0), lambda total, k: total * (n + k) / k)
    return sizes.select("n_1", "n_2", counts.alias("counts"), ways.alias("ways"))


def _exact(statistic: Column, largest: Column) -> Column:
    """Twice the smaller tail, at most 1; both distributions are symmetric."""
    k = F.round(F.least(statistic, largest - statistic)).cast("int")
    tail = F.aggregate(F.slice("counts", F.lit(1), k + 1), F.lit(0.0), lambda total, n: total + n)
    return F.least(F.lit(1.0), 2 * tail / F.col("ways"))


def _corrected(statistic: Column, mean: Column, variance: Column) -> Column:
    """Normal approximation with continuity correction."""
    shift = statistic - mean
    return F.when(variance > 0, normal_two_sided((shift - F.signum(shift) * 0.5) / F.sqrt(variance)))


def with_signed_rank_p(tested: DataFrame) -> DataFrame:
    """Add `p` to statistic, n, zeros, ties; null without any difference. `ties` is the sum of t^3 - t over tie groups."""
    n = F.col("n").cast("double")
    largest = n * (n + 1) / 2
    exact = (n > 0) & (n < EXACT_BELOW) & (F.col("zeros") == 0) & (F.col("ties") == 0)
    normal = _corrected(F.col("statistic"), largest / 2, n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    joined = tested.join(F.broadcast(signed_rank_table(tested.sparkSession)), "n", "left")
    p = F.when(n == 0, None).when(exact, _exact(F.col("statistic"), largest)).otherwise(normal)
    return joined.withColumn("p", p).select(*tested.columns, "p")


def with_rank_sum_p(tested: DataFrame, sizes: DataFrame) -> DataFrame:
    """Add `p` to statistic, n_1, n_2, ties; null if a side is empty. `sizes` has the pairs (n_1, n_2) that may occur."""
    m, n = F.col("n_1").cast("double"), F.col("n_2").cast("double")
    small = (m > 0) & (n > 0) & (m < EXACT_BELOW) & (n < EXACT_BELOW)
    total = m + n
    variance = m * n / 12 * ((total + 1) - F.col("ties") / (total * (total - 1)))
    # At most EXACT_BELOW squared rows.
    table = F.broadcast(rank_sum_table(sizes.select("n_1", "n_2").where(small).distinct()))
    p = F.when((m == 0) | (n == 0), None).when(small & (F.col("ties") == 0), _exact(F.col("statistic"), m * n))
    p = p.otherwise(_corrected(F.col("statistic"), m * n / 2, variance))
    return tested.join(table, ["n_1", "n_2"], "left").withColumn("p", p).select(*tested.columns, "p")
