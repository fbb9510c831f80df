"""Box statistics and two-sample tests, for any number of molecule pairs at once.

Frames are long: target_id, molecule, file_id, value. Targets are told apart by target_id; names may repeat.
Frames are read several times, so pass them materialised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import t_two_sided, with_rank_sum_p, with_signed_rank_p
from ..functions.scoring import p_text, significance_label
from .ordering import quantiles, tied_ranks, with_index

PAIR = ["target_1", "target_2", "name_1", "name_2"]


def _ties() -> Column:
    """Sum of t^3 - t over groups of equal values."""
    t = F.col("n").cast("double")
    return F.sum(t * t * t - t)


def all_pairs(molecules: DataFrame, order: str) -> DataFrame:
    """Every pair of the listed targets (target_id, molecule), the earlier one first."""
    named = molecules.select("target_id", "molecule", F.col(order).alias("_order"))
    placed = with_index(named, [], [F.col("_order"), F.col("target_id")], "place")
    side = lambda i: [F.col("target_id").alias(f"target_{i}"), F.col("molecule").alias(f"name_{i}")]
    earlier = F.sequence(F.lit(1).cast("long"), F.col("place") - 1)
    second = placed.where("place > 1").select(*side(2), F.explode(earlier).alias("place"))
    return placed.select(*side(1), "place").join(second, "place").select(*PAIR)


def box_statistics(values: DataFrame) -> DataFrame:
    """Quartiles and whiskers per target; a whisker ends at the last point
    within 1.5 interquartile ranges of the box."""
    of = ["target_id", "molecule"]
    box = quantiles(values, of, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    kept = F.when(inside, F.col("value"))
    return (
        values.join(box.drop("molecule"), "target_id")
        .groupBy(*of, "q1", "median", "q3")
        .agg(
            F.count("value").alias("n"),
            F.min(kept).alias("whisker_low"),
            F.max(kept).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def paired_differences(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """value of the first target minus value of the second in each sample that has both."""
    side = lambda i, name: values.select(F.col("target_id").alias(f"target_{i}"), "file_id", F.col("value").alias(name))
    both = pairs.join(side(1, "x"), "target_1").join(side(2, "y"), ["target_2", "file_id"])
    return both.select(*PAIR, "file_id", (F.col("x") - F.col("y")).alias("d"))


def unpaired_samples(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """How many samples of either side have no partner, per pair."""
    return (
        _sides(values, pairs)
        .groupBy(*PAIR, "file_id")
        .agg(F.count("*").alias("sides"))
        .groupBy(*PAIR)
        .agg(F.count_if(F.col("sides") == 1).alias("n_unpaired"))
    )


def _sides(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """Values of both targets of each pair, marked by side."""
    side = lambda i: pairs.join(
        values.select(F.col("target_id").alias(f"target_{i}"), "file_id", "value"), f"target_{i}"
    ).select(*PAIR, "file_id", "value", F.lit(i).alias("side"))
    return side(1).unionByName(side(2))


def signed_rank(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """Paired Wilcoxon test: V, number of non-zero differences, zeros, ties, p."""
    differences = paired_differences(values, pairs)
    moved = differences.where("d <> 0").withColumn("size", F.abs("d"))
    ranked = tied_ranks(moved, PAIR, "size", n_up=F.count_if(F.col("d") > 0))
    positive = ranked.groupBy(*PAIR).agg(
        F.sum(F.col("n_up") * F.col("mid_rank")).alias("statistic"),
        F.sum("n").alias("n"),
        _ties().alias("ties"),
    )
    zeros = differences.groupBy(*PAIR).agg(F.count_if(F.col("d") == 0).alias("zeros"))
    tested = zeros.join(positive, PAIR, "left")
    counted = tested.select(
        *PAIR,
        F.coalesce("statistic", F.lit(0.0)).alias("statistic"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
        "zeros",
        F.coalesce("ties", F.lit(0.0)).alias("ties"),
    )
    return with_signed_rank_p(counted)


def rank_sum(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """Unpaired Wilcoxon test: W of the first molecule, both sizes, ties, p."""
    ranked = tied_ranks(_sides(values, pairs), PAIR, "value", n_first=F.count_if(F.col("side") == 1))
    first = F.sum("n_first")
    counted = ranked.groupBy(*PAIR).agg(
        (F.sum(F.col("n_first") * F.col("mid_rank")) - first * (first + 1) / 2).alias("statistic"),
        first.alias("n_1"),
        (F.sum("n") - first).alias("n_2"),
        _ties().alias("ties"),
    )
    amounts = values.groupBy("target_id").agg(F.count("*").alias("n"))
    amount = lambda i: amounts.select(F.col("target_id").alias(f"target_{i}"), F.col("n").alias(f"n_{i}"))
    return with_rank_sum_p(counted, pairs.join(amount(1), "target_1").join(amount(2), "target_2"))


def paired_t(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """Paired t-test: t, degrees of freedom, mean difference, p."""
    n = F.count("d")
    counted = paired_differences(values, pairs).groupBy(*PAIR).agg(
        F.try_divide(F.avg("d"), F.stddev_samp("d") / F.sqrt(n)).alias("statistic"),
        (n - 1).cast("double").alias("df"),
        F.avg("d").alias("mean_difference"),
    )
    return counted.withColumn("p", t_two_sided(F.col("statistic"), F.col("df")))


def welch_t(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """Unpaired t-test without equal variances: t, degrees of freedom, both means, p."""
    per_target = values.groupBy("target_id").agg(
        F.avg("value").alias("mean"),
        (F.var_samp("value") / F.count("value")).alias("error"),
        F.count("value").alias("n"),
    )
    side = lambda i: per_target.select(
        F.col("target_id").alias(f"target_{i}"),
        *[F.col(name).alias(f"{name}_{i}") for name in ("mean", "error", "n")],
    )
    both = pairs.join(side(1), "target_1").join(side(2), "target_2")
    error = F.col("error_1") + F.col("error_2")
    share = lambda i: F.try_divide(F.col(f"error_{i}") * F.col(f"error_{i}"), F.col(f"n_{i}") - 1)
    counted = both.select(
        *PAIR,
        F.try_divide(F.col("mean_1") - F.col("mean_2"), F.sqrt(error)).alias("statistic"),
        F.try_divide(error * error, share(1) + share(2)).alias("df"),
        "mean_1",
        "mean_2",
    )
    return counted.withColumn("p", t_two_sided(F.col("statistic"), F.col("df")))


def compare(
    values: DataFrame, pairs: DataFrame, test: str = "wilcox.test", paired: bool = True
) -> DataFrame:
    """One row per pair with statistic, p and its labels, by the named test."""
    tests = {
        ("wilcox.test", True): signed_rank,
        ("wilcox.test", False): rank_sum,
        ("t.test", True): paired_t,
        ("t.test", False): welch_t,
    }
    if (test, paired) not in tests:
        raise ValueError(f"unknown test: {test}")
    return tests[test, paired](values, pairs).select(
        *PAIR,
        F.lit(test).alias("method"),
        F.lit(paired).alias("paired"),
        "statistic",
        "p",
        significance_label(F.col("p")).alias("p_signif"),
        p_text(F.col("p")).alias("p_format"),
    )
