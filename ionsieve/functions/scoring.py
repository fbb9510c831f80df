"""Scores, errors, plot values. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_intensity(value: Column) -> Column:
    return F.log10(value + 1)


def plot_intensity(value: Column, log_scale: bool = True) -> Column:
    return log_intensity(value) if log_scale else value


def heat_value(metric: str) -> Column:
    """Cell value of a heatmap over summary columns; unknown metrics mean the maximum."""
    if metric == "detected":
        return F.col("detected").cast("double")
    return log_intensity(F.col("auc" if metric == "auc" else "max_intensity"))


def detection_score(n_hits: Column) -> Column:
    """Ten or more scans with a hit score 100."""
    return F.least(F.lit(100.0), n_hits / F.lit(10) * F.lit(100))


def ppm_error(observed: Column, expected: Column) -> Column:
    return F.try_divide(observed - expected, expected) * F.lit(1e6)


def detection_status(score: Column) -> Column:
    return (
        F.when(score > 50, F.lit("Detected"))
        .when(score > 0, F.lit("Tentative"))
        .otherwise(F.lit("Not Detected"))
    )


def colour_bucket(value: Column, low: Column, high: Column) -> Column:
    """Equal-width bucket 1..100 of `value` between `low` and `high`."""
    share = (value - low) / (high - low + F.lit(1e-10))
    return F.greatest(F.lit(1).cast("long"), F.ceil(share * 100))


def significance_label(p: Column) -> Column:
    return (
        F.when(p <= 1e-4, "****")
        .when(p <= 1e-3, "***")
        .when(p <= 0.01, "**")
        .when(p <= 0.05, "*")
        .when(p.isNotNull(), "ns")
    )


def p_text(p: Column) -> Column:
    """p-value as printed beside a plot: two significant digits without padding zeros, a floor at 2.2e-16."""
    plain = F.regexp_replace(F.format_string("%.2g", p), r"(\.\d*?)0+$", "$1")
    return (
        F.when(p < 2.2e-16, F.lit("p < 2.2e-16"))
        .when(p < 1e-4, F.concat(F.lit("p = "), F.regexp_replace(F.format_string("%.1e", p), r"\.0e", "e")))
        .when(p.isNotNull(), F.concat(F.lit("p = "), F.regexp_replace(plain, r"\.$", "")))
    )
