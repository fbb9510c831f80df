"""Samples and their acquisition dates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..session import materialize
from ..sources.metadata import latest_metadata
from .ordering import with_index

# Sorts undated samples behind every month.
UNDATED = 999_999


def _lookup(metadata: DataFrame) -> DataFrame:
    """(_kind, _key, _date): dates by raw and by decoded name, one row each; `_date` is never null.

    Raw names that decode alike give the date of the first of them.
    """
    decoded = names.url_decoded(F.col("name"))
    entry = lambda kind, key: F.struct(F.lit(kind).alias("_kind"), key.alias("_key"))
    both = latest_metadata(metadata).select(
        "name",
        F.struct("year", "month").alias("_date"),
        F.explode(F.array(entry("raw", F.col("name")), entry("decoded", decoded))).alias("_entry"),
    )
    return both.groupBy("_entry._kind", "_entry._key").agg(F.min_by("_date", "name").alias("_date"))


def _with_match(samples: DataFrame, metadata: DataFrame, name: str, probes: list[tuple[str, Column]]) -> DataFrame:
    """Add `_date`: of the first of the `probes` (kind, key) that the metadata knows, null if none.

    All probes of all distinct names go through one join.
    """
    probe = lambda i, kind, key: F.struct(F.lit(i).alias("_step"), F.lit(kind).alias("_kind"), key.alias("_key"))
    every = F.explode(F.array(*[probe(i, *x) for i, x in enumerate(probes)])).alias("_probe")
    asked = samples.select(name).distinct().select(F.col(name).alias("_name"), every).select("_name", "_probe.*")
    found = asked.join(_lookup(metadata), ["_kind", "_key"])
    first = found.groupBy("_name").agg(F.min_by("_date", "_step").alias("_date"))
    return samples.join(first, F.col(name) == F.col("_name"), "left").drop("_name")


def with_dates(samples: DataFrame, metadata: DataFrame) -> DataFrame:
    """Add year, month, date_order and display_name from the metadata.

    A sample takes the first match of: equal raw names; equal decoded names;
    its decoded name equal to a raw name. A match without a month still counts
    as the match, and leaves the sample undated.
    """
    file, decoded = F.col("file"), names.url_decoded(F.col("file"))
    probes = [("raw", file), ("decoded", decoded), ("raw", decoded)]
    found = _with_match(samples, metadata, "file", probes)
    dated = found.withColumns({"year": F.col("_date.year"), "month": F.col("_date.month")})
    year, month = F.col("year"), F.col("month")
    return (
        dated.withColumn("date_order", names.date_order(year, month))
        .withColumn("display_name", names.display_name(file, year, month))
        .drop("_date")
    )


def once_per_sample(
    frame: DataFrame, columns: list[str], added: list[str], step: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Run `step` on the distinct samples of a frame and join its `added` columns back.

    A frame of samples x molecules then goes through one join instead of one
    per lookup.
    """
    found = step(frame.select("file_id", *columns).distinct())
    return frame.join(found.select("file_id", *added), "file_id", "left")


def dated_frame(frame: DataFrame, metadata: DataFrame) -> DataFrame:
    """`with_dates` for a frame with many rows per sample."""
    added = ["year", "month", "date_order", "display_name"]
    return once_per_sample(frame, ["file"], added, lambda samples: with_dates(samples, metadata))


def labelled_frame(frame: DataFrame, metadata: DataFrame | None, name: str) -> DataFrame:
    """`with_date_labels` for a frame with many rows per sample."""
    if metadata is None:
        return with_date_labels(frame, None, name)
    label = lambda samples: with_date_labels(samples, metadata, name)
    return once_per_sample(frame, [name], ["date_label"], label)


def reorder_by_date(samples: DataFrame, metadata: DataFrame) -> DataFrame:
    """Samples with dates and their 1-based place by date: undated last, ties by name."""
    return in_date_order(with_dates(samples, metadata), [], "sample_idx")


def in_date_order(dated: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add the place by (date_order, file) inside each group as `name`.

    The dated frame is written out first, so that its lookups run once.
    """
    dated = materialize(dated)
    order = [F.coalesce("date_order", F.lit(UNDATED)), F.col("file"), F.col("file_id")]
    return with_index(dated, keys, order, name)


def date_span(dated: DataFrame) -> DataFrame:
    """First and last month of the dated samples; nulls if none is dated."""
    month = F.when(F.col("date_order").isNotNull(), F.struct("year", "month"))
    span = dated.agg(F.min(month).alias("first"), F.max(month).alias("last"))
    return span.select(
        F.col("first.year").alias("min_year"),
        F.col("first.month").alias("min_month"),
        F.col("last.year").alias("max_year"),
        F.col("last.month").alias("max_month"),
    )


def with_date_labels(
    samples: DataFrame, metadata: DataFrame | None = None, name: str = "file"
) -> DataFrame:
    """Add `date_label`: from the metadata if it dates the sample, else from its name.

    The decoded name is looked up as it is, then without its date prefix. The
    label from the name uses the raw name.
    """
    if metadata is None:
        return samples.withColumn("date_label", names.date_label(F.col(name)))
    decoded = names.url_decoded(F.col(name))
    probes = [("decoded", decoded), ("decoded", names.without_date_prefix(decoded))]
    found = _with_match(samples, metadata, name, probes)
    label = names.month_label(F.col("_date.year"), F.col("_date.month"))
    return found.withColumn("date_label", F.coalesce(label, names.date_label(F.col(name)))).drop("_date")
