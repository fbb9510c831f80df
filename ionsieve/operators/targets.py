"""Target masses, prepared once for one scan of the peaks."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import MOLECULES, require_columns
from ..session import BROADCAST_MAX_ROWS

# Up to this many windows are read to the driver as they are; longer lists are
# first condensed by Spark. Either way the scan gets at most SCAN_RANGES ranges.
LISTED = 256
SCAN_RANGES = 32


@dataclass(frozen=True)
class Targets:
    """Targets with their mass windows.

    `table` has target_id, molecule, target_mz, lo, hi. `scan_ranges` covers
    every window with a few intervals, for pruning only. `rejected` holds the
    entries without a mass (target_id, molecule), which nothing can search for.
    """

    table: DataFrame
    tolerance: float
    count: int
    scan_ranges: tuple[tuple[float, float], ...]
    rejected: DataFrame | None = None

    @property
    def windows(self) -> DataFrame:
        return self.table.select("target_id", "lo", "hi")

    @property
    def labels(self) -> DataFrame:
        return self.table.select("target_id", "molecule", "target_mz")

    @property
    def few(self) -> bool:
        """Whether the windows (fixed width, at most two bins each) may be broadcast."""
        return 2 * self.count <= BROADCAST_MAX_ROWS


def _keyed(molecules: DataFrame) -> DataFrame:
    """Targets from (name, mz) rows, or suspects with an `exact_mass` to search for.

    Names may repeat, so each row gets a key. A given `target_id` is kept; else
    the key is a hash of name, mass and the running number among identical
    rows, which does not depend on row order.
    """
    if "mz" not in molecules.columns and "exact_mass" in molecules.columns:
        molecules = molecules.withColumnRenamed("exact_mass", "mz")
    require_columns(molecules, MOLECULES.fieldNames())
    if "target_id" not in molecules.columns:
        same = Window.partitionBy("name", "mz").orderBy("name")
        molecules = molecules.withColumn("_copy", F.row_number().over(same)).withColumn(
            "target_id", F.xxhash64("name", "mz", "_copy")
        )
    return molecules


def target_table(molecules: DataFrame, tolerance: float) -> DataFrame:
    """The entries that have a mass, with their windows."""
    return _keyed(molecules).where("mz is not null").select(
        "target_id",
        F.col("name").alias("molecule"),
        F.col("mz").alias("target_mz"),
        (F.col("mz") - F.lit(float(tolerance))).alias("lo"),
        (F.col("mz") + F.lit(float(tolerance))).alias("hi"),
    )


def prepare_targets(molecules: DataFrame, tolerance: float = 0.01) -> Targets:
    """Check how many targets there are and where their windows lie."""
    table = target_table(molecules, tolerance)
    rejected = _keyed(molecules).where("mz is null").select("target_id", F.col("name").alias("molecule"))
    listed = table.select("lo", "hi").limit(LISTED + 1).collect()
    if len(listed) <= LISTED:
        return Targets(table, tolerance, len(listed), merged_ranges(listed, SCAN_RANGES), rejected)
    span = table.agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    cell = F.floor((F.col("lo") - F.lit(span.lo)) / F.lit(max(span.hi - span.lo, 1e-9)) * F.lit(SCAN_RANGES))
    cells = table.groupBy(cell).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ranges = merged_ranges(cells.select("lo", "hi").collect(), SCAN_RANGES)
    return Targets(table, tolerance, span.n, ranges, rejected)


def targets_of(spark: SparkSession, molecules: Iterable[tuple[str, float]], tolerance: float = 0.01) -> Targets:
    """Targets from (name, mz) pairs given in the program."""
    return prepare_targets(spark.createDataFrame(list(molecules), MOLECULES), tolerance)


def merged_ranges(
    ranges: Iterable[tuple[float, float]], at_most: int
) -> tuple[tuple[float, float], ...]:
    """Few intervals that cover all `ranges`: overlaps join, then the narrowest gaps close."""
    cover: list[list[float]] = []
    for low, high in sorted((row[0], row[1]) for row in ranges):
        if cover and low <= cover[-1][1]:
            cover[-1][1] = max(cover[-1][1], high)
        else:
            cover.append([low, high])
    while len(cover) > at_most:
        i = min(range(1, len(cover)), key=lambda k: cover[k][0] - cover[k - 1][1])
        cover[i - 1 : i + 1] = [[cover[i - 1][0], cover[i][1]]]
    return tuple((low, high) for low, high in cover)
