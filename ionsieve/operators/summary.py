"""Chromatograms reduced to one row per target and sample."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import base_name
from .targets import Targets

# Minutes of a chromatogram that one task orders at a time.
RT_CELL = 1.0

# Pairs of samples and targets that one task makes, about; several times as many where there would be more than MOST_TASKS.
GRID_ROWS = 500_000
MOST_TASKS = 4_096

# Targets of a block when there are too many to broadcast, and samples that meet it in one cell. Both sides are listed
# once for each block of the other one.
TARGETS_PER_BLOCK = 5_000
SAMPLES_PER_BLOCK = 5_000


def _first_at_max() -> Column:
    """RT of the highest intensity, the earliest one among equals."""
    return F.min_by("rt", F.struct((-F.col("intensity")).alias("high"), F.col("rt").alias("early")))


@dataclass(frozen=True)
class Grid:
    """Samples times targets, dealt out by `cells`, and how anything keyed like it finds its cell."""

    pairs: DataFrame
    cells: dict[str, Column]
    samples: DataFrame | None = None
    wanted: DataFrame | None = None
    tasks: int = 0

    def left_join(self, results: DataFrame) -> DataFrame:
        """`results` (file_id, target_id, ...) on every pair, nulls where there are none.

        The cells are part of the join keys, so only the results have to move to where the pairs are made already, with
        spark.sql.requireAllClusterKeysForCoPartition off (see session.recommended_conf).
        """
        if self.cells:
            return self._with_found(results)
        # Hashed rather than sorted: a task has at most as many results as it makes pairs.
        placed = results.withColumns(self.cells).hint("shuffle_hash")
        return self.pairs.join(placed, [*self.cells, "file_id", "target_id"], "left").drop(*self.cells)

    def _with_found(self, results: DataFrame) -> DataFrame:
        """The same in blocks: a sample takes its results of a block of targets along, so that pairs never move, whatever the
        session's settings."""
        values = [c for c in results.columns if c not in ("file_id", "target_id")]
        entry = F.struct("target_id", F.struct(*values).alias("of"))
        known = results.where("target_id is not null").withColumns(self.cells).groupBy(*self.cells, "file_id")
        found = known.agg(F.map_from_entries(F.collect_list(entry)).alias("_found"))
        samples = self.samples.join(found, [*self.cells, "file_id"], "left").repartition(self.tasks, *self.cells)
        pairs = samples.join(self.wanted, [*self.cells]).withColumn("_of", F.try_element_at("_found", F.col("target_id")))
        return pairs.withColumns({c: F.col(f"_of.{c}") for c in values}).drop("_found", "_of", *self.cells)


def sample_target_grid(manifest: DataFrame, targets: Targets, **more: Column) -> Grid:
    """One row per sample and target: `pos`, file_id, file, target_id, molecule, target_mz, and `more` about a target.

    Every pair is a row of the result, found or not; what is in `more` is worked out once per target. Samples are dealt out first, to as many tasks as the pairs need; a
    short target list is then broadcast to them, and blocks of a long one meet blocks of samples by an equi join.
    """
    samples = manifest.select("file_id", "pos", base_name(F.col("file_id")).alias("file"))
    count = samples.count()
    spark = manifest.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-count * targets.count // GRID_ROWS)))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    n_t = 1 if targets.few else -(-targets.count // TARGETS_PER_BLOCK)
    n_s = 1 if targets.few else max(1, -(-count // SAMPLES_PER_BLOCK))
    wanted = targets.labels.withColumns(more).withColumn("_t", block("target_id", n_t))
    if targets.few:
        dealt = samples.withColumn("_t", F.pmod(F.xxhash64("file_id"), F.lit(1))).repartition(tasks, "file_id")
        return Grid(dealt.join(F.broadcast(wanted), "_t").drop("_t"), {})
    cells = {"_s": block("file_id", n_s), "_t": block("target_id", n_t)}
    dealt = samples.withColumn("_s", cells["_s"]).withColumn("_t", every(n_t)).repartition(tasks, "_s", "_t")
    wanted = wanted.withColumn("_s", every(n_s)).repartition(tasks, "_s", "_t")
    return Grid(dealt.join(wanted, ["_s", "_t"]), cells, dealt, wanted, tasks)


def complete(results: DataFrame, manifest: DataFrame, targets: Targets, **more: Column) -> DataFrame:
    """Results on the full grid: pairs without a result get nulls. For `more` see sample_target_grid."""
    return sample_target_grid(manifest, targets, **more).left_join(results)


def apexes(chromatograms: DataFrame) -> DataFrame:
    """Highest point of each chromatogram; the earliest one if several are equal."""
    return chromatograms.groupBy("target_id", "file_id").agg(
        F.max("intensity").alias("max_intensity"), _first_at_max().alias("rt_at_max")
    )


def max_intensities(chromatograms: DataFrame, manifest: DataFrame, targets: Targets) -> DataFrame:
    """Max frame: a sample without a hit has maximum 0 and no RT or target mass."""
    full = complete(apexes(chromatograms), manifest, targets)
    found = F.col("max_intensity").isNotNull()
    return full.select(
        "target_id",
        "molecule",
        "file_id",
        "file",
        "pos",
        F.coalesce("max_intensity", F.lit(0.0)).alias("max_intensity"),
        "rt_at_max",
        F.when(found, F.col("target_mz")).alias("target_mz"),
    )


def curve_summary(chromatograms: DataFrame) -> DataFrame:
    """Maximum, its RT, number of points and trapezoid area of each chromatogram.

    The area needs neighbours in RT order. Each minute is ordered on its own
    and gives its inner area and end points; the minutes of a chromatogram are
    then joined up, so a huge one spreads over many tasks.
    """
    minute = Window.partitionBy("target_id", "file_id", "_cell").orderBy("rt")
    rt, height = F.col("rt"), F.col("intensity")
    slices = (
        chromatograms.withColumn("_cell", F.floor(rt / F.lit(RT_CELL)))
        .withColumn("_rt", F.lag("rt").over(minute))
        .withColumn("_height", F.lag("intensity").over(minute))
        .groupBy("target_id", "file_id", "_cell")
        .agg(
            F.sum((rt - F.col("_rt")) * (height + F.col("_height")) / 2).alias("area"),
            F.count("*").alias("n"),
            F.min("rt").alias("start"),
            F.min_by("intensity", "rt").alias("start_height"),
            F.max("rt").alias("end"),
            F.max_by("intensity", "rt").alias("end_height"),
            F.max("intensity").alias("intensity"),
            _first_at_max().alias("rt"),
        )
    )
    run = Window.partitionBy("target_id", "file_id").orderBy("_cell")
    joint = (F.col("start") - F.lag("end").over(run)) * (
        F.col("start_height") + F.lag("end_height").over(run)
    ) / 2
    area = F.sum(F.coalesce("area", F.lit(0.0)) + F.coalesce("joint", F.lit(0.0)))
    return (
        slices.withColumn("joint", joint)
        .groupBy("target_id", "file_id")
        .agg(
            F.max("intensity").alias("max_intensity"),
            _first_at_max().alias("rt_at_max"),
            F.sum("n").alias("n_points"),
            F.when(F.sum("n") == 1, F.max("intensity")).otherwise(area).alias("auc"),
        )
    )


def summarize(chromatograms: DataFrame, manifest: DataFrame, targets: Targets) -> DataFrame:
    """Summary frame: a sample without a hit is not detected and has nulls."""
    full = complete(curve_summary(chromatograms), manifest, targets)
    return full.select(
        "target_id",
        "molecule",
        "file_id",
        "file",
        "pos",
        F.col("n_points").isNotNull().alias("detected"),
        "max_intensity",
        "rt_at_max",
        F.coalesce("n_points", F.lit(0).cast("long")).alias("n_points"),
        "auc",
    )


def screening_aggregate(hit_table: DataFrame) -> DataFrame:
    """Per target and sample: scans with a hit, maximum, mean of the scans' mean m/z."""
    return hit_table.groupBy("target_id", "file_id").agg(
        F.count("*").alias("n_hits"),
        F.max("max_intensity").alias("max_intensity"),
        F.avg("mean_mz").alias("mean_mz"),
    )
