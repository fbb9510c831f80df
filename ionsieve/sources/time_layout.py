"""Peaks laid out for time windows: neighbours in (sample, retention time) share a file.

Spectra ask for a few tenths of a minute of some samples. Peaks are range-partitioned along a Z-curve over the sample's
number and its time, so that a file covers few samples and a short time. A zone table beside the files has their bounds, and
only files whose zone meets a window are opened. The layout by mass (peaks.write_peaks) serves chromatograms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import url_decoded
from ..operators.filters import at_level
from ..operators.ordering import with_index
from ..schemas import PEAKS
from ..session import BROADCAST_MAX_ROWS, at_most, materialize
from .peaks import clean_points

NUMBERED = T.StructType([*PEAKS.fields, T.StructField("number", T.LongType())])

# Bits of each coordinate of the curve.
BITS = 16
# Masks that make room for another bit between the bits of a number, from coarse to fine.
_SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def _spread(number: Column) -> Column:
    for step, mask in _SPREAD:
        number = (number.bitwiseOR(F.shiftleft(number, step))).bitwiseAND(F.lit(mask).cast("long"))
    return number


def z_value(x: Column, y: Column) -> Column:
    """The bits of two numbers below 2 ** BITS in turn."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def _scaled(value: Column, low: float, high: float) -> Column:
    share = (value - F.lit(low)) / F.lit(max(high - low, 1e-9))
    return F.greatest(F.lit(0), F.least(F.lit((1 << BITS) - 1), F.floor(share * F.lit(1 << BITS)))).cast("long")


def write_time_layout(peaks: DataFrame, path: str, partitions: int) -> None:
    """Write `peaks` below `path`: peaks (by MS level, along the curve), samples (file_id, number) and zones.

    Samples are numbered in key order. Rows without a sample or a time come first on the curve. `peaks` is read twice.
    """
    spark = peaks.sparkSession
    named = with_index(peaks.select("file_id").distinct(), [], [F.col("file_id")], "number")
    named.write.parquet(f"{path}/samples")
    samples = spark.read.parquet(f"{path}/samples")
    span = peaks.agg(F.min("rt").alias("low"), F.max("rt").alias("high")).first()
    last = samples.agg(F.max("number")).first()[0] or 1
    if at_most(samples, BROADCAST_MAX_ROWS):
        samples = F.broadcast(samples)
    numbered = peaks.select(*PEAKS.fieldNames()).join(samples, "file_id", "left")
    time = _scaled(F.col("rt"), span.low or 0.0, span.high or 0.0)
    z = z_value(_scaled(F.col("number"), 1, last + 1), time)
    (
        numbered.withColumn("_z", F.coalesce(z, F.lit(-1).cast("long")))
        .repartitionByRange(partitions, "mslevel", "_z", "mz")
        .sortWithinPartitions("mslevel", "_z", "mz")
        .drop("_z")
        .write.partitionBy("mslevel")
        .parquet(f"{path}/peaks")
    )
    written = _read(spark, path).select(F.col("_metadata.file_path").alias("uri"), "mslevel", "number", "rt")
    ends = [f(x).alias(f"{name}_{x}") for x in ("number", "rt") for name, f in (("low", F.min), ("high", F.max))]
    written.groupBy("uri", "mslevel").agg(*ends, F.count("*").alias("n")).write.parquet(f"{path}/zones")


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NUMBERED).parquet(f"{path}/peaks")


def zones(spark: SparkSession, path: str) -> DataFrame:
    """uri, mslevel, low_number, high_number, low_rt, high_rt, n: what each file holds."""
    return spark.read.parquet(f"{path}/zones")


def files_in_windows(spark: SparkSession, path: str, windows: DataFrame, mslevel: str) -> list[str]:
    """Files that may hold a point of `windows` (file_id, lo, hi). Zones meet windows sample by sample."""
    of_level = zones(spark, path)
    of_level = of_level.where(at_level(of_level, mslevel)).where("low_number is not null")
    covered = of_level.withColumn("number", F.explode(F.sequence("low_number", "high_number")))
    asked = windows.join(spark.read.parquet(f"{path}/samples"), "file_id").groupBy("number", F.floor("lo").alias("minute"))
    # Windows of one sample and minute count as one, which keeps a sample with very many of them small.
    asked = asked.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    met = covered.join(asked, "number").where("low_rt <= hi and lo <= high_rt")
    return sorted(row.path for row in met.select(url_decoded(F.col("uri")).alias("path")).distinct().collect())


def peaks_in_windows(spark: SparkSession, path: str, windows: DataFrame, mslevel: str) -> DataFrame:
    """Peaks of the files that may hold a point of `windows` (file_id, lo, hi): all points of the windows, and others near them."""
    files = files_in_windows(spark, path, materialize(windows), mslevel)
    if not files:
        return clean_points(_read(spark, path)).where("false")
    rows = spark.read.schema(NUMBERED).option("basePath", f"{path}/peaks").parquet(*files)
    return clean_points(rows)
