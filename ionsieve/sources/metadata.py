"""Acquisition dates of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import METADATA, require_columns


def as_metadata(table: DataFrame) -> DataFrame:
    """Check the columns of a metadata table and make year and month numbers.

    Further columns are kept. Text that is not a number becomes null.
    """
    require_columns(table, METADATA.fieldNames())
    return table.withColumns(
        {name: F.expr(f"try_cast(try_cast({name} as double) as int)") for name in ("year", "month")}
    )


def read_metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """Metadata from a CSV file with a header; all columns start as text.

    `pos` numbers the rows in file order (rising, not dense), unless the file has such a column.
    """
    rows = spark.read.option("header", True).csv(path)
    if "pos" not in rows.columns:
        rows = rows.withColumn("pos", F.monotonically_increasing_id())
    return as_metadata(rows)


def latest_metadata(metadata: DataFrame) -> DataFrame:
    """One row per raw name: the highest year, missing years last.

    Equal years keep the row with the lowest `pos` if there is such a column,
    else the lowest month.
    """
    tie = "pos" if "pos" in metadata.columns else "month"
    rank = F.struct(
        F.col("year").isNull().alias("undated"),
        (-F.col("year")).alias("newest"),
        F.col(tie).isNull().alias("no_tie"),
        F.col(tie).alias("tie"),
    )
    return metadata.groupBy("name").agg(
        F.min_by(F.struct("year", "month"), rank).alias("latest")
    ).select("name", "latest.year", "latest.month")
