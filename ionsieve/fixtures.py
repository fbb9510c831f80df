"""Screening tables derived from the order tables of the test data.

Each line item becomes one peak, each supplier one sample file, each region a
molecule and each part an entry of a suspect library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import PEAKS


# The columns used of each table. A declared schema spares a look at the files.
TABLES = {
    "lineitem": "l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_linestatus string",
    "supplier": "s_suppkey long",
    "region": "r_regionkey int",
    "part": "p_partkey long",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def sample_name(number: str) -> Column:
    """File name of a sample number: kinds, date styles and an encoded space."""
    kind, style = F.col(number) % 10, F.col(number) % 3
    return F.concat(
        F.when(kind == 0, "Blanc").when(kind == 1, "POOL").when(kind == 2, "cal").otherwise("Sample"),
        F.lit("_"),
        F.when(style == 0, "2022_05").when(style == 1, "2023").otherwise("run"),
        F.lit("%20"),
        F.col(number).cast("string"),
        F.lit(".parquet"),
    )


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    return lines.select(
        sample_name("l_suppkey").alias("file_id"),
        F.when(F.col("l_linestatus") == "F", "1").otherwise("2").alias("mslevel"),
        (F.col("l_quantity") * 10 + F.col("l_linenumber")).cast("long").alias("scanid"),
        (F.col("l_quantity") * F.lit(0.1)).alias("rt"),
        (
            F.lit(150.0) + (F.col("l_partkey") % 4) * 5 + F.col("l_discount") + F.col("l_tax") / 10
        ).alias("mz"),
        F.col("l_extendedprice").alias("intensity"),
    ).select(*PEAKS.fieldNames())


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = _table(spark, sf_dir, "supplier")
    with_peaks = suppliers.select(
        sample_name("s_suppkey").alias("file_id"), F.col("s_suppkey").cast("long").alias("pos")
    )
    # A sample without peaks. Its name depends on a column, as real names do, so
    # that joins on it stay equi joins.
    kind = F.when(F.col("id") == 0, "empty")
    without = spark.range(1).select(
        F.concat(F.lit("Sample_"), kind, F.lit(".parquet")).alias("file_id"),
        F.lit(-1).cast("long").alias("pos"),
    )
    return with_peaks.unionByName(without).withColumn("file", F.col("file_id"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date per supplier and an older, wrong one.

    Odd names are already decoded. Rows of every seventh supplier, and most of
    the older rows, are about other samples.
    """
    key = F.col("s_suppkey")
    suppliers = _table(spark, sf_dir, "supplier")
    encoded = sample_name("s_suppkey")
    name = F.when(key % 2 == 0, encoded).otherwise(F.replace(encoded, F.lit("%20"), F.lit(" ")))
    name = F.when(key % 7 == 3, F.concat(F.lit("Other_"), name)).otherwise(name)
    right = suppliers.select(
        name.alias("name"),
        (2019 + key % 5).cast("int").alias("year"),
        (1 + key % 12).cast("int").alias("month"),
    )
    older = F.when(key % 6 == 0, name).otherwise(F.concat(F.lit("Old_"), name))
    wrong = suppliers.select(older.alias("name"), F.lit(2007).alias("year"), F.lit(1).alias("month"))
    return right.unionByName(wrong)


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("r_regionkey")
    return _table(spark, sf_dir, "region").select(
        key.cast("long").alias("target_id"),
        F.concat(F.lit("mol_"), key.cast("string")).alias("name"),
        (F.lit(150.0) + key * 5 + F.lit(0.0523)).alias("mz"),
    )


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select(
        key.cast("long").alias("target_id"),
        F.concat(F.lit("part_"), key.cast("string")).alias("name"),
        (F.lit(149.9) + key * F.lit(0.01) + F.lit(0.0003)).alias("mz"),
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A share's listing: files in folders and at the root, some without a URL, some of another kind, some twice, and folders."""
    key = F.col("s_suppkey")
    sample = sample_name("s_suppkey")
    name = F.when(key % 5 == 4, F.replace(sample, F.lit(".parquet"), F.lit(".csv"))).when(key % 7 == 2, F.upper(sample)).otherwise(sample)
    folder = F.when(key % 4 == 0, "").when(key % 4 == 1, "batch/").otherwise("batch/part two/")
    rows = _table(spark, sf_dir, "supplier").select(
        name.alias("name"),
        F.concat(folder, name).alias("path"),
        (key % 11 == 0).alias("is_folder"),
        F.when(key % 2 == 0, F.concat(F.lit("file:///data/"), folder, name)).alias("url"),
        key.alias("key"),
    )
    return rows.drop("key").unionByName(rows.where("key % 3 = 0").drop("key"))


def text_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as text: numbers, numbers with a fraction, words and gaps; names repeat, also within a year."""
    key = F.col("s_suppkey")
    year = (2019 + key % 3).cast("string")
    return _table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("sample "), (key % 9).cast("string")).alias("name"),
        F.when(key % 5 == 0, F.concat(year, F.lit(".0"))).when(key % 7 == 0, "unknown").when(key % 13 == 0, None).otherwise(year).alias("year"),
        F.when(key % 4 == 0, "May").otherwise((1 + key % 12).cast("string")).alias("month"),
        (F.lit(1_000_000) - key).alias("pos"),
    )
