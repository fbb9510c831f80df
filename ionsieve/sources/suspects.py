"""Suspect lists: names, structures and the m/z to search for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SUSPECTS, require_columns

# The built-in list. The masses are those of the [M+H]+ ions.
PREDEFINED = (
    ("Caffeine", "CN1C=NC2=C1C(=O)N(C(=O)N2C)C", 195.0877),
    ("Nicotine", "CN1CCCC1C2=CC=CN=C2", 163.1230),
    ("Cocaine", "COC(=O)C1C(OC(=O)C2=CC=CC=C2)CC3CCC1N3C", 304.1543),
    ("MDMA", "CC(CC1=CC2=C(C=C1)OCO2)NC", 194.1176),
    ("THC", "CCCCCC1=CC(=C2C3C=C(CCC3C(OC2=C1)(C)C)C)O", 315.2319),
    ("Fentanyl", "CCC(=O)N(C1CCN(CC1)CCC2=CC=CC=C2)C3=CC=CC=C3", 337.2275),
)


def predefined_suspects(spark: SparkSession) -> DataFrame:
    """The built-in list; it replaces whatever list was in use."""
    return spark.createDataFrame(list(PREDEFINED), SUSPECTS)


def read_suspects_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(usable suspects, rows without a mass) of a CSV file with a header.

    `exact_mass` is optional in the file. Further columns are dropped.
    """
    table = require_columns(spark.read.option("header", True).csv(path), ["name", "smiles"])
    mass = F.expr("try_cast(exact_mass as double)") if "exact_mass" in table.columns else F.lit(None)
    rows = table.select("name", "smiles", mass.cast("double").alias("exact_mass"))
    return rows.where("exact_mass is not null"), rows.where("exact_mass is null")


def append_suspects(suspects: DataFrame, added: DataFrame) -> DataFrame:
    """Add complete rows; the same suspect may be added twice."""
    complete = "name is not null and smiles is not null and exact_mass is not null"
    return suspects.unionByName(added.select(*SUSPECTS.fieldNames()).where(complete))
