"""Result files."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import with_index
from ..session import materialize


def by_score(results: DataFrame) -> DataFrame:
    """Screening results, best detection score first."""
    return results.orderBy(F.desc("Detection_Score"), "Compound", "Sample")


def ranked_by_score(results: DataFrame) -> DataFrame:
    """The same order as a column: `place`, from 1. The results are written out first, as they are read several times."""
    order = [-F.col("Detection_Score"), F.col("Compound"), F.col("Sample")]
    return with_index(materialize(results), [], order, "place")


def in_reading_order(frame: DataFrame) -> DataFrame:
    """Chromatograms by sample and time, spectra by sample and m/z, other frames by input order."""
    by = [name for name in ("molecule", "pos", "file_id", "file", "rt", "mz") if name in frame.columns]
    return frame.orderBy(*by)


def write_results_csv(results: DataFrame, folder: str, day: date | None = None, overwrite: bool = False) -> str:
    """Write a screening result as CSV parts with a header; returns the path. A result of the same day stays unless told."""
    path = f"{folder.rstrip('/')}/screening_results_{day or date.today():%Y-%m-%d}.csv"
    results.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)
    return path
