"""Table shapes shared by every stage, and the one column check they use."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# One row per peak inside one sample file.
PEAK_FILE = _struct(
    mslevel=T.StringType(),
    scanid=T.LongType(),
    rt=T.DoubleType(),
    mz=T.DoubleType(),
    intensity=T.DoubleType(),
)

# The same rows once they belong to a table of many samples.
PEAKS = T.StructType([T.StructField("file_id", T.StringType()), *PEAK_FILE.fields])

# `pos` is the input order of the samples; order is data here.
MANIFEST = _struct(
    file_id=T.StringType(),
    file=T.StringType(),
    path=T.StringType(),
    pos=T.LongType(),
)

METADATA = _struct(name=T.StringType(), year=T.IntegerType(), month=T.IntegerType())

MOLECULES = _struct(name=T.StringType(), mz=T.DoubleType())

SUSPECTS = _struct(name=T.StringType(), smiles=T.StringType(), exact_mass=T.DoubleType())


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Return `df`, or raise if it lacks one of `columns`."""
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    return df
