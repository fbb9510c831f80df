"""Which sample files can't be read, and why.

Files are listed by Spark, which holds their names on the driver, and opened by tasks, footers only unless asked for more. A file is opened through pyarrow's file
systems, so its URI must be one of those that pyarrow knows (local files, S3, GCS, ABFS, HDFS).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import base_name, matches_any, sample_key, url_decoded
from ..schemas import PEAK_FILE
from ..session import BROADCAST_MAX_ROWS, at_most, materialize
from .manifest import PARQUET_FILES
from .peaks import read_samples

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Files that one task opens.
FILES_PER_TASK = 64
# Faults that an error names.
NAMED = 20

# What a column may be stored as, by the type it is read as.
_STORED = {
    "string": (pa.types.is_string, pa.types.is_large_string, pa.types.is_dictionary),
    "bigint": (pa.types.is_int64, pa.types.is_int32),
    "double": (pa.types.is_float64, pa.types.is_float32),
}


def _opened(uri: str) -> pq.ParquetFile:
    files, path = fs.FileSystem.from_uri(uri)
    return pq.ParquetFile(files.open_input_file(path))


def fault_of(uri: str, whole: bool) -> str | None:
    """Why the file can't be read as a sample, or None. `whole` reads every column, a row group at a time."""
    try:
        file = _opened(uri)
        schema = file.schema_arrow
        for field in PEAK_FILE.fields:
            if field.name not in schema.names:
                return f"column {field.name} is missing"
            kind, wanted = schema.field(field.name).type, field.dataType.simpleString()
            if not any(test(kind) for test in _STORED[wanted]):
                return f"column {field.name} is {kind}, not {wanted}"
        if whole:
            for group in range(file.num_row_groups):
                file.read_row_group(group, columns=PEAK_FILE.fieldNames())
    except Exception as error:  # whatever a broken file makes the reader say is its fault
        return f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"
    return None


def file_faults(spark: SparkSession, paths: str | Sequence[str], whole: bool = False, exclude_patterns: Sequence[str] = ()) -> DataFrame:
    """file_id, file, error: the files below `paths` that can't be read. One job that opens every file.

    `exclude_patterns` leave out files by name, unopened.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", PARQUET_FILES)
    # The listing itself names the files, empty ones too; a scan would pass these over.
    uris = listed.load([paths] if isinstance(paths, str) else list(paths)).inputFiles()
    path = url_decoded(F.col("path"))
    named = spark.createDataFrame([(uri,) for uri in uris], "path string")
    named = named.where(~matches_any(base_name(path), exclude_patterns)) if exclude_patterns else named
    tasks = max(1, -(-len(uris) // FILES_PER_TASK))

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows["error"] = [fault_of(uri, whole) for uri in rows["path"]]
            yield rows[rows["error"].notna()]

    found = named.repartition(tasks, "path").mapInPandas(opened, "path string, error string")
    return found.select(sample_key(path).alias("file_id"), base_name(path).alias("file"), "error")


class DamagedFiles(ValueError):
    """Some files can't be read; `faults` has file_id, file, error of all of them."""

    def __init__(self, faults: DataFrame, count: int) -> None:
        self.faults = faults
        rows = faults.orderBy("file_id").limit(NAMED).collect()
        super().__init__(f"{count} damaged files: " + "; ".join(f"{row.file_id} ({row.error})" for row in rows))


def read_checked(
    spark: SparkSession,
    paths: str | Sequence[str],
    all_or_nothing: bool = False,
    whole: bool = False,
    exclude_patterns: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(peaks, rejects): the peaks of all sound files, and file_id, file, error of the others.

    No row of a rejected file is among the peaks, also not of one whose damage lies behind rows that could be read (which
    `whole` finds). `all_or_nothing` raises DamagedFiles instead of leaving any out.
    """
    rejects = materialize(file_faults(spark, paths, whole, exclude_patterns))
    count = rejects.count()
    if count and all_or_nothing:
        raise DamagedFiles(rejects, count)
    peaks = read_samples(spark, paths, skip_damaged=count > 0, exclude_patterns=exclude_patterns)
    if count:
        bad = rejects.select("file_id")
        peaks = peaks.join(F.broadcast(bad) if at_most(bad, BROADCAST_MAX_ROWS) else bad, "file_id", "left_anti")
    return peaks, rejects
