"""Sample names: decoding, date labels, display names. Columns in, columns out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that mark samples which are not field samples. The list
# for paths, applied before any file is opened, leaves out "SST".
EXCLUDED_SAMPLES = ("blanc", "reference", "pool", "cal", "SST")
EXCLUDED_PATHS = ("blanc", "reference", "pool", "cal")

# Date shapes in a sample name, tried in this order.
DATE_PREFIX = r"E-\d{4}_\d{2}"
YEAR_MONTH = r"20[12]\d[-_]\d{2}"
YEAR = r"20[12]\d"


def base_name(path: Column) -> Column:
    """Last segment of a path."""
    return F.element_at(F.split(path, "/"), -1)


def sample_key(path: Column) -> Column:
    """Full path as a key; local files go without their scheme, however it was written."""
    return F.regexp_replace(path, "^file:/+", "/")


def folder_name(path: Column) -> Column:
    """Everything before the last segment; "." for a root file."""
    trimmed = trim_slashes(path)
    return F.when(trimmed.contains("/"), F.regexp_replace(trimmed, r"/[^/]*$", "")).otherwise(".")


def trim_slashes(path: Column) -> Column:
    return F.btrim(path, F.lit("/"))


def join_path(folder: Column, name: Column) -> Column:
    return F.concat_ws("/", folder, name)


def is_parquet(name: Column) -> Column:
    return F.lower(name).endswith(".parquet")


def url_decoded(name: Column) -> Column:
    """Decode %XX only; '+' stays a plus, a broken escape leaves the name as is."""
    return F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)


def matches_any(name: Column, patterns: Sequence[str]) -> Column:
    """Case-insensitive search for any pattern; no patterns match nothing."""
    if not patterns:
        return F.lit(False)
    return name.rlike(f"(?i)({'|'.join(patterns)})")


def without_date_prefix(name: Column) -> Column:
    return F.regexp_replace(name, f"^{DATE_PREFIX}-", "")


def _found(name: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(name, pattern, 0), F.lit(""))


def date_label(name: Column) -> Column:
    """Year-month, else year, else the first ten characters of the name."""
    prefixed = F.replace(F.substring(_found(name, DATE_PREFIX), 3, 7), F.lit("_"), F.lit("-"))
    year_month = F.replace(_found(name, YEAR_MONTH), F.lit("_"), F.lit("-"))
    return F.coalesce(prefixed, year_month, _found(name, YEAR), F.substring(name, 1, 10))


def month_label(year: Column, month: Column) -> Column:
    """'2021-03' from numbers; null if either is missing."""
    both = year.isNotNull() & month.isNotNull()
    return F.when(both, F.format_string("%d-%02d", year, month))


def year_part(label: Column) -> Column:
    return F.substring_index(label, "-", 1)


def date_order(year: Column, month: Column) -> Column:
    return year * 100 + month


def display_name(file: Column, year: Column, month: Column) -> Column:
    """Name with its date in front; undated names are only made readable."""
    readable = F.replace(file, F.lit("%20"), F.lit(" "))
    stem = F.replace(F.regexp_replace(file, r"\.parquet$", ""), F.lit("%20"), F.lit(" "))
    dated = F.format_string("E-%d_%02d-%s.parquet", year, month, stem)
    return F.when(year.isNotNull() & month.isNotNull(), dated).otherwise(readable)
