"""Positions, ranks and quantiles over long ordered groups.

Every group (all samples of a molecule, say) is cut into cells that follow its order. The few cells of a group get
running totals, and rows are ordered inside their cell only, so no task orders a long group. How many cells a group has
follows its rows; where they are cut comes from a sample of its own keys. Neither changes any result.

Rows sort like Spark sorts them: nulls first, NaN above all numbers. Null group keys are a group like any other.
The input is read several times: pass a table or a materialised frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of a group per cell, about.
ROWS_PER_CELL = 65_536

# Cells of a group at most: a power of two, as cuts are found by halving.
MOST_CELLS = 4_096


def _cuts(rows: DataFrame) -> DataFrame:
    """_g, _cuts: per group the sorted keys that begin its second and later cells.

    Each of MOST_CELLS hash classes gives the key whose hash is lowest, which is a fair sample and the same one on every
    run; evenly spaced ones of these become cuts. `rows` has the group _g and the order key _k.
    """
    hashed = rows.select("_g", "_k", F.xxhash64("_k").alias("_h"))
    classes = hashed.groupBy("_g", F.pmod("_h", F.lit(MOST_CELLS)).alias("_class"))
    classes = classes.agg(F.count("*").alias("_n"), F.min_by("_k", "_h").alias("_k"))
    groups = classes.groupBy("_g").agg(F.sum("_n").alias("_n"), F.sort_array(F.collect_list("_k")).alias("_keys"))
    cells = F.least(F.floor(F.col("_n") / F.lit(ROWS_PER_CELL)), F.size("_keys"))
    stride = F.floor(F.size("_keys") / F.greatest(cells, F.lit(1)))
    chosen = F.filter("_keys", lambda _, i: (i > 0) & (i % stride == 0))
    return groups.where(cells > 1).select("_g", F.slice(chosen, 1, MOST_CELLS - 1).alias("_cuts"))


def _cell(key: str, cuts: str) -> Column:
    """How many of the sorted cuts lie at or below the key, found by halving."""
    steps, step = [], MOST_CELLS // 2
    while step:
        steps.append(F.lit(step))
        step //= 2
    at = lambda place: F.get(F.col(cuts), place - 1)
    return F.aggregate(
        F.array(*steps),
        F.lit(0),
        lambda place, s: F.when(
            (place + s <= F.size(cuts)) & (at(place + s) <= F.col(key)), place + s
        ).otherwise(place),
    )


def with_running_total(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: Column
) -> DataFrame:
    """Add `before` (weight of all earlier rows of the group) and `total`."""
    # A struct of keys is never null itself, and its null fields are equal, so groups join by plain equality. Without
    # keys, all rows get 0 from a column, which keeps the join an equi join.
    group = F.struct(*keys) if keys else F.struct(F.pmod(F.xxhash64(*order), F.lit(1)).alias("_"))
    key = F.struct(*[column.alias(f"k{i}") for i, column in enumerate(order)])
    rows = rows.withColumns({"_g": group, "_k": key, "_w": weight})
    rows = rows.join(_cuts(rows), "_g", "left")
    rows = rows.withColumn("_cell", F.coalesce(_cell("_k", "_cuts"), F.lit(0))).drop("_cuts")
    past = lambda value, window: F.coalesce(
        F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    cells = rows.groupBy("_g", "_cell").agg(F.sum("_w").alias("_weight"))
    whole = Window.partitionBy("_g")
    cells = cells.select(
        "_g",
        "_cell",
        past("_weight", whole.orderBy("_cell")).alias("_cells_before"),
        F.sum("_weight").over(whole).alias("total"),
    )
    inside = Window.partitionBy("_g", "_cell").orderBy("_k")
    return (
        rows.withColumn("_in_cell", past("_w", inside))
        .join(cells, ["_g", "_cell"])
        .withColumn("before", F.col("_cells_before") + F.col("_in_cell"))
        .drop("_g", "_k", "_w", "_cell", "_cells_before", "_in_cell")
    )


def with_index(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str
) -> DataFrame:
    """Add the 1-based position of each row in its group as `name`."""
    placed = with_running_total(rows, keys, order, F.lit(1).cast("long"))
    return placed.withColumn(name, F.col("before") + 1).drop("before", "total")


def tied_ranks(rows: DataFrame, keys: Sequence[str], value: str, **extra: Column) -> DataFrame:
    """One row per distinct value of each group: count `n`, `before`, `total`, `mid_rank`.

    `extra` aggregates are taken per distinct value too. Equal values collapse
    before anything is ordered.
    """
    distinct = rows.groupBy(*keys, value).agg(
        F.count("*").alias("n"), *[column.alias(name) for name, column in extra.items()]
    )
    ranked = with_running_total(distinct, keys, [F.col(value)], F.col("n"))
    return ranked.withColumn("mid_rank", F.col("before") + (F.col("n") + 1) / F.lit(2))


def quantiles(
    rows: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group."""
    ranked = tied_ranks(rows.where(F.col(value).isNotNull()), keys, value)
    columns = []
    for name, share in shares.items():
        # Zero-based place of the quantile among the sorted values.
        place = (F.col("total") - 1) * F.lit(float(share))
        lower, upper = F.floor(place), F.ceil(place)
        covers = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
        low = F.max(F.when(covers(lower), F.col(value)))
        high = F.max(F.when(covers(upper), F.col(value)))
        columns.append((low + (high - low) * F.max(place - lower)).alias(name))
    return ranked.groupBy(*keys).agg(*columns)


def evenly_spaced(
    manifest: DataFrame, samples: int, position: str = "pos", key: str = "file_id"
) -> DataFrame:
    """`samples` rows spread evenly over the manifest order; all rows if it has no more.

    Wanted positions run from the first to the last row in equal steps, rounded
    half to even.
    """
    if samples < 1:
        raise ValueError("samples must be at least 1")
    placed = with_index(manifest, [], [F.col(position), F.col(key)], "_at")
    total = F.col("total")
    step = (total - 1) / F.lit(max(samples - 1, 1))
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.bround(i * step + 1).cast("long")
    )
    every = F.sequence(F.lit(1).cast("long"), total)
    wanted = manifest.agg(F.count("*").alias("total")).select(
        F.explode(F.when(total <= samples, every).otherwise(spread)).alias("_at")
    )
    return placed.join(wanted, "_at", "left_semi").drop("_at")
