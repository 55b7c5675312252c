"""Row numbers over groups of any size.

``row_number() over (partition by key)`` sorts a whole group in one task. Where a group
has no bound, rows are range-partitioned by (key, order) instead, numbered inside each
slice, and shifted by the number of rows of the key in earlier slices. A hot key is then
spread over as many tasks as it has slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradeloom.staging import staged

SLICE = "_slice"


def sliced(df: DataFrame, keys: list[str], order: list[Column], label: str, slices: int | None = None) -> DataFrame:
    """Rows with the number of their range slice. Written out, so slice borders are fixed
    for every later reader even when a task is rerun."""
    by = [F.col(k) for k in keys] + order
    ranged = df.repartitionByRange(slices, *by) if slices else df.repartitionByRange(*by)
    return staged(ranged.withColumn(SLICE, F.spark_partition_id()), label)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Dense 1..n numbering per key; ``order`` must be unique within a key."""
    parts = sliced(df, keys, order, f"numbered-{name}")
    sizes = parts.groupBy(*keys, SLICE).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, SLICE, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    local = parts.withColumn("_local", F.row_number().over(inside))
    return local.join(offsets, [*keys, SLICE]).withColumn(
        name, (F.col("_local") + F.col("_before")).cast("bigint")).drop(SLICE, "_local", "_before")
