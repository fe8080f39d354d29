"""Dense positions in a global order, without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicspark.session import shared_folder

_ROW_BITS = 33  # monotonically_increasing_id keeps the row within the partition in its low 33 bits


def _placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """The range-sorted rows, checkpointed, which fixes partitions and order on shared storage; `_part` and `_id` tell both."""
    shared_folder(df.sparkSession)
    placed = df.sort(*order).checkpoint().withColumn("_id", F.monotonically_increasing_id())
    return placed.withColumn("_part", F.shiftright("_id", _ROW_BITS).cast("int"))


def _offsets(placed: DataFrame, rows: Column) -> DataFrame:
    """(_part, _offset): the sum of `rows` over all partitions before; one row per partition."""
    parts = placed.groupBy("_part").agg(rows.alias("_rows"))
    return parts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_offset"))


def dense_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add `name`: 0, 1, 2, ... in the given order: the offset of the row's partition plus its place there."""
    placed = _placed(df, order)
    within = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.join(F.broadcast(_offsets(placed, F.count(F.lit(1)))), "_part")
        .withColumn(name, F.col("_offset") + within)
        .drop("_id", "_part", "_offset")
    )


def sum_before(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Add `name`: the sum of `value` over all rows before, in the given order."""
    placed = _placed(df, order)
    here = F.sum(value).over(Window.partitionBy("_part").orderBy("_id")) - F.col(value)
    return (
        placed.withColumn("_here", here)
        .join(F.broadcast(_offsets(placed, F.sum(value))), "_part")
        .withColumn(name, F.col("_offset") + F.col("_here"))
        .drop("_id", "_part", "_offset", "_here")
    )
