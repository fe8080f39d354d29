"""Rows out of arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, array: Column, name: str, *keep: str | Column, place: str = "_place") -> DataFrame:
    """The columns `keep` and a row `name` per element; an empty or null array has no row. With `place` kept, also where it stands.

    For a plain explode Spark adds a filter below it, that the array is not null and not empty, and so builds the array up
    to three times per row. With the outer form it is built once, and the rows of empty arrays go afterwards.
    """
    held = df.select(*keep, F.posexplode_outer(array).alias(place, name)).filter(F.col(place).isNotNull())
    return held.drop(place) if place == "_place" else held
