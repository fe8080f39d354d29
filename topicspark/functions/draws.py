"""Seeded draws that depend on the data only, not on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(parts) -> Column:
    """The md5 of the parts joined by '|', in hexadecimal digits."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def draw_bits(*parts) -> Column:
    """52 uniform bits as a long, from the md5 of the parts joined by '|'."""
    return F.conv(F.substring(_digest(parts), 1, 13), 16, 10).cast("bigint")


def uniform_topic(num_topics: int, *parts) -> Column:
    """A topic in [0, num_topics), each equally likely: the remainder of `draw_bits`.

    Where the number divides 16, the last of the 13 digits tells the remainder, and is looked up instead of all being converted.
    """
    if 16 % num_topics == 0:
        digit = F.position(F.substring(_digest(parts), 13, 1), F.lit("0123456789abcdef")) - 1
        return (digit % F.lit(num_topics)).cast("int")
    return (draw_bits(*parts) % F.lit(num_topics)).cast("int")
