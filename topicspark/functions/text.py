"""Text predicates and projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def balanced_brackets(text: Column) -> Column:
    """True iff no prefix closes more round brackets than it opens and all are closed at the end.

    Everything but brackets is dropped first, so only the brackets are scanned one by one. The running
    depth sticks at -1 once it has been negative.
    """
    brackets = F.split(F.regexp_replace(text, "[^()]", ""), "")
    depth = F.aggregate(
        brackets,
        F.lit(0),
        lambda d, c: F.when(d < 0, d).when(c == "(", d + 1).when(c == ")", d - 1).otherwise(d),
    )
    return depth == 0


def first_three_fields(line: Column) -> list[Column]:
    """The first three comma fields, or three nulls when there are fewer.

    Empty fields at the end of the line do not count.
    """
    fields = F.split(F.regexp_replace(line, ",+\\z", ""), ",")
    return [F.when(F.size(fields) >= 3, fields[i]).alias(f"c{i}") for i in range(3)]


def words(text: Column) -> Column:
    """Lower-case runs of letters, as an array."""
    return F.regexp_extract_all(F.lower(text), F.lit("\\p{L}+"), F.lit(0))
