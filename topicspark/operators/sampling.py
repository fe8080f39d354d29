"""Sampling and splitting of lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicspark.session import Workspace

DIGITS = 3  # of a digest, per histogram: 4,096 buckets
EDGE_ROWS = 100_000  # so many digests at the cut are ranked at once


def _edge(keyed: DataFrame, n: int) -> tuple[str, str, int]:
    """(low, prefix, missing): all digests below `low` are taken, and `missing` more of those that start with `prefix`.

    Histograms of the digests' leading digits, each inside the bucket at the cut of the one before.
    """
    prefix, missing = "", n
    for length in range(DIGITS, 32, DIGITS):
        inside = keyed.filter(F.col("_key").startswith(prefix)) if prefix else keyed
        sizes = inside.groupBy(F.substring("_key", 1, length).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
        upto = F.sum("rows").over(Window.orderBy("bucket"))  # one row per bucket
        cut = sizes.withColumn("upto", upto).filter(F.col("upto") >= missing).orderBy("bucket").first()
        if cut is None:
            return "g", "g", 0  # beyond all digests: there are fewer lines than asked for
        missing -= cut["upto"] - cut["rows"]
        prefix = cut["bucket"]
        if cut["rows"] <= EDGE_ROWS:
            break
    return prefix, prefix, missing


def sample_docs(lines: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly n lines without replacement (all lines if there are fewer), the same for the same seed.

    The sample is the first n lines in the order of the md5 of seed and line. Histograms of the digests' leading
    digits find the cut; lines below it pass through a plain filter. At the cut, distinct digests with their number of
    copies are ranked, and only those taken fetch their text. No task gets more than the digests of one small bucket.
    """
    if n <= 0:
        raise ValueError("the sample size must be above 0")
    keyed = lines.select("value", F.md5(F.concat_ws("|", F.lit(seed), "value")).alias("_key"))
    low, prefix, missing = _edge(keyed, n)
    below = keyed.filter(F.col("_key") < low).select("value")
    if not missing:
        return below
    edge = keyed.filter(F.col("_key").startswith(prefix))
    copies = edge.groupBy("_key").agg(F.count(F.lit(1)).alias("copies"))
    before = F.sum("copies").over(Window.orderBy("_key")) - F.col("copies")
    taken = copies.withColumn("take", F.least("copies", F.lit(missing) - before)).filter("take > 0").select("_key", "take")
    text = edge.join(taken, "_key").groupBy("_key", "take").agg(F.min("value").alias("value"))
    again = text.select("value", F.explode(F.sequence(F.lit(1).cast("bigint"), "take"))).select("value")
    return below.unionAll(again)


def holdout_split(lines: DataFrame, n: int, seed: int, space: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """(training, held out): n sampled lines, and every line whose text is not among them.

    Copies of a held-out line all leave the training set; other copies stay. The sample is written as a table, and the
    lines are matched by their digest, so Spark knows the size of what it joins and picks the join.
    """
    space = space or Workspace(lines.sparkSession)
    held_out = space.store(sample_docs(lines, n, seed), "held_out")
    digests = space.store(held_out.select(F.unhex(F.sha2("value", 256)).alias("_digest")).distinct(), "digests")
    keyed = lines.withColumn("_digest", F.unhex(F.sha2("value", 256)))
    return keyed.join(digests, "_digest", "left_anti").select("value"), held_out


def select_docs(lines: DataFrame, ids: Sequence[str] | DataFrame) -> DataFrame:
    """Lines whose first space-separated token is one of the ids, compared as text."""
    first = F.substring_index("value", " ", 1)
    if isinstance(ids, DataFrame):
        wanted = ids.toDF("_id").distinct()
        return lines.withColumn("_id", first).join(wanted, "_id", "left_semi").select("value")
    return lines.filter(first.isin([str(i) for i in ids])).select("value")


def sample_and_select(lines: DataFrame, n: int, seed: int, ids: Sequence[str] = ()) -> DataFrame:
    """The sample, and with ids also the lines they name; the union is then free of copies.

    The lines are read several times: they had better be a table.
    """
    sample = sample_docs(lines, n, seed)
    if not ids:
        return sample
    return sample.unionAll(select_docs(lines, ids)).distinct()
