"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.session import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses, in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_WRITTEN: list[str] = []  # paths of the tables that `stored` has written and `release` has not deleted


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table: it cuts the lineage and survives a lost executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """A mark for `release`: what is stored from now on."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the tables stored since that mark, but for those that the frames `keep` read.

    Spark deletes the shuffle files of finished jobs once the driver's collector has found these jobs out of use; it is
    asked to look now, for by itself it may take half an hour.
    """
    jvm = spark._jvm
    read = [f.rstrip("/") for df in keep for f in df.inputFiles()]
    kept = [p for p in _WRITTEN[since:] if any(p.rsplit("/", 1)[-1] in f for f in read)]
    for path in _WRITTEN[since:]:
        if path not in kept:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN[since:] = kept
    jvm.System.gc()


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else, whatever the locale."""
    return F.translate(column, UPPER, LOWER)


def ascii_lower_word(word: Column) -> Column:
    """The same for short texts most of which have no capital: those are told by `lower`, which is much faster."""
    return F.when(F.lower(word) == word, word).otherwise(ascii_lower(word))


def in_fold(doc_id: Column, mod: int, rest: int) -> Column:
    """crc32 of the id as text, modulo `mod`, is `rest`; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def with_draw(rows: DataFrame, order: str, ident: str) -> DataFrame:
    """The rows with their draw for `bounded_sample`: before a join, it keeps the texts out of the join's shuffle."""
    return rows.withColumn("_draw", F.xxhash64(F.lit(17), F.col(order), F.col(ident)))


def bounded_sample(rows: DataFrame, label: str, order: str, size: int, ident: str) -> list:
    """At most `size` rows per label, those of the smallest hash of `order` and `ident`, on the driver.

    Copies of one text under different idents are drawn apart from each other, so a hot text has its share of the sample and
    no more. Rows that repeat `ident` and `order` are one document and count once. The documents of each label are estimated
    first (to a few percent); then the hashes alone of about twice the wanted ones reach the driver and give each label's
    exact cut, and at last the texts up to the cut: at most size x labels, however many copies there are.
    """
    rows = rows if "_draw" in rows.columns else with_draw(rows, order, ident)
    rows = rows.where(F.col(label).isNotNull()).select(label, order, "_draw")
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.approx_count_distinct("_draw", 0.02).alias("n")).collect()}
    if not counts:
        return []

    def upto(cuts: dict) -> Column:
        keep = F.lit(False)
        for value, cut in cuts.items():
            keep = keep | ((F.col(label) == F.lit(value)) & (F.col("_draw") <= F.lit(cut)))
        return keep

    wide = {value: min(int(min(1.0, 2.0 * (size + 50) / n) * 2.0**64 - 2**63), 2**63 - 1) for value, n in counts.items()}
    draws: dict = {value: [] for value in counts}
    for r in rows.where(upto(wide)).select(label, "_draw").distinct().collect():
        draws[r[label]].append(r["_draw"])
    cuts = {value: sorted(found)[:size][-1] for value, found in draws.items() if found[:size]}
    # the few rows of a repeated document meet only after a partial aggregation
    taken = rows.where(upto(cuts)).groupBy(label, "_draw").agg(F.first(order).alias(order)).collect()
    return sorted(taken, key=lambda r: (r["_draw"], str(r[order])))
