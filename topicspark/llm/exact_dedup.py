"""Exact deduplication as a stream with keyed state on disk.

The documents are a file stream. Its state, in the RocksDB store, holds for each digest of a normalised text (A-Z
lower-cased, null as empty) the number of rows, the largest doc_id seen and the content locator of that row: its file
and its place in it. State has no watermark and never expires, so a later run on the same checkpoint goes on with all
it has seen, and new files are compared with every earlier one. Each micro-batch is aggregated before its shuffle, so
copies of one text are one row per task, however many they are.

Digests alone decide nothing. For every digest that was hit twice the full bytes are checked: the smallest and the
largest normalised text of its rows, again aggregated before the shuffle, must be the same. Rows of a digest that
fails are grouped by their full text instead.

Of equal texts the row of the largest doc_id stays. A null doc_id counts as smaller than any other; rows that repeat
the staying doc_id and text stay too, as they are the same document. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.llm.common import ascii_lower, fresh_path

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTINGS = {
    STORE: ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # a store per partition: none sets room aside on disk before it needs it
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def update_state(
    spark: SparkSession, source: str, folder: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None
) -> DataFrame:
    """Run all files of `source` not seen yet through the state in `folder`; (digest, n, keep_id, locator) of all digests.

    `folder` keeps the stream's checkpoint with its state, and what each micro-batch changed.
    """
    schema = spark.read.parquet(source).select("doc_id", "text").schema
    # no file is too old to be read, whatever has come before it
    stream = spark.readStream.schema(schema).option("maxFileAge", "36500d")
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    # a file stream takes a folder or a pattern; this pattern fits a table of one file too
    source = source.rstrip("/")
    rows = stream.parquet(f"{source[:-1]}[{source[-1]}]").select(
        digest(normalised(F.col("text"))).alias("digest"),
        "doc_id",
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator"),
    )
    state = rows.groupBy("digest").agg(
        F.count("*").alias("n"), F.max(F.struct("doc_id", "locator")).alias("top")
    )

    def keep(changed: DataFrame, number: int) -> None:
        changed.select("digest", "n", F.col("top.doc_id").alias("keep_id"), F.col("top.locator").alias("locator")).write.mode(
            "overwrite"
        ).parquet(f"{folder}/changes/batch={number}")

    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        run = (
            state.writeStream.outputMode("update").trigger(availableNow=True)
            .option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(keep).start()
        )
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return current_state(spark, folder)


def current_state(spark: SparkSession, folder: str) -> DataFrame:
    """The last change of each digest: one row per digest."""
    columns = "digest binary, n long, keep_id long, locator struct<file: string, row: long>, batch int"
    try:
        changes = spark.read.schema(columns).parquet(f"{folder}/changes")
    except Exception as error:  # no file has come yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], columns).drop("batch")
    if changes.select("batch").distinct().count() < 2:
        return changes.drop("batch")
    last = changes.groupBy("digest").agg(F.max("batch").alias("batch"))
    return changes.join(last, ["digest", "batch"]).drop("batch")


def members(docs: DataFrame, state: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, text_sha256) of each row, by the checked state."""
    text = normalised(F.col("text"))
    rows = docs.select("doc_id", text.alias("text")).withColumn("digest", digest(F.col("text")))
    hits = state.where("n > 1").select("digest")
    # the full bytes of every hit: all texts of a digest are equal if the smallest is the largest
    bytes_of = rows.join(hits, "digest", "left_semi").groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    clash = bytes_of.where("low != high").select("digest")
    clashes = clash.count()
    light = rows.select("doc_id", "digest", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    told = state.select("digest", "keep_id", F.col("n").alias("group_size"))
    # a row without its digest in the state would be lost in silence
    known = F.when(F.col("keep_id").isNull() & F.col("group_size").isNull(), F.raise_error(F.lit("a row's digest is not in the state")))
    sure = lambda rows: rows.withColumn("group_size", F.coalesce(known.cast("long"), "group_size"))
    if not clashes:
        return sure(light.join(told, "digest", "left"))
    apart = rows.join(clash, "digest", "left_semi")
    groups = apart.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    exact = apart.join(groups, "text").select(
        "digest", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size"
    )
    return sure(light.join(clash, "digest", "left_anti").join(told, "digest", "left")).unionByName(exact)


def exact_duplicates(
    spark: SparkSession, source: str, folder: str | None = None, digest: Callable[[Column], Column] = sha256,
    files_per_batch: int | None = None,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of the parquet table at `source`."""
    folder = folder or fresh_path(spark, "exact-dedup")
    state = update_state(spark, source, folder, digest, files_per_batch)
    found = members(spark.read.parquet(source), state, digest)
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
