"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "topicspark", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on; a cluster's own settings win where they are given."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read, as the session names it in spark.checkpoint.dir.

    Only where it is unset and the session is one process on this machine, as in tests, a temporary folder is made.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="topicspark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table; one of fewer splits than the session has cores is spread over them."""
    table = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


class Workspace:
    """Intermediate tables in the shared folder. Every write has a path of its own, so no table that is still to be
    read is ever overwritten.

    A loop keeps its last states and deletes older ones by `keep_last`. It works in a `child` of its own, so two
    loops never delete each other's tables.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark).rstrip('/')}/topicspark-{uuid.uuid4().hex}"
        self.written: dict[str, list[str]] = {}

    def path(self, name: str) -> str:
        """A path for files with a name of their own."""
        return f"{self.folder}/{name}"

    def child(self, name: str) -> Workspace:
        return Workspace(self.spark, f"{self.folder}/{name}-{uuid.uuid4().hex}")

    def fresh_path(self, name: str) -> str:
        """A path for the next table of this name."""
        paths = self.written.setdefault(name, [])
        paths.append(f"{self.folder}/{name}-{uuid.uuid4().hex}")
        return paths[-1]

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = self.fresh_path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free_shuffles(self) -> None:
        """Once tables are written: Spark deletes the shuffle files behind them when the driver's collector finds these jobs out
        of use, and is asked to look now, for by itself it may take half an hour."""
        self.spark._jvm.System.gc()

    def store_bucketed(self, df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
        """As a table whose buckets Spark knows: work grouped by the column reads it without a shuffle."""
        path = self.fresh_path(name)
        table = path.rsplit("/", 1)[-1].replace("-", "_")
        df.write.format("parquet").bucketBy(buckets, column).option("path", path).saveAsTable(table)
        return self.spark.table(table)

    def table(self, path: str, name: str) -> DataFrame:
        """A table of this name that another session has written."""
        self.written.setdefault(name, []).append(path)
        return self.spark.read.parquet(path)

    def bucketed_table(self, path: str, name: str, column: str, schema: str, buckets: int) -> DataFrame:
        """The same with its buckets, which the path alone does not tell."""
        self.written.setdefault(name, []).append(path)
        table = path.rsplit("/", 1)[-1].replace("-", "_")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{table}` ({schema}) USING parquet CLUSTERED BY ({column}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        return self.spark.table(table)

    def keep_last(self, name: str, number: int) -> None:
        """Delete all tables of this name but the last `number`."""
        paths = self.written.get(name, [])
        old, self.written[name] = (paths[:-number], paths[-number:]) if number else (paths, [])
        jvm = self.spark._jvm
        for path in old:
            self.spark.sql(f"DROP TABLE IF EXISTS `{path.rsplit('/', 1)[-1].replace('-', '_')}`")
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def clear(self) -> None:
        """Delete all tables of this workspace; those of its children stay."""
        for name in self.written:
            self.keep_last(name, 0)
