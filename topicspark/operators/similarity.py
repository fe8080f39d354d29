"""Similar topics and their merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.operators.counters import relabel

_BLOCK_CELLS = 1 << 22  # cells of a dense block of terms x topics
TILE = 256  # topics in a tile
ENTRIES_PER_TASK = TILE * TILE  # so that a task emits no more rows than it reads entries


def _square(num_topics: int):
    """Per task: the sum over its terms of count x count for every pair of topics a <= b."""
    rows_per_block = max(1, _BLOCK_CELLS // num_topics)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((num_topics, num_topics))
        for batch in batches:
            for first in range(0, batch.num_rows, rows_per_block):
                topics = batch.column("topics").slice(first, rows_per_block)
                counts = batch.column("cnts").slice(first, rows_per_block)
                lengths = topics.value_lengths().to_numpy(zero_copy_only=False)
                dense = np.zeros((len(topics), num_topics))
                row = np.repeat(np.arange(len(topics)), lengths)
                dense[row, topics.flatten().to_numpy()] = counts.flatten().to_numpy()
                gram += dense.T @ dense
        a, b = np.nonzero(np.triu(gram))
        yield pa.RecordBatch.from_pydict(
            {"topic_a": a.astype(np.int32), "topic_b": b.astype(np.int32), "dot": gram[a, b]}
        )

    return run


def _products(width: int):
    """Per task and pair of tiles: the sum over its terms of count x count for every pair of topics a <= b."""
    rows_per_block = max(1, _BLOCK_CELLS // width)

    def dense(topics: pa.ListArray, counts: pa.ListArray) -> np.ndarray:  # in here, so that a task needs no import of this package
        held = np.zeros((len(topics), width))
        row = np.repeat(np.arange(len(topics)), topics.value_lengths().to_numpy(zero_copy_only=False))
        held[row, topics.flatten().to_numpy()] = counts.flatten().to_numpy()
        return held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            a, b = (batch.column(x).to_numpy() for x in ("tile_a", "tile_b"))
            found = set(zip(a.tolist(), b.tolist()))
            for pair in found:
                rows = batch if len(found) == 1 else batch.filter(pa.array((a == pair[0]) & (b == pair[1])))
                gram = grams.setdefault(pair, np.zeros((width, width)))
                for first in range(0, rows.num_rows, rows_per_block):
                    block = rows.slice(first, rows_per_block)
                    left = dense(block.column("topics_a"), block.column("cnts_a"))
                    same = pair[0] == pair[1]
                    gram += left.T @ (left if same else dense(block.column("topics_b"), block.column("cnts_b")))
        for pair, gram in grams.items():
            a, b = np.nonzero(np.triu(gram) if pair[0] == pair[1] else gram)
            yield pa.RecordBatch.from_pydict({
                "topic_a": (a + pair[0] * width).astype(np.int32), "topic_b": (b + pair[1] * width).astype(np.int32), "dot": gram[a, b],
            })

    return run


def partial_products(term_topics: DataFrame, num_topics: int, tasks: int | None = None, width: int = TILE) -> DataFrame:
    """(topic_a, topic_b, dot), a <= b: sums of products over the terms of a task, to be added up.

    The topics are cut into tiles of `width`. A task gets some terms' rows of one pair of tiles and multiplies them into a table
    of width x width, so no task holds or emits topics x topics. An entry is shuffled once per tile, and as a task has
    about ENTRIES_PER_TASK entries, no more rows come out than entries went in, beside one table of topics x topics.
    """
    tiles = -(-num_topics // width)
    pairs_of_tiles = tiles * (tiles + 1) // 2
    schema = "topic_a int, topic_b int, dot double"
    if tasks is None:
        entries = term_topics.count()
        tasks = pairs_of_tiles * max(1, -(-2 * entries // (tiles * ENTRIES_PER_TASK)))
    entry = F.struct(F.pmod("topic", F.lit(width)).alias("topic"), F.col("cnt").cast("double").alias("cnt"))
    gathered = F.collect_list(entry).alias("held")  # at most one entry per topic
    if tiles == 1:
        held = term_topics.groupBy("term_id").agg(gathered)
        if int(term_topics.sparkSession.conf.get("spark.sql.shuffle.partitions")) > tasks:
            held = held.repartition(tasks, "term_id")
        return held.select(F.col("held.topic").alias("topics"), F.col("held.cnt").alias("cnts")).mapInArrow(_square(num_topics), schema)
    tile = F.floor(F.col("topic") / width).cast("int")
    held = term_topics.repartition("term_id").groupBy("term_id", tile.alias("tile")).agg(gathered)
    held = held.select("term_id", F.struct("tile", F.col("held.topic").alias("topics"), F.col("held.cnt").alias("cnts")).alias("a"))
    term = held.groupBy("term_id").agg(F.collect_list("a").alias("tiles"))
    each = term.select("term_id", "tiles", F.explode("tiles").alias("a"))
    both = each.select("term_id", "a", F.explode(F.filter("tiles", lambda b: b["tile"] >= F.col("a.tile"))).alias("b"))
    apart = F.col("a.tile") < F.col("b.tile")  # on the diagonal one side is enough
    rows = both.select(
        "term_id", F.col("a.tile").alias("tile_a"), F.col("b.tile").alias("tile_b"), F.col("a.topics").alias("topics_a"),
        F.col("a.cnts").alias("cnts_a"), F.when(apart, F.col("b.topics")).alias("topics_b"), F.when(apart, F.col("b.cnts")).alias("cnts_b"),
    )
    chunk = F.pmod(F.hash("term_id"), F.lit(-(-tasks // pairs_of_tiles)))
    return rows.repartition(tasks, "tile_a", "tile_b", chunk).drop("term_id").mapInArrow(_products(width), schema)


def topic_similarity(term_topics: DataFrame, num_topics: int, tasks: int | None = None, width: int = TILE) -> DataFrame:
    """(topic_a, topic_b, sim), a < b: cosine of two topics' counts over all terms, where it is not 0.

    What is shuffled follows the entries and the tiles of topics, see partial_products.
    """
    partial = partial_products(term_topics, num_topics, tasks, width)
    gram = partial.groupBy("topic_a", "topic_b").agg(F.sum("dot").alias("dot"))
    square = F.when(F.col("topic_a") == F.col("topic_b"), F.col("dot"))
    # topics x topics rows; the squares, one per topic, are broadcast
    squares = gram.select("topic_a", square.alias("square")).filter("square is not null")
    norm_a = F.broadcast(squares.select("topic_a", F.sqrt("square").alias("norm_a")))
    norm_b = F.broadcast(squares.select(F.col("topic_a").alias("topic_b"), F.sqrt("square").alias("norm_b")))
    return (
        gram.filter("topic_a < topic_b")
        .join(norm_a, "topic_a")
        .join(norm_b, "topic_b")
        .select("topic_a", "topic_b", (F.col("dot") / (F.col("norm_a") * F.col("norm_b"))).alias("sim"))
    )


def min_similar_topic(similarity: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(topic, target): for each topic the smallest one above the threshold, among those smaller than it."""
    near = similarity.filter((F.col("sim") > threshold) & (F.col("topic_a") < F.col("topic_b")))
    return near.groupBy(F.col("topic_b").alias("topic")).agg(F.min("topic_a").alias("target"))


def merge_duplicate_topics(
    edges: DataFrame, term_topics: DataFrame, num_topics: int, threshold: float = 0.95
) -> tuple[DataFrame, dict[int, int]]:
    """(edges with merged topics, map). The map goes one hop: a target that is itself mapped stays a target."""
    pairs = min_similar_topic(topic_similarity(term_topics, num_topics), threshold)
    mapping = {r["topic"]: r["target"] for r in pairs.collect()}  # at most one row per topic
    return (relabel(edges, mapping, num_topics) if mapping else edges), mapping
