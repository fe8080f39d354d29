"""Cutting token tables into shards, and bringing each shard the counters it needs.

A shard holds whole documents, and on average at most TOKENS_PER_SHARD tokens: a number of shards that is asked for is the
least one, and more are made where the tokens want them, for a task holds a shard in memory. Small documents are dealt by hash, large ones in
equal stretches of a running sum of their tokens, so no shard gets far more than its part unless one document is that
large. The edges are a bucketed table, one bucket per shard: a sweep reads them where they are, writes them bucketed again,
and shuffles counters only. Each shard gets each of its counters once.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from topicspark.functions.ranking import sum_before
from topicspark.operators.corpus import positive
from topicspark.operators.counters import blocks, uniform_topics
from topicspark.operators.models import Params
from topicspark.plans import kernel
from topicspark.session import Workspace

cloudpickle.register_pickle_by_value(kernel)  # executors need no copy of the package

MIN_SHARDS = 16
TOKENS_PER_SHARD = 1_000_000
COPY_ROWS = 1_000  # shards served by one copy of a counter row
MAX_TASKS = 100_000
LARGE = 64  # a document of more than this part of a shard is dealt by the running sum

EDGE_SCHEMA = "shard int, doc_id bigint, term_id int, block int, topics array<int>, loglik double"
_EDGE_ARROW = pa.schema([
    ("shard", pa.int32()), ("doc_id", pa.int64()), ("term_id", pa.int32()),
    ("block", pa.int32()), ("topics", pa.list_(pa.int32())), ("loglik", pa.float64()),
])
_COUNT_ARROW = pa.schema([("doc_id", pa.int64()), ("topic", pa.int32()), ("cnt", pa.float64())])
_SCORE_ARROW = pa.schema([("loglik", pa.float64())])


class Sharded(NamedTuple):
    """Edges with shards, and which shard needs which terms' counters. All are written tables."""

    edges: DataFrame  # EDGE_SCHEMA, bucketed by shard
    needs: DataFrame  # shard, id, copy
    copies: DataFrame  # id, copies: only ids with more than one
    num_shards: int
    tokens: int
    written: dict | None = None  # what was measured while the edges were written: tokens, loglik


def buckets_of(num_shards: int) -> int:
    return min(num_shards, MAX_TASKS)


def _shard_numbers(spark: SparkSession, num_shards: int) -> DataFrame:
    """(slot, shard): for each slot a number that Spark's hash puts into a bucket of its own, if there are as many."""
    buckets = buckets_of(num_shards)
    every = -(-num_shards // buckets)
    ids = spark.range(64 * num_shards).select(F.col("id").cast("int").alias("shard"))
    bucket = F.pmod(F.hash("shard"), F.lit(buckets))
    listed = ids.groupBy(bucket.alias("bucket")).agg(F.slice(F.sort_array(F.collect_list("shard")), 1, every).alias("shards"))
    placed = listed.select("bucket", F.posexplode("shards").alias("round", "shard"))
    return placed.select((F.col("round") * buckets + F.col("bucket")).alias("slot"), "shard").filter(F.col("slot") < num_shards)


def with_edges(sharded: Sharded, edges: DataFrame, space: Workspace) -> Sharded:
    """The same shards with new edges, written as a table. Their tokens and log-likelihood are summed as they are written."""
    seen = Observation()
    sums = F.sum(F.size("topics")).alias("tokens"), F.sum("loglik").alias("loglik")
    stored = space.store_bucketed(edges.observe(seen, *sums), "edges", "shard", buckets_of(sharded.num_shards))
    return sharded._replace(edges=stored, written={"tokens": seen.get["tokens"] or 0, "loglik": seen.get["loglik"]})


def _sizes(bow: DataFrame, space: Workspace) -> tuple[DataFrame, int]:
    """(doc_id, size) as a table, and the sum of the sizes, found while it is written."""
    seen = Observation()
    sizes = positive(bow).groupBy("doc_id").agg(F.sum("cnt").cast("bigint").alias("size"))
    stored = space.store(sizes.observe(seen, F.sum("size").alias("tokens")), "sizes")
    return stored, seen.get["tokens"] or 0


def large_slots(sizes: DataFrame, tokens: int, num_shards: int) -> DataFrame:
    """(doc_id, packed): the slots of the documents that hold more than 1 / LARGE of a shard.

    Every slot takes an equal stretch of the running sum of their sizes, and so at most one document more than that.
    """
    large = sizes.filter(F.col("size") * LARGE * num_shards > tokens)
    total = large.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    before = sum_before(large, [F.col("doc_id")], "size", "before")
    return before.select("doc_id", F.floor(F.col("before") * (num_shards / max(total, 1))).cast("int").alias("packed"))


def shard_bow(bow: DataFrame, num_topics: int, seed: int, space: Workspace, num_shards: int | None = None) -> Sharded:
    """Cut a bag of words into shards and give every occurrence a uniform topic.

    The topics are drawn after the rows were moved to their shards, so the small rows are shuffled, once. The bag of
    words is read twice, for the documents' sizes and for the rows: it had better be a table. There are `num_shards` shards
    (MIN_SHARDS without), or more if these would hold over TOKENS_PER_SHARD tokens. The tables of shard
    numbers and of large documents are broadcast only where their files' sizes allow.
    """
    spark = bow.sparkSession
    sizes, tokens = _sizes(bow, space)
    count = max(num_shards or MIN_SHARDS, math.ceil(tokens / TOKENS_PER_SHARD))
    numbers = space.store(_shard_numbers(spark, count), "numbers")
    packed = space.store(large_slots(sizes, tokens, count), "packed")
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(count)).cast("int")
    placed = blocks(bow).join(packed, "doc_id", "left").withColumn("slot", F.coalesce("packed", hashed)).join(numbers, "slot")
    placed = placed.repartition(buckets_of(count), "shard").select(
        "shard", "doc_id", "term_id", "block", uniform_topics(num_topics, seed).alias("topics"),
        F.lit(None).cast("double").alias("loglik"),
    )
    bare = with_edges(Sharded(placed, placed, placed, count, int(tokens)), placed, space)
    stored = bare.edges
    ids = stored.select("shard", F.col("term_id").cast("bigint").alias("id")).distinct()
    served = ids.groupBy("id").agg(F.count(F.lit(1)).alias("shards"))
    many = served.filter(F.col("shards") > COPY_ROWS)
    copies = space.store(many.select("id", F.ceil(F.col("shards") / COPY_ROWS).cast("int").alias("copies")), "copies")
    needs = space.store(
        ids.join(copies, "id", "left").select("shard", "id", F.pmod("shard", F.coalesce("copies", F.lit(1))).alias("copy")), "needs"
    )
    return bare._replace(needs=needs, copies=copies)


def pack_counters(counts: DataFrame) -> DataFrame:
    """One row per term with its counts by topic; at most one entry per topic."""
    held = F.collect_list(F.struct("topic", F.col("cnt").cast("double").alias("cnt")))
    return (
        counts.groupBy(F.col("term_id").cast("bigint").alias("id"))
        .agg(held.alias("held"))
        .select("id", F.col("held.topic").alias("topics"), F.col("held.cnt").alias("cnts"))
    )


def run_shards(
    sharded: Sharded,
    term_topics: DataFrame,
    n_k: np.ndarray,
    p: Params,
    task: str,
    seed: int = 0,
    sweep: int = 0,
    sweeps: int = 0,
    keep: int = 0,
    own: bool = True,
    score: bool = False,
    compat: bool = False,
) -> DataFrame:
    """Apply the kernel to every shard. See kernel.run_shard for the tasks. The counters may be packed already.

    The edges lie in buckets by shard already; only the counters are shuffled, to their shards. A counter row wanted
    by very many shards is copied, and each copy serves COPY_ROWS of them, so that no join key is hot.
    """
    packed = term_topics if "cnts" in term_topics.columns else pack_counters(term_topics)
    copied = packed.join(sharded.copies, "id", "left").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))
    )
    counters = sharded.needs.join(copied, ["id", "copy"]).select("shard", "id", "topics", "cnts")
    edges = sharded.edges.select("shard", "doc_id", "term_id", "block", "topics")
    schema, ddl = {
        "infer": (_COUNT_ARROW, "doc_id bigint, topic int, cnt double"),
        "score": (_SCORE_ARROW, "loglik double"),
    }.get(task, (_EDGE_ARROW, EDGE_SCHEMA))
    spec = {
        "task": task, "schema": schema, "n_k": np.asarray(n_k, float), "num_terms": p.num_terms, "alpha": p.alpha,
        "beta": p.beta, "alpha_as": p.alpha_as, "own": int(own), "seed": seed, "sweep": sweep, "sweeps": sweeps,
        "keep": keep, "score": score, "compat": compat,
    }
    return edges.groupBy("shard").cogroup(counters.groupBy("shard")).applyInArrow(kernel.run_shard(spec), ddl)
