"""Token topics and their counters.

edges: one row (doc_id, term_id, block, topics) per run of at most BLOCK_TOKENS occurrences of a term in
a document, so that no row grows with the corpus. Counters are long tables that hold counts above 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspark.functions.draws import uniform_topic
from topicspark.functions.rows import spread
from topicspark.operators.corpus import positive
from topicspark.session import Workspace

BLOCK_TOKENS = 4096
FEW = 4  # up to so many occurrences are drawn one by one


def blocks(bow: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, term_id, block, size): each count cut into runs of at most `block` occurrences."""
    doc_id = F.when(F.col("doc_id") >= 0, F.col("doc_id")).otherwise(
        F.raise_error(F.lit("document ids must not be negative")).cast("bigint")
    )
    numbers = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("cnt") - 1) / block).cast("bigint"))
    size = F.least(F.col("cnt") - F.col("block") * block, F.lit(block)).cast("int")
    return (
        positive(bow)
        .select(doc_id.alias("doc_id"), "term_id", "cnt", F.explode(numbers).alias("block"))
        .select("doc_id", "term_id", F.col("block").cast("int").alias("block"), size.alias("size"))
    )


def uniform_topics(num_topics: int, seed: int, it: int = 0, block: int = BLOCK_TOKENS) -> Column:
    """For a row of `blocks`: an array with a uniform topic per occurrence.

    A lambda is not compiled; most rows have FEW occurrences at most and are drawn without one.
    """
    first = F.col("block").cast("bigint") * block

    def draw(occ: Column) -> Column:
        return uniform_topic(num_topics, seed, it, F.col("doc_id"), F.col("term_id"), occ)

    out = F.when(F.col("size") == 1, F.array(draw(first)))
    for n in range(2, FEW + 1):
        out = out.when(F.col("size") == n, F.array(*[draw(first + i) for i in range(n)]))
    return out.otherwise(F.transform(F.sequence(first, first + F.col("size") - 1), draw))


def init_topics(bow: DataFrame, num_topics: int, seed: int, it: int = 0, block: int = BLOCK_TOKENS) -> DataFrame:
    """Edges with a uniform topic per occurrence. Built within the row: no shuffle."""
    return blocks(bow, block).select(
        "doc_id", "term_id", "block", uniform_topics(num_topics, seed, it, block).alias("topics")
    )


def store_edges(bow: DataFrame, num_topics: int, seed: int, space: Workspace) -> DataFrame:
    """`init_topics` as a table in buckets by document, in their order: counters of documents, and joins on them, need no shuffle.

    The rows are shuffled before they get their topics.
    """
    buckets = int(bow.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = bow.repartition(buckets, "doc_id").sortWithinPartitions("doc_id", "term_id")
    return space.store_bucketed(init_topics(placed, num_topics, seed), "edges", "doc_id", buckets)


def edge_tokens(edges: DataFrame, block: int = BLOCK_TOKENS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row (doc_id, term_id, occ, topic) per occurrence, and the columns `keep` of its edge."""
    return spread(edges, F.col("topics"), "topic", "doc_id", "term_id", "block", *keep, place="pos").select(
        "doc_id", "term_id", (F.col("block").cast("bigint") * block + F.col("pos")).alias("occ"), "topic", *keep
    )


def edges_to_bow(edges: DataFrame) -> DataFrame:
    return edges.groupBy("doc_id", "term_id").agg(F.sum(F.size("topics")).cast("bigint").alias("cnt"))


def edge_topics(edges: DataFrame) -> DataFrame:
    """(doc_id, term_id, topic, n): how many of the occurrences hold the topic."""
    held = spread(edges, F.col("topics"), "topic", "doc_id", "term_id")
    return held.groupBy("doc_id", "term_id", "topic").agg(F.count(F.lit(1)).alias("n"))


def doc_topic(edges: DataFrame) -> DataFrame:
    held = spread(edges, F.col("topics"), "topic", "doc_id")
    return held.groupBy("doc_id", "topic").agg(F.count(F.lit(1)).alias("cnt"))


def term_topic(edges: DataFrame) -> DataFrame:
    held = spread(edges, F.col("topics"), "topic", "term_id")
    return held.groupBy("term_id", "topic").agg(F.count(F.lit(1)).alias("cnt"))


def topic_total(term_topics: DataFrame, num_topics: int) -> DataFrame:
    """(topic, cnt) for all topics; a topic without tokens has 0."""
    sums = term_topics.groupBy("topic").agg(F.sum("cnt").alias("cnt"))
    topics = term_topics.sparkSession.range(num_topics).select(F.col("id").cast("int").alias("topic"))
    zero = F.lit(0).cast(sums.schema["cnt"].dataType)
    return topics.join(sums, "topic", "left").select("topic", F.coalesce("cnt", zero).alias("cnt"))


def num_docs(edges: DataFrame) -> DataFrame:
    return edges.agg(F.countDistinct("doc_id").alias("num_docs"))


def num_tokens(edges: DataFrame) -> DataFrame:
    return edges.agg(F.coalesce(F.sum(F.size("topics")), F.lit(0)).cast("bigint").alias("num_tokens"))


def check_totals(edges: DataFrame, totals: DataFrame) -> DataFrame:
    """One row: tokens on the edges, tokens in the totals, and whether they agree."""
    none = F.lit(None).cast("bigint")
    counted = num_tokens(edges).select("num_tokens", none.alias("total_count"))
    summed = totals.agg(F.sum("cnt").cast("bigint").alias("total_count")).select(none.alias("num_tokens"), "total_count")
    both = counted.unionAll(summed).agg(F.max("num_tokens").alias("num_tokens"), F.max("total_count").alias("total_count"))
    return both.withColumn("ok", F.col("num_tokens") == F.col("total_count"))


def triplets(edges: DataFrame, term_topics: DataFrame, doc_topics: DataFrame) -> DataFrame:
    """(doc_id, term_id, n, topic, n_dk, n_kw): each edge with the topics its document holds.

    n is the number of occurrences; n_kw is 0 where the term does not hold the topic. A document's topics come as two arrays and
    a term's as a map, and only then is there a row per topic: none of these rows is shuffled or sorted.
    """
    sizes = edges_to_bow(edges).withColumnRenamed("cnt", "n")
    held = F.sort_array(F.collect_list(F.struct("topic", "cnt"))).alias("_h")
    docs = doc_topics.groupBy("doc_id").agg(held).select("doc_id", F.col("_h.topic").alias("topic"), F.col("_h.cnt").alias("n_dk"))
    terms = term_topics.groupBy("term_id").agg(F.map_from_entries(F.collect_list(F.struct("topic", "cnt"))).alias("_w"))
    both = sizes.join(docs.hint("shuffle_hash"), "doc_id").join(terms.hint("shuffle_hash"), "term_id", "left").withColumn("_d", F.arrays_zip("topic", "n_dk"))
    each = both.select("doc_id", "term_id", "n", "_w", F.explode("_d").alias("_d"))
    n_kw = F.coalesce(F.try_element_at("_w", F.col("_d.topic")), F.lit(0).cast("bigint"))
    return each.select("doc_id", "term_id", "n", "_d.topic", "_d.n_dk", n_kw.alias("n_kw"))


def relabel(edges: DataFrame, mapping: dict[int, int], num_topics: int) -> DataFrame:
    """Replace topics by the map; topics outside it stay. The map has at most one entry per topic."""
    table = F.array(*[F.lit(mapping.get(k, k)) for k in range(num_topics)])
    return edges.withColumn("topics", F.transform("topics", lambda t: F.coalesce(F.get(table, t), t)))


def accumulate(total: DataFrame, new: DataFrame) -> DataFrame:
    """Sum of two term counters."""
    return total.unionAll(new.select(total.columns)).groupBy("term_id", "topic").agg(F.sum("cnt").alias("cnt"))


def average_counters(counters: list[DataFrame]) -> DataFrame:
    """(term_id, topic, cnt double): mean over the given sweeps; a topic absent from one counts 0 there."""
    stacked = reduce(DataFrame.unionAll, [c.select("term_id", "topic", "cnt") for c in counters])
    mean = F.sum("cnt") / F.lit(float(len(counters)))
    return stacked.groupBy("term_id", "topic").agg(mean.alias("cnt"))


def topic_term(term_topics: DataFrame) -> DataFrame:
    """Term x topic as topic x term. In long form the two differ in the leading column only."""
    return term_topics.select("topic", "term_id", "cnt")
