"""Sums over the topics of a token, in columns: a sweep with frozen counters, and perplexity."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.functions.draws import draw_bits
from topicspark.functions.rows import spread
from topicspark.operators.counters import edge_tokens
from topicspark.operators.models import Params
from topicspark.operators.priors import token_topic_prob

FEW = 256  # up to so many topics, a term's weights are an array of all of them
UNROLLED = 16  # up to so many topics, a token's weights and sums are written out, for a lambda is not compiled


def _totals(topic_totals: DataFrame, num_topics: int) -> list[float]:
    """The tokens of each topic; one number per topic reaches the driver."""
    n_k = [0.0] * num_topics
    for row in topic_totals.collect():
        n_k[row["topic"]] = float(row["cnt"])
    return n_k


def _map(entries: Column) -> Column:
    return F.map_from_entries(F.collect_list(entries))


def frozen_sweep(
    edges: DataFrame, doc_topics: DataFrame, term_topics: DataFrame, topic_totals: DataFrame, num_tokens: int, p: Params, seed: int, it: int
) -> DataFrame:
    """(doc_id, term_id, occ, topic, new): a topic for each token, drawn from its weights over all topics.

    All counters stay as they are, only the token itself is left out of them. The weights are added up in the order of the
    topics, and the new topic is the first whose sum reaches the token's draw. A document's and a term's counters come as one
    map or array each to the edges, whose tokens become rows after the joins; so only edges are shuffled, and no row per token and
    topic is made. Where they lie in the order of the documents, what they carry to the second join is compressed well.
    """
    totals, few = _totals(topic_totals, p.num_topics), p.num_topics <= UNROLLED
    n_k = F.array(*map(F.lit, totals))
    held = []
    for counts, key, name in ((doc_topics, "doc_id", "_d"), (term_topics, "term_id", "_w")):
        by_topic = counts.groupBy(key).agg(_map(F.struct("topic", "cnt")).alias(name))
        if few:
            every = F.array(*[F.coalesce(F.try_element_at(name, F.lit(k)), F.lit(0)) for k in range(p.num_topics)])
            by_topic = by_topic.withColumn(name, every)
        held.append(by_topic.hint("shuffle_hash"))
    met = edges.select("doc_id", "term_id", "block", "topics").join(held[0], "doc_id").join(held[1], "term_id")
    tokens = edge_tokens(met, keep=("_d", "_w"))
    draw = draw_bits(seed, it, F.col("doc_id"), F.col("term_id"), F.col("occ")) / F.lit(float(1 << 52))

    def of(w: Column, d: Column, n: Column, k: Column) -> Column:
        plain, own = (token_topic_prob(w, d, n, num_tokens, p, x) for x in (0, 1))
        return F.when(k == F.col("topic"), own).otherwise(plain)

    if few:
        topics = range(p.num_topics)
        weights = F.array(*[of(F.get("_w", F.lit(k)), F.get("_d", F.lit(k)), F.lit(totals[k]), F.lit(k)) for k in topics])
        told = tokens.select("doc_id", "term_id", "occ", "topic", weights.alias("_weights"), draw.alias("_draw"))
        sums = [F.get("_weights", F.lit(0))]
        for k in topics[1:]:
            sums.append(sums[-1] + F.get("_weights", F.lit(k)))
        told = told.select("doc_id", "term_id", "occ", "topic", F.array(*sums).alias("_sums"), "_draw")
        goal, new = F.col("_draw") * F.get("_sums", F.lit(p.num_topics - 1)), F.lit(-1)
        for k in reversed(topics):
            new = F.when(F.get("_sums", F.lit(k)) >= F.col("_goal"), F.lit(k)).otherwise(new)
        return told.withColumn("_goal", goal).select("doc_id", "term_id", "occ", "topic", new.alias("new"))

    topics = F.sequence(F.lit(0), F.lit(p.num_topics - 1))

    def weight(k: Column) -> Column:
        w, d = (F.coalesce(F.try_element_at(F.col(c), k), F.lit(0)) for c in ("_w", "_d"))
        return of(w, d, F.get(n_k, k), k)

    told = tokens.select("doc_id", "term_id", "occ", "topic", F.transform(topics, weight).alias("_weights"), draw.alias("_draw"))
    goal = F.col("_draw") * F.aggregate("_weights", F.lit(0.0), lambda a, w: a + w)
    told = told.withColumn("_goal", goal)

    def step(a: Column, w: Column) -> Column:
        reached = (a["new"] < 0) & (a["sum"] + w >= F.col("_goal"))
        return F.struct((a["sum"] + w).alias("sum"), (a["k"] + 1).alias("k"), F.when(reached, a["k"]).otherwise(a["new"]).alias("new"))

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("k"), F.lit(-1).alias("new"))
    return told.select("doc_id", "term_id", "occ", "topic", F.aggregate("_weights", start, step)["new"].alias("new"))


def log_likelihood(edges: DataFrame, term_topics: DataFrame, topic_totals: DataFrame, p: Params, compat: bool = False) -> DataFrame:
    """(loglik, num_tokens), one row: the tokens' log-likelihood under the smoothed counters with a symmetric alpha.

    A token's sum over all topics has three parts: the topics that document and term share, one part per document, and one
    per term; so only topics with counts are looked at. A document's counters meet its edges inside a shard, and a term's
    counters come once to each shard that holds it, so no row of edges is shuffled with counters beside it, and `planned_by_shard`
    lets Spark leave the edges where they are. The sum is exact to 12 places of each edge, whatever the order. compat: see `perplexity`.
    """
    if "shard" not in edges.columns:
        slots = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        edges = edges.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int")).repartition(slots, "shard")
    n_k = _totals(topic_totals, p.num_topics)
    scale = F.array(*[F.lit(1.0 / (n + p.num_terms * p.beta)) for n in n_k])

    def counts(rows: DataFrame, *keys: str) -> DataFrame:
        """With `_n`, the counts by topic in the order of the topics."""
        return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("topic", "cnt"))).alias("_n"))

    def over(factor: float) -> Column:
        return F.aggregate("_n", F.lit(0.0), lambda a, x: a + x["cnt"] * F.get(scale, x["topic"])) * factor

    held = spread(edges, F.col("topics"), "topic", "shard", "doc_id").groupBy("shard", "doc_id", "topic").agg(F.count(F.lit(1)).alias("cnt"))
    length = F.aggregate("_n", F.lit(0).cast("bigint"), lambda a, x: a + x["cnt"])
    docs = counts(held, "shard", "doc_id").select("shard", "doc_id", length.alias("n_d"), over(p.beta).alias("doc_part"), F.col("_n").alias("_d"))
    weights = F.map_from_entries(F.transform("_n", lambda x: F.struct(x["topic"], x["cnt"] * F.get(scale, x["topic"]))))
    terms = counts(term_topics, "term_id").select("term_id", over(p.alpha).alias("term_part"), weights.alias("_w"))
    if p.num_topics <= FEW:  # then an array of all topics is shorter to search
        every = F.transform(F.sequence(F.lit(0), F.lit(p.num_topics - 1)), lambda k: F.coalesce(F.try_element_at("_w", k), F.lit(0.0)))
        terms = terms.withColumn("_w", every)
    sent = edges.select("shard", "term_id").distinct().join(terms, "term_id")
    pairs = edges.select("shard", "doc_id", "term_id", F.size("topics").alias("cnt"))
    pairs = pairs.join(docs.hint("shuffle_hash"), ["shard", "doc_id"]).join(sent.hint("shuffle_hash"), ["shard", "term_id"])

    def weight(topic: Column) -> Column:
        return F.get("_w", topic) if p.num_topics <= FEW else F.coalesce(F.try_element_at("_w", topic), F.lit(0.0))

    shared = F.aggregate("_d", F.lit(0.0), lambda a, x: a + x["cnt"] * weight(x["topic"]))
    rest = p.alpha * p.beta * sum(1.0 / (n + p.num_terms * p.beta) for n in n_k)
    sums = pairs.select("cnt", "n_d", (shared + F.col("doc_part") + F.col("term_part") + F.lit(rest)).alias("p"))
    length = F.col("n_d") + p.num_topics * p.alpha
    prob = F.col("p") * (1 + 1 / length) if compat else F.col("p") / length
    told = (F.col("cnt") * F.log(prob)).cast("decimal(38,12)")
    return sums.agg(F.sum(told).cast("double").alias("loglik"), F.sum("cnt").alias("num_tokens"))


@contextmanager
def planned_by_shard(spark: SparkSession) -> Iterator[None]:
    """For jobs planned inside: rows that lie by shard stay there for a join on shard and a further key."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
