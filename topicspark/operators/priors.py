"""Priors, proposal weights and acceptance ratios as column arithmetic.

Counts of a token's current topic are taken with the token itself left out: `own` is 1 for them, 0 else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicspark.operators.models import Model, Params


def as_prior(n_k: Column, num_tokens: int, p: Params, own: int = 0) -> Column:
    """Asymmetric document prior of a topic with n_k tokens."""
    scale = p.alpha * p.num_topics / (num_tokens - 1 + p.alpha_as * p.num_topics)
    return (n_k - own + p.alpha_as) * scale


def word_topic_prob(n_kw: Column, n_k: Column, p: Params, own: int = 0) -> Column:
    """Weight of a topic in the word proposal."""
    return (n_kw - own + p.beta) / (n_k - own + p.num_terms * p.beta)


def doc_topic_prob(n_dk: Column, n_k: Column, num_tokens: int, p: Params, own: int = 0) -> Column:
    """Weight of a topic in the document proposal."""
    return n_dk - own + as_prior(n_k, num_tokens, p, own)


def token_topic_prob(n_kw: Column, n_dk: Column, n_k: Column, num_tokens: int, p: Params, own: int = 0) -> Column:
    """Weight of a topic for a token."""
    return word_topic_prob(n_kw, n_k, p, own) * doc_topic_prob(n_dk, n_k, num_tokens, p, own)


def prior_table(topic_totals: DataFrame, num_tokens: int, p: Params) -> DataFrame:
    """(topic, prior, prior_own): the prior of every topic, without and with a token of its own left out."""
    n_k = F.col("cnt")
    return topic_totals.select(
        "topic", as_prior(n_k, num_tokens, p).alias("prior"), as_prior(n_k, num_tokens, p, 1).alias("prior_own")
    )


def with_counts(
    df: DataFrame, topic: str, doc_topics: DataFrame, term_topics: DataFrame, topic_totals: DataFrame, suffix: str
) -> DataFrame:
    """Add n_dk, n_kw and n_k of the topic column, 0 where the counters have no row.

    The counters of a document, and of a term, come as one map each, so rows that lie by document stay there; a map is
    looked up right after its join and goes no further.
    """
    k = topic_totals.select(F.col("topic").alias(topic), F.col("cnt").alias(f"n_k{suffix}"))
    joined = df
    for counts, key, name in ((doc_topics, "doc_id", f"n_dk{suffix}"), (term_topics, "term_id", f"n_kw{suffix}")):
        n = F.coalesce(F.try_element_at("_held", F.col(topic)), F.lit(0).cast(counts.schema["cnt"].dataType))
        joined = joined.join(count_maps(counts, key), key, "left").withColumn(name, n).drop("_held")
    return joined.join(F.broadcast(k), topic)  # k has one row per topic


def count_maps(counts: DataFrame, key: str) -> DataFrame:
    """(key, _held): the counts of each document, or term, as a map by topic. A join hashes them and leaves the other rows' order."""
    held = F.map_from_entries(F.collect_list(F.struct("topic", "cnt"))).alias("_held")
    return counts.filter(F.col("topic").isNotNull()).groupBy(key).agg(held).hint("shuffle_hash")


def mh_acceptance(
    tokens: DataFrame,
    doc_topics: DataFrame,
    term_topics: DataFrame,
    topic_totals: DataFrame,
    num_tokens: int,
    p: Params,
) -> DataFrame:
    """Acceptance probability of tokens (doc_id, term_id, occ, topic, proposal, by_doc).

    by_doc tells whether the document proposal drew the new topic; else it was the word proposal. A
    proposal of the current topic is accepted. The counters of a document, and of a term, come as one map each, so both
    topics are looked up in one join; and right after it, so no map goes on to the next.
    """

    sides = (("topic", "_cur"), ("proposal", "_new"))
    both = tokens
    for counts, key, name in ((doc_topics, "doc_id", "n_dk"), (term_topics, "term_id", "n_kw")):
        held = {f"{name}{suffix}": F.coalesce(F.try_element_at("_held", F.col(topic)), F.lit(0)) for topic, suffix in sides}
        both = both.join(count_maps(counts, key), key, "left").withColumns(held).drop("_held")
    for topic, suffix in sides:
        n_k = topic_totals.select(F.col("topic").alias(topic), F.col("cnt").alias(f"n_k{suffix}"))
        both = both.join(F.broadcast(n_k), topic)  # one row per topic
    cur = [F.col(f"{c}_cur") for c in ("n_kw", "n_dk", "n_k")]
    new = [F.col(f"{c}_new") for c in ("n_kw", "n_dk", "n_k")]
    q_cur = F.when(F.col("by_doc"), doc_topic_prob(cur[1], cur[2], num_tokens, p, 1)).otherwise(
        word_topic_prob(cur[0], cur[2], p, 1)
    )
    q_new = F.when(F.col("by_doc"), doc_topic_prob(new[1], new[2], num_tokens, p)).otherwise(
        word_topic_prob(new[0], new[2], p)
    )
    ratio = (token_topic_prob(*new, num_tokens, p) * q_cur) / (token_topic_prob(*cur, num_tokens, p, 1) * q_new)
    accept = F.when(F.col("proposal") == F.col("topic"), F.lit(1.0)).otherwise(F.least(F.lit(1.0), ratio))
    return both.select("doc_id", "term_id", "occ", "topic", "proposal", accept.alias("acceptance"))


def term_cdf(model: Model) -> DataFrame:
    """(term_id, topic, cdf): running sum over the topics of n_kw / (n_k + V beta)."""
    p = model.params
    totals = model.topic_total.withColumnRenamed("cnt", "n_k")
    weight = F.col("cnt") / (F.col("n_k") + p.num_terms * p.beta)
    running = Window.partitionBy("term_id").orderBy("topic").rowsBetween(Window.unboundedPreceding, 0)
    # totals has one row per topic; a window partition at most as many
    return model.term_topic.join(F.broadcast(totals), "topic").select(
        "term_id", "topic", F.sum(weight).over(running).alias("cdf")
    )


def topic_cdf(model: Model, num_tokens: int) -> DataFrame:
    """(topic, smoothing_cdf, prior_cdf): running sums of beta / (n_k + V beta) and of the document prior."""
    p = model.params
    running = Window.orderBy("topic").rowsBetween(Window.unboundedPreceding, 0)  # one row per topic
    return model.topic_total.select(
        "topic",
        F.sum(p.beta / (F.col("cnt") + p.num_terms * p.beta)).over(running).alias("smoothing_cdf"),
        F.sum(as_prior(F.col("cnt"), num_tokens, p)).over(running).alias("prior_cdf"),
    )


def doc_cdf(doc_topics: DataFrame) -> DataFrame:
    """(doc_id, topic, cdf): running sum of a document's counts over the topics."""
    running = Window.partitionBy("doc_id").orderBy("topic").rowsBetween(Window.unboundedPreceding, 0)
    return doc_topics.select("doc_id", "topic", F.sum("cnt").over(running).alias("cdf"))


def doc_topic_dist(doc_topics: DataFrame) -> DataFrame:
    """(doc_id, topic, prob): counts over their sum per document."""
    total = F.sum("cnt").over(Window.partitionBy("doc_id"))
    return doc_topics.select("doc_id", "topic", (F.col("cnt") / total).alias("prob"))
