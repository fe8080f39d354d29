"""Trained models as tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.operators.counters import accumulate, average_counters, topic_total

EMPTY_PERPLEXITY = 9999999.0


class Params(NamedTuple):
    num_topics: int
    num_terms: int
    alpha: float = 0.1
    beta: float = 0.01
    alpha_as: float = 1.0
    perplexity: float = EMPTY_PERPLEXITY
    total_iter: int = 0
    burn_in: int = 0


PARAMS_SCHEMA = (
    "num_topics int, num_terms int, alpha double, beta double, alpha_as double, perplexity double, "
    "total_iter int, burn_in int"
)


class Model(NamedTuple):
    term_topic: DataFrame  # term_id int, topic int, cnt double; cnt > 0
    topic_total: DataFrame  # topic int, cnt double; one row per topic
    params: Params


def empty_model(spark: SparkSession, num_topics: int, num_terms: int, **params) -> Model:
    counters = spark.createDataFrame([], "term_id int, topic int, cnt double")
    return Model(counters, topic_total(counters, num_topics), Params(num_topics, num_terms, **params))


def model_from_counters(term_topics: DataFrame, params: Params) -> Model:
    """A model whose topic totals are the sums of its term counters."""
    counters = term_topics.select("term_id", "topic", F.col("cnt").cast("double").alias("cnt"))
    return Model(counters, topic_total(counters, params.num_topics), params)


def averaged_model(counters: list[DataFrame], params: Params) -> Model:
    """The mean of several sweeps' counters."""
    return model_from_counters(average_counters(counters), params)


def merge_models(a: Model, b: Model) -> Model:
    """Add the counters of two models; the first one's parameters stay."""
    totals = a.topic_total.unionAll(b.topic_total.select("topic", "cnt"))
    return Model(
        accumulate(a.term_topic, b.term_topic), totals.groupBy("topic").agg(F.sum("cnt").alias("cnt")), a.params
    )


def merge_increment(model: Model, increments: DataFrame) -> Model:
    """Add single counts (term_id, topic, cnt), for one term or many, to a model."""
    counts = increments.select("term_id", "topic", F.col("cnt").cast("double").alias("cnt"))
    return merge_models(model, Model(counts, topic_total(counts, model.params.num_topics), model.params))


def model_stats(model: Model) -> DataFrame:
    """One row: topics, terms, tokens."""
    return model.topic_total.agg(
        F.count(F.lit(1)).cast("int").alias("num_topics"),
        F.lit(model.params.num_terms).alias("num_terms"),
        F.sum("cnt").alias("num_tokens"),
    )
