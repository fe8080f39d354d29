"""Readable reports of models and of inferred topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicspark.functions.ranking import dense_index
from topicspark.operators.corpus import positive
from topicspark.operators.models import Model, Params
from topicspark.session import Workspace

PIECE = 4096  # terms of a topic's line that are joined at once


def topics_by_total(model: Model) -> DataFrame:
    """(rank, topic, cnt), largest total first; ties by topic. One row per topic."""
    rank = F.row_number().over(Window.orderBy(F.desc("cnt"), "topic")) - 1
    return model.topic_total.select(rank.cast("bigint").alias("rank"), "topic", "cnt")


def topic_totals_report(model: Model) -> DataFrame:
    """(rank, value): lines `topic count`, largest first."""
    return topics_by_total(model).select("rank", F.format_string("%d %.2f", "topic", "cnt").alias("value")).orderBy(
        "rank"
    )


def top_terms(model: Model, vocab: DataFrame, n: int) -> DataFrame:
    """(topic, rank, term, cnt): the n most frequent terms of each topic; ties by term.

    Spark keeps n rows per topic, and those tied with the last, in each task before the shuffle; only these get their names.
    """
    tied = F.rank().over(Window.partitionBy("topic").orderBy(F.desc("cnt")))
    named = positive(model.term_topic).withColumn("_tied", tied).filter(F.col("_tied") <= n).drop("_tied").join(vocab, "term_id")
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("cnt"), "term"))
    return named.withColumn("rank", rank).filter(F.col("rank") <= n).select("topic", "rank", "term", "cnt")


def topic_terms_table(model: Model, vocab: DataFrame, probs: bool = False) -> DataFrame:
    """(topic, rank, term_id, term, value) of every term of every topic, largest first from rank 0, ties by term id.

    With probs the value is the count over the topic's total. The ranks come from one distributed sort.
    """
    topics = positive(model.topic_total).withColumnRenamed("cnt", "total")  # one row per topic
    value = F.col("cnt") / F.col("total") if probs else F.col("cnt")
    valued = (
        positive(model.term_topic)
        .join(F.broadcast(topics), "topic")
        .select("topic", "term_id", value.alias("value"))
        .join(vocab, "term_id")
    )
    ranked = dense_index(valued, [F.col("topic"), F.desc("value"), F.col("term_id")], "place")
    firsts = ranked.groupBy("topic").agg(F.min("place").alias("first"))  # one row per topic
    rank = (F.col("place") - F.col("first")).alias("rank")
    return ranked.join(F.broadcast(firsts), "topic").select("topic", rank, "term_id", "term", "value")


def topic_terms_report(model: Model, vocab: DataFrame, decimals: int = 2, probs: bool = False) -> DataFrame:
    """(topic, value): the table as text, one line `topic term:value ...` per topic, whatever its length.

    A line holds all terms of its topic and so has to fit a task; `topic_terms_table` is the form for any size. It is put
    together from texts of PIECE terms, so no task holds an entry per term of a line.
    """
    table = topic_terms_table(model, vocab, probs)
    text = F.concat(F.col("term"), F.format_string(f":%.{decimals}f", "value")).alias("text")
    piece = F.floor(F.col("rank") / PIECE).alias("piece")
    held = table.select("topic", piece, F.struct("rank", text).alias("entry")).groupBy("topic", "piece").agg(
        F.sort_array(F.collect_list("entry")).alias("terms")
    )
    held = held.select("topic", F.struct("piece", F.array_join(F.col("terms.text"), " ").alias("text")).alias("entry"))
    held = held.groupBy("topic").agg(F.sort_array(F.collect_list("entry")).alias("terms"))
    every = vocab.sparkSession.range(model.params.num_topics).select(F.col("id").cast("int").alias("topic"))
    joined = every.join(held.select("topic", F.array_join(F.col("terms.text"), " ").alias("terms")), "topic", "left")
    return joined.select("topic", F.concat(F.col("topic").cast("string"), F.lit(" "), F.coalesce("terms", F.lit(""))).alias("value"))


def topic_terms_records(model: Model, vocab: DataFrame, decimals: int = 2, probs: bool = False) -> DataFrame:
    """(topic, rank, value): the pieces of the same text, in the order of topic and rank, to be joined by blanks.

    A piece is one `term:value`. The last one of a topic also holds the line's end and the heads of the lines that follow;
    the first piece of all, of rank -1, holds the heads before the first pair. Only a list of the topics is collected.
    """
    table = topic_terms_table(model, vocab, probs)
    space = Workspace(vocab.sparkSession)
    table = space.store(table, "terms")
    counts = {r["topic"]: r["n"] for r in table.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).collect()}
    heads, at = {-1: []}, -1
    for topic in range(model.params.num_topics):
        heads[at].append(str(topic))
        if topic in counts:
            heads[topic], at = [], topic
    tails = [(t, counts[t] - 1, "".join(f"\n{h} " for h in heads[t])[: -1 if heads[t] else None]) for t in counts]
    spark = vocab.sparkSession
    last = F.broadcast(spark.createDataFrame(tails, "topic int, rank bigint, tail string"))  # one row per topic
    pair = F.concat(F.col("term"), F.format_string(f":%.{decimals}f", "value"), F.coalesce("tail", F.lit("")))
    first = spark.createDataFrame([(-1, -1, " \n".join(heads[-1]))], "topic int, rank bigint, value string")
    return table.join(last, ["topic", "rank"], "left").select("topic", "rank", pair.alias("value")).union(first)


def top_topics(dist: DataFrame, n: int) -> DataFrame:
    """(doc_id, rank, topic, prob): the n most probable topics of each document; ties by topic."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("prob"), "topic"))
    return positive(dist, "prob").withColumn("rank", rank).filter(F.col("rank") <= n).select(
        "doc_id", "rank", "topic", "prob"
    )


def row_index(docs: DataFrame) -> DataFrame:
    """Add row_index 0, 1, ... by doc_id."""
    return dense_index(docs, [F.col("doc_id")], "row_index")


def doc_topics_report(dist: DataFrame) -> DataFrame:
    """(row_index, value): lines `rowIndex docId topic:prob ...`, most probable first; ties by topic."""
    entry = F.struct(-F.col("prob"), "topic", F.format_string("%d:%f", "topic", "prob").alias("text"))
    lines = (
        positive(dist, "prob")
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(entry)).alias("topics"))  # at most one entry per topic
        .select("doc_id", F.array_join(F.col("topics.text"), " ").alias("topics"))
    )
    return row_index(lines).select(
        "row_index", F.concat_ws(" ", F.col("row_index").cast("string"), "doc_id", "topics").alias("value")
    )


def model_dir(p: Params) -> str:
    """Folder name with the parameters, four of them rounded to 2 decimals."""
    # Fixed value: the format of a model's name
    return "LDAModel_%.2f_%.2f_%.2f_%.2f_%d_%d_" % (
        p.alpha, p.beta, p.alpha_as, p.perplexity, p.total_iter, p.burn_in
    )
