"""Model files: tables of our own, and the readable text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.operators.corpus import vocabulary_lookup
from topicspark.operators.models import PARAMS_SCHEMA, Model, Params
from topicspark.operators.report import model_dir, topic_terms_records, topic_totals_report
from topicspark.sources.sinks import write_text
from topicspark.sources.text import long_line_pairs

# Names of the files of a model in text form
TOTALS_FILE = "TopicCounters.txt"
COUNTS_FILE = "TopicTermCounts.txt"
PROBS_FILE = "TopicTermProbs.txt"
RESULTS_FILE = "TestResults.txt"


def restore_params(path: str, num_topics: int = 0, num_terms: int = 0) -> Params:
    """Parameters out of a name such as `LDAModel_0.10_0.01_0.10_258.85_...`."""
    parts = path.rstrip("/").split("/")[-1].split("_")
    alpha, beta, alpha_as, perplexity = (float(x) for x in parts[1:5])
    return Params(num_topics, num_terms, alpha, beta, alpha_as, perplexity)


def restore_topic_totals(spark: SparkSession, path: str, num_topics: int) -> DataFrame:
    """(topic, cnt) from lines `topic count`; a topic without a line has 0."""
    fields = F.split("value", " ")
    stored = spark.read.text(path).select(
        _in_range(fields[0].cast("int"), num_topics).alias("topic"), fields[1].cast("double").alias("cnt")
    )
    topics = spark.range(num_topics).select(F.col("id").cast("int").alias("topic"))
    # from the stored side, so that no line escapes the check
    return stored.groupBy("topic").agg(F.sum("cnt").alias("cnt")).join(topics, "topic", "right").fillna(0.0, ["cnt"])


def _in_range(topic: Column, num_topics: int) -> Column:
    """The topic, or an error where it is not one of 0 .. num_topics - 1."""
    message = F.format_string(f"topic %s is not one of {num_topics}", topic.cast("string"))
    return F.when((topic >= 0) & (topic < num_topics), topic).otherwise(F.raise_error(message).cast("int"))


def restore_term_topic(spark: SparkSession, path: str, vocab: DataFrame, num_topics: int) -> DataFrame:
    """(term_id, topic, cnt) from lines `topic term:count ...`, the terms looked up in today's vocabulary.

    A line of any length is read by as many tasks as it has splits.
    """
    pairs = long_line_pairs(spark, path)
    fields = F.split("pair", ":")
    counts = pairs.select(
        _in_range(F.col("head").cast("int"), num_topics).alias("topic"), fields[0].alias("term"), fields[1].cast("double").alias("cnt")
    )
    return vocabulary_lookup(counts, vocab).filter("cnt > 0").select("term_id", "topic", "cnt")


def load_text_model(spark: SparkSession, path: str, vocab: DataFrame, num_topics: int, num_terms: int) -> Model:
    """A model from its text files. `path` is the prefix of their names."""
    return Model(
        restore_term_topic(spark, path + COUNTS_FILE, vocab, num_topics),
        restore_topic_totals(spark, path + TOTALS_FILE, num_topics),
        restore_params(path, num_topics, num_terms),
    )


def write_topic_terms(
    model: Model, vocab: DataFrame, path: str, decimals: int = 2, probs: bool = False, single_file: bool = False
) -> None:
    """Write the lines `topic term:value ...`, largest value first, without a row per line.

    The files one after another, in the order of their names, are the text; a long line goes on from one file to the next.
    Tasks write their range of the sorted pairs as they come; a single file is written by one task that holds no line.
    """
    records = topic_terms_records(model, vocab, decimals, probs).sort("topic", "rank").select("value")
    (records.coalesce(1) if single_file else records).write.mode("overwrite").option("lineSep", " ").text(path)


def save_model(model: Model, vocab: DataFrame, path: str, reports: bool = True, single_file: bool = False) -> str:
    """Write the tables, and with `reports` the text form beside them. Returns the folder."""
    folder = f"{path.rstrip('/')}/{model_dir(model.params)}"
    spark = vocab.sparkSession
    vocabulary_lookup(model.term_topic, vocab).select("term_id", "term", "topic", "cnt").write.mode(
        "overwrite"
    ).parquet(f"{folder}/term_topic")
    model.topic_total.write.mode("overwrite").parquet(f"{folder}/topic_total")
    spark.createDataFrame([tuple(model.params)], PARAMS_SCHEMA).write.mode("overwrite").parquet(f"{folder}/params")
    if reports:
        write_text(topic_totals_report(model).select("value"), f"{folder}/{TOTALS_FILE}", single_file)
        write_topic_terms(model, vocab, f"{folder}/{COUNTS_FILE}", 2, single_file=single_file)
        write_topic_terms(model, vocab, f"{folder}/{PROBS_FILE}", 8, probs=True, single_file=single_file)
    return folder


def load_model(spark: SparkSession, folder: str, vocab: DataFrame | None = None) -> Model:
    """A model from its tables; with a vocabulary its terms get that vocabulary's ids, unknown ones are dropped."""
    params = Params(*spark.read.schema(PARAMS_SCHEMA).parquet(f"{folder}/params").first())
    stored = spark.read.schema("term_id int, term string, topic int, cnt double").parquet(f"{folder}/term_topic")
    if vocab is not None:
        stored = vocabulary_lookup(stored.drop("term_id"), vocab)
    totals = spark.read.schema("topic int, cnt double").parquet(f"{folder}/topic_total")
    checked = _in_range(F.col("topic"), params.num_topics).alias("topic")
    return Model(stored.select("term_id", checked, "cnt"), totals, params)
