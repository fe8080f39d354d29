"""Bags of words from raw text, and their token view."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.functions.ranking import dense_index
from topicspark.functions.rows import spread
from topicspark.functions.text import words
from topicspark.session import Workspace


class Corpus(NamedTuple):
    vocab: DataFrame  # term_id int, term string
    bow: DataFrame  # doc_id bigint, term_id int, cnt bigint


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, term, cnt) of every word in every document."""
    exploded = spread(docs, words(F.col("text")), "term", "doc_id")
    return exploded.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("cnt"))


def build_vocab(docs: DataFrame, min_count: int = 1) -> DataFrame:
    """(term_id, term) of all terms, ids in the order of the terms; with min_count only of those seen as often."""
    kept = (
        spread(docs, words(F.col("text")), "term")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("_total"))
        .filter(F.col("_total") >= min_count)
        .select("term")
    )
    indexed = dense_index(kept, [F.col("term")], "term_id")
    return indexed.select(F.col("term_id").cast("int").alias("term_id"), "term")


def build_corpus(docs: DataFrame, min_count: int = 1, space: Workspace | None = None) -> Corpus:
    """Vocabulary and bag of words of `docs(doc_id, text)`.

    The words are read twice, once per term and once per (document, term): both passes aggregate
    before their shuffle, and nothing of the corpus's size is kept in between. The vocabulary is
    written as a table, so Spark knows its size when it picks the join on the word: a small one is
    broadcast; else a word that fills a large part of the pairs is split by the adaptive skew join.
    """
    space = space or Workspace(docs.sparkSession)
    vocab = space.store(build_vocab(docs, min_count), "vocab")
    return Corpus(vocab, to_bow(word_counts(docs), vocab))


def to_bow(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Term strings to ids; terms outside the vocabulary are dropped."""
    return counts.join(vocab, "term").select("doc_id", "term_id", "cnt")


def bow_lines(bow: DataFrame) -> DataFrame:
    """Render as `docId term:count ...`, terms in order: one line per document."""
    pairs = F.sort_array(F.collect_list(F.struct("term_id", "cnt")))
    rendered = F.transform(pairs, lambda p: F.concat_ws(":", p["term_id"], p["cnt"]))
    lines = bow.groupBy("doc_id").agg(F.array_join(rendered, " ").alias("_terms"))
    return lines.select(F.concat_ws(" ", "doc_id", "_terms").alias("value"))


def positive(df: DataFrame, column: str = "cnt") -> DataFrame:
    """Rows whose value is above 0."""
    return df.filter(F.col(column) > 0)


def tokens(bow: DataFrame, block: int = 4096) -> DataFrame:
    """One row (doc_id, term_id, occ) per occurrence, occ = 0 .. cnt-1, by way of blocks: no array is longer than one."""
    zero = F.lit(0).cast("bigint")
    first = F.explode(F.sequence(zero, F.col("cnt") - 1, F.lit(block).cast("bigint"))).alias("_first")
    parts = positive(bow).select("doc_id", "term_id", "cnt", first)
    last = F.least(F.col("_first") + block, "cnt") - 1
    return parts.select("doc_id", "term_id", F.explode(F.sequence("_first", last)).alias("occ"))


def vocabulary_lookup(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add the term to a frame with `term_id`, or the term id to a frame with `term`.

    A term listed twice in the vocabulary means its first id.
    """
    if "term_id" in df.columns:
        return df.join(vocab, "term_id")
    return df.join(vocab.groupBy("term").agg(F.min("term_id").alias("term_id")), "term")
