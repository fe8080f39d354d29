"""Text predicates, readers, sampling."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from topicspark.functions.ranking import dense_index
from topicspark.functions.text import balanced_brackets, first_three_fields
from topicspark.operators import counters as N
from topicspark.operators import sampling as S
from topicspark.operators.corpus import bow_lines, build_corpus, tokens
from topicspark.sources import text
from topicspark.sources.sinks import CSV_OPTIONS, write_rows, write_text


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


@pytest.mark.parametrize(
    "value, expected",
    [
        # Known examples
        ("(if (zero? x) max (/ 1 x))", True),
        ("I told him (that it's not (yet) done).\n(But he wasn't listening)", True),
        (":-)", False),
        ("())(", False),
        ("", True),
        ("no brackets", True),
        ("(" * 500 + ")" * 500, True),
    ],
)
def test_balanced_brackets(spark, value, expected):
    assert lines(spark, value).select(balanced_brackets(F.col("value"))).first()[0] is expected


@pytest.mark.parametrize(
    "value, expected",
    [
        ("a,b,c,d", ("a", "b", "c")),
        ("a,b", (None,) * 3),
        ("a,b,", (None,) * 3),
        ("", (None,) * 3),
        (",,", (None,) * 3),
        (",,c", ("", "", "c")),
        ("a,,c,,", ("a", "", "c")),
    ],
)
def test_first_three_fields(spark, space, value, expected):
    df = lines(spark, value)
    assert tuple(df.select(*first_three_fields(F.col("value"))).first()) == expected
    write_rows(df, space.path("rows"))
    back = spark.read.options(**CSV_OPTIONS).schema("c0 string, c1 string, c2 string").csv(space.path("rows"))
    assert tuple(back.first()) == expected


def test_parse_bow_adds_repeated_terms_before_truncating(spark):
    got = text.parse_bow(lines(spark, "7 0:1 3:2 0:4", "8 1:0.6 1:0.6", "9"), 5).collect()
    assert {tuple(r) for r in got} == {(7, 0, 5), (7, 3, 2), (8, 1, 1)}


def test_parse_bow_rejects_a_term_outside_the_vocabulary(spark):
    with pytest.raises(Exception, match="out of range"):
        text.parse_bow(lines(spark, "7 5:1"), 5).collect()


def test_negative_documents_are_rejected(spark):
    from topicspark.operators.counters import init_topics

    with pytest.raises(Exception, match="negative"):
        init_topics(text.parse_bow(lines(spark, "-1 0:1"), 5), 2, 0).collect()


def test_vocabulary_ids_follow_the_lines_over_many_files(spark, space):
    words = [f"w{i:03d}" for i in range(300)]
    df = spark.createDataFrame([(f"x\t{w}",) for w in words], "value string").repartitionByRange(7, "value")
    write_text(df, space.path("vocab"))
    got = text.read_vocab(spark, space.path("vocab")).orderBy("term_id").collect()
    assert [tuple(r) for r in got] == list(enumerate(words))


def test_num_terms_is_the_sum_of_the_lines(spark, space):
    write_text(lines(spark, "3", " 4 "), space.path("size"))
    assert text.read_num_terms(spark, space.path("size")) == 7
    assert text.read_lines(spark, space.path("size"), 5).rdd.getNumPartitions() >= 2


def test_dense_index_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = dense_index(df, [F.desc("x")], "at").collect()
    assert all(r["at"] == 999 - r["x"] for r in got)


def test_small_corpus(spark):
    docs = spark.createDataFrame([(0, "B a, b! É"), (1, "a b1c é"), (2, "")], "doc_id bigint, text string")
    c = build_corpus(docs, 2)
    assert [tuple(r) for r in c.vocab.orderBy("term_id").collect()] == [(0, "a"), (1, "b"), (2, "é")]
    got = {tuple(r) for r in c.bow.select("doc_id", "term_id", "cnt").collect()}
    assert got == {(0, 0, 1), (0, 1, 2), (0, 2, 1), (1, 0, 1), (1, 1, 1), (1, 2, 1)}
    assert tokens(c.bow).filter("doc_id = 0 and term_id = 1").count() == 2


def test_a_document_is_one_line(spark):
    bow = spark.createDataFrame([(d, t, t + 1) for d, n in ((0, 50), (1, 5)) for t in range(n)], "doc_id bigint, term_id int, cnt bigint")
    rendered = bow_lines(bow)
    assert rendered.count() == 2
    assert {tuple(r) for r in text.parse_bow(rendered, 50).collect()} == {tuple(r) for r in bow.collect()}


def test_tokens_of_a_large_count(spark):
    bow = spark.createDataFrame([(1, 2, 10_001), (1, 3, 1), (2, 2, 0)], "doc_id bigint, term_id int, cnt bigint")
    got = tokens(bow)
    assert got.count() == 10_002 and got.filter("term_id = 2").agg(F.max("occ"), F.countDistinct("occ")).first() == (10_000, 10_001)


def first_by_digest(values, n, seed):
    return sorted(sorted(values, key=lambda v: (hashlib.md5(f"{seed}|{v}".encode()).hexdigest(), v))[:n])


@pytest.mark.parametrize("n", [1, 7, 150, 301, 420, 500, 501, 1000])
@pytest.mark.parametrize("edge", [0, 100_000])
def test_sampling_when_one_line_is_a_third(spark, monkeypatch, n, edge):
    monkeypatch.setattr(S, "EDGE_ROWS", edge)  # 0: as many histograms as there are digits
    values = [f"line {i % 140}" for i in range(334)] + ["the hot line"] * 167
    sample = S.sample_docs(lines(spark, *values).repartition(5), n, 42)
    assert sorted(r[0] for r in sample.collect()) == first_by_digest(values, n, 42)
    assert "TakeOrdered" not in sample._jdf.queryExecution().executedPlan().toString()


def test_sample_needs_a_size(spark):
    with pytest.raises(ValueError):
        S.sample_docs(lines(spark, "a"), 0, 1)


def test_holdout_removes_every_copy(spark):
    values = ["x", "x", "y", "y", "y"]
    train, held = S.holdout_split(lines(spark, *values), 1, 3)
    (kept,) = [r[0] for r in held.collect()]
    assert sorted(r[0] for r in train.collect()) == [v for v in values if v != kept]


def test_select_docs_compares_text(spark):
    df = lines(spark, "1 0:1", "01 0:1", "12 0:1", "1")
    assert {r[0] for r in S.select_docs(df, ["1"]).collect()} == {"1 0:1", "1"}
    ids = spark.createDataFrame([("1",), ("1",), ("12",)], "i string")
    assert sorted(r[0] for r in S.select_docs(df, ids).collect()) == ["1", "1 0:1", "12 0:1"]


def test_sample_and_select_is_distinct_only_with_ids(spark):
    df = lines(spark, "1 a", "1 a", "2 b")
    assert S.sample_and_select(df, 3, 1).count() == 3
    assert sorted(r[0] for r in S.sample_and_select(df, 3, 1, ["2"]).collect()) == ["1 a", "2 b"]


def test_long_lines_are_read_in_splits(spark, space):
    """Heads, pairs and line ends on both sides of every split, and a text that goes on in the next file."""
    made = [f"{t} " + " ".join(f"w{t}x{i}:{i % 7}.00" for i in range(t * 300)) for t in range(6)]
    whole = "\n".join(made) + "\n"
    want = {(str(t), f"w{t}x{i}:{i % 7}.00") for t in range(6) for i in range(t * 300)}
    folder = space.path("long")
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.option("lineSep", "\n").text(folder)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("200", "1777", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            rows = text.long_line_pairs(spark, folder).collect()
            assert {tuple(r) for r in rows} == want and len(rows) == len(want)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_no_line_is_split_again_for_each_pair(spark):
    """The split of a line lies below the explode, not beside it."""
    rows = lines(spark, "1 0:2 1:3")
    plan = text.parse_bow(rows, 5)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert "split(substr(value" not in above and "split(substr(value" in plan


@pytest.mark.parametrize("topics", [1, 2, 7, 8, 16, 32])
def test_a_topic_is_the_remainder_of_the_draw(spark, topics):
    """By the last digit or by all of them; rows of few and of many occurrences draw alike."""
    bow = spark.createDataFrame([(d, t, c) for d, t, c in zip(range(60), range(60), [1, 2, 3, 4, 5, 9] * 10)], "doc_id bigint, term_id int, cnt bigint")
    for r in N.init_topics(bow, topics, 42).collect():
        texts = [f"42|0|{r['doc_id']}|{r['term_id']}|{i}" for i in range(len(r["topics"]))]
        assert r["topics"] == [int(hashlib.md5(t.encode()).hexdigest()[:13], 16) % topics for t in texts]
        assert len(texts) == [1, 2, 3, 4, 5, 9][r["doc_id"] % 6]
    plan = N.init_topics(bow, topics, 42)._jdf.queryExecution().optimizedPlan().toString()
    assert ("conv(" in plan) == (topics in (7, 32))
