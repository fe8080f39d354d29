"""Training, inference, merging, model files, jobs."""

from __future__ import annotations

import math
import os
import pathlib

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from jobs import infer as infer_job
from jobs import rows as rows_job
from jobs import sample as sample_job
from jobs import train as train_job
from topicspark.checks import catalog
from topicspark.functions.ranking import sum_before
from topicspark.operators import counters as N
from topicspark.operators import frozen
from topicspark.operators import priors as P
from topicspark.operators import report as R
from topicspark.operators.corpus import bow_lines
from topicspark.operators.frozen import frozen_sweep, log_likelihood
from topicspark.operators.models import Model, Params, averaged_model, model_from_counters
from topicspark.operators.report import topic_terms_report, topic_totals_report
from topicspark.operators.similarity import min_similar_topic, partial_products, topic_similarity
from topicspark.plans import infer as I
from topicspark.plans import shards
from topicspark.plans import train as T
from topicspark.plans.log import Log
from topicspark.sources import models as files
from topicspark.sources import sinks
from topicspark.sources.sinks import write_text
from topicspark.sources.text import read_num_terms, read_vocab
from topicspark.streaming.infer import infer_stream, read_inferred, stream_lines

K, WORDS = 4, 40


@pytest.fixture(scope="module")
def planted(spark):
    """200 documents of about 40 tokens; topic k uses terms 10k .. 10k+9, each document mostly one topic."""
    rng = np.random.default_rng(0)
    rows = []
    for d in range(200):
        main = d % K
        topics = np.where(rng.random(40) < 0.9, main, rng.integers(0, K, 40))
        terms, counts = np.unique(topics * 10 + rng.integers(0, 10, 40), return_counts=True)
        rows += [(d, int(t), int(c)) for t, c in zip(terms, counts)]
    df = spark.createDataFrame(rows, "doc_id bigint, term_id int, cnt bigint").coalesce(4).cache()
    df.count()
    return df


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([(i, f"w{i:02d}") for i in range(WORDS)], "term_id int, term string")


@pytest.fixture(scope="module")
def model(planted):
    return T.train(planted, WORDS, K, 20, 5, 0.1, 0.01, 0.1, seed=7, num_shards=8)


def hot_bow(spark):
    """One document holds a third of all tokens, and one of its terms half of those."""
    rows = [(d, t, 2) for d in range(1, 60) for t in range(d % 5, 40, 5)]
    rest = sum(r[2] for r in rows)
    rows += [(0, 3, rest // 4)] + [(0, t, rest // 4 // 39) for t in range(40) if t != 3]
    return spark.createDataFrame(rows, "doc_id bigint, term_id int, cnt bigint")


def as_set(df):
    return {tuple(r) for r in df.collect()}


def dominant(model: Model) -> np.ndarray:
    counts = np.zeros((WORDS, K))
    for r in model.term_topic.collect():
        counts[r["term_id"], r["topic"]] = r["cnt"]
    return counts


def test_planted_topics_are_found(model):
    counts = dominant(model)
    groups = counts.reshape(K, 10, K).sum(axis=1)  # planted topic x found topic
    assert len(set(groups.argmax(axis=1))) == K
    assert (groups.max(axis=1) / groups.sum(axis=1) > 0.8).all()
    assert model.params.perplexity < 20


def test_inference_finds_the_planted_topic(model, planted):
    found = dominant(model).reshape(K, 10, K).sum(axis=1).argmax(axis=1)
    dist = I.infer(planted, model, seed=3, num_shards=4)
    best = dist.groupBy("doc_id").agg(F.max_by("topic", "prob").alias("topic"), F.sum("prob").alias("total")).collect()
    assert len(best) == 200 and all(abs(r["total"] - 1) < 1e-9 for r in best)
    assert np.mean([r["topic"] == found[r["doc_id"] % K] for r in best]) > 0.97


def test_a_document_is_inferred_alike_alone_and_in_any_shards(spark, model, planted):
    every = [as_set(I.infer(planted, model, seed=3, num_shards=n)) for n in (1, 5, 16)]
    assert every[0] == every[1] == every[2] and len({d for d, _, _ in every[0]}) == 200
    alone = as_set(I.infer(planted.filter("doc_id = 17"), model, seed=3, num_shards=4))
    assert alone == {r for r in every[0] if r[0] == 17}


@pytest.mark.parametrize("files, at_once", [(1, 1), (7, 2), (3, 100)])
def test_a_stream_is_inferred_as_a_table_is(spark, space, model, planted, files, at_once):
    """For any split into files and batches; also when files come later, an old one too, and when a batch fails and is run again."""
    arrived, sink, log = space.path("arrived"), space.path("sink"), space.path("log")
    lines = bow_lines(planted).union(spark.createDataFrame([("900",), ("",)], "value string"))  # no pairs, no document
    lines.filter("not startswith(value, '17 ')").repartition(files).write.text(arrived)
    run = lambda **more: infer_stream(
        stream_lines(spark, arrived, at_once), model, sink, log, seed=3, num_shards=4, space=space, **more
    ).awaitTermination()
    run()
    lines.filter("startswith(value, '17 ')").coalesce(1).write.mode("append").text(arrived)
    late = max(pathlib.Path(arrived).glob("part-*"), key=lambda f: f.stat().st_mtime_ns)
    os.utime(late, (1_000_000_000, 1_000_000_000))
    run()
    run()  # nothing new
    want = as_set(I.infer(planted, model, seed=3, num_shards=5))
    told = read_inferred(spark, sink)
    assert told.count() == len(want) and as_set(told.drop("batch")) == want
    last = told.agg(F.max("batch")).first()[0]
    os.remove(f"{log}/commits/{last}")  # the batch was written, but the driver was lost before it could say so
    for crc in pathlib.Path(log, "commits").glob(f".{last}.crc"):
        os.remove(crc)
    run()
    again = read_inferred(spark, sink)
    assert again.count() == len(want) and as_set(again.drop("batch")) == want
    assert not [f for f in pathlib.Path(space.folder).rglob("edges-*")]  # a batch leaves no tables behind


def test_a_stream_checks_its_lines_and_iterations(spark, space, model):
    write_text(spark.createDataFrame([("1 40:1",)], "value string"), space.path("in"))
    lines = stream_lines(spark, space.path("in"))
    with pytest.raises(ValueError):
        infer_stream(lines, model, space.path("sink"), space.path("log"), 3, 3)
    with pytest.raises(Exception, match="out of range"):
        infer_stream(lines, model, space.path("sink"), space.path("log"), space=space).awaitTermination()


def test_results_of_a_shared_space_stay_readable(spark, space, planted):
    """Two trainings and two inferences that are read later, in one space."""
    models = [T.train(planted, WORDS, K, 2, 1, 0.1, 0.01, 0.1, seed=s, num_shards=4, space=space) for s in (1, 2)]
    waiting = [I.infer(planted, m, 4, 2, seed=1, num_shards=4, space=space) for m in models]
    assert [m.term_topic.agg(F.sum("cnt")).first()[0] for m in models] == [8000.0, 8000.0]
    assert all(d.select("doc_id").distinct().count() == 200 for d in waiting)
    assert as_set(models[0].term_topic) != as_set(models[1].term_topic)


def test_a_sweep_does_not_shuffle_the_edges(spark, planted):
    state = T.start(planted, Params(K, WORDS, 0.1, 0.01, 0.1), 1, 8)
    new = shards.run_shards(state.sharded, state.term_topic, state.n_k, state.params, "train", 1, 1, 1)
    plan = new._jdf.queryExecution().executedPlan().toString()
    edges = plan[: plan.index("topics#")] if "topics#" not in plan else plan
    scan = next(i for i, line in enumerate(edges.splitlines()) if "Bucketed: true" in line)
    above = edges.splitlines()[:scan]
    depth = lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)"))
    # up from the scan to the cogroup, nothing is an exchange
    path, level = [], depth(edges.splitlines()[scan])
    for line in reversed(above):
        if depth(line) < level:
            path.append(line)
            level = depth(line)
        if "FlatMapCoGroups" in line:
            break
    assert path and not any("Exchange" in line for line in path)


def test_same_seed_same_model(planted, model):
    again = T.train(planted.repartition(3), WORDS, K, 20, 5, 0.1, 0.01, 0.1, seed=7, num_shards=8)
    assert as_set(again.term_topic) == as_set(model.term_topic)
    assert again.params == model.params


def test_incremental_training_keeps_topics_and_prior(planted, model):
    more = T.train_incremental(planted, model, total_iter=4, burn_in=2, seed=1, num_shards=8)
    assert (more.params.num_topics, more.params.alpha, more.params.alpha_as) == (K, 0.1, 1.0)
    assert (dominant(more).argmax(axis=1) == dominant(model).argmax(axis=1)).mean() > 0.9


@pytest.mark.parametrize("total, burn", [(5, 5), (5, 0), (0, 0), (3, 4)])
def test_iteration_bounds(planted, model, total, burn):
    with pytest.raises(ValueError):
        T.train(planted, WORDS, K, total, burn)
    with pytest.raises(ValueError):
        T.train_incremental(planted, model, total_iter=total, burn_in=burn)
    with pytest.raises(ValueError):
        I.infer(planted, model, total, burn)


def test_trace_falls(spark, planted):
    state = T.start(planted, Params(K, WORDS, 0.1, 0.01, 0.1), 1, 8)
    before = T.perplexity(state)
    state, trace = T.run_gibbs(state, 6)
    assert [i for i, _ in trace] == list(range(1, 7))
    assert trace[0][1] == pytest.approx(before, rel=1e-12)
    assert T.perplexity(state) < trace[-1][1] * 1.1 < trace[0][1]


def test_hot_document_and_hot_counters(spark, space, monkeypatch):
    """A document of a third of all tokens, and counters that are copied for many shards."""
    monkeypatch.setattr(shards, "COPY_ROWS", 2)
    bow = hot_bow(spark)
    p = Params(3, 40, 0.1, 0.01, 0.1)
    one, many = T.start(bow, p, 5, 1), T.start(bow, p, 5, 7, space)
    assert many.sharded.copies.count() > 0 and one.sharded.copies.count() == 0
    assert T.perplexity(many) == pytest.approx(T.perplexity(one), rel=1e-12)
    after, trace = T.run_gibbs(many, 3)
    assert as_set(N.edges_to_bow(after.edges)) == as_set(bow.filter("cnt > 0"))
    assert trace[0][1] == pytest.approx(T.perplexity(one), rel=1e-12)
    model = model_from_counters(N.term_topic(after.edges), p)
    assert as_set(I.infer(bow, model, 6, 3, 5, 7)) == as_set(I.infer(bow, model, 6, 3, 5, 1))
    warm = T.init_topics_from_model(bow, model, 5, 7)
    assert as_set(N.edges_to_bow(warm.edges)) == as_set(bow.filter("cnt > 0"))


def test_no_shard_holds_over_twice_its_part(spark, space):
    """24 documents of a third of a shard each, which hold all shards' tokens but a third, and 3,000 small ones."""
    rows = [(d, t, 500) for d in range(0, 24_000, 1_000) for t in range(20)]
    rows += [(d, 5, 5) for d in range(1, 4_000) if d % 1_000][:3_000]
    bow = spark.createDataFrame(rows, "doc_id bigint, term_id int, cnt bigint")
    cut = shards.shard_bow(bow, 3, 1, space, 8)
    held = cut.edges.groupBy("shard").agg(F.sum(F.size("topics")).alias("n"), F.countDistinct("doc_id").alias("docs")).collect()
    assert len(held) == 8 and sum(r["n"] for r in held) == cut.tokens == cut.written["tokens"] == 255_000
    assert max(r["n"] for r in held) < 2 * 255_000 / 8
    assert sum(r["docs"] for r in held) == 3_024  # no document is in two shards
    assert as_set(N.edges_to_bow(cut.edges)) == as_set(bow)


def test_sums_before(spark):
    rows = [(i, (i * 7) % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(13)
    got = {r["id"]: r["s"] for r in sum_before(df, [F.col("id")], "v", "s").collect()}
    assert got == {i: sum(v for _, v in rows[:i]) for i, _ in rows}
    assert sum_before(df.limit(0), [F.col("id")], "v", "s").count() == 0


def test_more_shards_than_tasks(spark, planted, monkeypatch):
    p = Params(K, WORDS, 0.1, 0.01, 0.1)
    many = T.gibbs_sweep(T.start(planted, p, 1, 8))
    monkeypatch.setattr(shards, "MAX_TASKS", 3)
    few = T.gibbs_sweep(T.start(planted, p, 1, 8))
    assert as_set(few.term_topic) == as_set(many.term_topic)


def test_empty_topics_have_a_line(spark, model, vocab):
    wide = model._replace(
        topic_total=model.topic_total.unionAll(spark.createDataFrame([(K, 0.0)], "topic int, cnt double")),
        params=model.params._replace(num_topics=K + 1),
    )
    lines = {r["topic"]: r["value"] for r in topic_terms_report(wide, vocab).collect()}
    assert sorted(lines) == list(range(K + 1)) and lines[K] == f"{K} "


def test_large_counts_are_cut_into_blocks(spark):
    bow = spark.createDataFrame([(1, 0, 10_001), (2, 1, 0)], "doc_id bigint, term_id int, cnt bigint")
    edges = N.init_topics(bow, 5, 1)
    assert sorted(r[0] for r in edges.select(F.size("topics")).collect()) == [1809, 4096, 4096]
    assert N.edge_tokens(edges).select("occ").distinct().count() == 10_001
    assert as_set(N.edges_to_bow(edges)) == {(1, 0, 10_001)}


def test_unseen_terms_and_empty_documents(spark, model):
    bow = spark.createDataFrame([(1, 5, 3), (1, 45, 2), (2, 45, 4), (3, 1, 0)], "doc_id bigint, term_id int, cnt bigint")
    wide = model._replace(params=model.params._replace(num_terms=WORDS + 10))
    got = I.infer(bow, wide, seed=1, num_shards=2).groupBy("doc_id").agg(F.sum("prob").alias("p")).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2] and all(abs(r["p"] - 1) < 1e-9 for r in got)


def test_merge_goes_one_hop(spark):
    rows = [(1, 2, 0.99), (2, 3, 0.99), (1, 3, 0.5), (0, 4, 0.96), (1, 4, 0.97)]
    sims = spark.createDataFrame(rows, "topic_a int, topic_b int, sim double")
    assert as_set(min_similar_topic(sims, 0.95)) == {(2, 1), (3, 2), (4, 0)}
    edges = spark.createDataFrame([(1, 1, 0, [3, 2, 1, 0])], "doc_id bigint, term_id int, block int, topics array<int>")
    assert N.relabel(edges, {2: 1, 3: 2}, 4).first()["topics"] == [2, 1, 1, 0]
    assert N.relabel(edges, {2: 1}, 3).first()["topics"] == [3, 1, 1, 0]  # a topic beyond the map stays


@pytest.mark.parametrize("topics, width, tasks", [(70, 16, None), (70, 16, 40), (70, 64, 3), (70, 256, None), (2048, 256, None)])
def test_similarity_by_tiles(spark, topics, width, tasks):
    """Against numpy; a topic without terms, one with a single term, and a term of all topics. No task emits topics x topics."""
    rng = np.random.default_rng(topics)
    dense = np.where(rng.random((300, topics)) < 0.05, rng.integers(1, 9, (300, topics)), 0).astype(float)
    dense[7], dense[:, 3], dense[:, 5] = 1, 0, 0
    dense[9, 5] = 4
    t, k = np.nonzero(dense)
    rows = spark.createDataFrame(zip(t.tolist(), k.tolist(), dense[t, k].tolist()), "term_id int, topic int, cnt double")
    with np.errstate(invalid="ignore"):
        unit = np.nan_to_num(dense / np.linalg.norm(dense, axis=0))
    want = np.triu(unit.T @ unit, 1)
    got = topic_similarity(rows, topics, tasks, width).toPandas()
    found = np.zeros((topics, topics))
    found[got["topic_a"], got["topic_b"]] = got["sim"]
    assert len(got) == (want > 0).sum() and np.allclose(found, want, atol=1e-12)
    if topics == 2048:
        emitted = partial_products(rows, topics, tasks, width)
        sizes = [r["n"] for r in emitted.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) <= len(t) * (topics // width) + topics * topics / 2 and max(sizes) < topics * topics / 8


def test_planted_duplicates_are_merged(spark, planted, model):
    """Topic 1 is split at random over topics 1 and 4."""
    twin = model.term_topic.withColumn("cnt", F.when(F.col("topic") == 1, F.col("cnt") / 2).otherwise(F.col("cnt")))
    twin = twin.unionAll(twin.filter("topic = 1").withColumn("topic", F.lit(4)))
    for tasks in (3, 256):
        assert as_set(min_similar_topic(topic_similarity(twin, 5, tasks), 0.95)) == {(4, 1)}
    state = T.start(planted, Params(K, WORDS, 0.1, 0.01, 0.1), 1, 8)
    merged, mapping = T.merge_duplicate_topics(state, 0.0)
    assert mapping == {1: 0, 2: 0, 3: 0}
    assert list(merged.n_k) == [state.n_k.sum(), 0, 0, 0]
    same, none = T.merge_duplicate_topics(state, 1.0)
    assert none == {} and same is state


def test_a_sweep_is_checked_by_its_own_write(spark, planted, monkeypatch):
    """Tokens and log-likelihood come with the edges; a sampler that drops a document stops the sweep."""
    state = T.gibbs_sweep(T.start(planted, Params(K, WORDS, 0.1, 0.01, 0.1), 1, 8), 1, score=True)
    told = state.edges.agg(F.sum(F.size("topics")), F.sum("loglik")).first()
    assert state.sharded.written == {"tokens": told[0], "loglik": pytest.approx(told[1], rel=1e-12)}
    run = T.run_shards
    monkeypatch.setattr(T, "run_shards", lambda *a, **k: run(*a, **k).filter("doc_id != 17"))
    with pytest.raises(RuntimeError, match="were written"):
        T.gibbs_sweep(state, 1)


def test_a_lost_token_is_noticed(spark, planted):
    state = T.start(planted, Params(K, WORDS, 0.1, 0.01, 0.1), 1, 8)
    with pytest.raises(RuntimeError, match="tokens"):
        T._counted(state.sharded._replace(tokens=int(state.n_k.sum()) + 1), state.params, 1, 1, state.space)


def test_perplexity_in_columns_is_the_kernel_s(spark, planted):
    state = T.gibbs_sweep(T.start(planted, Params(K, WORDS, 0.1, 0.01, 0.1), 3, 8))
    for compat in (False, True):
        scores = shards.run_shards(state.sharded, state.term_topic, state.n_k, state.params, "score", compat=compat)
        want = math.exp(-scores.agg(F.sum("loglik")).first()[0] / state.n_k.sum())
        assert T.perplexity(state, compat) == pytest.approx(want, rel=1e-12)
    told = log_likelihood(state.edges, state.term_topic, N.topic_total(state.term_topic, K), state.params)
    assert "Arrow" not in told._jdf.queryExecution().toString()


def test_a_frozen_sweep_follows_the_weights(spark):
    """Two terms, each all of one topic, in documents of one topic each: new topics go to the own ones in nearly all draws."""
    rows = [(d, t, 40) for d in range(20) for t in range(2) if d % 2 == t]
    edges = N.init_topics(spark.createDataFrame(rows, "doc_id bigint, term_id int, cnt bigint"), 1, 1)
    edges = edges.withColumn("topics", F.transform("topics", lambda t: (t + F.col("term_id")).cast("int")))
    tt, dt = N.term_topic(edges), N.doc_topic(edges)
    moved = frozen_sweep(edges, dt, tt, N.topic_total(tt, 3), 800, Params(3, 2, 0.1, 0.01, 0.1), 7, 1).collect()
    assert len(moved) == 800 and all(0 <= r["new"] < 3 for r in moved)
    assert sum(r["new"] == r["topic"] for r in moved) > 780


class _Stopped(Exception):
    pass


@pytest.mark.parametrize("stop", ["warm", "averaged", "between"])
def test_a_stopped_training_goes_on(spark, space, planted, monkeypatch, stop):
    """Stopped after a sweep, while averaging, or when edges were written and counters were not; then resumed elsewhere."""
    options = dict(num_topics=K, total_iter=5, burn_in=2, alpha=0.1, beta=0.01, alpha_as=0.1, seed=9, num_shards=8)
    want = T.train(planted, WORDS, **options)
    log = space.path("log")
    add, counted = Log.add, T._counted

    def stopping(self, number, facts, tables):
        add(self, number, facts, tables)
        if number == {"warm": 2, "averaged": 4}.get(stop):
            raise _Stopped

    def counting(sharded, params, seed, sweep, space):
        if stop == "between" and sweep == 3:
            raise _Stopped
        return counted(sharded, params, seed, sweep, space)

    with monkeypatch.context() as m:
        m.setattr(Log, "add", stopping)
        m.setattr(T, "_counted", counting)
        with pytest.raises(_Stopped):
            T.train(planted, WORDS, log=log, space=space, **options)
    for table in spark.catalog.listTables():  # another session knows no tables
        if table.name.startswith("edges_"):
            spark.sql(f"DROP TABLE `{table.name}`")
    seen = []
    got = T.resume(spark, log, report=lambda i, x: seen.append(i))
    assert seen == {"warm": [3], "averaged": [], "between": [3]}[stop]
    assert as_set(got.term_topic) == as_set(want.term_topic) and as_set(got.topic_total) == as_set(want.topic_total)
    assert got.params._replace(perplexity=0) == want.params._replace(perplexity=0)
    assert got.params.perplexity == pytest.approx(want.params.perplexity, rel=1e-12)
    with pytest.raises(ValueError, match="is done"):
        T.resume(spark, log)
    with pytest.raises(ValueError, match="no sweep"):
        T.resume(spark, space.path("nowhere"))


def test_mean_counts_absent_topics_as_zero(spark):
    a = spark.createDataFrame([(0, 0, 4), (0, 1, 2)], "term_id int, topic int, cnt bigint")
    b = spark.createDataFrame([(0, 0, 6)], "term_id int, topic int, cnt bigint")
    mean = averaged_model([a, b], Params(3, 1))
    assert as_set(mean.term_topic) == {(0, 0, 5.0), (0, 1, 1.0)}
    assert as_set(mean.topic_total) == {(0, 5.0), (1, 1.0), (2, 0.0)}


def test_text_model_reads_back_and_checks_its_topics(spark, space, model, vocab):
    write_text(topic_terms_report(model, vocab, 2).select("value"), space.path("counts"))
    write_text(topic_totals_report(model).select("value"), space.path("totals"))
    back = files.restore_term_topic(spark, space.path("counts"), vocab, K)
    kept = model.term_topic.select("term_id", "topic", F.round("cnt", 2)).filter("`round(cnt, 2)` > 0")
    assert as_set(back) == as_set(kept)
    assert files.restore_topic_totals(spark, space.path("totals"), K).count() == K
    with pytest.raises(Exception, match="is not one of 3"):
        files.restore_term_topic(spark, space.path("counts"), vocab, K - 1).collect()
    with pytest.raises(Exception, match="is not one of 3"):
        files.restore_topic_totals(spark, space.path("totals"), K - 1).collect()


@pytest.mark.parametrize("single", [True, False])
def test_topic_terms_are_written_as_they_come(spark, space, vocab, single):
    """The files joined are the report's lines; topics without terms have a line too."""
    counts = [(t, k, float(1 + (t * k) % 5)) for t in range(WORDS) for k in (1, 2, 5) if (t + k) % 3]
    counts = spark.createDataFrame(counts, "term_id int, topic int, cnt double")
    model = model_from_counters(counts, Params(8, WORDS, 0.1, 0.01, 0.1))
    files.write_topic_terms(model, vocab, space.path("terms"), single_file=single)
    parts = spark.read.text(space.path("terms"), wholetext=True).select("value", F.col("_metadata.file_path").alias("f"))
    got = "".join(r["value"] for r in parts.sort("f").collect())
    want = [r["value"] for r in topic_terms_report(model, vocab).sort("topic").collect()]
    assert got.rstrip(" ").split("\n") == [*want[:-1], want[-1].rstrip(" ")]
    back = files.restore_term_topic(spark, space.path("terms"), vocab, 8)
    assert as_set(back) == as_set(counts)


def test_a_sweep_that_moves_nothing_fails_the_checks(spark, monkeypatch):
    """The queries about sampling notice a sampler that does nothing."""
    from conftest import SMALL

    monkeypatch.setattr(T, "gibbs_sweep", lambda state, *a, **k: state)
    assert not catalog.gibbs_sweep(spark, SMALL).first()["ok"]
    assert not catalog.save_averaged(spark, SMALL).first()["ok"]


def test_model_round_trip(spark, space, model, vocab):
    folder = files.save_model(model, vocab, space.path("models"))
    back = files.load_model(spark, folder)
    assert as_set(back.term_topic) == as_set(model.term_topic)
    assert as_set(back.topic_total) == as_set(model.topic_total)
    assert back.params == model.params
    named = files.restore_params(folder)
    assert (named.alpha, named.beta, named.alpha_as) == (0.1, 0.01, 0.1)
    assert named.perplexity == pytest.approx(model.params.perplexity, abs=0.0051)


def test_jobs(spark, space, planted, vocab, capsys):
    root = space.path("job")
    write_text(bow_lines(planted), f"{root}/in/CorpusTrain.libsvm")
    write_text(vocab.orderBy("term_id").select(F.concat_ws("\t", "term_id", "term")), f"{root}/in/Corpus.voc")
    write_text(spark.createDataFrame([(str(WORDS),)], "value string"), f"{root}/in/CorpusVocData.size")
    assert read_num_terms(spark, f"{root}/in/CorpusVocData.size") == WORDS
    assert as_set(read_vocab(spark, f"{root}/in/Corpus.voc")) == as_set(vocab)

    folder = train_job.main(["4", "0.1", "0.01", "0.1", "6", "2", "20", root, "in", f"{root}/out"], spark)
    results = spark.read.text(f"{folder}/TestResults.txt")
    assert results.count() == 20
    assert files.load_model(spark, folder).topic_total.agg(F.sum("cnt")).first()[0] == pytest.approx(180 * 40)

    for extra, at in (([], folder), (["--text-model"], folder + "/")):
        path = infer_job.main(["4", "6", "3", f"{root}/in", "CorpusTrain.libsvm", at, f"{root}/out", *extra], spark)
        lines = [r[0].split() for r in spark.read.text(path).collect()]
        assert sorted(int(x[1]) for x in lines) == list(range(200))
        for x in lines:
            probs = [float(e.split(":")[1]) for e in x[2:]]
            assert sum(probs) == pytest.approx(1, abs=1e-5) and probs == sorted(probs, reverse=True)

    train_job.main(
        ["4", "0.1", "0.01", "0.1", "3", "1", "0", root, "in", f"{root}/out2", f"{root}/in/CorpusTrain.libsvm"], spark
    )
    sample_job.main(["10", f"{root}/in/CorpusTrain.libsvm", f"{root}/sample", "3", "5"], spark)
    sample = spark.read.text(f"{root}/sample")
    assert 10 <= sample.count() <= 12 and sample.filter("value like '3 %' or value like '5 %'").count() == 2
    rows_job.main([f"{root}/in/CorpusTrain.libsvm", f"{root}/rows"], spark)
    assert spark.read.csv(f"{root}/rows").count() == 200
    assert "training" in capsys.readouterr().out


def test_our_training_is_no_worse_than_variational(spark, planted, model):
    """Cross-check with MLlib's estimator: the same corpus, the same measure."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.linalg import SparseVector

    docs = {}
    for r in planted.collect():
        docs.setdefault(r["doc_id"], {})[r["term_id"]] = float(r["cnt"])
    df = spark.createDataFrame([(d, SparseVector(WORDS, c)) for d, c in docs.items()], ["id", "features"])
    other = LDA(k=K, maxIter=20, seed=1, optimizer="em").fit(df)
    phi = other.topicsMatrix().toArray()
    phi = phi / phi.sum(axis=0)
    loglik = 0.0
    for row in other.transform(df).collect():
        theta = row["topicDistribution"].toArray()
        for t, c in docs[row["id"]].items():
            loglik += c * math.log(phi[t] @ theta)
    assert model.params.perplexity < 1.1 * math.exp(-loglik / (200 * 40))


def test_a_shard_holds_a_bounded_part_whatever_number_is_asked_for(spark, space, planted, monkeypatch):
    monkeypatch.setattr(shards, "TOKENS_PER_SHARD", 500)
    cut = shards.shard_bow(planted, K, 1, space, 2)
    sizes = [r["n"] for r in cut.edges.groupBy("shard").agg(F.sum(F.size("topics")).alias("n")).collect()]
    assert cut.num_shards == 16 and len(sizes) == 16 and sum(sizes) == cut.tokens == 8000 and max(sizes) <= 1000
    assert shards.shard_bow(planted, K, 1, space, 20).num_shards == 20


def test_topics_are_drawn_once_per_occurrence(spark, planted):
    for counted in (N.term_topic, N.doc_topic, N.edge_topics, N.edge_tokens):
        plan = counted(N.init_topics(planted, K, 1))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("sequence(") <= 3, plan  # the blocks, guarded by a filter, and the occurrences


def test_perplexity_leaves_the_edges_where_they_are(spark, planted):
    state = T.start(planted, Params(K, WORDS, 0.1, 0.01, 0.1), 3, 8)
    totals = N.topic_total(state.term_topic, K)
    with frozen.planned_by_shard(spark):
        told = log_likelihood(state.edges, state.term_topic, totals, state.params)
        plan, there = told._jdf.queryExecution().executedPlan().toString(), told.first()
    assert "size(topics" in plan and plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan
    assert "hashpartitioning(doc_id" not in plan and "hashpartitioning(shard" not in plan
    bare = log_likelihood(state.edges.drop("shard"), state.term_topic, totals, state.params).first()
    assert there["num_tokens"] == bare["num_tokens"] == 8000 and there["loglik"] == bare["loglik"]


def test_triplets_shuffle_no_row_per_topic(spark):
    rows = [(d, t, 1 + (d * t) % 4) for d in range(30) for t in range(12) if (d + t) % 3]
    edges = N.init_topics(spark.createDataFrame(rows, "doc_id bigint, term_id int, cnt bigint"), K, 1)
    dt, tt = N.doc_topic(edges).filter("doc_id != 7"), N.term_topic(edges).filter("term_id != 5 and topic != 2")
    got = N.triplets(edges, tt, dt)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join")
    n_dk, n_kw = ({tuple(r)[:2]: tuple(r)[2] for r in x.collect()} for x in (dt, tt))
    want = {(d, t, n, k, n_dk[d, k], n_kw.get((t, k), 0)) for d, t, n in rows for k in range(K) if (d, k) in n_dk}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_a_report_s_line_is_put_together_from_pieces(spark, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 3)
    counts = spark.createDataFrame([(t, t % 2, float(1 + t * 7 % 11)) for t in range(22)], "term_id int, topic int, cnt double")
    names = spark.createDataFrame([(t, f"w{t:02d}") for t in range(22)], "term_id int, term string")
    report = topic_terms_report(model_from_counters(counts, Params(3, 22)), names)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 2
    want = {2: "2 "}
    for k in (0, 1):
        held = sorted((-(1 + t * 7 % 11), t) for t in range(22) if t % 2 == k)
        want[k] = f"{k} " + " ".join(f"w{t:02d}:{-c:.2f}" for c, t in held)
    assert {r["topic"]: r["value"] for r in report.collect()} == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_single_file_is_made_by_all_tasks_and_keeps_the_order(spark, space):
    """Each line tells the task it was made by."""
    made_by = F.udf(lambda i: str(TaskContext.get().taskAttemptId()))
    lines = spark.range(0, 40, 1, 5).select(F.concat_ws(" ", "id", made_by("id")).alias("value"))
    for _ in range(2):  # the second replaces the first
        sinks.write_single_text(lines, space.path("one"))
    files = [f for f in os.listdir(space.path("one").removeprefix("file:")) if f.startswith("part-")]
    assert len(files) == 1
    with open(os.path.join(space.path("one").removeprefix("file:"), files[0])) as file:
        found = [line.split(" ") for line in file.read().splitlines()]
    assert [i for i, _ in found] == [str(i) for i in range(40)] and len({task for _, task in found}) == 5
    sinks.write_single_text(lines.filter("false"), space.path("none"))
    assert spark.read.text(space.path("none")).count() == 0


def test_edges_lie_by_document_and_tokens_are_not_shuffled_for_their_counters(spark, space):
    bow = spark.createDataFrame([(d, t, 1 + (d + t) % 3) for d in range(20) for t in range(d % 4, 12, 4)], "doc_id bigint, term_id int, cnt bigint")
    e = N.store_edges(bow, 3, 1, space)
    assert as_set(N.edge_tokens(e)) == as_set(N.edge_tokens(N.init_topics(bow, 3, 1)))
    dt, tt = N.doc_topic(e), N.term_topic(e)
    totals, p = N.topic_total(tt, 3), Params(3, 12, 0.1, 0.01, 0.1)
    frozen_plan = _plan(frozen.frozen_sweep(e, dt, tt, totals, 500, p, 1, 1))
    assert 0 <= frozen_plan.find("Generate posexplode") < frozen_plan.find("Join")
    for found in (P.with_counts(N.edge_topics(e), "topic", dt, tt, totals, ""), N.triplets(e, tt, dt)):
        assert "hashpartitioning(doc_id" not in _plan(found)


def test_frozen_sweep_draws_alike_written_out_and_by_lambdas(spark, monkeypatch):
    bow = spark.createDataFrame([(d, t, 1 + (d * t) % 5) for d in range(15) for t in range(d % 3, 20, 3)], "doc_id bigint, term_id int, cnt bigint")
    e = N.init_topics(bow, 7, 1)
    dt, tt = N.doc_topic(e), N.term_topic(e)
    args = e, dt, tt, N.topic_total(tt, 7), 300, Params(7, 20, 0.1, 0.01, 0.1), 5, 1
    few = as_set(frozen.frozen_sweep(*args))
    monkeypatch.setattr(frozen, "UNROLLED", 1)
    assert few == as_set(frozen.frozen_sweep(*args)) and len({r[4] for r in few}) == 7


def test_lines_that_are_sampled_are_made_once(spark):
    assert "regexp_extract_all" not in _plan(catalog.sample_and_select(spark, "/root/testdata/sf0.001"))
