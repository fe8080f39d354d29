"""Training: sweeps over the corpus, each one a Spark job over the shards."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.operators import similarity
from topicspark.operators.counters import accumulate, term_topic, topic_total
from topicspark.operators.frozen import log_likelihood, planned_by_shard
from topicspark.operators.models import Model, Params, model_from_counters
from topicspark.plans.log import Log
from topicspark.plans.shards import EDGE_SCHEMA, Sharded, buckets_of, run_shards, shard_bow, with_edges
from topicspark.session import Workspace

# Defaults of training
NUM_TOPICS = 2048
TOTAL_ITER = 150
BURN_IN = 5
ALPHA = 0.1
BETA = 0.01
ALPHA_AS = 0.1
ALPHA_AS_INCREMENTAL = 1.0
PASSES = 8
WARM_SWEEPS = 15


class State(NamedTuple):
    """Topics of all tokens after some sweeps. Edges and counters are written tables."""

    sharded: Sharded
    term_topic: DataFrame
    n_k: np.ndarray  # tokens per topic
    params: Params
    seed: int
    sweep: int
    space: Workspace

    @property
    def edges(self) -> DataFrame:
        return self.sharded.edges


def _counted(sharded: Sharded, params: Params, seed: int, sweep: int, space: Workspace) -> State:
    """Recount the terms' topics, and check that no token was lost: by the sums that came with the edges and the counters."""
    if sharded.written and sharded.written["tokens"] != sharded.tokens:
        raise RuntimeError(f"{sharded.written['tokens']} tokens were written, but there are {sharded.tokens} tokens")
    counters = space.store(term_topic(sharded.edges), "term_topic")
    n_k = np.zeros(params.num_topics)
    for row in counters.groupBy("topic").agg(F.sum("cnt").alias("cnt")).collect():  # one row per topic
        n_k[row["topic"]] = row["cnt"]
    if n_k.sum() != sharded.tokens:
        raise RuntimeError(f"topic totals sum to {n_k.sum():.0f}, but there are {sharded.tokens} tokens")
    return State(sharded, counters, n_k, params, seed, sweep, space)


def start(
    bow: DataFrame, params: Params, seed: int, num_shards: int | None = None, space: Workspace | None = None
) -> State:
    """Uniform topics."""
    space = (space or Workspace(bow.sparkSession)).child("train")
    return _counted(shard_bow(bow, params.num_topics, seed, space, num_shards), params, seed, 0, space)


def init_topics_from_model(
    bow: DataFrame,
    model: Model,
    seed: int,
    num_shards: int | None = None,
    space: Workspace | None = None,
    alpha_as: float | None = None,
) -> State:
    """Uniform topics, then sweeps against the model's counters, which stay as they are, all in one task per shard."""
    space = (space or Workspace(bow.sparkSession)).child("train")
    p = model.params
    sharded = shard_bow(bow, p.num_topics, seed, space, num_shards)
    new = run_shards(sharded, model.term_topic, topic_totals(model), p, "warm", seed, 0, WARM_SWEEPS, own=False)
    sharded = with_edges(sharded, new, space)
    params = p if alpha_as is None else p._replace(alpha_as=alpha_as)
    return _counted(sharded, params, seed, 0, space)


def topic_totals(model: Model) -> np.ndarray:
    n_k = np.zeros(model.params.num_topics)
    for row in model.topic_total.collect():  # one row per topic
        n_k[row["topic"]] = row["cnt"]
    return n_k


def gibbs_sweep(state: State, passes: int = PASSES, score: bool = False) -> State:
    """One sweep: every token is visited `passes` times, then all counters are rebuilt.

    With score the new edges carry, in `loglik`, the log-likelihood of the state before the sweep. The tables of the
    state before stay.
    """
    s = state
    new = run_shards(s.sharded, s.term_topic, s.n_k, s.params, "train", s.seed, s.sweep + 1, passes, score=score)
    sharded = with_edges(s.sharded, new, s.space)
    return _counted(sharded, s.params, s.seed, s.sweep + 1, s.space)


def _next(state: State, score: bool = False) -> State:
    """A sweep of a loop that needs no state but the last."""
    state = gibbs_sweep(state, score=score)
    for name in ("edges", "term_topic"):
        state.space.keep_last(name, 2)
    return state


def run_gibbs(
    state: State, sweeps: int, trace: bool = True, report: Callable[[int, float], None] | None = None,
    done: int = 0, commit: Callable[[State], None] | None = None,
) -> tuple[State, list[tuple[int, float]]]:
    """(state after the sweeps, [(iteration, perplexity before it)]).

    The perplexities are found by the sweeps themselves, without a job of their own. Each is also
    given to `report` once its sweep is done. The first `done` sweeps are left out; `commit` is called after each.
    """
    found = []
    for i in range(done + 1, sweeps + 1):
        tokens = state.n_k.sum()
        state = _next(state, score=trace)
        if trace:
            found.append((i, math.exp(-state.sharded.written["loglik"] / tokens)))
            if report:
                report(*found[-1])
        if commit:
            commit(state)
    return state, found


def perplexity(state: State, compat: bool = False) -> float:
    """exp(- log-likelihood per token), p(w|d) from the smoothed counters with a symmetric alpha.

    compat: the historical formula, which adds p / (N_d + K alpha) to p where the predictive
    probability divides by it. Its values are no true perplexities.
    """
    totals = topic_total(state.term_topic, state.params.num_topics)
    with planned_by_shard(state.space.spark):
        told = log_likelihood(state.edges, state.term_topic, totals, state.params, compat).first()
    return math.exp(-told["loglik"] / told["num_tokens"])


def save_averaged(
    state: State, burn_in: int, total: DataFrame | None = None, done: int = 0, commit: Callable[[State, DataFrame], None] | None = None
) -> tuple[State, Model]:
    """`burn_in` more sweeps, and the model of their mean counters with the final perplexity.

    The counters are added up sweep by sweep, so one sum is kept, whatever burn_in is. `total` is the sum of the first
    `done` of them, if these are done; `commit` is called after each.
    """
    for _ in range(done, burn_in):
        state = _next(state)
        total = state.space.store(state.term_topic if total is None else accumulate(total, state.term_topic), "sum")
        state.space.keep_last("sum", 2)
        if commit:
            commit(state, total)
    params = state.params._replace(perplexity=perplexity(state), burn_in=burn_in)
    mean = total.select("term_id", "topic", (F.col("cnt") / F.lit(float(burn_in))).alias("cnt"))
    model = model_from_counters(state.space.store(mean, "model_term_topic"), params)
    return state, model._replace(topic_total=state.space.store(model.topic_total, "model_topic_total"))


def check_iterations(total_iter: int, burn_in: int) -> None:
    if not total_iter > burn_in > 0:
        raise ValueError("total_iter must be above burn_in, and burn_in above 0")


def _finish(
    state: State, total_iter: int, burn_in: int, report: Callable[[int, float], None] | None, log: str | None = None, done: int = 0,
    total: DataFrame | None = None,
) -> Model:
    """The sweeps after the first `done`; `total` is the sum of the averaged ones among these."""
    state = state._replace(params=state.params._replace(total_iter=total_iter))
    warm = total_iter - burn_in
    book = Log(state.space.spark, log) if log else None

    def commit(state: State, total: DataFrame | None = None) -> None:
        if book:
            tables = {"edges": state.edges, "term_topic": state.term_topic, "needs": state.sharded.needs, "copies": state.sharded.copies}
            tables |= {"sum": total} if total is not None else {}
            facts = {
                "seed": state.seed, "sweep": state.sweep, "num_shards": state.sharded.num_shards, "tokens": state.sharded.tokens,
                "params": list(state.params), "total_iter": total_iter, "burn_in": burn_in, "folder": state.space.folder,
            }
            book.add(state.sweep, facts, tables)

    if not done:
        commit(state)
    state, _ = run_gibbs(state, warm, report is not None, report, min(done, warm), commit)
    state, model = save_averaged(state, burn_in, total, max(0, done - warm), commit)
    if book:
        book.close()
    for name in ("edges", "term_topic", "sum", "needs", "copies", "numbers", "sizes", "packed"):
        state.space.keep_last(name, 0)
    return model


def resume(spark: SparkSession, log: str, report: Callable[[int, float], None] | None = None) -> Model:
    """Go on with a training that stopped, from the last sweep that its `log` holds; the model is that of an undisturbed one.

    Draws belong to seed, sweep and token, so a sweep that is done again is the same sweep.
    """
    facts, tables = Log(spark, log).last()
    space = Workspace(spark, facts["folder"])
    params = Params(*facts["params"])
    edges = space.bucketed_table(tables["edges"], "edges", "shard", EDGE_SCHEMA, buckets_of(facts["num_shards"]))
    read = {name: space.table(path, name) for name, path in tables.items() if name != "edges"}
    sharded = Sharded(edges, read["needs"], read["copies"], facts["num_shards"], facts["tokens"])
    n_k = np.zeros(params.num_topics)
    for row in read["term_topic"].groupBy("topic").agg(F.sum("cnt").alias("cnt")).collect():  # one row per topic
        n_k[row["topic"]] = row["cnt"]
    state = State(sharded, read["term_topic"], n_k, params, facts["seed"], facts["sweep"], space)
    return _finish(state, facts["total_iter"], facts["burn_in"], report, log, facts["sweep"], read.get("sum"))


def train(
    bow: DataFrame,
    num_terms: int,
    num_topics: int = NUM_TOPICS,
    total_iter: int = TOTAL_ITER,
    burn_in: int = BURN_IN,
    alpha: float = ALPHA,
    beta: float = BETA,
    alpha_as: float = ALPHA_AS,
    seed: int = 42,
    num_shards: int | None = None,
    space: Workspace | None = None,
    report: Callable[[int, float], None] | None = None,
    log: str | None = None,
) -> Model:
    """total_iter - burn_in sweeps, then burn_in sweeps whose counters are averaged.

    report(iteration, perplexity) is called for the former, if given. With a folder `log` that all machines share, each
    sweep that is done is noted there, and `resume` goes on from the last one.
    """
    check_iterations(total_iter, burn_in)
    params = Params(num_topics, num_terms, alpha, beta, alpha_as)
    return _finish(start(bow, params, seed, num_shards, space), total_iter, burn_in, report, log)


def train_incremental(
    bow: DataFrame,
    model: Model,
    alpha_as: float = ALPHA_AS_INCREMENTAL,
    total_iter: int = TOTAL_ITER,
    burn_in: int = BURN_IN,
    seed: int = 42,
    num_shards: int | None = None,
    space: Workspace | None = None,
    report: Callable[[int, float], None] | None = None,
    log: str | None = None,
) -> Model:
    """As train, from topics that fit the old model, with its topics, alpha and beta."""
    check_iterations(total_iter, burn_in)
    state = init_topics_from_model(bow, model, seed, num_shards, space, alpha_as)
    return _finish(state, total_iter, burn_in, report, log)


def merge_duplicate_topics(state: State, threshold: float = 0.95) -> tuple[State, dict[int, int]]:
    """Merge similar topics of a state and recount."""
    edges, mapping = similarity.merge_duplicate_topics(
        state.edges, state.term_topic, state.params.num_topics, threshold
    )
    if not mapping:
        return state, mapping
    sharded = with_edges(state.sharded, edges, state.space)
    merged = _counted(sharded, state.params, state.seed, state.sweep + 1, state.space)
    return merged, mapping
