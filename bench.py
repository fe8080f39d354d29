"""Time the headline operators; prints one JSON line.

Corpus operators are timed from the tables to their result; the model's steps on a state made before,
which has its own entry (corpus, start). Every time covers an action over all rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from topicspark.checks.catalog import ALPHA, ALPHA_AS, BETA, QUERIES, SEED, TOPICS  # noqa: E402
from topicspark.operators.corpus import to_bow, word_counts, build_vocab  # noqa: E402
from topicspark.operators.models import Params, model_from_counters  # noqa: E402
from topicspark.operators.report import top_terms  # noqa: E402
from topicspark.operators.similarity import topic_similarity  # noqa: E402
from topicspark.plans.infer import infer  # noqa: E402
from topicspark.plans.train import gibbs_sweep, perplexity, start  # noqa: E402
from topicspark.session import Workspace, build_session, read_table  # noqa: E402

WHOLE = ("balanced_text", "three_fields", "sample_docs_large", "holdout_split", "doc_topic", "triplets", "token_topic_prob")


def run(folder: str, cpus: str) -> dict:
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, fn):
        began = time.time()
        result = fn()
        if hasattr(result, "write"):
            result.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
        return result

    space = Workspace(spark)
    docs = read_table(spark, f"{folder}/documents.parquet")
    spark.range(1000).selectExpr("sum(id)").collect()  # the session is up before the clock starts
    vocab = timed("vocab", lambda: space.store(build_vocab(docs), "vocab"))
    bow = timed("bow", lambda: space.store(to_bow(word_counts(docs), vocab), "bow"))
    params = Params(TOPICS, vocab.count(), ALPHA, BETA, ALPHA_AS)
    state = timed("start", lambda: start(bow, params, SEED, space=space))
    for i in (1, 2, 3):
        state = timed(f"sweep_{i}", lambda s=state: gibbs_sweep(s))
    timed("perplexity", lambda: perplexity(state))
    timed("similarity", lambda: topic_similarity(state.term_topic, TOPICS))
    model = model_from_counters(state.term_topic, params)
    timed("top_terms", lambda: top_terms(model, vocab, 10))
    timed("infer", lambda: infer(bow, model))
    for name in WHOLE:
        timed(name, lambda n=name: QUERIES[n](spark, folder))
    tokens = int(state.n_k.sum())
    spark.stop()
    return {
        "metric": "topic model and corpus operators, wall-clock", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rstrip("/").split("sf")[-1], "tokens": tokens,
        "token_visits_per_sec": round(8 * tokens / times["sweep_3"]),
    }


if __name__ == "__main__":
    print(json.dumps(run(os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"))))
