"""One query per operator, each from the given tables to its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.functions.draws import draw_bits, uniform_topic
from topicspark.functions.ranking import dense_index
from topicspark.functions.text import balanced_brackets, first_three_fields
from topicspark.operators import corpus as C
from topicspark.operators import counters as N
from topicspark.operators import frozen
from topicspark.operators import models as M
from topicspark.operators import priors as P
from topicspark.operators import report as R
from topicspark.operators import sampling as S
from topicspark.operators import similarity
from topicspark.plans import infer as inference
from topicspark.plans import train as training
from topicspark.session import Workspace, read_table
from topicspark.sources import models as model_files
from topicspark.sources import sinks, text
from topicspark.streaming import infer as streaming

SEED, TOPICS, SHARDS = 42, 8, 16
ALPHA, BETA, ALPHA_AS = 0.1, 0.01, 0.1
SWEEPS, BURN_IN = 20, 5
SIMILAR = 0.85

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# inputs


def documents(spark, sf):
    return read_table(spark, f"{sf}/documents.parquet")


def corpus(spark, sf) -> C.Corpus:
    return C.build_corpus(documents(spark, sf))


def edges(spark, sf, seed=SEED) -> DataFrame:
    return N.init_topics(corpus(spark, sf).bow, TOPICS, seed)


def stored_edges(spark, sf) -> DataFrame:
    """The same as a table, for results that read them more than once."""
    space = Workspace(spark)
    stored = N.store_edges(corpus(spark, sf).bow, TOPICS, SEED, space)
    space.free_shuffles()
    return stored


def params(vocab: DataFrame) -> M.Params:
    return M.Params(TOPICS, vocab.count(), ALPHA, BETA, ALPHA_AS)


def counters(spark, sf):
    """(edges, doc-topic, term-topic, topic totals, tokens, params) of the uniform start."""
    c = corpus(spark, sf)
    space = Workspace(spark)
    e = N.store_edges(c.bow, TOPICS, SEED, space)
    dt, tt = N.doc_topic(e), space.store(N.term_topic(e), "term_topic")
    tokens = N.num_tokens(e).first()[0]
    space.free_shuffles()
    return e, dt, tt, N.topic_total(tt, TOPICS), tokens, params(c.vocab)


def two_starts(spark, sf):
    """(vocabulary, the model of the mean counters of two uniform starts)."""
    c = stored_corpus(spark, sf)  # both read it
    both = [N.term_topic(N.init_topics(c.bow, TOPICS, seed)) for seed in (SEED, SEED + 1)]
    return c.vocab, M.averaged_model(both, params(c.vocab))


def stored_two_starts(spark, sf):
    vocab, model = two_starts(spark, sf)
    space = Workspace(spark)
    model = model._replace(term_topic=space.store(model.term_topic, "term_topic"))
    return vocab, M.model_from_counters(model.term_topic, model.params), space


def stored_corpus(spark, sf) -> C.Corpus:
    c = corpus(spark, sf)
    return c._replace(bow=Workspace(spark).store(c.bow, "bow"))


def start(spark, sf):
    c = stored_corpus(spark, sf)
    return training.start(c.bow, params(c.vocab), SEED, SHARDS), c


def corpus_lines(spark, sf) -> DataFrame:
    return C.bow_lines(corpus(spark, sf).bow)


def stored_lines(spark, sf) -> DataFrame:
    """The same as a table, for what reads them more than once."""
    space = Workspace(spark)
    stored = space.store(corpus_lines(spark, sf), "lines")
    space.free_shuffles()
    return stored


def text_lines(spark, sf) -> DataFrame:
    """The lines of all documents."""
    return documents(spark, sf).select(F.explode(F.split("text", "\r\n|\n|\r")).alias("value"))


def long_word_vocab(vocab: DataFrame) -> DataFrame:
    """Another vocabulary: the terms of more than three letters, numbered anew."""
    longer = vocab.filter(F.length("term") > 3).select("term")
    return dense_index(longer, [F.col("term")], "term_id").select(F.col("term_id").cast("int").alias("term_id"), "term")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# sources


@query
def read_lines(spark, sf):
    path = Workspace(spark).path("lines")
    sinks.write_text(documents(spark, sf).select("text"), path)
    return text.read_lines(spark, path, 2)


@query
def read_num_terms(spark, sf):
    path = Workspace(spark).path("sizes")
    sizes = corpus(spark, sf).vocab.groupBy(F.substring("term", 1, 1)).count()
    sinks.write_text(sizes.select(F.col("count").cast("string")), path)
    return spark.range(1).select(F.lit(text.read_num_terms(spark, path)).cast("bigint").alias("num_terms"))


@query
def read_vocab(spark, sf):
    path = Workspace(spark).path("vocab")
    ordered = corpus(spark, sf).vocab.orderBy("term")
    sinks.write_text(ordered.select(F.concat_ws("\t", F.length("term"), "term")), path)
    return text.read_vocab(spark, path)


@query
def parse_bow(spark, sf):
    """Every term twice in its line."""
    c = corpus(spark, sf)
    terms = F.expr("substr(value, instr(value, ' ') + 1)")
    lines = C.bow_lines(c.bow).select(F.concat_ws(" ", "value", terms).alias("value"))
    return text.parse_bow(lines, c.vocab.count())


@query
def read_corpus(spark, sf):
    c = corpus(spark, sf)
    path = Workspace(spark).path("corpus")
    sinks.write_text(C.bow_lines(c.bow), path)
    return text.read_corpus(spark, path, c.vocab.count())


@query
def restore_params(spark, sf):
    state, _ = start(spark, sf)
    p = state.params._replace(perplexity=training.perplexity(state), total_iter=20, burn_in=5)
    r = model_files.restore_params("models/" + R.model_dir(p) + "/")
    return spark.createDataFrame(
        [(r.alpha, r.beta, r.alpha_as, r.perplexity)], "alpha double, beta double, alpha_as double, perplexity double"
    )


@query
def restore_topic_totals(spark, sf):
    _, model, space = stored_two_starts(spark, sf)
    sinks.write_text(R.topic_totals_report(model).select("value"), space.path("totals"))
    return model_files.restore_topic_totals(spark, space.path("totals"), TOPICS + 1)


@query
def restore_term_topic(spark, sf):
    """Read back with another vocabulary."""
    vocab, model, space = stored_two_starts(spark, sf)
    sinks.write_text(R.topic_terms_report(model, vocab).select("value"), space.path("counts"))
    return model_files.restore_term_topic(spark, space.path("counts"), long_word_vocab(vocab), TOPICS)


@query
def load_model(spark, sf):
    """Counters and totals of a saved model, with another vocabulary."""
    vocab, model, space = stored_two_starts(spark, sf)
    folder = model_files.save_model(model, vocab, space.path("models"), reports=False)
    loaded = model_files.load_model(spark, folder, long_word_vocab(vocab))
    totals = loaded.topic_total.withColumnRenamed("cnt", "total")
    return loaded.term_topic.join(F.broadcast(totals), "topic").select(
        "term_id", "topic", "cnt", "total", F.lit(loaded.params.alpha_as).alias("alpha_as")
    )


@query
def load_text_model(spark, sf):
    """Counters and totals of a model from its text files."""
    vocab, model, space = stored_two_starts(spark, sf)
    folder = model_files.save_model(model, vocab, space.path("models"))
    loaded = model_files.load_text_model(spark, folder + "/", vocab, TOPICS, model.params.num_terms)
    totals = loaded.topic_total.withColumnRenamed("cnt", "total")
    return loaded.term_topic.join(F.broadcast(totals), "topic").select(
        "term_id", "topic", "cnt", "total", F.lit(loaded.params.alpha_as).alias("alpha_as")
    )


# sinks


@query
def write_single_text(spark, sf):
    path = Workspace(spark).path("single")
    sinks.write_single_text(corpus_lines(spark, sf), path)
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return read.groupBy("value").agg(F.countDistinct("file").alias("files"))


@query
def write_rows(spark, sf):
    path = Workspace(spark).path("rows")
    sinks.write_rows(text_lines(spark, sf), path)
    return spark.read.options(**sinks.CSV_OPTIONS).schema("c0 string, c1 string, c2 string").csv(path)


@query
def topic_totals_report(spark, sf):
    return R.topic_totals_report(two_starts(spark, sf)[1])


@query
def topic_terms_report(spark, sf):
    vocab, model = two_starts(spark, sf)
    return R.topic_terms_report(model, vocab, 2)


@query
def topic_term_probs_report(spark, sf):
    vocab, model = two_starts(spark, sf)
    return R.topic_terms_report(model, vocab, 8, probs=True)


@query
def topic_terms_text(spark, sf):
    """The pairs of the written text with their topics, read back from lines that no row holds."""
    vocab, model, space = stored_two_starts(spark, sf)
    model_files.write_topic_terms(model, vocab, space.path("counts"))
    pairs = text.long_line_pairs(spark, space.path("counts"))
    return pairs.select(F.col("head").cast("int").alias("topic"), F.substring_index("pair", ":", 1).alias("term"), "pair")


@query
def doc_topics_report(spark, sf):
    return R.doc_topics_report(P.doc_topic_dist(N.doc_topic(edges(spark, sf))))


@query
def model_dir(spark, sf):
    state, _ = start(spark, sf)
    p = state.params._replace(perplexity=training.perplexity(state), total_iter=20, burn_in=5)
    return spark.createDataFrame([(R.model_dir(p),)], "name string")


@query
def save_model(spark, sf):
    vocab, model, space = stored_two_starts(spark, sf)
    folder = model_files.save_model(model, vocab, space.path("models"))
    return spark.read.parquet(folder + "/term_topic")


# projections, filters, predicates


@query
def three_fields(spark, sf):
    return text_lines(spark, sf).select(*first_three_fields(F.col("value")))


@query
def select_docs(spark, sf):
    wanted = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1")
    return S.select_docs(corpus_lines(spark, sf), wanted.select(F.col("doc_id").cast("string")))


@query
def truncated_counts(spark, sf):
    """Counts lowered by 0.3 in the text, truncated on reading; those that fall to 0 leave no row."""
    c = corpus(spark, sf)
    pair = F.concat(F.col("term_id").cast("string"), F.lit(":"), (F.col("cnt") - 1).cast("string"), F.lit(".7"))
    lines = c.bow.select(F.concat_ws(" ", "doc_id", pair).alias("value"))
    return C.positive(text.parse_bow(lines, c.vocab.count()))


@query
def tokens(spark, sf):
    return C.tokens(corpus(spark, sf).bow)


@query
def positive_counts(spark, sf):
    tt = N.term_topic(edges(spark, sf))
    return C.positive(tt.withColumn("cnt", F.col("cnt") - 2))


@query
def balanced_text(spark, sf):
    """Whole documents and pages, and bracket tokens of pages, some reversed and some cut short."""
    docs = documents(spark, sf).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text"))
    pages = read_table(spark, f"{sf}/pages.parquet")
    whole = pages.select(F.lit("page"), F.col("page_id"), F.col("html"))
    word = pages.select("page_id", F.explode(F.split("html", "\\s+")).alias("token")).filter("token rlike '[()]'")
    turned = F.when(F.col("page_id") % 2 == 1, F.reverse("token")).otherwise(F.col("token"))
    cut = F.when(F.col("page_id") % 3 == 0, F.expr("substr(turned, 1, length(turned) - 1)")).otherwise(F.col("turned"))
    odd = word.withColumn("turned", turned).select(F.lit("token"), "page_id", cut)
    return docs.unionAll(whole).unionAll(odd).select("kind", "id", "text", balanced_brackets(F.col("text")).alias("ok"))


# sampling and joins


@query
def sample_docs(spark, sf):
    return S.sample_docs(documents(spark, sf).select(F.col("text").alias("value")), 100, SEED)


@query
def sample_docs_large(spark, sf):
    """The same with the method for samples too large for one task."""
    return S.sample_docs(documents(spark, sf).select(F.col("text").alias("value")), 300, SEED)


@query
def holdout_split(spark, sf):
    training_set, held_out = S.holdout_split(documents(spark, sf).select(F.col("text").alias("value")), 50, SEED)
    return training_set.withColumn("part", F.lit("training")).unionAll(held_out.withColumn("part", F.lit("held out")))


@query
def sample_and_select(spark, sf):
    return S.sample_and_select(stored_lines(spark, sf), 50, SEED, ["1", "5", "17"])


@query
def accumulate(spark, sf):
    bow = stored_corpus(spark, sf).bow
    return N.accumulate(*[N.term_topic(N.init_topics(bow, TOPICS, s)) for s in (SEED, SEED + 1)])


@query
def triplets(spark, sf):
    e = stored_edges(spark, sf)
    return N.triplets(e, N.term_topic(e), N.doc_topic(e))


@query
def vocabulary_term(spark, sf):
    c = corpus(spark, sf)
    return C.vocabulary_lookup(c.bow, c.vocab).select("doc_id", "term_id", "cnt", "term")


@query
def vocabulary_index(spark, sf):
    docs = documents(spark, sf)
    return C.vocabulary_lookup(C.word_counts(docs), C.build_vocab(docs)).select("doc_id", "term_id", "cnt", "term")


@query
def frequent_vocab(spark, sf):
    """The terms that are seen ten times or more."""
    return C.build_vocab(documents(spark, sf), min_count=10)


@query
def topic_terms_table(spark, sf):
    """Every term of every topic by its rank, as a table."""
    vocab, model = two_starts(spark, sf)
    return R.topic_terms_table(model, vocab)


@query
def relabel(spark, sf):
    return N.edge_tokens(N.relabel(edges(spark, sf), {1: 0, 5: 2, 7: 1}, TOPICS))


# counters


@query
def doc_topic(spark, sf):
    return N.doc_topic(edges(spark, sf))


@query
def term_topic(spark, sf):
    return N.term_topic(edges(spark, sf))


@query
def topic_total(spark, sf):
    """With one topic more than there are, which stays empty."""
    return N.topic_total(N.term_topic(edges(spark, sf)), TOPICS + 1)


@query
def num_docs(spark, sf):
    return N.num_docs(edges(spark, sf))


@query
def num_tokens(spark, sf):
    return N.num_tokens(edges(spark, sf))


@query
def check_totals(spark, sf):
    e = stored_edges(spark, sf)
    return N.check_totals(e, N.topic_total(N.term_topic(e), TOPICS))


@query
def average_counters(spark, sf):
    return two_starts(spark, sf)[1].term_topic


@query
def averaged_totals(spark, sf):
    return two_starts(spark, sf)[1].topic_total


@query
def merge_models(spark, sf):
    c = stored_corpus(spark, sf)
    p = params(c.vocab)
    a, b = (M.model_from_counters(N.term_topic(N.init_topics(c.bow, TOPICS, s)), p) for s in (SEED, SEED + 1))
    merged = M.merge_models(a, b)
    return merged.term_topic.join(F.broadcast(merged.topic_total.withColumnRenamed("cnt", "total")), "topic").select(
        "term_id", "topic", "cnt", "total"
    )


@query
def merge_increment(spark, sf):
    """One more token of topic 0 for every term."""
    c = corpus(spark, sf)
    model = M.model_from_counters(N.term_topic(N.init_topics(c.bow, TOPICS, SEED)), params(c.vocab))
    more = c.vocab.select("term_id", F.lit(0).alias("topic"), F.lit(1).alias("cnt"))
    return M.merge_increment(model, more).term_topic


@query
def topic_term(spark, sf):
    return N.topic_term(N.term_topic(edges(spark, sf)))


@query
def model_stats(spark, sf):
    return M.model_stats(two_starts(spark, sf)[1])


# ranking and prefix sums


@query
def topics_by_total(spark, sf):
    return R.topics_by_total(two_starts(spark, sf)[1])


@query
def top_terms(spark, sf):
    vocab, model = two_starts(spark, sf)
    return R.top_terms(model, vocab, 10)


@query
def top_topics(spark, sf):
    return rounded(R.top_topics(P.doc_topic_dist(N.doc_topic(edges(spark, sf))), 3), "prob")


@query
def row_index(spark, sf):
    return R.row_index(corpus(spark, sf).bow.select("doc_id").distinct())


@query
def proposal_cdf_terms(spark, sf):
    return rounded(P.term_cdf(two_starts(spark, sf)[1]), "cdf")


@query
def proposal_cdf_topics(spark, sf):
    _, _, tt, _, total, p = counters(spark, sf)
    return rounded(P.topic_cdf(M.model_from_counters(tt, p), total), "smoothing_cdf", "prior_cdf", places=9)


@query
def proposal_cdf_docs(spark, sf):
    return P.doc_cdf(N.doc_topic(edges(spark, sf)))


# the topic model's arithmetic


@query
def init_topics(spark, sf):
    return N.edge_tokens(edges(spark, sf))


@query
def as_prior(spark, sf):
    *_, totals, total, p = counters(spark, sf)
    return rounded(P.prior_table(totals, total, p), "prior", "prior_own", places=9)


def _own_weights(spark, sf, weight) -> DataFrame:
    """Weights of the topics each edge holds: as they are, and with one of its tokens left out."""
    e, dt, tt, totals, total, p = counters(spark, sf)
    held = P.with_counts(N.edge_topics(e), "topic", dt, tt, totals, "")
    columns = [weight(total, p, own).alias(name) for own, name in ((0, "weight"), (1, "weight_own"))]
    return rounded(held.select("doc_id", "term_id", "topic", *columns), "weight", "weight_own", places=9)


@query
def token_topic_prob(spark, sf):
    cols = F.col("n_kw"), F.col("n_dk"), F.col("n_k")
    return _own_weights(spark, sf, lambda total, p, own: P.token_topic_prob(*cols, total, p, own))


@query
def doc_topic_prob(spark, sf):
    cols = F.col("n_dk"), F.col("n_k")
    return _own_weights(spark, sf, lambda total, p, own: P.doc_topic_prob(*cols, total, p, own))


@query
def word_topic_prob(spark, sf):
    cols = F.col("n_kw"), F.col("n_k")
    return _own_weights(spark, sf, lambda total, p, own: P.word_topic_prob(*cols, p, own))


@query
def mh_acceptance(spark, sf):
    e, dt, tt, totals, total, p = counters(spark, sf)
    ids = [F.col(c) for c in ("doc_id", "term_id", "occ")]
    asked = N.edge_tokens(e).withColumns(
        {
            "proposal": uniform_topic(TOPICS, SEED, 1, *ids),
            "by_doc": draw_bits(SEED, 2, *ids) % 2 == 0,
        }
    )
    return rounded(P.mh_acceptance(asked, dt, tt, totals, total, p), "acceptance")


@query
def frozen_sweep(spark, sf):
    """The new topic of every token in a sweep whose counters stand still."""
    e, dt, tt, totals, total, p = counters(spark, sf)
    return frozen.frozen_sweep(e, dt, tt, totals, total, p, SEED, 1)


@query
def doc_topic_dist(spark, sf):
    return rounded(P.doc_topic_dist(N.doc_topic(edges(spark, sf))), "prob")


@query
def perplexity(spark, sf):
    value = training.perplexity(start(spark, sf)[0])
    return spark.createDataFrame([(round(value, 6),)], "perplexity double")


@query
def perplexity_compat(spark, sf):
    value = training.perplexity(start(spark, sf)[0], compat=True)
    return spark.createDataFrame([(round(value, 6),)], "perplexity double")


@query
def topic_similarity(spark, sf):
    return rounded(similarity.topic_similarity(N.term_topic(edges(spark, sf)), TOPICS), "sim")


@query
def min_similar_topic(spark, sf):
    sims = similarity.topic_similarity(N.term_topic(edges(spark, sf)), TOPICS)
    return similarity.min_similar_topic(sims, SIMILAR)


@query
def merge_duplicate_topics(spark, sf):
    """Term counters after the merge."""
    state, _ = start(spark, sf)
    return training.merge_duplicate_topics(state, SIMILAR)[0].term_topic


@query
def empty_model(spark, sf):
    """An empty model of the corpus's size, with one increment per term merged in."""
    vocab = corpus(spark, sf).vocab
    model = M.empty_model(spark, TOPICS, vocab.count())
    more = vocab.select("term_id", (F.length("term") % TOPICS).alias("topic"), F.lit(1).alias("cnt"))
    filled = M.merge_increment(model, more)
    p = filled.params
    return filled.topic_total.select("topic", "cnt", F.lit(p.alpha_as).alias("alpha_as"), F.lit(p.perplexity).alias("perplexity"))


# sampling: what must hold whatever is drawn


@query
def gibbs_sweep(spark, sf):
    """Tokens per document and term after a sweep, and whether it moved tokens, to topics in range, to a lower perplexity."""
    before, _ = start(spark, sf)
    after = training.gibbs_sweep(before)
    keys = ["shard", "doc_id", "term_id", "block"]  # an edge stays in its shard
    pairs = after.edges.select(*keys, F.col("topics").alias("new")).join(before.edges.select(*keys, "topics"), keys)
    with frozen.planned_by_shard(spark):
        moved = pairs.agg(F.sum(F.size(F.filter(F.zip_with("new", "topics", lambda a, b: a != b), lambda x: x)))).first()[0]
    bad = after.edges.filter(F.exists("topics", lambda t: (t < 0) | (t >= TOPICS))).count()
    ok = moved > 0 and not bad and training.perplexity(after) < training.perplexity(before)
    return N.edges_to_bow(after.edges).withColumn("ok", F.lit(ok))


@query
def run_gibbs(spark, sf):
    """The first perplexity of the trace, and whether the later ones are below it."""
    _, trace = training.run_gibbs(start(spark, sf)[0], 3)
    first = trace[0][1]
    rows = [(i, round(first, 6), i == 1 or p < first) for i, p in trace]
    return spark.createDataFrame(rows, "iter int, first double, improved boolean")


def _model_facts(spark, model: M.Model, before: float) -> DataFrame:
    stats = M.model_stats(model)
    return stats.select(
        "num_topics", "num_terms", F.round("num_tokens", 6).alias("num_tokens"),
        F.lit(model.params.perplexity < before).alias("improved"),
    )


_TRAINED: dict = {}


def _trained(spark, sf):
    """(corpus, model, perplexity of the start), trained once per session and folder; the model is a written table."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TRAINED:
        _TRAINED[key] = _train_once(spark, sf)
    return _TRAINED[key]


def _train_once(spark, sf):
    state, c = start(spark, sf)
    before = training.perplexity(state)
    model = training.train(
        c.bow, state.params.num_terms, TOPICS, SWEEPS, BURN_IN, ALPHA, BETA, ALPHA_AS, SEED, SHARDS
    )
    return c, model, before


@query
def train(spark, sf):
    """Tokens per term of the averaged model, and whether it is better than the start and its counts are fifths."""
    _, model, before = _trained(spark, sf)
    fifths = model.term_topic.filter(F.abs(F.col("cnt") * BURN_IN - F.round(F.col("cnt") * BURN_IN)) > 1e-6).limit(1).count() == 0
    ok = fifths and model.params.perplexity < before
    return model.term_topic.groupBy("term_id").agg(F.round(F.sum("cnt"), 6).alias("cnt")).withColumn("ok", F.lit(ok))


@query
def save_averaged(spark, sf):
    """Tokens per term in the model of two averaged sweeps, and whether all counts are multiples of one half, some odd."""
    _, model = training.save_averaged(start(spark, sf)[0], 2)
    halves = model.term_topic.withColumn("twice", F.col("cnt") * 2)
    odd = halves.filter(F.col("twice") % 2 == 1).limit(1).count() > 0
    whole = halves.filter(F.col("twice") != F.round("twice")).limit(1).count() == 0
    return model.term_topic.groupBy("term_id").agg(F.round(F.sum("cnt"), 6).alias("cnt")).withColumn("ok", F.lit(odd and whole))


@query
def init_topics_from_model(spark, sf):
    """Tokens per document and term of a warm start, and whether its topics fit the model better than uniform ones."""
    c = stored_corpus(spark, sf)
    counts = N.term_topic(N.init_topics(c.bow, TOPICS, SEED))
    model = M.model_from_counters(Workspace(spark).store(counts, "counts"), params(c.vocab))
    p = params(c.vocab)
    warm = training.init_topics_from_model(c.bow, model, SEED + 1, SHARDS)
    better = training.perplexity(warm) < training.perplexity(training.start(c.bow, p, SEED + 1, SHARDS))
    return N.edges_to_bow(warm.edges).withColumn("ok", F.lit(better))


@query
def train_incremental(spark, sf):
    c, model, before = _trained(spark, sf)
    return _model_facts(spark, training.train_incremental(c.bow, model, 1.0, 4, 2, SEED, SHARDS), before)


@query
def infer(spark, sf):
    """Probability sum and validity per document."""
    c, model, _ = _trained(spark, sf)
    dist = inference.infer(c.bow, model, seed=SEED, num_shards=SHARDS)
    return dist.groupBy("doc_id").agg(
        F.round(F.sum("prob"), 6).alias("total"), F.min((F.col("prob") > 0) & F.col("topic").between(0, TOPICS - 1)).alias("ok")
    )


@query
def run_inference(spark, sf):
    """Documents of the result file, read back, in its order."""
    c, model, _ = _trained(spark, sf)
    path = Workspace(spark).path("results")
    inference.run_inference(c.bow, model, path, seed=SEED, num_shards=SHARDS)
    fields = F.split("value", " ")
    probs = F.transform(F.slice(fields, 3, TOPICS), lambda e: F.split(e, ":")[1].cast("double"))
    falling = F.array_sort(probs, lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)) == probs
    total = F.aggregate(probs, F.lit(0.0), lambda a, b: a + b)
    return spark.read.text(path).select(
        fields[0].cast("bigint").alias("row_index"), fields[1].cast("bigint").alias("doc_id"),
        (F.size(probs).between(1, TOPICS) & falling & F.abs(total - 1).__lt__(0.01)).alias("ok"),
    )


@query
def infer_stream(spark, sf):
    """Per document: do the rows of a stream of its line, among files of lines, equal those of `infer`? With a batch run twice."""
    c, model, _ = _trained(spark, sf)
    space = Workspace(spark)
    C.bow_lines(c.bow).repartition(8).write.text(space.path("lines"))
    for checkpoint in ("first", "again"):  # another checkpoint knows of no batch and runs all of them again
        arriving = streaming.stream_lines(spark, space.path("lines"), 3)
        streaming.infer_stream(arriving, model, space.path("sink"), space.path(checkpoint), seed=SEED, num_shards=SHARDS).awaitTermination()
    told = streaming.read_inferred(spark, space.path("sink")).withColumn("streamed", F.lit(1))
    want = inference.infer(c.bow, model, seed=SEED, num_shards=SHARDS).withColumn("streamed", F.lit(0))
    both = told.drop("batch").unionByName(want).groupBy("doc_id", "topic").agg(
        F.sum("streamed").alias("streamed"), F.count(F.lit(1)).alias("rows"), (F.min("prob") == F.max("prob")).alias("same")
    )
    alike = (F.col("streamed") == 1) & (F.col("rows") == 2) & F.col("same")
    return both.groupBy("doc_id").agg(F.min(alike).alias("ok"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Top terms per topic after a training of 20 sweeps, the last 5 averaged."""
    c = stored_corpus(spark, sf)
    model = training.train(c.bow, c.vocab.count(), TOPICS, 20, 5, ALPHA, BETA, ALPHA_AS, SEED, SHARDS)
    return R.top_terms(model, c.vocab, 10)
