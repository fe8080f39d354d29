"""The numpy kernel against brute force."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from topicspark.plans import kernel


def make_shard(doc, term, z, num_terms, K, own, counts=None, alpha=0.3, beta=0.2, alpha_as=0.5):
    doc, term, z = (np.array(x) for x in (doc, term, z))
    if counts is None:
        counts = np.zeros((num_terms, K))
        np.add.at(counts, (term, z), 1)
    row, topic = np.nonzero(counts)
    terms = kernel.Rows(row, topic, counts[row, topic], num_terms, K)
    return kernel.Shard(doc, term, z, terms, counts.sum(axis=0), num_terms, alpha, beta, alpha_as, own)


def weights(s, n_dk, n_kw, n_k):
    prior = s.alpha * s.K * (n_k + s.alpha_as) / (n_k.sum() + s.alpha_as * s.K)
    return (n_kw + s.beta) / (n_k + s.V * s.beta) * (n_dk + prior)


def test_inference_samples_the_exact_posterior():
    """A document of three tokens under a fixed model: all 27 topic triples can be enumerated."""
    counts = np.array([[9.0, 0, 1], [0, 5, 2], [3, 3, 0], [1, 0, 0]])
    term = np.array([0, 1, 3])
    s = make_shard([0, 0, 0], term, [0, 1, 2], 4, 3, 0, counts)
    n_k = counts.sum(axis=0)
    prior = s.alpha * 3 * (n_k + s.alpha_as) / (n_k.sum() + s.alpha_as * 3)
    p = {}
    for topics in itertools.product(range(3), repeat=3):
        n, w = np.zeros(3), 1.0
        for t, k in zip(term, topics):
            w *= (counts[t, k] + s.beta) / (n_k[k] + 4 * s.beta) * (n[k] + prior[k])
            n[k] += 1
        p[topics] = w
    total = sum(p.values())
    seen = dict.fromkeys(p, 0)
    rounds = 40_000
    for i in range(rounds):
        s.visit(s.batches[0], 5, i)
        seen[tuple(int(k) for k in s.z)] += 1
    for topics, w in p.items():
        assert seen[topics] / rounds == pytest.approx(w / total, abs=0.012)


def test_proposals_leave_the_own_token_out():
    rng = np.random.default_rng(1)
    doc, term, z = [0] * 6 + [1] * 2, [0, 0, 1, 1, 2, 0, 0, 1], [0, 1, 1, 2, 2, 1, 0, 0]
    s = make_shard(doc, term, z, 3, 3, 1)
    i, rounds = 2, 200_000  # document 0, term 1, topic 1
    u = rng.random(rounds)
    cur = np.full(rounds, 1)
    entry, count = s.terms.find(np.full(rounds, 1 * 3 + 1))
    got = np.bincount(s.term_proposals(np.full(rounds, 1), cur, entry, count, u), minlength=3) / rounds
    n_kw, n_k = np.array([1.0, 0, 1]), np.array([3.0, 2, 2])
    want = (n_kw + s.beta) / (n_k + 3 * s.beta)
    assert got == pytest.approx(want / want.sum(), abs=0.005)

    new, peer = s.doc_proposals(np.zeros(rounds, int), cur, np.full(rounds, 2), u)
    assert not (peer == i).any()
    topic = np.where(peer >= 0, s.z[peer], new)
    n_dk = np.array([1.0, 2, 2])
    want = n_dk + s.alpha * 3 * (n_k + s.alpha_as) / (n_k.sum() + s.alpha_as * 3)
    assert np.bincount(topic, minlength=3) / rounds == pytest.approx(want / want.sum(), abs=0.005)


@pytest.mark.parametrize("dense", [True, False])
def test_training_keeps_the_counters_true(monkeypatch, dense):
    if not dense:
        monkeypatch.setattr(kernel, "DENSE_CELLS", 0)
        monkeypatch.setattr(kernel, "BATCH_CELLS", 40)
    rng = np.random.default_rng(2)
    doc = np.sort(rng.integers(0, 30, 4000))
    doc[:1500] = 0  # a long document beside short ones
    doc = np.unique(np.sort(doc), return_inverse=True)[1]
    term, z = rng.integers(0, 50, 4000), rng.integers(0, 7, 4000)
    s = make_shard(doc, term, z, 50, 7, 1)
    s.train(3, 9, 1)
    want = np.zeros((50, 7))
    np.add.at(want, (term, s.z), 1)
    got = np.zeros(50 * 7)
    got[s.terms.key] = s.terms.cnt
    assert (got.reshape(50, 7) == want).all() and (s.n_k == want.sum(axis=0)).all()
    for batch in s.batches:
        counts = s.doc_counts(batch).reshape(-1, 7)
        for d in range(*batch):
            assert (counts[d - batch[0]] == np.bincount(s.z[doc == d], minlength=7)).all()


def test_training_follows_the_token_weights():
    """One token against a large fixed rest: its long-run topics are the weights without it."""
    doc, term, z = [0, 0, 0, 0], [0, 1, 1, 1], [0, 1, 1, 2]
    s = make_shard(doc, term, z, 2, 3, 1)
    seen, rounds = np.zeros(3), 30_000
    for i in range(rounds):
        s.z[1:] = [1, 1, 2]
        key, cnt = np.unique(np.concatenate([[s.z[0]], 3 + s.z[1:]]), return_counts=True)
        s.terms = kernel.Rows(key // 3, key % 3, cnt, 2, 3)
        s.n_k = np.bincount(s.z, minlength=3).astype(float)
        s.prepare()
        s.visit(s.batches[0], 3, i)
        seen[s.z[0]] += 1
    want = weights(s, np.array([0.0, 2, 1]), np.zeros(3), np.array([0.0, 2, 1]))
    assert seen / rounds == pytest.approx(want / want.sum(), abs=0.02)


def test_log_likelihood_is_the_formula():
    rng = np.random.default_rng(4)
    K, V = 5, 6
    doc = np.repeat([0, 1, 2], [7, 1, 4])
    term, z = rng.integers(0, V, 12), rng.integers(0, K, 12)
    s = make_shard(doc, term, z, V, K, 1)
    n_dk = np.zeros((3, K))
    np.add.at(n_dk, (doc, z), 1)
    n_kw = np.zeros((V, K))
    np.add.at(n_kw, (term, z), 1)
    phi = (n_kw + s.beta) / (n_kw.sum(axis=0) + V * s.beta)
    theta = (n_dk + s.alpha) / (n_dk.sum(axis=1, keepdims=True) + K * s.alpha)
    want = sum(np.log(theta[d] @ phi[t]) for d, t in zip(doc, term))
    assert s.log_likelihood(doc, term, np.ones(12), False) == pytest.approx(want, rel=1e-12)


def test_a_long_document_follows_the_exact_marginals():
    """200 tokens of one term under a fixed model, visited in order: the topic counts are Dirichlet-multinomial."""
    counts = np.array([[30.0, 10, 5]])
    n, K = 200, 3
    s = make_shard([0] * n, [0] * n, [0] * n, 1, K, 0, counts, alpha=0.9)
    n_k = counts.sum(axis=0)
    prior = s.alpha * K * (n_k + s.alpha_as) / (n_k.sum() + s.alpha_as * K)
    w = (counts[0] + s.beta) / (n_k + s.V * s.beta)
    assert w == pytest.approx(w[0], abs=0.02)  # of about equal weight, so that the counts are nearly the prior's urn
    shares = []
    for i in range(6000):
        s.visit(s.batches[0], 8, i)
        shares.append(np.bincount(s.z, minlength=K) / n)
    shares = np.array(shares[200:])
    # log p(counts) = sum of log of rising factorials of the prior + counts . log w; its mean by enumeration
    from itertools import product
    from math import lgamma

    total, mean = 0.0, np.zeros(K)
    for a, b in product(range(n + 1), repeat=2):
        if a + b <= n:
            c = np.array([a, b, n - a - b])
            log = sum(lgamma(x + p) - lgamma(p) - lgamma(x + 1) for x, p in zip(c, prior)) + float(c @ np.log(w))
            total += np.exp(log)
            mean += np.exp(log) * c / n
    assert shares.mean(axis=0) == pytest.approx(mean / total, abs=0.05)


def test_steps_and_the_plain_loop_agree(monkeypatch):
    rng = np.random.default_rng(6)
    doc = np.repeat(np.arange(40), rng.integers(1, 60, 40))
    term, z = rng.integers(0, 30, len(doc)), rng.integers(0, 5, len(doc))
    found = []
    for abreast in (1, 10, 10**6):
        monkeypatch.setattr(kernel, "ABREAST", abreast)
        s = make_shard(doc, term, z.copy(), 30, 5, 1)
        s.train(3, 4, 2)
        found.append(s.z.tolist())
    assert found[0] == found[1] == found[2] and found[0] != z.tolist()


def test_few_topics_or_many_the_sampling_is_the_same(monkeypatch):
    """Rows with an entry for every topic, and blocks of few tokens, change no draw."""
    rng = np.random.default_rng(5)
    doc, term = np.repeat(np.arange(60), 30), rng.integers(0, 50, 1800)
    topic = rng.integers(0, 5, 1800)

    def trained(full, tokens):
        monkeypatch.setattr(kernel, "FULL", full)
        monkeypatch.setattr(kernel, "BATCH_TOKENS", tokens)
        key, cnt = np.unique(term * 5 + topic, return_counts=True)
        rows = kernel.Rows(key // 5, key % 5, cnt, 50, 5)
        assert rows.full == (full > 0)
        s = kernel.Shard(doc, term, topic.copy(), rows, np.bincount(topic, minlength=5), 50, 0.1, 0.01, 0.1, 1)
        assert len(s.batches) == (1 if tokens > 1800 else 60)
        s.train(4, 3, 1)
        return s.z.tolist()

    assert trained(8, 1 << 21) == trained(0, 1 << 21) == trained(8, 30) == trained(0, 30)


def test_proposals_that_change_nothing_are_not_visited(monkeypatch):
    """A term proposal of the token's own topic is left out before the steps, and the topics are those of all tokens visited."""
    rng = np.random.default_rng(7)
    doc = np.repeat(np.arange(50), 40)
    term, z = rng.integers(0, 30, len(doc)), rng.integers(0, 3, len(doc))
    seen = []
    plain = kernel.Shard._one_by_one

    def spy(self, topic, held, zero, at, z, cell, source, left, *rest):
        known = left != zero
        assert (topic[source[known]] != z[known]).all()
        seen.append(len(at))
        plain(self, topic, held, zero, at, z, cell, source, left, *rest)

    monkeypatch.setattr(kernel, "ABREAST", 10**6)  # all tokens in the plain loop
    monkeypatch.setattr(kernel.Shard, "_one_by_one", spy)
    s = make_shard(doc, term, z.copy(), 30, 3, 1)
    s.train(3, 4, 2)
    assert len(seen) == 3 and max(seen) < 0.9 * len(doc)


@pytest.mark.parametrize("own", [0, 1])
def test_pieces_of_any_length_give_the_same_topics(monkeypatch, own):
    rng = np.random.default_rng(8)
    doc = np.repeat(np.arange(40), rng.integers(1, 60, 40))
    term, z = rng.integers(0, 30, len(doc)), rng.integers(0, 5, len(doc))
    counts = None if own else rng.integers(0, 9, (30, 5)).astype(float)
    found = []
    for piece in (1 << 15, 100, 1):
        monkeypatch.setattr(kernel, "PIECE", piece)
        s = make_shard(doc, term, z.copy(), 30, 5, own, counts)
        if own:
            s.train(3, 4, 2)
        else:
            s.infer(3, 1, 4)
        found.append(s.z.tolist())
    assert found[0] == found[1] == found[2] and found[0] != z.tolist()
