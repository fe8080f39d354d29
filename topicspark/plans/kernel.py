"""Sampling inside one shard, in numpy.

A shard is a set of whole documents with the counters of their terms. Each document's tokens are visited one after the
other; documents advance side by side, so step j visits the j-th token of every document that has one. Where few
documents are left, their remaining tokens are visited in a plain loop, by the same arithmetic. Document counters
change after each token; term and topic counters after each visit of all tokens.

A token's new topic is proposed either from its document (another token's topic, or the prior) or from
its term's counters, with its own topic left out of all counts, and then accepted or not. In the
acceptance ratio the proposal's own factor cancels: what is left for a document proposal is the ratio of
the term weights, and for a term proposal the ratio of the document weights.

Every draw is a hash of (seed, sweep, visit, document, place of the token in it), so it does not matter which
documents share a shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

ABREAST = 24  # fewer documents than this are visited token by token
BATCH_CELLS = 1 << 24  # cells of a dense documents x topics block
BATCH_TOKENS = 1 << 21  # tokens of a block of documents, if it holds more than one
DENSE_CELLS = 1 << 24  # up to so many rows x topics, entries are found by a table
FULL = 8  # rows that hold 1 / FULL of all their topics or more are kept with an entry for every topic
PIECE = 1 << 15  # tokens whose proposals are drawn at a time, which fit the cache
RAGGED_CELLS = 1 << 22


class Rows:
    """Sparse rows of counts per topic. `key` = row * K + topic, ascending.

    Where there are few topics, each has an entry in each row, and so a key is its own place.
    """

    def __init__(self, row, topic, cnt, num_rows, num_topics):
        key = np.asarray(row, np.int64) * num_topics + topic
        order = np.argsort(key, kind="stable")
        self.K, self.num_rows = num_topics, num_rows
        self.key, self.cnt = key[order], np.asarray(cnt, float)[order]
        self.full = 0 < num_rows * num_topics <= min(DENSE_CELLS, FULL * len(key))
        if self.full:
            sparse, self.key = self.key, np.arange(num_rows * num_topics)
            self.cnt = np.bincount(sparse, self.cnt, len(self.key))
        self._index()

    def _index(self):
        self.table = None
        if self.full:
            self.table = self.key
        elif 0 < self.num_rows * self.K <= DENSE_CELLS:
            self.table = np.full(self.num_rows * self.K, -1, np.int32)
            self.table[self.key] = np.arange(len(self.key))

    def bounds(self):
        return np.searchsorted(self.key, np.arange(self.num_rows + 1, dtype=np.int64) * self.K)

    def find(self, key):
        """(position, count) per key; the count is 0 where there is no such entry."""
        if self.full:
            return key, self.cnt[key]
        if not len(self.key):
            return np.zeros(len(key), np.int64), np.zeros(len(key))
        if self.table is not None:
            at = self.table[key]
            return at, np.where(at >= 0, self.cnt[at], 0.0)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return at, np.where(self.key[at] == key, self.cnt[at], 0.0)

    def add(self, key, change):
        if self.full:
            self.cnt += np.bincount(key, change, len(self.cnt))
            return
        order = np.argsort(key)
        key = key[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, change = key[start], np.add.reduceat(change[order], start)
        at, _ = self.find(key)
        known = self.key[at] == key
        self.cnt[at[known]] += change[known]
        fresh = ~known & (change != 0)
        spot = np.searchsorted(self.key, key[fresh])
        self.key = np.insert(self.key, spot, key[fresh])
        self.cnt = np.insert(self.cnt, spot, change[fresh])
        self._index()


def _pick(cum, x, first, last):
    """Index in first..last of the interval of the running sum `cum` that holds x."""
    return np.clip(np.searchsorted(cum, x, side="right"), first, last)


def _mixed(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_keys(doc_ids, place):
    """One 64-bit number per token, from its document's id and its place in it."""
    return _mixed(_mixed(np.asarray(doc_ids, np.int64).view(np.uint64)) + np.asarray(place).astype(np.uint64))


def draws(keys, *visit):
    """Three uniform draws in [0, 1) per token, for a visit named by integers."""
    name = np.zeros(1, np.uint64)
    for part in visit:
        name = _mixed(name * np.uint64(0x9E3779B97F4A7C15) + np.array([part & 0xFFFFFFFFFFFFFFFF], np.uint64))
    base = _mixed(keys ^ name)
    return [(_mixed(base + np.uint64(i + 1)) >> np.uint64(11)) * 2.0**-53 for i in range(3)]


class Shard:
    """Tokens, sorted by document, with the counters they are sampled against.

    own = 1: the tokens are part of the counters, which follow their moves (training).
    own = 0: the counters belong to a finished model and stay (inference).
    """

    def __init__(self, doc, term, topic, terms: Rows, n_k, num_terms, alpha, beta, alpha_as, own, keys=None):
        self.doc, self.term, self.z = doc, term, topic
        self.terms, self.own = terms, own
        self.n_k = np.array(n_k, float)
        self.K, self.V = len(self.n_k), num_terms
        self.alpha, self.beta, self.alpha_as = alpha, beta, alpha_as
        self.num_docs = int(doc.max()) + 1 if len(doc) else 0
        self.doc_len = np.bincount(doc, minlength=self.num_docs)
        self.doc_start = np.cumsum(self.doc_len) - self.doc_len
        self.keys = token_keys(doc, np.arange(len(doc)) - self.doc_start[doc]) if keys is None else keys
        per_batch = max(1, BATCH_CELLS // self.K)
        self.batches, d = [], 0
        while d < self.num_docs:
            upto = int(np.searchsorted(self.doc_start, self.doc_start[d] + BATCH_TOKENS))
            self.batches.append((d, max(d + 1, min(d + per_batch, upto, self.num_docs))))
            d = self.batches[-1][1]
        self.order = {}
        self.prepare()

    def prepare(self):
        """Weights and running sums of the current counters."""
        self.denom = self.n_k + self.V * self.beta
        scale = self.alpha * self.K / (self.n_k.sum() - self.own + self.alpha_as * self.K)
        self.prior, self.prior_own = (self.n_k + self.alpha_as) * scale, self.own * scale
        self.prior_cum = np.cumsum(self.prior)
        self.smooth = self.beta / self.denom
        self.smooth_cum = np.cumsum(self.smooth)
        self.weight = self.terms.cnt / self.denom[self.terms.key % self.K]
        self.weight_cum = np.cumsum(self.weight)
        bounds = self.terms.bounds()
        edge = np.concatenate([[0.0], self.weight_cum])[bounds]
        self.first, self.last, self.base, self.row_sum = bounds[:-1], bounds[1:] - 1, edge[:-1], np.diff(edge)

    def tokens_of(self, batch):
        d0, d1 = batch
        t0 = self.doc_start[d0]
        return slice(t0, self.doc_start[d1 - 1] + self.doc_len[d1 - 1])

    def laid_out(self, batch):
        """The batch's tokens by their places in their documents: the same for every visit, so it is found once.

        (tokens, where each token of the batch stands in them, where each place begins, document, term, place, keys)
        """
        if batch not in self.order:
            span = self.tokens_of(batch)
            place = np.arange(span.start, span.stop) - self.doc_start[self.doc[span]]
            tokens = np.argsort(place, kind="stable")
            spot = np.empty(len(tokens), np.int64)
            spot[tokens] = np.arange(len(tokens))
            begin = np.concatenate([[0], np.cumsum(np.bincount(place))])
            self.order[batch] = tokens, spot, begin, self.doc[span][tokens], self.term[span][tokens], place[tokens], self.keys[span][tokens]
        return self.order[batch]

    def doc_counts(self, batch):
        """Dense counts of the batch's documents."""
        d0, d1 = batch
        t = self.tokens_of(batch)
        cell = (self.doc[t] - d0).astype(np.int64) * self.K + self.z[t]
        return np.bincount(cell, minlength=(d1 - d0) * self.K).astype(float)

    def pick_entries(self, term, x):
        """The entry of each term whose stretch of the running sum holds x."""
        if not self.terms.full:
            return _pick(self.weight_cum, x, self.first[term], self.last[term])
        before, at = self.first[term] - 1, np.zeros(len(x), np.int64)  # counts the entries up to x, of all but the last, by halves
        step = 1 << (self.K - 1).bit_length() >> 1
        while step:
            upto = np.minimum(at + step, self.K - 1)
            at = np.where(self.weight_cum[before + upto] <= x, upto, at)
            step >>= 1
        return before + 1 + at

    def term_proposals(self, term, cur, entry, count, u):
        term_sum, rest = self.row_sum[term], self.smooth_cum[-1]
        if self.own:
            denom = self.denom[cur]
            less = count / denom - (count - 1) / (denom - 1)  # weight the own token takes off its topic's term part
            more = self.beta / (denom - 1) - self.smooth[cur]  # and adds to its smoothing part
            term_sum = term_sum - less
            x = u * (term_sum + rest + more)
        else:
            x = u * (term_sum + rest)
        from_term = x < term_sum
        new = np.empty(len(cur), np.int64)
        w = np.flatnonzero(~from_term)  # few
        y = x[w] - term_sum[w]
        if self.own:
            start = self.smooth_cum[cur[w]] - self.smooth[cur[w]]
            y = np.where(y < start, y, np.maximum(y - more[w], start))
        new[w] = _pick(self.smooth_cum, y, 0, self.K - 1)
        w = np.flatnonzero(from_term)
        t, x = term[w], x[w]
        base = self.base[t]
        if self.own:
            less = less[w]
            x = np.where(x < self.weight_cum[entry[w]] - base - less, x, x + less)
        at = self.pick_entries(t, base + x)
        new[w] = (at if self.terms.full else self.terms.key[at]) % self.K
        return new

    def doc_proposals(self, doc, cur, place, u):
        """(topic, peer): the token of the document (by its index in the shard) that gives the topic; or the topic, and -1."""
        others = self.doc_len[doc] - 1
        x = u * (others + self.prior_cum[-1] - self.prior_own)
        peer = x.astype(np.int64)
        peer += self.doc_start[doc] + (peer >= place)
        new = np.zeros(len(cur), np.int64)
        drawn = np.flatnonzero(x >= others)  # few
        y = x[drawn] - others[drawn]
        y = np.where(y < self.prior_cum[cur[drawn]] - self.prior_own, y, y + self.prior_own)
        new[drawn], peer[drawn] = _pick(self.prior_cum, y, 0, self.K - 1), -1
        return new, peer

    def proposals(self, piece, z, doc, term, place, keys, name):
        """The draws of some tokens: which take a term proposal of another topic, the topic, and their toss; which take a
        document proposal, the topic, the peer, and the current topic's side of the ratio."""
        z, doc, term, place = z[piece], doc[piece], term[piece], place[piece]
        coin, u, toss = draws(keys[piece], *name)
        by_doc = coin < 0.5
        entry, count = self.terms.find(term * self.K + z)
        w, d = np.flatnonzero(~by_doc), np.flatnonzero(by_doc)
        new = self.term_proposals(term[w], z[w], entry[w], count[w], u[w])
        other = np.flatnonzero(new != z[w])
        drawn, peer = self.doc_proposals(doc[d], z[d], place[d], u[d])
        side = toss[d] * ((count[d] - self.own + self.beta) / (self.denom[z[d]] - self.own))
        w = w[other]
        return piece.start + w, new[other], toss[w], piece.start + d, drawn, peer, side

    def visit(self, batch, *name):
        """Visit every token of a batch of documents once. Returns the documents' counts after it.

        Each place of the documents is one step, document proposals first, then term proposals; a document has one token there.
        A proposal is taken from where its topic stands in `topic`: at its peer, or behind all tokens where it is known
        before. A known proposal of a term that is the token's own topic changes nothing, and is left out.

        Both kinds are accepted by factor * (held[left] + less) < held[right + proposal] + more: `held` has the documents'
        counts, a 0 and, with full rows, the ratio of each term and topic. For a document proposal the left side is a number.
        """
        d0, _ = batch
        span = self.tokens_of(batch)
        n_dk = self.doc_counts(batch)
        if span.start == span.stop:
            return n_dk
        tokens, spot, begin, doc, term, place, keys = self.laid_out(batch)
        z, n, full = self.z[span][tokens], len(tokens), self.terms.full
        found = [self.proposals(slice(a, a + PIECE), z, doc, term, place, keys, name) for a in range(0, n, PIECE)]
        w, new, toss_w, d, drawn, peer, side = (np.concatenate(x) for x in zip(*found))
        z_w, z_d, doc_d, term_d = z[w], z[d], doc[d], term[d] * self.K
        peer = np.where(peer >= 0, spot[np.maximum(peer - span.start, 0)], n + np.arange(len(d)))
        topic = np.concatenate([z, drawn, new])
        ratio = (self.terms.cnt + self.beta) / self.denom[self.terms.key % self.K] if full else []
        zero, doc_w = len(n_dk), (doc[w] - d0) * self.K
        held = np.concatenate([n_dk, [0.0], ratio])

        first_d, first_w = np.searchsorted(d, begin), np.searchsorted(w, begin)
        to_d, to_w = np.arange(len(d)) + first_w[place[d]], np.arange(len(w)) + first_d[place[w] + 1]

        def both(of_d, of_w, kind=np.int64):
            out = np.empty(len(d) + len(w), kind)
            out[to_d], out[to_w] = of_d, of_w
            return out

        at, z, cell = both(d, w), both(z_d, z_w), both((doc_d - d0) * self.K, doc_w)
        source = both(peer, n + len(d) + np.arange(len(w)))
        left, right = both(zero, doc_w + z_w), both(term_d + (zero + 1) * full, doc_w)
        factor, less = both(1.0, toss_w, float), both(side, self.prior[z_w] - self.prior_own - 1, float)
        more = both(0.0, self.prior[new], float)

        thin = np.flatnonzero(np.diff(begin) < ABREAST)  # documents only get fewer from place to place
        steps = int(thin[0]) if len(thin) else len(begin) - 1
        cuts, middle = (first_d + first_w).tolist(), (first_d[1:] + first_w[:-1]).tolist()
        for j in range(steps):
            a, c = cuts[j], cuts[j + 1]
            new = topic[source[a:c]]
            if full:
                there = held[right[a:c] + new]
            else:
                b, there = middle[j], np.empty(c - a)
                there[: b - a] = (self.terms.find(right[a:b] + new[: b - a])[1] + self.beta) / self.denom[new[: b - a]]
                there[b - a :] = held[right[b:c] + new[b - a :]]
            ok = factor[a:c] * (held[left[a:c]] + less[a:c]) < there + more[a:c]
            ok &= new != z[a:c]
            moved = ok.nonzero()[0]
            new = new[moved]
            moved += a
            rows = cell[moved]  # no row comes twice
            held[rows + z[moved]] -= 1
            held[rows + new] += 1
            topic[at[moved]] = new
        if cuts[steps] < len(at):
            self._one_by_one(topic, held, zero, *(x[cuts[steps] :] for x in (at, z, cell, source, left, right, factor, less)))
        moved = np.empty(n, np.int64)
        moved[tokens] = topic[:n]
        self.z[span] = moved
        return held[:zero]

    def _one_by_one(self, topic, held, zero, at, z, cell, source, left, right, factor, less):
        """These tokens in order: the same as a step, for one token."""
        beta, denom, prior, full = self.beta, self.denom.tolist(), self.prior.tolist(), self.terms.full
        counts = {row: held[row : row + self.K].tolist() for row in np.unique(cell).tolist()}
        topic_of, held_of = topic.item, held.item
        for i, cur, row, p, here, term, coin, number in zip(*(x.tolist() for x in (at, z, cell, source, left, right, factor, less))):
            new = topic_of(p)
            if new == cur:
                continue
            row = counts[row]
            if here == zero:  # a term's counters at the topics its document could propose are looked up as they are needed
                accepted = number < (held_of(term + new) if full else (self._held(term + new) + beta) / denom[new])
            else:
                accepted = coin * (row[cur] + number) < row[new] + prior[new]
            if accepted:
                row[cur] -= 1
                row[new] += 1
                topic[i] = new
        for row, found in counts.items():
            held[row : row + self.K] = found

    def _held(self, key):
        """The count of one entry, 0 where there is none."""
        find, keys = self.terms.table, self.terms.key
        if find is not None:
            at = int(find[key])
        else:
            at = int(np.searchsorted(keys, key))
            at = at if at < len(keys) and keys[at] == key else -1
        return float(self.terms.cnt[at]) if at >= 0 else 0.0

    def train(self, passes, seed, sweep):
        for number in range(passes):
            before = self.z.copy()
            for batch in self.batches:
                self.visit(batch, seed, sweep, number)
            moved = np.flatnonzero(before != self.z)
            old, new = before[moved], self.z[moved]
            cell = self.term[moved].astype(np.int64) * self.K
            if len(moved):
                self.terms.add(np.concatenate([cell + new, cell + old]), np.repeat([1.0, -1.0], len(moved)))
                self.n_k += np.bincount(new, minlength=self.K) - np.bincount(old, minlength=self.K)
                self.prepare()

    def infer(self, sweeps, keep, seed):
        """Sum of the documents' counts over the last `keep` sweeps: (document, topic, sum)."""
        found = []
        for batch in self.batches:
            total = 0.0
            for sweep in range(sweeps):
                n_dk = self.visit(batch, seed, sweep, 0)
                if sweep >= sweeps - keep:
                    total = total + n_dk
            if keep:
                cell = np.flatnonzero(total)
                found.append((batch[0] + cell // self.K, cell % self.K, total[cell]))
        return [np.concatenate(part) for part in zip(*found)] if found else None

    def log_likelihood(self, doc, term, size, compat):
        """Sum over (document, term, tokens) of tokens * ln p(term | document)."""
        total = 0.0
        per_term = np.bincount(self.terms.key // self.K, self.weight, self.terms.num_rows)
        width = self.last - self.first + 1
        for batch in self.batches:
            d0, d1 = batch
            n_dk = self.doc_counts(batch)
            block = n_dk.reshape(d1 - d0, self.K)
            doc_size = block.sum(axis=1)
            doc_part = block @ self.smooth
            here = np.flatnonzero((doc >= d0) & (doc < d1))
            cost = np.cumsum(width[term[here]])
            for part in np.split(here, np.searchsorted(cost, np.arange(RAGGED_CELLS, cost[-1], RAGGED_CELLS))):
                t, d = term[part], doc[part] - d0
                edge = np.repeat(np.arange(len(part)), width[t])
                skip = np.cumsum(width[t]) - width[t]
                at = np.arange(len(edge)) - np.repeat(skip - self.first[t], width[t])
                both = self.weight[at] * n_dk[d[edge] * self.K + self.terms.key[at] % self.K]
                p = np.bincount(edge, both, len(part)) + doc_part[d] + self.alpha * per_term[t]
                p += self.alpha * self.smooth.sum()
                scale = 1.0 / (doc_size[d] + self.K * self.alpha)
                total += float(size[part] @ np.log(p * (1 + scale) if compat else p * scale))
        return total


def shard_from_arrow(edges: pa.Table, counters: pa.Table, spec):
    """(shard, edge columns in order). Rows are put in order first: what arrives first must not matter."""
    doc_id, term_id, block = (edges[c].to_numpy() for c in ("doc_id", "term_id", "block"))
    order = np.lexsort((block, term_id, doc_id))
    topics = edges["topics"].combine_chunks()
    length = topics.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(length) - length
    doc_id, term_id, block, length, start = (x[order] for x in (doc_id, term_id, block, length, start))
    docs, doc = np.unique(doc_id, return_inverse=True)
    terms, term = np.unique(term_id, return_inverse=True)
    first = np.cumsum(length) - length
    source = np.arange(int(length.sum())) + np.repeat(start - first, length)
    z = topics.flatten().to_numpy()[source].astype(np.int64)

    spot = np.minimum(np.searchsorted(terms, counters["id"].to_numpy()), max(len(terms) - 1, 0))
    counters = counters.filter(pa.array(terms[spot] == counters["id"].to_numpy()))
    spot = np.searchsorted(terms, counters["id"].to_numpy())
    topic_lists = counters["topics"].combine_chunks()
    size = topic_lists.value_lengths().to_numpy(zero_copy_only=False)
    K = len(spec["n_k"])
    held = Rows(np.repeat(spot, size), topic_lists.flatten().to_numpy(), counters["cnts"].combine_chunks().flatten().to_numpy(), len(terms), K)
    token_doc, token_term = np.repeat(doc, length), np.repeat(term, length)
    doc_len = np.bincount(token_doc, minlength=len(docs))
    place = np.arange(len(token_doc)) - (np.cumsum(doc_len) - doc_len)[token_doc]
    shard = Shard(
        token_doc, token_term, z, held, spec["n_k"], spec["num_terms"], spec["alpha"], spec["beta"], spec["alpha_as"], spec["own"],
        token_keys(docs[token_doc], place),
    )
    return shard, {"doc_id": doc_id, "term_id": term_id, "block": block, "length": length, "docs": docs, "doc": doc, "term": term}


def run_shard(spec):
    """The function applied to each shard's (edges, counters).

    spec["task"]: "train" and "warm" return the edges with their new topics, "infer" the documents'
    topic sums, "score" the shard's log-likelihood.
    """

    def run(key, edges: pa.Table, counters: pa.Table) -> pa.Table:
        number = key[0].as_py()
        if not edges.num_rows:
            return spec["schema"].empty_table()
        shard, at = shard_from_arrow(edges, counters, spec)
        score = None
        if spec["score"] or spec["task"] == "score":
            score = shard.log_likelihood(at["doc"], at["term"], at["length"].astype(float), spec["compat"])
        if spec["task"] == "score":
            return pa.table({"loglik": [score]}, schema=spec["schema"])
        if spec["task"] == "infer":
            doc, topic, total = shard.infer(spec["sweeps"], spec["keep"], spec["seed"])
            return pa.table(
                {"doc_id": at["docs"][doc], "topic": topic.astype(np.int32), "cnt": total}, schema=spec["schema"]
            )
        if spec["task"] == "train":
            shard.train(spec["sweeps"], spec["seed"], spec["sweep"])
        else:
            shard.infer(spec["sweeps"], 0, spec["seed"])
        rows = len(at["length"])
        offsets = np.concatenate([[0], np.cumsum(at["length"])]).astype(np.int32)
        scores = pa.array([score] + [None] * (rows - 1), pa.float64())
        return pa.table(
            {
                "shard": np.full(rows, number, np.int32), "doc_id": at["doc_id"], "term_id": at["term_id"], "block": at["block"],
                "topics": pa.ListArray.from_arrays(pa.array(offsets), pa.array(shard.z.astype(np.int32))),
                "loglik": scores,
            },
            schema=spec["schema"],
        )

    return run
