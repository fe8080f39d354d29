"""The minimised acceptor of a list of words, and its composition with a one-edit transducer and itself, in numpy.

The words are sorted by code points and made a trie level by level. Nodes with the same set of continuations are one
state, told by 128-bit hashes from the leaves up; that is the minimal acceptor. A state's words are numbered in order, so
a path to a state names a run of consecutive words.

In the composition a path first reads the same symbols on both sides (no edit yet, both sides in one state), then the
edit, then again the same symbols, in a pair of states. The edit stands at the first place where the words differ, so
each pair of words has one path. A pair of states lives on only if both can still read the same word: that is told by
masks over their continuations. Where both sides reach the same state, all words from there on are pairs at once. What
follows a state is worked out once, for all prefixes that lead to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
LABEL_BITS, CHUNK = 21, 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _turned(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    by = by & U(63)
    return (x << by) | (x >> ((U(64) - by) & U(63)))


def _steps(counts: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class Acceptor:
    """Of sorted distinct words. Node 0 is the root; nodes go by depth, then in the order of the words."""

    def __init__(self, words: list[str]):
        n = len(words)
        self.lengths = lengths = np.fromiter(map(len, words), np.int64, n)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        shared = np.zeros(n, np.int64)  # symbols that a word shares with the one before
        live, depth = np.arange(1, n), 0
        while len(live):
            live = live[(lengths[live] > depth) & (lengths[live - 1] > depth)]
            live = live[codes[starts[live] + depth] == codes[starts[live - 1] + depth]]
            shared[live] += 1
            depth += 1
        parents, labels, firsts, counts, finals = [], [], [np.zeros(1, np.int64)], [np.array([n])], [np.array([n > 0 and lengths[0] == 0])]
        self.levels = [0, 1]
        at, here, depth = np.arange(n), np.zeros(n, np.int64), 1
        while len(at := at[lengths[at] >= depth]):
            new = shared[at] < depth
            ids = self.levels[-1] + np.cumsum(new) - 1
            parents.append(here[at[new]])
            labels.append(codes[starts[at[new]] + depth - 1])
            firsts.append(at[new])
            counts.append(np.bincount(ids - self.levels[-1]))
            final = np.zeros(len(parents[-1]), bool)
            final[ids[lengths[at] == depth] - self.levels[-1]] = True
            finals.append(final)
            here[at] = ids
            self.levels.append(self.levels[-1] + len(final))
            depth += 1
        none = np.zeros(0, np.int64)
        self.parent, self.label = np.concatenate([none, *parents]), np.concatenate([none, *labels])  # of node i + 1
        self.first, self.count, self.final = np.concatenate(firsts), np.concatenate(counts), np.concatenate(finals)
        self.depth = np.repeat(np.arange(len(self.levels) - 1), np.diff(self.levels))
        self.children = np.bincount(self.parent, minlength=len(self.first))
        self.child = np.cumsum(self.children) - self.children + 1  # first child, if there is one
        self.edges = (self.parent << LABEL_BITS) | self.label  # ascending
        self._minimise()

    def _minimise(self) -> None:
        """For each node its state's first node, and masks of the continuations: by first symbol, length and a sum of symbols."""
        total = len(self.first)
        low, high = np.zeros(total, U), np.zeros(total, U)
        self.heads, self.ends, self.sums = np.zeros(total, U), np.zeros(total, U), np.zeros(total, U)
        for a, b in zip(self.levels[-2::-1], self.levels[:0:-1]):
            own = self.final[a:b].astype(U)
            low[a:b], high[a:b] = _mixed(low[a:b] + own * U(0x9E3779B9)), _mixed(high[a:b] ^ (own * U(0x51ED270B)) + U(7))
            self.ends[a:b] |= own
            self.sums[a:b] |= own
            if a == 0:
                break
            up, label = self.parent[a - 1 : b - 1], self.label[a - 1 : b - 1].astype(U)
            cut = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
            to, turn = up[cut], _mixed(label + U(1))
            low[to] = np.add.reduceat(_mixed(low[a:b] + turn), cut)
            high[to] = np.add.reduceat(_mixed(high[a:b] ^ (turn * U(0xD6E8FEB86659FD93))), cut)
            self.heads[to] = np.bitwise_or.reduceat(U(1) << (turn & U(63)), cut)
            self.ends[to] = np.bitwise_or.reduceat(_turned(self.ends[a:b], np.ones(1, U)), cut)
            self.sums[to] = np.bitwise_or.reduceat(_turned(self.sums[a:b], turn >> U(8)), cut)
        order = np.lexsort((high, low))
        new = np.ones(total, bool)
        new[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
        self.state = np.empty(total, np.int64)
        self.state[order] = np.minimum.reduceat(order, np.flatnonzero(new))[np.cumsum(new) - 1] if total else 0

    def near_pairs(self, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j) of word numbers, each once: words that differ by one inserted, deleted or replaced symbol and share
        their first least[i] = least[j] symbols; words of different `least` share fewer."""
        allowed = np.flatnonzero(self.depth >= least[np.minimum(self.first, max(len(least) - 1, 0))]) if len(least) else np.zeros(0, np.int64)
        allowed = allowed[self.children[allowed] > 0]
        order = allowed[np.argsort(self.state[allowed], kind="stable")]  # the prefixes of each state lie together
        states, begin, often = np.unique(self.state[order], return_index=True, return_counts=True)
        for a in range(0, len(states), 1 << 16):
            for which, left, right in self._from(states[a : a + (1 << 16)]):
                which = which + a
                times = often[which]
                for part in np.array_split(np.arange(len(which)), max(1, int(times.sum() // CHUNK))):
                    t = times[part]
                    base = self.first[order[np.repeat(begin[which[part]], t) + _steps(t)]]
                    yield base + np.repeat(left[part], t), base + np.repeat(right[part], t)

    def _from(self, states: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(number of the state, word, word): the pairs whose edit stands right at the state, words numbered from the state's first."""
        number = np.repeat(np.arange(len(states)), self.children[states])
        edge = np.repeat(self.child[states], self.children[states]) + _steps(self.children[states])
        place, origin = edge - self.child[states[number]], states[number]
        later = self.children[origin] - 1 - place
        one = np.repeat(np.arange(len(edge)), later)
        two = one + 1 + _steps(later)
        jump = self.first[edge] - self.first[origin]
        none = np.full(len(one), -1)
        # replaced: two edges of the state; left out: one edge against the state itself, which may not read that symbol first
        stack = [
            (number[one], self.state[edge[one]], self.state[edge[two]], jump[one], jump[two], none),
            (number, self.state[edge], origin, jump, np.zeros_like(jump), self.label[edge - 1]),
        ]
        while stack:
            pairs = stack.pop()
            if len(pairs[0]) > CHUNK:
                stack += [tuple(x[i : i + CHUNK] for x in pairs) for i in range(0, len(pairs[0]), CHUNK)]
                continue
            which, p, q, left, right, ban = pairs
            same = p == q
            n = self.count[p[same]]
            if len(n):
                yield np.repeat(which[same], n), np.repeat(left[same], n) + _steps(n), np.repeat(right[same], n) + _steps(n)
            live = ~same & ((self.sums[p] & self.sums[q]) != 0) & ((self.ends[p] & self.ends[q]) != 0)
            both = live & self.final[p] & self.final[q]
            if both.any():
                yield which[both], left[both], right[both]
            live &= (self.heads[p] & self.heads[q]) != 0
            which, p, q, left, right, ban = (x[live] for x in (which, p, q, left, right, ban))
            if not len(p):
                continue
            swap = self.children[p] > self.children[q]  # the fewer edges are looked up among the others
            few, many = np.where(swap, q, p), np.where(swap, p, q)
            n = self.children[few]
            row = np.repeat(np.arange(len(p)), n)
            edge = self.child[few[row]] + _steps(n)
            key = (many[row] << LABEL_BITS) | self.label[edge - 1]
            found = np.searchsorted(self.edges, key)
            hit = (found < len(self.edges)) & (self.label[edge - 1] != ban[row])
            hit[hit] = self.edges[found[hit]] == key[hit]
            row, edge, other = row[hit], edge[hit], found[hit] + 1
            on = np.where(swap[row], other, edge), np.where(swap[row], edge, other)
            stack.append((
                which[row], self.state[on[0]], self.state[on[1]], left[row] + self.first[on[0]] - self.first[p[row]],
                right[row] + self.first[on[1]] - self.first[q[row]], np.full(len(row), -1),
            ))
