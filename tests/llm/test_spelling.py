"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from topicspark.llm import spelling
from topicspark.llm.acceptor import Acceptor

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def are_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[at + 1 :] == b[at + 1 :]
    a, b = sorted((a, b), key=len, reverse=True)
    return a[at + 1 :] == b[at:]


def brute(rows):
    """{word: (form, root, n, n_near, form_n)} of rows (doc_id, text)."""
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    # near words have a common rest after leaving out one symbol, or one is the other's rest
    rests = {}
    for w in counts:
        for rest in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            rests.setdefault(rest, []).append(w)
    near = {w: set() for w in counts}
    for group in rests.values():
        for w in group:
            near[w] |= {v for v in group if are_near(v, w)}
    forms = {}
    for w, n in counts.items():
        top = min(near[w], key=lambda v: (-counts[v], v), default=None)
        forms[w] = top if top is not None and counts[top] >= 10 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (forms[w], root, n, len(near[w]), counts[forms[w]] if forms[w] else None)
    return out


def told(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def texts(seed):
    """Words of few syllables in very different numbers, with slips in them; a chain of forms; a hot start."""
    rng = random.Random(seed)
    words = ["common" + "".join(rng.choice(("ab", "ba", "é", "c", "÷")) for _ in range(rng.randint(1, 5))) for _ in range(150)]
    words += ["".join(rng.choice(("tion", "ren", "da", "ß")) for _ in range(rng.randint(2, 4))) for _ in range(60)]
    words += ["chainlink"] * 1 + ["chainlonk"] * 12 + ["chainlonkk"] * 130
    rows = []
    for d in range(80):
        some = [rng.choice(words[: rng.choice((5, 40, len(words)))]) for _ in range(60)]
        for _ in range(8):
            w = rng.choice(some)
            at = rng.randrange(len(w))
            some.append(w[:at] + rng.choice(("", "x", "é", "q" + w[at])) + w[at + 1 :])
        rng.shuffle(some)
        rows.append((d, rng.choice((" ", ", ", "-", "3")).join(some).upper() if d % 9 == 0 else " ".join(some)))
    rows += [(90, "chainlink chainlink " + "chainlonk " * 30), (91, "chainlonkk " * 400)]
    return rows


@pytest.mark.parametrize("limit", [100_000, 12])
def test_variants_are_brute_force(docs, limit):
    rows = texts(1)
    want = brute(rows)
    got = told(spelling.spelling_variants(docs(rows).repartition(3), limit=limit))
    assert got == want
    assert want["chainlink"][:2] == ("chainlonk", "chainlonkk") and sum(v[3] for v in want.values()) > 200


def test_odd_rows(docs, odd, nothing):
    assert spelling.spelling_variants(nothing).count() == 0
    long = "x" * 60_000
    rows = [(1, None), (2, ""), (None, "wordless wordless wordles"), (None, "wordless wordless wordles"), (5, long + " " + long), (6, long[1:] + " " + long[1:])]
    assert told(spelling.spelling_variants(docs(rows))) == brute(rows)
    assert told(spelling.spelling_variants(odd)) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])


def test_the_composition_is_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        symbols = "abcé"[: rng.choice((2, 3, 4))]
        words = sorted({"".join(rng.choice(symbols) for _ in range(rng.randint(0, 8))) for _ in range(rng.choice((0, 1, 3, 50, 200)))})
        least = rng.choice((0, 1, 2))
        got = [tuple(sorted(p)) for i, j in Acceptor(words).near_pairs(np.full(len(words), least)) for p in zip(i.tolist(), j.tolist())]
        fit = lambda a, b: are_near(a, b) and a[:least] == b[:least] and min(len(a), len(b)) >= least
        want = {(i, j) for j in range(len(words)) for i in range(j) if fit(words[i], words[j])}
        assert len(got) == len(set(got)) and set(got) == want


def test_the_acceptor_is_minimal():
    words = sorted(a + b for a in ("un", "re", "in") for b in ("do", "made", "make"))
    states = len(set(Acceptor(words).state.tolist()))
    assert states == 9  # the root; after u and i; after r; after the first part; after d, m, ma; before the last e; the end


def test_the_smallest_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert told(spelling.spelling_variants(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
