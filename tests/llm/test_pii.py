"""Personal data against plain patterns; what the trees add; odd texts."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from topicspark.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, text):
    numbers = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(numbers)))
        return 13 <= len(numbers) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(numbers) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def check(rows, found):
    """Base columns as by plain patterns; all base spans among the spans."""
    left = {}
    for i, t in rows:
        left.setdefault(i, []).append(brute(t))
    for r in found:
        want = next(w for w in left[r["doc_id"]] if hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in w).encode()).hexdigest() == r["base_sha256"])
        left[r["doc_id"]].remove(want)
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x[0] == k for x in want) for k in PLAIN]
        got = [tuple(int(x) if x.isdigit() else x for x in s.split(":")) for s in r["spans"].split(",") if s]
        assert set(want) <= set(got) and got == sorted(set(got), key=lambda s: (list(PLAIN).index(s[0]), s[1]))
    assert not any(left.values())


ODD = [
    "a@b.c@d.e", "x a@b.c_d@e.f", "@b.c", "a@b", "a@b.", "a@b..c", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.4", "0001.002.3.0255", "1.2.3.99999999999999999999",
    "4111111111111111", "4111 1111-1111 1111", "4111  1111 1111 1111", "+1 (376) 555-7269.", "++1 2 345678901", "+1" + " " * 300 + "2345678901", "+123", "é+49 30 1234567890é😀 1.2.3.4",
    "4222222222222 +4222222222222", "a@b" + ".c" * 4000, "z" * 30_000 + "@", "9" * 50_000, "1.1.1.1 " * 3000, "", None, "\U0001f600a@b.c",
]


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_base_spans_are_the_plain_patterns(docs, model):
    rng = random.Random(2)
    rows = list(enumerate(ODD)) + [(None, "1.2.3.4"), (None, "1.2.3.4"), (3, "a@b")]
    for i in range(400):
        rows.append((100 + i, "".join(rng.choice("1234 0.@-+()aé😀 1255") for _ in range(rng.randint(0, 60)))))
    check(rows, pii.report(docs(rows).repartition(4), model).collect())
    check(rows, pii.report(docs(rows), pii.Redactor()).collect())


def test_nothing(docs, nothing, odd, model):
    assert pii.report(nothing, model).count() == 0 and pii.fit(nothing) == pii.Redactor()
    assert pii.report(odd, model).count() == 8 and pii.redacted(odd, model).count() == 8
    assert pii.fit(docs([(1, "plain words only")])) == pii.Redactor()


def test_trees_find_looser_forms_and_leave_plain_text(docs, model):
    """Forms that no base pattern takes are found; numbers and prose that mean nothing are left."""
    assert set(model.thresholds) >= {"email", "ip"}
    rows = [
        (1, "and the thing onre.46 at mail8 dot example dot com in the eren"), (2, "seen from 84[.]93[.]123[.]184 at ti"),
        (3, "they met at the house and dot was there"), (4, "in the at of on and, look at example.com or meet at the end.then"), (5, 'token = "11acdfb36bb72224148e6160f674b"'),
    ]
    found = {r["doc_id"]: r["spans"] for r in pii.report(docs(rows), model).collect()}
    assert found[1] == "email:14:50" and found[2] == "ip:10:29"
    assert found[3] == found[4] == found[5] == ""


def test_few_spans_are_added_to_the_tables(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = pii.report(docs, model).collect()
    check(rows, found)
    base = sum(sum(r[f"n_{k}"] for k in PLAIN) for r in found)
    every = sum(len(r["spans"].split(",")) for r in found if r["spans"])
    assert base > 20 and every - base <= 0.1 * base


def test_texts_are_redacted(docs, model):
    rows = [(1, "mail a.b@c.de now 1.2.3.4, end"), (2, None), (3, "none"), (4, "1.2.3.4@x.de"), (5, "😀 +1 (376) 555-7269")]
    got = {r["doc_id"]: r["text"] for r in pii.redacted(docs(rows), model).collect()}
    assert got == {1: "mail <email> now <ip>, end", 2: None, 3: "none", 4: "<email>", 5: "😀 <phone>"}


def test_expressions_only(docs, model):
    for df in (pii.report(docs([(1, "a@b.c")]), model), pii.redacted(docs([(1, "a@b.c")]), model)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def test_trees_learn_from_all_texts(spark):
    """More texts than a sample would hold, a candidate each: all are counted, those that rewriting leaves alone twice."""
    n = 8_000
    rows = [(i, f"write to user{i}@mail.example.org now" if i % 2 else f"order 12.34.5{i % 9}.999 sent") for i in range(n)]
    found = pii.examples(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    got = {(r["kind"], r["label"]): r["n"] for r in found.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got[("email", 1.0)] == n  # as it is written, and in its looser form
    assert got[("ip", 0.0)] == n
