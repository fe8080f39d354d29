"""URL filter: rules, and for all other URLs the likelihood ratio of two character models.

Both models are variable-order Markov models over the characters of host and path: the probability of a character
after its longest known context of at most `order` characters, smoothed down to shorter contexts (Witten-Bell), and at
last to equal chances. A context is known if it was seen `least_seen` times, so the order varies with the data. One
model learns from accepted URLs, the other from rejected ones. A URL's score is the difference of the log-likelihoods
per character; it is allowed if the score is at least a threshold, which is chosen on a third of the labelled rows that
the models have not seen, as the one of the best balanced accuracy.

The accepted and rejected URLs are those that a rule allows or blocks, all of them: their characters are counted by a shuffle.
The models hold all known contexts and what follows these. Models of at most MOST entries are broadcast. Larger ones stay
tables: the gain of each distinct run of order + 1 characters is found by joins, order by order, and then joined to the
URLs' characters, so neither the driver nor a task holds a model.

A null URL or one without `://` has an empty host and path, score 0 and no rule; it is judged like others. If one class
has no rows, every URL without a rule is allowed. Rows are judged one by one, repeated ones too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import ascii_lower, stored

ALLOW, BLOCK = "allow", "block"
ORDER, LEAST_SEEN = 5, 3
MOST = 2_000_000  # contexts and characters after them that are broadcast, of both models
START = "\x02"
SCHEMA = "page_id long, host string, path string, rule string, verdict string, score double"
_MULTIPLIER = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?`, `#` or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits; nulls if none does. Of equally long ones the first wins."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def codes(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, each led by `order` start signs, and the text of each code point)."""
    joined = "".join(START * order + t for t in texts)
    lengths = np.fromiter((order + len(t) for t in texts), np.int64, len(texts))
    return np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64), np.repeat(np.arange(len(texts)), lengths)


def grams(points: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 0 .. order a 64-bit key of the last n + 1 code points at each place (wrong in the first n places)."""
    out = [_mixed(points + np.uint64(1))]
    for n in range(1, order + 1):
        before = np.concatenate([np.zeros(n, np.uint64), points[:-n]])
        out.append(_mixed(out[-1] * np.uint64(_MULTIPLIER) + before + np.uint64(n + 1)))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _contexts(points: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 0 .. order a key of the n code points before each place."""
    shifted = np.concatenate([np.zeros(1, np.uint64), points[:-1]])
    keys = grams(shifted, max(order - 1, 0))
    return [np.zeros(len(points), np.uint64), *keys[:order]]


@dataclass
class Markov:
    """Counts of contexts and of characters after them, per order."""

    order: int
    least_seen: int
    seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # key, total, kinds per order
    after: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # key, count per order
    alphabet: int = 256

    @classmethod
    def learn(cls, texts: list[str], order: int, least_seen: int) -> Markov:
        model = cls(order, least_seen)
        points, _ = codes(texts, order)
        inside = points != ord(START)
        full, context = grams(points, order), _contexts(points, order)
        for n in range(order + 1):
            c, g = context[n][inside], full[n][inside]
            keys, total = np.unique(c, return_counts=True)
            pair, where, count = np.unique(g, return_index=True, return_counts=True)
            kinds = np.bincount(np.searchsorted(keys, c[where]), minlength=len(keys))
            kept = (total >= least_seen) | (n == 0)
            model.seen.append((keys[kept], total[kept], kinds[kept]))
            held = np.isin(c[where], keys[kept])
            model.after.append((pair[held], count[held]))
        model.alphabet = max(256, len(model.after[0][0]))
        return model

    def logs(self, points: np.ndarray) -> np.ndarray:
        """Log-probability of each code point after those before it."""
        p = np.full(len(points), 1.0 / self.alphabet)
        full, context = grams(points, self.order), _contexts(points, self.order)
        for n in range(self.order + 1):
            keys, total, kinds = self.seen[n]
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, context[n]), len(keys) - 1)
            known = keys[at] == context[n]
            pair, count = self.after[n]
            spot = np.minimum(np.searchsorted(pair, full[n]), len(pair) - 1)
            hits = np.where(pair[spot] == full[n], count[spot], 0)
            smoothed = (hits + kinds[at] * p) / (total[at] + kinds[at])
            p = np.where(known, smoothed, p)
        return np.log(p)


@dataclass
class Counts:
    """What both models count, as written tables."""

    order: int
    least_seen: int
    contexts: DataFrame  # verdict, n, context, total, kinds: the known ones
    grams: DataFrame  # verdict, n, context, gram, cnt: all
    alphabet: dict[str, int]
    entries: int  # known contexts and the characters after them


@dataclass
class UrlModel:
    """Two models; or their counts, where they are too large to be held."""

    accepted: Markov | None
    rejected: Markov | None
    threshold: float = 0.0
    counts: Counts | None = None

    def scores(self, texts: list[str]) -> np.ndarray:
        """Difference of the log-likelihoods per character; 0 for an empty text and without models."""
        if self.accepted is None or self.rejected is None or not texts:
            return np.zeros(len(texts))
        points, owner = codes(texts, self.accepted.order)
        inside = points != ord(START)
        gain = (self.accepted.logs(points) - self.rejected.logs(points))[inside]
        total = np.bincount(owner[inside], gain, len(texts))
        length = np.bincount(owner[inside], minlength=len(texts))
        return total / np.maximum(length, 1)


def judged_by_rules(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, verdict) with nulls where no rule fits."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return parts.withColumns({"rule": name, "verdict": verdict})


def count_grams(rows: DataFrame, order: int) -> DataFrame:
    """(verdict, n, context, gram, cnt) of all rows (text, verdict): how often each character follows its n characters before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = np.array(batch.column("verdict").to_pylist(), dtype=object)
            texts = np.array([t.replace(START, " ") for t in batch.column("text").to_pylist()], dtype=object)
            for verdict in (ALLOW, BLOCK):
                points, _ = codes(list(texts[told == verdict]), order)
                inside = points != ord(START)
                full, context = grams(points, order), _contexts(points, order)
                for n in range(order + 1):
                    gram, where, count = np.unique(full[n][inside], return_index=True, return_counts=True)
                    size = len(gram)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([verdict] * size, pa.string()), pa.array(np.full(size, n, np.int32)),
                         pa.array(context[n][inside][where].view(np.int64)), pa.array(gram.view(np.int64)), pa.array(count)],
                        ["verdict", "n", "context", "gram", "cnt"],
                    )

    found = rows.mapInArrow(run, "verdict string, n int, context long, gram long, cnt long")
    return found.groupBy("verdict", "n", "context", "gram").agg(F.sum("cnt").alias("cnt"))


def learned(rows: DataFrame, order: int, least_seen: int) -> Counts:
    """The counts of all rows (text, verdict)."""
    grams = stored(count_grams(rows, order), "url-grams")
    seen = grams.groupBy("verdict", "n", "context").agg(F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("kinds"))
    contexts = stored(seen.where((F.col("n") == 0) | (F.col("total") >= least_seen)), "url-contexts")
    entries = contexts.agg(F.sum(F.col("kinds") + 1)).first()[0]
    first = contexts.where("n = 0").select("verdict", "kinds").collect()  # two rows
    return Counts(order, least_seen, contexts, grams, {r["verdict"]: max(256, r["kinds"]) for r in first}, entries or 0)


def held_models(counts: Counts) -> dict[str, Markov]:
    """Both models on the driver: the same as `Markov.learn` of all texts."""
    pairs = counts.grams.join(counts.contexts.select("verdict", "n", "context"), ["verdict", "n", "context"])
    contexts, after = counts.contexts.toArrow(), pairs.select("verdict", "n", "gram", "cnt").toArrow()

    def columns(table: pa.Table, verdict: str, n: int, key: str, *names: str) -> tuple[np.ndarray, ...]:
        mine = table.filter(pc.and_(pc.equal(table["verdict"], verdict), pc.equal(table["n"], n)))
        keys = mine[key].to_numpy().view(np.uint64)
        sort = np.argsort(keys)
        return keys[sort], *(mine[name].to_numpy()[sort] for name in names)

    out = {}
    for verdict in (ALLOW, BLOCK):
        model = Markov(counts.order, counts.least_seen, alphabet=counts.alphabet.get(verdict, 256))
        for n in range(counts.order + 1):
            model.seen.append(columns(contexts, verdict, n, "context", "total", "kinds"))
            model.after.append(columns(after, verdict, n, "gram", "cnt"))
        out[verdict] = model
    return out


def _asked(rows: DataFrame, order: int) -> DataFrame:
    """(n, gram, context, below) of all rows (text), each gram once; `below` is the gram of n - 1 that ends it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, _ = codes([t.replace(START, " ") for t in batch.column("text").to_pylist()], order)
            inside = points != ord(START)
            full, context = grams(points, order), _contexts(points, order)
            for n in range(order + 1):
                gram, where = np.unique(full[n][inside], return_index=True)
                below = full[max(n - 1, 0)][inside][where]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(gram), n, np.int32)), *(pa.array(x.view(np.int64)) for x in (gram, context[n][inside][where], below))],
                    ["n", "gram", "context", "below"],
                )

    return rows.select("text").mapInArrow(run, "n int, gram long, context long, below long").dropDuplicates(["n", "gram"])


def gram_gains(rows: DataFrame, counts: Counts) -> DataFrame:
    """(gram, gain) of all runs of order + 1 characters in the rows (text): the difference of both models' logs of the last one."""
    asked = stored(_asked(rows, counts.order), "url-asked")
    sides = {"a": ALLOW, "r": BLOCK}

    def of(side: str, column: str) -> Column:
        return F.sum(F.when(F.col("verdict") == sides[side], F.col(column))).alias(f"{column}_{side}")

    found = None
    for n in range(counts.order + 1):
        level = asked.where(F.col("n") == n).select("gram", "context", "below")
        if found is None:
            level = level.withColumns({f"p_{s}": F.lit(1.0 / counts.alphabet.get(v, 256)) for s, v in sides.items()})
        else:
            level = level.join(found.withColumnRenamed("gram", "below"), "below")
        contexts = counts.contexts.where(F.col("n") == n).groupBy("context").agg(*(of(s, c) for s in sides for c in ("total", "kinds")))
        after = counts.grams.where(F.col("n") == n).groupBy("gram").agg(*(of(s, "cnt") for s in sides))
        level = level.join(contexts, "context", "left").join(after, "gram", "left")

        def smoothed(s: str) -> Column:
            p, total, kinds = (F.col(f"{c}_{s}") for c in ("p", "total", "kinds"))
            hits = F.coalesce(f"cnt_{s}", F.lit(0))
            return F.when(total.isNotNull(), (hits + kinds * p) / (total + kinds)).otherwise(p).alias(f"p_{s}")

        found = stored(level.select("gram", *(smoothed(s) for s in sides)), "url-level")
    return found.select("gram", (F.log("p_a") - F.log("p_r")).alias("gain"))


def scored_by_joins(rows: DataFrame, counts: Counts) -> DataFrame:
    """The rows (text and others) with their score, as `UrlModel.scores`, from models that no task holds."""
    order = counts.order
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "url-rows")
    gains = gram_gains(rows, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, texts = batch.column("_row").to_numpy(), [t.replace(START, " ") for t in batch.column("text").to_pylist()]
            points, owner = codes(texts, order)
            inside = points != ord(START)
            gram, owner = grams(points, order)[order][inside].view(np.int64), owner[inside]
            sort = np.lexsort((gram, owner))
            gram, owner = gram[sort], owner[sort]
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(gram)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[owner[first]]), pa.array(gram[first]), pa.array(times.astype(np.int32))], ["_row", "gram", "times"]
            )

    places = rows.select("_row", "text").mapInArrow(run, "_row long, gram long, times int").join(gains, "gram")
    total = places.groupBy("_row").agg((F.sum(F.col("times") * F.col("gain")) / F.sum("times")).alias("score"))
    return rows.join(total, "_row", "left").drop("_row").withColumn("score", F.coalesce("score", F.lit(0.0)))


def _scored_by_model(rows: DataFrame, model: UrlModel) -> DataFrame:
    """(verdict, score) of the rows (text, verdict), by a model that each worker holds."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = held.value.scores([t.replace(START, " ") for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("verdict"), pa.array(score)], ["verdict", "score"])

    return rows.mapInArrow(run, "verdict string, score double")


def fit(judged: DataFrame, order: int = ORDER, least_seen: int = LEAST_SEEN) -> UrlModel:
    """Models from all rows with a verdict; a third of them, by a hash, is kept apart to choose the threshold.

    Rows that repeat page_id and URL count once. A class without rows in one of the parts has all its rows there.
    """
    known = judged.where(F.col("verdict").isNotNull()).select(F.concat("host", "path").alias("text"), "verdict", "page_id").distinct()
    apart = F.pmod(F.xxhash64(F.lit(17), "text", "page_id"), F.lit(3)) == 0
    rows = stored(known.select("text", "verdict", apart.alias("apart")), "url-labels")
    sizes = {(r["verdict"], r["apart"]): r["n"] for r in rows.groupBy("verdict", "apart").agg(F.count(F.lit(1)).alias("n")).collect()}
    if {v for v, _ in sizes} != {ALLOW, BLOCK}:
        return UrlModel(None, None, 0.0)

    def part(kept_apart: bool) -> DataFrame:
        whole = [v for v in (ALLOW, BLOCK) if (v, kept_apart) not in sizes]
        return rows.where((F.col("apart") == kept_apart) | F.col("verdict").isin(whole)).select("text", "verdict")

    counts = learned(part(False), order, least_seen)
    if counts.entries > MOST:
        model = UrlModel(None, None, counts=counts)
        scored = scored_by_joins(part(True), counts)
    else:
        models = held_models(counts)
        model = UrlModel(models[ALLOW], models[BLOCK])
        scored = _scored_by_model(part(True), model)
    bins = scored.groupBy("verdict", F.round("score", 3).alias("score")).agg(F.count(F.lit(1)).alias("n")).collect()  # few: rounded
    edges = np.unique([r["score"] for r in bins])
    good, bad = (np.zeros(len(edges)) for _ in range(2))
    for r in bins:
        (good if r["verdict"] == ALLOW else bad)[np.searchsorted(edges, r["score"])] += r["n"]
    middle = np.concatenate([edges[:1], (edges[1:] + edges[:-1]) / 2])
    right = 1 - (np.cumsum(good) - good) / good.sum() + (np.cumsum(bad) - bad) / bad.sum()
    best = np.flatnonzero(right == right.max())
    model.threshold = float(middle[best[len(best) // 2]])
    return model


def filter_urls(pages: DataFrame, rules: list[Rule], model: UrlModel | None = None, **options) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page: the rule's verdict, else the models'."""
    judged = judged_by_rules(pages, rules)
    model = model or fit(judged, **options)
    if model.counts is not None:
        scored = scored_by_joins(judged.withColumn("text", F.concat("host", "path")), model.counts)
        verdict = F.coalesce("verdict", F.when(F.col("score") >= model.threshold, ALLOW).otherwise(BLOCK)).alias("verdict")
        return scored.select("page_id", "host", "path", "rule", verdict, "score")
    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = held.value
        for batch in batches:
            host, path = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            score = np.concatenate(
                [tool.scores([(h + p).replace(START, " ") for h, p in zip(host[i : i + 5000], path[i : i + 5000])])
                 for i in range(0, len(host), 5000)] or [np.zeros(0)]
            )
            verdict = [v or (ALLOW if s >= tool.threshold else BLOCK) for v, s in zip(batch.column("verdict").to_pylist(), score)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"), batch.column("rule"),
                 pa.array(verdict, pa.string()), pa.array(score)],
                ["page_id", "host", "path", "rule", "verdict", "score"],
            )

    return judged.mapInArrow(run, SCHEMA)
