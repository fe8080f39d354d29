"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; all other text is unlabelled web text, in which good and bad are mixed. A
linear model over text features minimises the non-negative unbiased risk of the sigmoid loss,

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),

where the class prior, the share of good ones in all text, is estimated from the scores of positives and unlabelled text;
labels of bad documents are not learned from. Where the second part falls below 0, the step goes against it, so the
model does not learn the positives by heart.

The features of a whole text are shares and lengths of its characters, words and lines, and repetition, all scaled by
the unlabelled sample, with squares. At last a line search puts the decision where the estimated risk is least.

Fitted on a bounded sample of the learning fold, by a hash of text and doc_id: `positives` and `unlabelled` documents. Labels
are only read of rows outside the held-out fold. Null texts count as empty; empty texts have the features of no words
and get a score. With fewer than four positives or unlabelled rows every score is the share of positive labels, or 0.5 without labels.
Several labels of one document: the lowest counts. Rows of a null doc_id teach nothing.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import bounded_sample, in_fold, with_draw

POSITIVES, UNLABELLED = 4000, 8000
SCHEMA = "doc_id long, score double, predicted int"
WORD = re.compile(r"\w+").findall
LETTERS = re.compile(r"[^\W\d_]").findall
NAMES = (
    "chars", "words", "lines", "letters", "upper", "digits", "space", "marks", "odd_marks", "word_length", "distinct_words",
    "top_word", "repeats", "distinct_lines", "line_length", "end_marks", "marks_per_word", "long_words", "packed", "short_lines",
    "upper_words", "pairs",
)
PLAIN_MARKS = frozenset(".,;:!?'\"-()")


def features(text: str) -> list[float]:
    """Numbers about a whole text, in the order of NAMES."""
    n = len(text)
    if not n:
        return [0.0] * len(NAMES)
    chars = Counter(text)
    letters = upper = digits = space = plain = odd = 0
    for c, k in chars.items():
        if c.isalpha():
            letters += k
            upper += k if c.isupper() else 0
        elif c.isdigit():
            digits += k
        elif c.isspace():
            space += k
        elif c in PLAIN_MARKS:
            plain += k
        else:
            odd += k
    tokens = text.split()
    words = Counter(tokens)
    lines = text.split("\n")
    m = max(1, len(tokens))
    raw = text.encode()
    packed = len(zlib.compress(raw, 1)) / len(raw)
    repeats = sum(a == b for a, b in zip(tokens, tokens[1:])) / m
    pairs = len(set(zip(tokens, tokens[1:]))) / m
    shout = sum(k for w, k in words.items() if w.isupper() and len(w) > 1) / m
    return [
        np.log1p(n), np.log1p(len(tokens)), np.log1p(len(lines)), letters / n, upper / max(1, letters), digits / n, space / n, plain / n,
        odd / n, letters / m, len(words) / m, max(words.values(), default=0) / m, repeats, len(set(lines)) / len(lines),
        np.log1p(n / len(lines)), (chars["."] + chars["!"] + chars["?"]) / m, (plain + odd) / m,
        sum(k for w, k in words.items() if len(w) > 14) / m, packed, sum(len(x) < 30 for x in lines) / len(lines), shout, pairs,
    ]


@dataclass
class QualityModel:
    weights: np.ndarray | None
    centre: np.ndarray
    scale: np.ndarray
    prior: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        return np.hstack([z, z * z - 1, np.ones((len(x), 1))])

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), self.prior)
        return _sigmoid(self.inputs(np.array([features(t) for t in texts])) @ self.weights)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def pu_weights(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Weights of least non-negative unbiased risk, by Adam over mini-batches of both sets."""
    rng = np.random.default_rng(seed)
    w = np.zeros(pos.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        p, u = pos[rng.integers(0, len(pos), 512)], unl[rng.integers(0, len(unl), 1024)]
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)  # the sigmoid loss of calling a row negative; 1 - it of calling it positive
        gp = ((sp * (1 - sp))[:, None] * p).mean(axis=0)
        gu = ((su * (1 - su))[:, None] * u).mean(axis=0)
        negative = su.mean() - prior * sp.mean()
        grad = -prior * gp + (gu - prior * gp) if negative >= 0 else -(gu - prior * gp)
        grad = grad + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def estimated_prior(pos: np.ndarray, unl: np.ndarray, least: float = 0.6) -> float:
    """The share of good ones among the unlabelled, from their scores and those of positives.

    Above any threshold the unlabelled hold at least the share of positives times the prior, so each ratio is an upper
    bound; the least of them is taken over thresholds that leave at least `least` of the positives.
    """
    cuts = np.quantile(pos, np.linspace(0.0, 1 - least, 50))
    above = lambda x: 1 - np.searchsorted(np.sort(x), cuts) / len(x)
    return float(np.clip((above(unl) / above(pos)).min(), 0.01, 0.99))


def _prior_from_positives(zp: np.ndarray, zu: np.ndarray) -> float:
    """By a classifier of positives against unlabelled rows, learned on one half of both and looked at on the other."""
    w = pu_weights(zp[::2], zu[::2], 0.5)
    return estimated_prior(zp[1::2] @ w, zu[1::2] @ w)


def fit(
    docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, mod: int = 3, rest: int = 1
) -> QualityModel:
    """Learn from the documents outside the held-out fold and from their labels."""
    fold = ~in_fold(F.col("doc_id"), mod, rest) & F.col("doc_id").isNotNull()
    known = labels.where(fold & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = known.agg(F.avg((F.col("quality") == 1).cast("double")).alias("p")).first()["p"]
    blank = np.zeros(len(NAMES))
    if share is None:
        return QualityModel(None, blank, blank + 1, 0.5)
    text = with_draw(docs.where(fold).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "doc_id")
    good = text.join(known.where("quality = 1").select("doc_id"), "doc_id", "left_semi").withColumn("kind", F.lit(1))
    pos = [r["text"] for r in bounded_sample(good, "kind", "text", positives, "doc_id")]
    unl = [r["text"] for r in bounded_sample(text.withColumn("kind", F.lit(0)), "kind", "text", unlabelled, "doc_id")]
    if min(len(pos), len(unl)) < 4 or share == 0.0:
        return QualityModel(None, blank, blank + 1, float(share))
    xp, xu = np.array([features(t) for t in pos]), np.array([features(t) for t in unl])
    model = QualityModel(None, xu.mean(axis=0), xu.std(axis=0) + 1e-3, float(share))
    zp, zu = model.inputs(xp), model.inputs(xu)
    model.prior = _prior_from_positives(zp, zu)  # labels of 0 have no part in it
    w = pu_weights(zp, zu, model.prior)
    # the shift of least estimated risk, 0-1 loss
    sp, su = np.sort(zp @ w), np.sort(zu @ w)
    cuts = np.quantile(su, np.linspace(0.005, 0.6, 120))
    miss = np.searchsorted(sp, cuts) / len(sp)
    risk = model.prior * miss + np.maximum(0, (1 - np.searchsorted(su, cuts) / len(su)) - model.prior * (1 - miss))
    w[-1] -= cuts[int(np.argmin(risk))]
    model.weights = w
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score, predicted) of every row; only the text is looked at."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * (4 << 20) / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found = held.value.scores([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
