"""Quality scores by Bradley-Terry pairwise ranking.

From labelled rows pairs of a preferred (label 1) and another (label 0) document are drawn; the probability that the
first is preferred is the logistic function of the difference of their scores, which are linear in features of the text.
The weights minimise the logistic loss on feature differences (with a small L2 term, by Newton steps). The cut is a
quantile of the training scores, the one whose two sides agree best with the labels; a score of CUT in the result is that cut.

Features come from the whole text alone: shares of kinds of bytes and of repeated neighbouring, repeated and upper-case words.
The model is fitted on at most SAMPLE labelled rows of each label, those with the smallest hash of their id; scoring is
one pass without a shuffle, and all columns of a row stay where they are.

Cases: null and empty texts have all features zero and get a score as any text; repeated rows get equal scores; rows whose
label isn't 0 or 1, or is contradicted, aren't learned from; without labels of both kinds every score is 0.5; an empty
table gives an empty table.
"""

from __future__ import annotations

from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeql.llm import bpe
from latticeql.llm.common import bound_batches, text_of

#: Labelled rows of each label that a model is fitted on, at most; pairs drawn from them.
SAMPLE, PAIRS = 10_000, 60_000
CUT = 0.3

# Groups of bytes whose shares are features.
KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"|", b"*", b"#", b"$%&", b"@_/\\", b"<>{}[]()=+~^`\"'", b"\n", bytes(range(128, 256))]
NAMES = ["upper", "digit", "stop", "mark", "pipe", "star", "hash", "sign", "path", "bracket", "line", "high", "same_next", "repeated", "capitals", "word_length", "log_words", "short", "symbols"]


class Model(NamedTuple):
    """Scores are logistic(scale * (weights . (features - mean) / spread - cut) + logit(CUT))."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.scale * (raw - self.cut) + (np.log(CUT / (1 - CUT)) if self.scale else 0), -30, 30)))


def features(text: bytes) -> list:
    if not text:
        return [0.0] * len(NAMES)
    n, words = len(text), text.split()
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = [float(kinds[np.frombuffer(k, np.uint8)].sum()) / n for k in KINDS]
    m = max(1, len(words))
    same = sum(map(eq, words, words[1:])) / m
    distinct = len(set(words)) / m
    capitals = sum(map(bytes.isupper, words)) / m
    return [*shares, same, (1 - distinct) * min(1, 200 / m), capitals, min(30, n / m) / 10, float(np.log1p(len(words))), float(len(words) < 8), min(1.0, sum(shares[3:10]) * 8)]


def _udf(function, kind: str):
    return F.arrow_udf(lambda text: function(np.array([features(x) for x in bpe.texts(text)], float).reshape(-1, len(NAMES))), kind)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, pairs: int = PAIRS) -> Model:
    """The model learned from the rows of labels (ids and 0 or 1) and their texts in docs."""
    bound_batches(docs.sparkSession)
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("z")).filter("y = z").select("id", "y")
    chosen = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    udf = _udf(lambda x: pa.array(list(x), pa.list_(pa.float64())), "array<double>")
    # The chosen rows are at most 2 * sample by their construction, so they may be broadcast.
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = texts.select("id", "y", udf("text").alias("x")).groupBy("id").agg(F.first("y").alias("y"), F.min("x").alias("x")).collect()
    rows = sorted(rows, key=lambda r: str(r["id"]))
    return learn(np.array([r["x"] for r in rows], float).reshape(-1, len(NAMES)), np.array([r["y"] for r in rows], int), pairs)


def learn(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Model:
    mean, spread = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(mean, spread, np.zeros(len(NAMES)), 0.0, 0.0)
    rng, z = np.random.default_rng(seed), np.clip((x - mean) / spread, -8, 8)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w, l2 = np.zeros(d.shape[1]), 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) / pairs + l2 * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + l2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    # The quantile of the scores with the best balanced agreement; its cut lies in the middle of the gap there.
    order = np.argsort(s, kind="stable")
    below_bad, below_good = np.cumsum(y[order] == 0), np.cumsum(y[order] == 1)
    balance = below_bad / len(bad) + (len(good) - below_good) / len(good)
    balance[:-1][s[order][1:] == s[order][:-1]] = -1
    k = int(np.argmax(balance))
    cut = float((s[order][k] + s[order][min(k + 1, len(s) - 1)]) / 2)
    # The scale of a logistic fit along the scores.
    scales = np.geomspace(0.05, 5, 25)
    margin = (2 * y - 1) * (s - cut)
    losses = [np.logaddexp(0, -a * margin).mean() for a in scales]
    return Model(mean, spread, w, cut, float(scales[int(np.argmin(losses))]))


def scored(model: Model, text_col: str = "text") -> Column:
    """The score, 0 to 1, of a text column. At least CUT: good."""
    return _udf(lambda x: pa.array(model.score(x)), "double")(text_of(text_col))
