"""Quality rules: gradient-boosted trees over document statistics, scored from flat node arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import map_rows, share
from saltmarsh.llm.stats import FEATURES, Reader

#: The classifier is fitted on about so many labelled documents (in the mean), chosen by a hash of doc_id.
TRAIN_ROWS = 20_000
#: Quality never rises with these.
FALLING = ("symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "shouts_per_word", "bar_share", "same_as_previous_share")
MIN_WORDS = 20
MOST_REPEAT_PERCENT = 30

_SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())])
_TRAIN = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("label", pa.float64()), ("features", pa.list_(pa.float64()))])


@dataclass
class Trees:
    """Boosted trees as node arrays. A leaf is its own child on both sides, so all walks have equal length."""

    bias: float = 0.0
    depth: int = 0
    roots: list[int] = field(default_factory=list)
    feature: list[int] | np.ndarray = field(default_factory=list)
    threshold: list[float] | np.ndarray = field(default_factory=list)
    left: list[int] | np.ndarray = field(default_factory=list)
    right: list[int] | np.ndarray = field(default_factory=list)
    value: list[float] | np.ndarray = field(default_factory=list)

    def add(self) -> int:
        k = len(self.value)
        for arrays, v in ((self.feature, 0), (self.threshold, np.inf), (self.left, k), (self.right, k), (self.value, 0.0)):
            arrays.append(v)
        return k

    def freeze(self) -> Trees:
        for name, kind in (("feature", np.int64), ("threshold", float), ("left", np.int64), ("right", np.int64), ("value", float)):
            setattr(self, name, np.asarray(getattr(self, name), kind))
        return self

    def margins(self, x: np.ndarray) -> np.ndarray:
        if not self.roots:
            return np.full(len(x), self.bias)
        at = np.broadcast_to(np.asarray(self.roots, np.int64), (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.bias + self.value[at].sum(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Boost logistic loss with binned features. ``signs``: -1, 0 or 1 for each feature's allowed direction.

    A split on a constrained feature counts only if its two leaf values are in order, and the halves
    below it stay on their sides of the mean of the two, so the whole function is monotonic.
    """
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    model = Trees(bias=float(np.log(share / (1 - share))), depth=depth)
    if len(y) < 2 or y.min() == y.max():
        return model.freeze()
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # code <= k if x <= edges[k]
    margin = np.full(len(y), model.bias)

    def grow(node: int, rows: np.ndarray, low: float, high: float, level: int) -> None:
        g, h = grad[rows], hess[rows]
        model.value[node] = rate * float(np.clip(-g.sum() / (h.sum() + ridge), low, high))
        best = (1e-6, -1, -1, 0.0, 0.0)
        if level < depth:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                gl = np.cumsum(np.bincount(codes[rows, j], g, len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(codes[rows, j], h, len(e) + 1))[:-1]
                gr, hr = g.sum() - gl, h.sum() - hl
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                gain = -(gl * vl + (hl + ridge) * vl * vl / 2) - (gr * vr + (hr + ridge) * vr * vr / 2)
                gain = np.where((hl < least) | (hr < least) | (signs[j] * (vr - vl) < 0), -np.inf, gain)
                k = int(gain.argmax())
                if gain[k] > best[0] + (g.sum() ** 2 / (h.sum() + ridge) / 2 if best[1] < 0 else 0):
                    best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
        _, j, k, vl, vr = best
        if j < 0:
            margin[rows] += model.value[node]
            return
        middle = (vl + vr) / 2
        model.feature[node], model.threshold[node] = j, float(edges[j][k])
        model.left[node], model.right[node] = model.add(), model.add()
        a, b = ((low, high), (low, high)) if not signs[j] else ((low, middle), (middle, high)) if signs[j] > 0 else ((middle, high), (low, middle))
        goes = codes[rows, j] <= k
        left, right = model.left[node], model.right[node]
        grow(left, rows[goes], *a, level + 1)
        grow(right, rows[~goes], *b, level + 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        model.roots.append(root := model.add())
        grow(root, np.arange(len(y)), -np.inf, np.inf, 0)
    return model.freeze()


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Trees:
    """Fit on about ``most`` of the labelled documents, those with the lowest hash of doc_id.

    A doc_id with several labels has their mean, and one with several texts is learned from the text with
    the least hash. The chosen labels, about ``most`` rows of two numbers, are broadcast, so no text is shuffled.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("quality").cast("double")).alias("label"))
    chosen = known.withColumn("pick", F.xxhash64("doc_id")).where(share(most, known.count())).select("doc_id", "label")

    def rows(labelled: Iterator[tuple]) -> Iterator[tuple]:
        reader = Reader()
        for doc_id, text_hash, label, text in labelled:
            yield doc_id, text_hash, label, reader.read(text)[2]

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = map_rows(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", F.xxhash64("text").alias("h"), "label", "text"), rows, _TRAIN)
    got = sorted(read.groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("features", "text_hash").alias("features")).collect())
    x, y = np.array([r["features"] for r in got]).reshape(-1, len(FEATURES)), np.array([r["label"] for r in got])
    return fit(x, y, np.array([-1 if f in FALLING else 0 for f in FEATURES]))


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts, base verdict and the trees' verdict of every document.

    A null text has no words and fails the base rule. Rows with equal doc_id are judged each by its own
    text. Without labels, or with labels of one kind, the trees have no say. Empty tables give an
    empty result. Other columns of ``docs`` are not used.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def rows(texts: Iterator[tuple]) -> Iterator[tuple]:
        reader, held = Reader(), []

        def judged() -> Iterator[tuple]:
            trees = model.value
            for (doc_id, counts, _), score in zip(held, trees.scores(np.array([f for *_, f in held])), strict=True):
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > MOST_REPEAT_PERCENT * counts[0]
                yield doc_id, *counts, failed, not failed and bool(score >= 0.5 or not trees.roots), float(score)

        for doc_id, text in texts:
            held.append((doc_id, *reader.read(text)[1:]))
            if len(held) >= 500:
                yield from judged()
                held.clear()
        if held:
            yield from judged()

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, _SCHEMA)
