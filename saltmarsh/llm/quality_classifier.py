"""Quality classifier: expectation-maximisation over weak labellers, then a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from saltmarsh.llm.common import cut, map_rows, renamed, share
from saltmarsh.llm.stats import FEATURES, Reader

#: The linear scorer is fitted on about so many documents (in the mean), chosen by a hash of doc_id and text; equal rows count as one with a weight.
TRAIN_ROWS = 10_000
BUCKETS = 1024

#: Labellers: name, statistic, at least so much means bad, at most so much means good (none: it then abstains).
#: Each kind of junk is seen by two or more of them.
LABELLERS = (
    ("odd words", "odd_share", 0.3, 0.1),
    ("symbols", "symbols_per_word", 0.2, None),
    ("capitals", "upper_share", 0.5, None),
    ("shouts", "shouts_per_word", 0.25, None),
    ("bars", "bar_share", 0.15, None),
    ("repeats", "repeat_share", 0.3, None),
    ("lines", "dup_line_share", 0.3, None),
    ("stutter", "same_as_previous_share", 0.2, None),
    ("one word", "top_word_share", 0.3, None),
)
#: Shapes of ordinary words, see Shapes.
PLAIN = ("a", "Aa", "A", "a.", "Aa.", "A.", "a,", "Aa,", "A,", "a;", "a:", "a?", "a!", "0")

_READ = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("pick", pa.int64()), ("words", pa.bool_()), ("votes", pa.int32()), ("at", pa.list_(pa.int16())), ("value", pa.list_(pa.float32()))])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("posterior", pa.float64()), ("score", pa.float64()), ("kept", pa.bool_())])


def vote(features: list[float], at: np.ndarray) -> int:
    """The labellers' votes as digits in base 3: 0 abstains, 1 good, 2 bad. ``at``: the words' shape buckets."""
    odd = 1 - float(_PLAIN[at].mean()) if len(at) else 0.0
    code = 0
    for _, name, bad, good in LABELLERS:
        value = odd if name == "odd_share" else features[FEATURES.index(name)]
        code = 3 * code + (2 if value >= bad else 1 if good is not None and value <= good else 0)
    return code


def digits(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(LABELLERS) - 1, -1, -1) % 3


def accuracies(codes: np.ndarray, counts: np.ndarray, rounds: int = 100, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns and how often each occurs: log odds of good of each possible vote, and of good itself.

    Each labeller has its own chances to abstain, to say good and to say bad for good and for bad
    documents. The first guess is the majority vote, ties being good.
    """
    votes = np.eye(3)[digits(codes)]  # pattern, labeller, vote
    good = ((votes[:, :, 1] - votes[:, :, 2]).sum(1) >= 0).astype(float) * 0.8 + 0.1
    for _ in range(rounds):
        share = [(counts * good).sum() + ridge, (counts * (1 - good)).sum() + ridge]
        chance = [(np.einsum("p,plv->lv", counts * w, votes) + ridge) / (s + 2 * ridge) for w, s in zip((good, 1 - good), share, strict=True)]
        odds, prior = np.log(chance[0]) - np.log(chance[1]), np.log(share[0]) - np.log(share[1])
        good = 1 / (1 + np.exp(-np.clip(np.einsum("lv,plv->p", odds, votes) + prior, -30, 30)))
    return odds, prior


def posterior(code: int | np.ndarray, odds: np.ndarray, prior: float) -> np.ndarray:
    picked = np.take_along_axis(odds.T, digits(np.atleast_1d(code)), 0)
    return 1 / (1 + np.exp(-np.clip(picked.sum(1) + prior, -30, 30)))


class Shapes(dict):
    """Word to the bucket of its shape: runs of capitals, of other letters, of digits, and each other character once."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        shape = ""
        for c in word:
            kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
            if shape[-1:] != kind:
                shape += kind
        self[word] = bucket = _bucket(shape)
        return bucket


def _bucket(key: str) -> int:
    return xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass")) % BUCKETS


_PLAIN = np.zeros(BUCKETS, bool)
_PLAIN[[_bucket(shape) for shape in PLAIN]] = True


def hashed(at: np.ndarray, features: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """A text as hashed counts of word shapes (log, unit length) and of statistics by steps of an eighth: buckets and values."""
    x = np.log1p(np.bincount(at, minlength=BUCKETS)).astype(np.float32)
    x /= max(float(np.linalg.norm(x)), 1e-9)
    for name, value in zip(FEATURES, features, strict=True):
        if name.endswith("share") or name.endswith("per_word"):
            x[_STEPS[name][min(int(8 * value), 8)]] += 0.5
    used = np.flatnonzero(x)
    return used, x[used]


_STEPS = {name: [_bucket(f"{name}:{k}") for k in range(9)] for name in FEATURES}


def fit(row: np.ndarray, column: np.ndarray, value: np.ndarray, y: np.ndarray, many: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full gradient steps with per-weight rates; both kinds weigh the same.

    ``row``, ``column`` and ``value`` are the entries of the sparse matrix, ``many`` the rows' own weights.
    """
    w, b, seen = np.zeros(BUCKETS), 0.0, np.full(BUCKETS + 1, 1e-8)
    weight = many * (y / max((many * y).sum(), 1e-9) + (1 - y) / max((many * (1 - y)).sum(), 1e-9))
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[column], len(y)) + b, -30, 30)))
        error = weight * (p - y)
        g = np.append(np.bincount(column, value * error[row], BUCKETS) + decay * w, error.sum())
        seen += g * g
        step = rate * g / np.sqrt(seen)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def entries(at: pa.ListArray, value: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of each entry of lists of buckets and values."""
    row = np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy()))
    return row, at.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy().astype(np.float64)


def classify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text_hash, posterior (of the labellers), score (of the linear scorer) and kept, for every document.

    Each text is read once, to votes and hashed features. The votes on all documents are counted by pattern (3 to
    the number of labellers at most, so they fit the driver) and give the labellers' accuracies. The scorer
    is fitted on the posteriors of about ``train_rows`` documents. A document is kept if its score is 0.5 or more;
    one without a word (also a null text) is not kept. Rows with equal doc_id are judged each by its own
    text. Equal scores are of no account. An empty table gives an empty result. Other columns of ``docs`` are not used.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = own.select("doc_id", "text", F.xxhash64("text").alias("h"), F.xxhash64("doc_id", F.xxhash64("text")).alias("pick"))

    def read(rows: Iterator[tuple]) -> Iterator[tuple]:
        reader, shapes = Reader(), Shapes()
        for doc_id, text, text_hash, pick in rows:
            words, _, features = reader.read(text)
            buckets = shapes.of(words)
            at, value = hashed(buckets, features)
            yield doc_id, text_hash, pick, bool(words), vote(features, buckets), at, value

    told = cut(map_rows(texts, read, _READ))
    found = told.groupBy("votes").count().collect()
    codes, counts = np.array([r["votes"] for r in found], np.int64), np.array([r["count"] for r in found], float)
    odds, prior = accuracies(codes, counts)
    chosen = told.where(share(train_rows, int(counts.sum()))).groupBy("pick").agg(F.count("*").alias("many"), *(F.first(c).alias(c) for c in ("votes", "at", "value")))
    sample = chosen.orderBy("pick").toArrow().combine_chunks()
    lists = [sample[c].chunk(0) if sample[c].num_chunks else pa.array([], t) for c, t in (("at", pa.list_(pa.int16())), ("value", pa.list_(pa.float32())))]
    w, b = fit(*entries(*lists), posterior(sample["votes"].to_numpy().astype(np.int64), odds, prior), sample["many"].to_numpy().astype(float))
    model = docs.sparkSession.sparkContext.broadcast((odds, prior, w, b))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, prior, w, b = model.value
        for batch in batches:
            row, column, value = entries(batch["at"], batch["value"])
            scores = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[column], len(batch)) + b, -30, 30)))
            good = posterior(batch["votes"].to_numpy().astype(np.int64), odds, prior)
            kept = batch["words"].to_numpy(zero_copy_only=False) & (scores >= 0.5)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(good), pa.array(scores), pa.array(kept)], schema=_SCHEMA)

    return told.select("doc_id", "text_hash", "words", "votes", "at", "value").mapInArrow(score, from_arrow_schema(_SCHEMA))


def keep_good(docs: DataFrame, **how: int) -> DataFrame:
    """The documents that ``classify`` keeps, with all their columns, whatever these are named."""
    kept = classify(docs, **how).where("kept").select("doc_id", "text_hash").distinct()
    rows, new = renamed(docs)
    same = F.col(new["doc_id"]).cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.col(new["text"]).cast("string")) == F.col("text_hash"))
    return rows.join(kept, same, "left_semi").toDF(*docs.columns)
