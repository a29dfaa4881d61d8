"""Personal data: exact patterns, and a skip-chain conditional random field for what they miss."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import map_rows, share

KINDS = ("email", "ip", "card", "phone")
#: The field is fitted on about so many distinct texts with a digit or @ (in the mean, chosen by a hash), and on so many tokens in a row
#: of each, from a place that the hash says; beliefs are formed over all tokens of all texts.
TRAIN_ROWS, TRAIN_TOKENS = 2000, 200
#: Belief from which a token is taken, rounds of message passing, and share of the old message that is kept.
BELIEF, ROUNDS, DAMPING = 0.9, 12, 0.3
BUCKETS = 4096

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]").search
_TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_NEIGHBOUR = re.compile(r"[^\x20\x09-\x0D]+")
_LEAD = re.compile(r"[^A-Za-z0-9+(]*")

_SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])
_TRAIN = pa.schema([("pick", pa.int64()), ("labels", pa.list_(pa.int32())), ("features", pa.list_(pa.list_(pa.int32()))), ("chain", pa.list_(pa.int32())), ("skip", pa.list_(pa.list_(pa.int32())))])


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ so that long texts take linear time."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans (kind's number, start, end) that the patterns find, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    if not _HINT(text):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def shape(token: str) -> str:
    """Digits as 9, letters as a or A, runs of more than four as four."""
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1+", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in token))


class Tokens:
    """A text's tokens with a digit or @, their features, and which are tied.

    Neighbours in the text are tied by chain edges; tokens with the same letters and digits, or the same
    five or more digits, by skip edges from each to the next of its like.
    """

    def __init__(self, text: str, base: list[tuple[int, int, int]], most: int | None = None, place: int = 0):
        self.spans = [m.span() for m in _TOKEN.finditer(text)]
        if most is not None and len(self.spans) > most:
            first = place % (len(self.spans) - most + 1)
            self.spans = self.spans[first : first + most]
        self.words = [text[a:b] for a, b in self.spans]
        n = len(self.spans)
        self.chain = [k for k in range(n - 1) if not text[self.spans[k][1] : self.spans[k + 1][0]].strip(" ") and self.spans[k + 1][0] - self.spans[k][1] <= 2]
        last: dict[str, int] = {}
        self.skip: list[tuple[int, int]] = []
        for k, word in enumerate(self.words):
            same, digits = "".join(filter(str.isalnum, word.lower())), "".join(filter(str.isdigit, word))
            before = {last[key] for key in (same, digits) if key in last}
            self.skip += [(j, k) for j in sorted(before)]
            last.update((key, k) for key in (same, digits) if len(key) >= 3 and (key == same or len(key) >= 5))
        self.label = np.zeros(n, np.int64)
        starts = np.array([a for a, _ in self.spans], np.int64)
        for kind, a, b in base:
            i, j = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b, "left")
            for k in range(max(int(i), 0), int(j)):
                inside = min(b, self.spans[k][1]) - max(a, self.spans[k][0])
                if 2 * inside >= self.spans[k][1] - self.spans[k][0]:
                    self.label[k] = kind + 1
        self.text = text

    def features(self) -> list[list[int]]:
        out, beside = [], set(self.chain)
        around = {m.end(): m[0] for m in _NEIGHBOUR.finditer(self.text)}
        starts = {end - len(word): word for end, word in around.items()}
        for k, word in enumerate(self.words):
            digits = sum(map(str.isdigit, word))
            a, b = self.spans[k]
            before, after = around.get(a - 1, ""), starts.get(b + 1, "")
            names = [
                "bias", f"shape {shape(word)}", f"digits {min(digits, 20)}", f"@ {word.count('@')}", f". {min(word.count('.'), 4)}", f"- {min(word.count('-'), 4)}", f"first {word[0]}", f"last {word[-1]}",
                f"letters {any(map(str.isalpha, word))}", f"length {min(len(word) // 4, 10)}", f"before {shape(before)}", f"after {shape(after)}", f"beside {k in beside} {k - 1 in beside}",
            ]
            out.append([zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names])
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Field:
    """Weights of the random field: of features by label, of neighbouring labels, and of equal labels across skip edges."""

    def __init__(self) -> None:
        self.unary, self.pair, self.same = np.zeros((BUCKETS, len(KINDS) + 1)), np.zeros((len(KINDS) + 1,) * 2), np.zeros(len(KINDS) + 1)

    def fit(self, label: np.ndarray, features: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int = 150, rate: float = 0.3, decay: float = 0.1) -> Field:
        """Pseudo-likelihood: each token given its neighbours' labels. ``chain`` and ``skip`` list token pairs."""
        if not len(label):
            return self
        eye = np.eye(len(KINDS) + 1)
        i, j = chain.T
        a, b = skip.T
        seen = [np.full(w.shape, 1e-6) for w in (self.unary, self.pair, self.same)]
        for _ in range(rounds):
            logits = self.unary[features].sum(1)
            np.add.at(logits, j, self.pair[label[i]])
            np.add.at(logits, i, self.pair[:, label[j]].T)
            np.add.at(logits, b, eye[label[a]] * self.same)
            np.add.at(logits, a, eye[label[b]] * self.same)
            error = _softmax(logits) - eye[label]
            grads = [decay * w for w in (self.unary, self.pair, self.same)]
            np.add.at(grads[0], features.ravel(), np.repeat(error, features.shape[1], 0))
            np.add.at(grads[1], label[i], error[j])
            np.add.at(grads[1].T, label[j], error[i])
            grads[2] += (eye[label[a]] * error[b]).sum(0) + (eye[label[b]] * error[a]).sum(0)
            for w, g, s in zip((self.unary, self.pair, self.same), grads, seen, strict=True):
                s += g * g
                w -= rate * g / np.sqrt(s)
        self.same = np.maximum(self.same, 1.0)  # like tokens never repel each other
        return self

    def beliefs(self, tokens: Tokens) -> np.ndarray:
        """Loopy sum-product. Tokens inside base spans are observed; all others start from their features."""
        own = self.unary[np.array(tokens.features())].sum(1)
        known = np.flatnonzero(tokens.label)
        own[known] = -30.0
        own[known, tokens.label[known]] = 0.0
        edges = np.array([(k, k + 1) for k in tokens.chain] + tokens.skip, np.int64).reshape(-1, 2)
        tables = np.concatenate([np.repeat(self.pair[None], len(tokens.chain), 0), np.repeat(np.diag(self.same)[None], len(tokens.skip), 0)])
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        sent = np.zeros((len(source), len(KINDS) + 1))
        for _ in range(ROUNDS if len(edges) else 0):
            total = own.copy()
            np.add.at(total, target, sent)
            inner = (total[source] - sent[back])[:, :, None] + tables
            top = inner.max(1, keepdims=True)
            new = top[:, 0] + np.log(np.exp(inner - top).sum(1))
            new -= new.max(1, keepdims=True)
            sent = DAMPING * sent + (1 - DAMPING) * new
        np.add.at(own, target, sent)
        return _softmax(own)


def _plausible(kind: int, found: str) -> bool:
    digits = "".join(c for c in found if c in "0123456789")
    return ("@" in found, found.count(".") >= 2 and len(digits) >= 4, 13 <= len(digits) <= 19 and luhn(digits), 7 <= len(digits) <= 15)[kind]


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """Runs of neighbouring tokens that the field gives one kind with enough belief, outside the base spans."""
    tokens = Tokens(text, base)
    if not len(tokens.spans) or tokens.label.all():
        return []
    belief = field.beliefs(tokens)
    best = np.where(belief.max(1) >= BELIEF, belief.argmax(1), 0) * (tokens.label == 0)
    taken, out, k, joined = sorted((a, b) for _, a, b in base), [], 0, set(tokens.chain)
    starts, ends = np.array([a for a, _ in taken], np.int64), np.maximum.accumulate(np.array([b for _, b in taken], np.int64))
    while k < len(best):
        end = k
        while end in joined and best[end + 1] == best[k]:
            end += 1
        if best[k]:
            a, b = tokens.spans[k][0], tokens.spans[end][1]
            while b > a and not (text[b - 1].isascii() and text[b - 1].isalnum()):
                b -= 1
            a = _LEAD.match(text, a, b).end()
            i = int(np.searchsorted(starts, b, "left")) - 1
            if a < b and (i < 0 or ends[i] <= a) and _plausible(int(best[k]) - 1, text[a:b]):
                out.append((int(best[k]) - 1, a, b))
        k = end + 1
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for kind, a, b in spans)


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Field:
    """Fit on the base spans of about ``rows`` distinct texts with a digit or @ (lowest hash of text)."""

    def read(texts: Iterator[tuple]) -> Iterator[tuple]:
        for pick, text in texts:
            tokens = Tokens(text, base_spans(text), TRAIN_TOKENS, pick)
            yield pick, tokens.label.tolist(), tokens.features(), tokens.chain, [list(x) for x in tokens.skip]

    hinted = docs.where(F.col("text").rlike("[0-9@]")).withColumn("pick", F.xxhash64("text"))
    known = hinted.agg(F.approx_count_distinct("pick")).first()[0]
    got = sorted(map_rows(hinted.where(share(rows, known)).dropDuplicates(["pick"]).select("pick", "text"), read, _TRAIN).collect())
    label, features, chain, skip, n = [], [], [], [], 0
    for row in got:
        label += row["labels"]
        features += row["features"]
        chain += [(n + k, n + k + 1) for k in row["chain"]]
        skip += [(n + a, n + b) for a, b in row["skip"]]
        n += len(row["labels"])
    return Field().fit(np.array(label, np.int64), np.array(features, np.int64), np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2))


def find(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Personal data in every text: base counts and digest, and all spans with those of the field.

    Positions are code points, ends exclusive; base spans of different kinds may overlap, added ones
    overlap none of them. A null text is empty. Rows with equal doc_id are searched each on its own. An
    empty table gives an empty result. Other columns of ``docs`` are not used.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    field = docs.sparkSession.sparkContext.broadcast(train(texts, train_rows))

    def rows(read: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in read:
            base = base_spans(text)
            more = added_spans(text, base, field.value) if _HINT(text) else []
            counts = [sum(kind == k for kind, *_ in base) for k in range(len(KINDS))]
            yield doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more))

    return map_rows(texts, rows, _SCHEMA)
