"""Toxicity: noisy-channel restoring of disguised words with a character language model, then a linear score."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import WORDS, cut, map_rows, share

#: The scorer is fitted on about so many labelled documents (in the mean), chosen by a hash of doc_id, and on so many word features.
TRAIN_ROWS, FEATURES = 20_000, 3000
#: Rows with this remainder of crc32(doc_id as text) are held out.
HELD_OUT, FOLDS = 0, 5
#: Characters of texts whose letters a task counts at a time.
COUNTED = 2_000_000
#: Results that a task remembers by word.
MOST_WORDS = 400_000

#: What a sign may stand for in a disguised word.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y"}
#: Signs that may stand between the letters of a word and mean nothing.
FILLERS = set(".-_*'~^,:;/\\=#%&\"`)")
#: Letters that the language model tells apart; all others are one.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäçèéêëìíîïñòóôöùúûüßœæ"
#: Log costs: reading a sign as a letter, passing over a filler, passing over a sign, reading a run of letters as one, passing over a space.
READ, FILL, DROP, COLLAPSE, JOIN = -0.5, -0.3, -7.0, -0.2, -1.5

_SIZE = 64
_PLACE = np.zeros(0x250, np.int64)
_PLACE[[ord(c) for c in LETTERS]] = np.arange(1, len(LETTERS) + 1)
for _c in map(chr, range(0x250)):
    if _c.isalpha() and _c.islower() and not _PLACE[ord(_c)]:
        _PLACE[ord(_c)] = _SIZE - 1
_SPACED = re.compile(r"(?<!\S)\S{1,2}(?: \S{1,2}){2,}(?!\S)")
_EDGE = re.compile(r"^(?:([^\w\s])\1+|[\"'(\[{<.,;:?*#%&-])+|(?:([^\w\s])\2+|[\"')\]}>.,;:?!*#%&-])+$")
_RUN = re.compile(r"([^\W\d_])\1\1")

_TRIGRAMS = pa.schema([("code", pa.int32()), ("n", pa.int64())])
_COUNTS = pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
_TRAIN = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("at", pa.list_(pa.int32()))])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])


def places(text: str) -> np.ndarray:
    """The model's number of each character of a lower-case text: 0 for what is no letter."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < len(_PLACE), _PLACE[np.minimum(codes, len(_PLACE) - 1)], np.where(codes > 0x2000, 0, _SIZE - 1))


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams, with word ends, over all documents, as a table of three model letters."""

    def rows(texts: Iterator[tuple]) -> Iterator[tuple]:
        total, held, size = np.zeros(_SIZE**3, np.int64), [], 0

        def count() -> None:
            p = np.concatenate([[0, 0], places("\n\n".join(held)), [0]])
            code = (p[:-2] * _SIZE + p[1:-1]) * _SIZE + p[2:]
            total[:] += np.bincount(code[(p[1:-1] > 0) | (p[2:] > 0)], minlength=len(total))

        for (text,) in texts:
            held.append((text or "").lower())
            size += len(held[-1])
            if size >= COUNTED:
                count()
                held, size = [], 0
        count()
        yield from ((int(k), int(total[k])) for k in np.flatnonzero(total))

    out = np.zeros(_SIZE**3)
    for row in map_rows(docs.select("text"), rows, _TRIGRAMS, flush=50_000).groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[row["code"]] = row["n"]
    return out.reshape(_SIZE, _SIZE, _SIZE)


def language_model(counts: np.ndarray) -> list[list[list[float]]]:
    """Log chance of a letter after two: trigrams backed off to bigrams and letters (Witten-Bell)."""
    one = (counts.sum((0, 1)) + 0.5) / (counts.sum() + 0.5 * _SIZE)
    two = counts.sum(0)
    kinds = (two > 0).sum(1, keepdims=True)
    two = (two + kinds * one + 0.01 * one) / (two.sum(1, keepdims=True) + kinds + 0.01)
    kinds = (counts > 0).sum(2, keepdims=True)
    three = (counts + kinds * two[None] + 0.01 * two[None]) / (counts.sum(2, keepdims=True) + kinds + 0.01)
    return np.log(three).astype(np.float32).tolist()


class Restorer(dict):
    """Lower-case token to the word that it most likely disguises; plain words and codes map to themselves."""

    def __init__(self, chance: list[list[list[float]]]):
        super().__init__()
        self.chance = chance

    def __missing__(self, token: str) -> str:
        if len(self) >= MOST_WORDS:
            self.clear()
        self[token] = word = self._restore(token)
        return word

    def _restore(self, token: str) -> str:
        if " " in token:
            letters, digits = sum(map(str.isalpha, token)), sum(map(str.isdigit, token))
            return self.decode(token) if letters >= 2 and digits <= letters + 2 else token
        if token.isalpha():
            return self.decode(token) if _RUN.search(token) else token
        bare = _EDGE.sub("", token)
        if bare.isalpha() and not _RUN.search(bare):
            return bare
        letters = sum(map(str.isalpha, bare))
        if not letters or 2 * sum(map(str.isdigit, bare)) > len(bare) + 2:
            return bare
        return self.decode(bare)

    def decode(self, token: str) -> str:
        """Viterbi over the lattice of readings of each sign and space; a state is the last two letters (0 between words).

        Each step keeps, by state, the best score, the state before and the letters read, so the work
        is linear in the token.
        """
        best: dict[tuple[int, int], float] = {(0, 0): 0.0}
        steps: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
        k = 0
        while k < len(token):
            c, run = token[k], 1
            while k + run < len(token) and token[k + run] == c:
                run += 1
            arcs: list[tuple[float, str]] = []
            if c == " ":
                arcs = [(0.0, " "), (JOIN, "")]
            elif c.isalpha():
                arcs = [(0.0, c * run)] if run < 3 else [(COLLAPSE, c), (COLLAPSE, c * 2)]
            else:
                arcs += [(READ * run, x * n) for x in LOOKS.get(c, "") for n in {1, min(run, 2)}]
                arcs.append(((FILL if c in FILLERS else DROP), ""))
            following: dict[tuple[int, int], float] = {}
            came: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
            for (a, b), score in best.items():
                for cost, letters in arcs:
                    x, y, s = a, b, score + cost
                    for letter in letters:
                        z = 0 if letter == " " else int(_PLACE[ord(letter)]) if ord(letter) < len(_PLACE) else _SIZE - 1
                        s += self.chance[x][y][z]
                        x, y = y, z
                    if (x, y) not in following or s > following[x, y]:
                        following[x, y], came[x, y] = s, ((a, b), letters)
            best, k = following, k + run
            steps.append(came)
        state = max(best, key=lambda ab: best[ab] + (self.chance[ab[0]][ab[1]][0] if ab[1] else 0.0))
        out = []
        for came in reversed(steps):
            state, letters = came[state]
            out.append(letters)
        return " ".join("".join(reversed(out)).split()) or token

    def _phrase(self, m: re.Match) -> str:
        """Three or more pieces of a letter or two, two of them single, may be a word spaced out; the lattice says where words end."""
        return self[m[0]] if sum(len(x) == 1 for x in m[0].split(" ")) >= 2 else m[0]

    def spaced(self, text: str) -> str:
        """The text in lower case, words spaced out being joined."""
        return _SPACED.sub(self._phrase, text.lower())

    def words(self, text: str) -> list[str]:
        """The words of a text with disguises undone."""
        return [self[x] for x in WORDS(self.spaced(text))]


def prefixes(word: str) -> list[str]:
    """A word's features: itself with its end marked, and its beginnings of 4 to 8 letters."""
    return [word + "$", *(word[:k] for k in range(4, min(len(word), 8) + 1))]


def named(counts: Counter) -> Iterator[str]:
    """Features of a text from the counts of its words' features: that it has one, two, four or eight of them."""
    for feature, n in counts.items():
        for k in (1, 2, 4, 8):
            if n >= k:
                yield f"{k}{feature}"


class Scorer:
    """Picks the chosen features of a text, remembering them by token."""

    def __init__(self, chance: list[list[list[float]]], chosen: list[str]):
        self.restorer, self.index = Restorer(chance), {f: k for k, f in enumerate(chosen)}
        self.known: dict[str, tuple[str, ...]] = {}
        self.used = {f[1:] for f in chosen}

    def of(self, text: str | None) -> list[int]:
        counts: Counter[str] = Counter()
        if len(self.known) >= MOST_WORDS:
            self.known.clear()
        for token, n in Counter(WORDS(self.restorer.spaced(text or ""))).items():
            features = self.known.get(token)
            if features is None:
                self.known[token] = features = tuple(f for f in prefixes(self.restorer[token]) if f in self.used)
            for f in features:
                counts[f] += n
        return [self.index[f] for f in named(counts) if f in self.index]


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def fit(labels: np.ndarray, rows: np.ndarray, columns: np.ndarray, n: int, rounds: int = 300, rate: float = 0.3, decay: float = 0.2) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse binary features, by full gradient steps with per-weight rates."""
    share = min(max(float(labels.mean()) if len(labels) else 0.1, 0.01), 0.99)
    w, b, seen = np.zeros(n), math.log(share / (1 - share)), np.full(n + 1, 1e-6)
    for _ in range(rounds if len(labels) else 0):
        margin = np.bincount(rows, w[columns], len(labels)) + b
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels
        g = np.append(np.bincount(columns, error[rows], n) + decay * w, error.sum())
        seen += g * g
        step = rate * g / np.sqrt(seen)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def score_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, features: int = FEATURES) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) of every document.

    The character model is counted over all documents. Labels are learned only from rows that are not
    held out, ``train_rows`` of them at most; which word features count is chosen by how much more often
    toxic than clean documents of that sample have them. A null text is empty and gets the score of a
    text without any feature. Rows with equal doc_id are scored each by its own text. Without labels of
    both kinds all scores are the share of toxic labels (0.1 without labels). An empty table gives an
    empty result. Other columns of ``docs`` are not used.
    """
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chance = context.broadcast(language_model(trigram_counts(texts)))
    known = labels.where("toxic is not null and doc_id is not null").where(fold(F.col("doc_id")) != HELD_OUT).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    sample = known.withColumn("pick", F.xxhash64("doc_id")).where(share(train_rows, known.count())).select("doc_id", "label")
    labelled = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))
    labelled = cut(labelled)

    def counted(rows: Iterator[tuple]) -> Iterator[tuple]:
        restorer, toxic, clean = Restorer(chance.value), Counter(), Counter()
        for label, text in rows:
            counts: Counter[str] = Counter()
            for word, n in Counter(restorer.words(text or "")).items():
                for f in prefixes(word):
                    counts[f] += n
            (toxic if label == 1 else clean).update(named(counts))
            if len(toxic) + len(clean) > 500_000:
                yield from ((f, toxic[f], clean[f]) for f in toxic.keys() | clean.keys())
                toxic.clear()
                clean.clear()
        yield from ((f, toxic[f], clean[f]) for f in toxic.keys() | clean.keys())

    sizes = labelled.agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") != 1).alias("clean")).first()
    m, n = max(sizes["toxic"], 1), max(sizes["clean"], 1)
    rate = (F.col("a") + F.col("b")) / (m + n)
    gap = (F.col("a") / m - F.col("b") / n) / F.sqrt(rate * (1 - rate) * (1 / m + 1 / n) + 1e-9)
    chosen = map_rows(labelled.select("label", "text"), counted, _COUNTS, flush=50_000).groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    chosen = [r["feature"] for r in chosen.where("a >= 3").select("feature", gap.alias("gap")).where("gap > 3").orderBy(F.desc("gap"), "feature").limit(features).collect()]

    def picked(rows: Iterator[tuple]) -> Iterator[tuple]:
        scorer = Scorer(chance.value, chosen)
        for doc_id, label, text in rows:
            yield doc_id, label, scorer.of(text)

    got = sorted(map_rows(labelled, picked, _TRAIN).collect())
    y = np.array([int(r["label"] == 1) for r in got])
    row, column = np.repeat(np.arange(len(got)), [len(r["at"]) for r in got]) if got else np.zeros(0, int), np.array([k for r in got for k in r["at"]], np.int64)
    w, b = fit(y, row, column, len(chosen))
    model = context.broadcast((chosen, w, b))

    def scored(rows: Iterator[tuple]) -> Iterator[tuple]:
        chosen, w, b = model.value
        scorer = Scorer(chance.value, chosen)
        for doc_id, text in rows:
            at = scorer.of(text)
            score = 1 / (1 + math.exp(-min(max(float(w[at].sum()) + b, -30), 30)))
            yield doc_id, score, int(score >= 0.5)

    return map_rows(texts, scored, _SCHEMA).select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", "predicted")
