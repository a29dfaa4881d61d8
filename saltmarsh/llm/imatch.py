"""Document fingerprints: I-Match over several randomised lexicon subsets."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import WordHashes, map_rows, mix64
from saltmarsh.llm.line_dedup import marked

#: The band: terms that at least this share of the distinct texts hold (and two texts), and at most that share.
LEAST_SHARE, MOST_SHARE = 0.0005, 0.2
#: Subsets on each level of density, and levels that a fingerprint holds.
SUBSETS, LEVELS = 48, 3
#: A text with fewer terms in the band than this has its fingerprint from its rarest terms.
FEW = 4
#: Terms that a task counts before it hands them on.
MOST_COUNTED = 300_000

_TERMS = re.compile(r"\w+").findall
_SEEDS = mix64(np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SECOND = np.uint64(0xD1B54A32D192ED03)
_COUNTS = pa.schema([("term", pa.int64()), ("n", pa.int64())])
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


class Terms:
    """Distinct terms of a text: runs of letters, digits and underscores in lower case, as sorted hashes."""

    def __init__(self) -> None:
        self.hashes = WordHashes()

    def of(self, text: str) -> np.ndarray:
        found = list(set(_TERMS(text.lower())))
        return np.sort(self.hashes.of(found))


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, int]:
    """Each text of ``docs`` once, and how many there are. Only texts that may stand in several rows are shuffled."""
    hashed = docs.select(F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    sizes = hashed.groupBy("h").agg(F.count("*").alias("size"))
    told = marked(hashed, "h", sizes.where("size > 1").select("h"))
    several = told.where("_maybe").dropDuplicates(["h"])
    return told.where("not _maybe").select("text").unionByName(several.select("text")), sizes.count()


def lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms in the band of document frequency (so of idf), and of those above it, sorted.

    Counts cover all distinct texts, so that copies do not make a term common. The band bounds what comes to
    the driver whatever the corpus: at most 1 / ``least`` times the mean number of distinct terms of a text
    can be in it or above.
    """

    def rows(texts: Iterator[tuple]) -> Iterator[tuple]:
        terms, counts = Terms(), Counter()
        for (text,) in texts:
            counts.update(terms.of(text or "").view(np.int64).tolist())
            if len(counts) >= MOST_COUNTED:
                yield from counts.items()
                counts.clear()
        yield from counts.items()

    texts, n = distinct_texts(docs)
    low, high = max(2, math.ceil(least * n)), max(2, math.floor(most * n))
    counted = map_rows(texts, rows, _COUNTS, flush=50_000).groupBy("term").agg(F.sum("n").alias("n"))
    got = counted.where(F.col("n") >= low).select("term", (F.col("n") > high).alias("above")).toArrow()
    term, above = got["term"].to_numpy().view(np.uint64), got["above"].to_numpy().astype(bool)
    return np.sort(term[~above]), np.sort(term[above])


def among(terms: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each of ``terms`` is in ``known``, which is sorted."""
    return known[np.minimum(np.searchsorted(known, terms), len(known) - 1)] == terms if len(known) else np.zeros(len(terms), bool)


class Fingerprint:
    """I-Match hashes of a text.

    On level r a subset keeps each lexicon term with probability 2 to the -r; the terms of the text
    that it keeps are hashed to 16 bits (0: none kept): the sum of the distinct terms' own scrambled hashes is
    scrambled, which is the same for terms in any order, so sorting them would change nothing. Which levels are held follows
    from the number of terms, so that a subset has about two, one and half a term: of sparse subsets
    about as large a share agrees as the texts have terms in common. A text with fewer than FEW lexicon
    terms has in their place all its terms but those above the band (``common``), or if these are few as well all its
    terms. A text without terms has one hash of itself.
    """

    def __init__(self, text: str, terms: np.ndarray, band: np.ndarray, common: np.ndarray = np.empty(0, np.uint64)):
        kept = terms[among(terms, band)]
        if len(kept) < FEW:
            kept = terms[~among(terms, common)]
        if len(kept) < FEW:
            kept = terms
        self.parts: dict[int, np.ndarray] = {}
        if not len(kept):
            self.text = "all:" + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:32]
            return
        first = max(0, int(math.log2(len(kept))) - 1)
        drawn = mix64(kept[:, None] ^ _SEEDS)
        # What a level keeps is part of what the one before keeps, so only the first level looks at all terms.
        subset = np.nonzero((drawn >> np.uint64(64 - first)) == 0 if first else np.ones(drawn.shape, bool))
        drawn, subset = drawn[subset], subset[1]
        hashed = mix64(drawn + _SECOND)
        for level in range(first, first + LEVELS):
            if level > first:
                inside = (drawn >> np.uint64(64 - level)) == 0
                drawn, hashed, subset = drawn[inside], hashed[inside], subset[inside]
            total = np.zeros(SUBSETS, np.uint64)
            np.add.at(total, subset, hashed)
            digest = (mix64(total) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
            self.parts[level] = np.where(np.bincount(subset, minlength=SUBSETS) > 0, digest, 0)
        self.text = f"{first:02d}:" + ":".join(p.astype(">u2").tobytes().hex() for p in self.parts.values())

    def like(self, other: Fingerprint) -> float:
        """Share of the subsets, on levels that both hold, in which the hashes agree; those empty in both do not count."""
        if self.text == other.text:
            return 1.0
        same = used = 0
        for level in self.parts.keys() & other.parts.keys():
            a, b = self.parts[level], other.parts[level]
            same += int(np.count_nonzero((a == b) & (a != 0)))
            used += int(np.count_nonzero((a != 0) | (b != 0)))
        return same / used if used else 0.0


def in_id_order(docs: DataFrame, ranges: int) -> DataFrame:
    """Deal rows (key, doc_id, text) to ``ranges`` runs of ascending doc_id, each also with the row after its last.

    Returns run, ahead (1 for that extra row), key, doc_id, text, with each run whole and in order in
    one task. The bounds between the runs are quantiles of doc_id and themselves doc_ids, so the row
    after a run is the row at the next bound; the one after the last run is the first of all.
    """
    ids = docs.where("doc_id is not null").agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)] or [0.5], 10_000).alias("at"), F.min("doc_id").alias("first"))
    got = ids.first()
    bounds = np.unique(np.array([b for b in got["at"] or [] if b > got["first"]], np.int64))
    first = None if docs.where("doc_id is null").limit(1).count() else got["first"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id = batch.column(0)
            null = doc_id.is_null().to_numpy(zero_copy_only=False)
            value = doc_id.fill_null(np.iinfo(np.int64).min).to_numpy()
            run = np.searchsorted(bounds, value, "right")
            start = np.isin(value, bounds)
            wrap = null if first is None else value == first
            take = np.concatenate([np.arange(len(value)), np.flatnonzero(start), np.flatnonzero(wrap)])
            runs = np.concatenate([run, run[start] - 1, np.full(np.count_nonzero(wrap), len(bounds))])
            ahead = (np.arange(len(take)) >= len(value)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(runs.astype(np.int32)), pa.array(ahead), *batch.take(pa.array(take)).columns], names=["run", "ahead", "doc_id", "text"])

    dealt = docs.select("doc_id", "text").mapInArrow(deal, "run int, ahead int, doc_id long, text string")
    return dealt.repartition(F.col("run")).sortWithinPartitions("run", "ahead", F.col("doc_id").asc_nulls_first(), "text")


def fingerprints(docs: DataFrame, band: Broadcast | None = None) -> DataFrame:
    """Fingerprint of each text and of its edited text, and how alike that one and the next document's are.

    The edited text has the last half of the code points replaced by the first as many of the next
    document in ascending doc_id (after the last: the first; null first; rows of equal doc_id in order
    of text). A null text is empty. A single document is its own next. An empty table gives an empty
    result. Other columns of ``docs`` are not used.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    band = band or spark.sparkContext.broadcast(lexicon(docs))  # the band and the terms above it
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def rows(ordered: Iterator[tuple]) -> Iterator[tuple]:
        terms, known = Terms(), band.value
        mark = lambda text: Fingerprint(text, terms.of(text), *known)
        held = None
        for run, ahead, doc_id, text in ordered:
            after = mark(text)
            if held and held[0] == run:
                _, own_id, own, print_ = held
                half = len(own) // 2
                edited = own[: len(own) - half] + text[:half]
                edited_print = mark(edited)
                yield own_id, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), print_.text, edited_print.text, print_.like(edited_print), print_.like(after)
            held = None if ahead else (run, doc_id, text, after)

    return map_rows(in_id_order(docs, ranges), rows, _SCHEMA)
