"""Importance resampling towards a target distribution: array-scored weights, a radix selection of the exact k-th key, ranks of what is drawn."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from saltmarsh.llm.common import cut, map_rows

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 7, 20, 25
#: Bits of one digit of a key; a pass of the selection brings at most two to that power of counts to the driver.
DIGIT = 16

#: Bytes of UTF-8 that words are made of stay (A-Z in lower case); all others become a space.
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_COUNTS = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64()), ("eligible", pa.bool_())])
#: The key that rows are drawn by, in ascending order: the score falling, doc_id (null last), and two that part what else would tie.
KEY = ("down", "none", "id", "n_features", "at")


def buckets_of(text: str | None, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words of a text, and the buckets of its words and of its pairs of neighbouring words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()
    if not words:
        return 0, np.empty(0, np.int64)
    single = list(map(crc32, words))
    # The checksum of a pair goes on from that of its first word.
    pairs = map(crc32, [b" " + w for w in words[1:]], single)
    return len(words), np.fromiter((*single, *pairs), np.int64, 2 * len(words) - 1) % buckets


def feature_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows of ``texts``: each task adds up its own, so at most ``buckets`` rows a task are shuffled."""

    def rows(read: Iterator[tuple]) -> Iterator[tuple]:
        counts = np.zeros(buckets, np.int64)
        for (text,) in read:
            counts += np.bincount(buckets_of(text, buckets)[1], minlength=buckets)
        yield from ((int(b), int(counts[b])) for b in np.flatnonzero(counts))

    got = map_rows(texts.select(F.col("text").cast("string")), rows, _COUNTS, flush=buckets).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(buckets, np.int64)
    counts[[r["bucket"] for r in got]] = [r["n"] for r in got]
    return counts


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight: the logarithm of how much more often the target has it, in thousandths, floored."""
    s_all, t_all = int(documents.sum()) + len(documents), int(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((float(t + 1) * s_all) / (float(s + 1) * t_all))) for s, t in zip(documents.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """A Gumbel draw in thousandths, floored, from a hash of doc_id (null: empty text)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, and whether a row may be drawn."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def rows(read: Iterator[tuple]) -> Iterator[tuple]:
        gain = shared.value
        for doc_id, text in read:
            n, found = buckets_of(text, len(gain))
            weight = int(gain[found].sum()) // len(found) if n else 0
            yield doc_id, len(found), weight, weight + noise(doc_id, seed), n >= least_words

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, _SCORED)


def unsigned(column: str) -> Column:
    """A long with its sign bit turned, so that its bits as an unsigned number are in the order of the values."""
    return F.col(column).bitwiseXOR(F.lit(-(2**63)))


def kth_key(rows: DataFrame, k: int) -> list[int]:
    """The k-th least of the keys (longs in KEY, all different) of ``rows``, digit by digit.

    A pass counts the rows by the next DIGIT bits among those that agree with all digits so far, and the running
    total of at most 2^DIGIT counts tells the digit. A column's least and greatest value come first: the digits in
    which they agree need no pass.
    """
    found: list[int] = []
    same = rows
    for column in KEY:
        low, high = same.agg(F.min(column), F.max(column)).first()
        shift = 64 if (low < 0) != (high < 0) else (low ^ high).bit_length()
        prefix = (low + 2**63) >> shift
        while shift > 0:
            width = min(DIGIT, shift)
            shift -= width
            digit = F.shiftrightunsigned(unsigned(column), shift).bitwiseAND(F.lit(2**width - 1)).cast("int")
            before = 0
            for value, n in sorted(tuple(r) for r in same.groupBy(digit.alias("digit")).count().collect()):
                if before + n >= k:
                    break
                before += n
            k -= before
            prefix = prefix << width | value
            same = same.where(digit == value)
        found.append(prefix - 2**63)
    return found


def up_to(key: list[int]) -> Column:
    """Whether a row's key is at most ``key``."""
    told = F.lit(True)
    for column, value in reversed(list(zip(KEY, key, strict=True))):
        told = (F.col(column) < value) | ((F.col(column) == value) & told)
    return told


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with rank (1, 2, ...) in the order of KEY: sorted by range, then each range counts on from those before it."""
    parts = cut(rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("part", F.spark_partition_id()))
    sizes = sorted(tuple(r) for r in parts.groupBy("part").count().collect())
    before = dict(zip((p for p, _ in sizes), np.cumsum([0] + [n for _, n in sizes]).tolist(), strict=False))
    schema = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64()), ("rank", pa.int64())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:  # the rows of a range are in one partition, in order
            if batch.num_rows:
                part = batch.column(4)[0].as_py()
                at = before[part] + seen.get(part, 0)
                seen[part] = seen.get(part, 0) + batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.arange(at + 1, at + batch.num_rows + 1))], schema=schema)

    return parts.select("doc_id", "n_features", "weight", "score", "part").mapInArrow(number, from_arrow_schema(schema))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and, for the ``percent`` in a hundred that are drawn, rank.

    Words are runs of digits, a-z (A-Z in lower case) and characters beyond ASCII; features are words and pairs of
    neighbours, hashed to ``buckets``. The weight is the floored mean of the features' gains towards the texts of
    ``target``; the score adds a Gumbel draw by doc_id, so that the highest scores are a draw without replacement
    by weight. Of the documents with ``least_words`` words that share, rounded down, is drawn. A null text has no words;
    a document without features has weight 0. Ties go to the smaller doc_id (null last), and of equal doc_ids to the
    row with fewer features; rows that repeat all of these are drawn in any order, which changes no value. An
    empty table gives an empty result, an empty target one in which only the documents' counts tell. Only doc_id and
    text are used, so other columns may have any name.

    The scored rows (four longs each) are written to the checkpoint folder once. The k-th key is found by counting
    digits, and only what is drawn is sorted.
    """
    texts = docs.select("doc_id", "text")
    gain = gains(feature_counts(texts, buckets), feature_counts(target, buckets))
    keys = {"down": -F.col("score"), "none": F.col("doc_id").isNull().cast("long"), "id": F.coalesce("doc_id", F.lit(0)), "at": F.monotonically_increasing_id()}
    rows = cut(scored(texts, gain, least_words, seed).withColumns(keys))
    eligible = rows.where("eligible")
    k = percent * eligible.count() // 100
    plain = lambda df: df.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    if not k:
        return plain(rows)
    drawn = F.col("eligible") & up_to(kth_key(eligible, k))
    return plain(rows.where(~drawn)).unionByName(ranked(rows.where(drawn).select("doc_id", "n_features", "weight", "score", "down", "none", "id", "at")))


#: The same in DuckDB's SQL, the checksum worked out byte by byte with a table that the polynomial makes.
SQL = rf"""
WITH codes AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, CAST(n AS BIGINT))) AS code),
texts AS (
  SELECT 0 AS kind, row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, coalesce(text, '') FROM benchmark),
words AS (
  SELECT kind, row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
features AS MATERIALIZED (
  SELECT kind, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
bytes AS (
  SELECT f, list_transform(range(0, octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b
  FROM (SELECT DISTINCT f FROM features)),
buckets AS MATERIALIZED (
  SELECT f, xor(list_reduce(b, lambda a, x: xor(code[(xor(a, x) & 255) + 1], a >> 8), CAST(4294967295 AS BIGINT)), 4294967295) % {BUCKETS} AS bucket FROM bytes, codes),
counts AS (
  SELECT bucket, sum(CASE WHEN kind = 0 THEN 1 ELSE 0 END) AS s, sum(kind) AS t FROM features JOIN buckets USING (f) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + {BUCKETS} AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain
  FROM counts),
weights AS (
  SELECT row, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
  FROM features JOIN buckets USING (f) JOIN gain USING (bucket) WHERE kind = 0 GROUP BY row),
scores AS (
  SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || w.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM words w LEFT JOIN weights USING (row) WHERE kind = 0),
ranks AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scores WHERE n_words >= {LEAST_WORDS}
  QUALIFY rank <= (SELECT {PERCENT} * count(*) // 100 FROM scores WHERE n_words >= {LEAST_WORDS}))
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CAST(rank AS BIGINT) AS rank FROM scores LEFT JOIN ranks USING (doc_id)
"""
