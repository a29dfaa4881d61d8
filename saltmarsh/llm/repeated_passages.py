"""Substring dedup: repeated passages found by anchors, confirmed, and located with sharded Aho-Corasick automata."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import from_arrow_schema

from saltmarsh.llm.common import cut, map_rows, mix64, renamed
from saltmarsh.llm.line_dedup import marked

#: Words of a window that repeats, and of the runs within it of which the one with the least hash is its anchor.
WINDOW, GRAM = 20, 8
#: Anchors that a task counts before it hands them on.
MOST_COUNTED = 500_000
#: The filter on repeated anchors has 16 bits for each, and so many longs at most (32 MB broadcast).
FILTER_LONGS = 2**22
#: Stretches of one anchor that are worked on in one piece, and stretches that one automaton serves.
PIECE, SHARD = 10_000, 5_000
#: An anchor with this share of all stretches or more is dealt to several tasks, so at most so many are listed.
HOT_SHARE = 0.001

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_COUNTS = pa.schema([("anchor", pa.int64()), ("n", pa.int64())])
_STRETCHES = pa.schema([("anchor", pa.int64()), ("salt", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("words", pa.binary())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64())])
_WHITE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8: bytes.split parts at just the six ASCII white-space characters."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class Places:
    """Where the words of a text begin and end in UTF-8, and a hash of each, without making the words.

    A hash is a polynomial of the word's bytes modulo 2^64, taken from running sums over the text: the powers
    before the word are divided out by those of the multiplier's inverse.
    """

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, np.uint64)

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = np.frombuffer(data, np.uint8)
        if len(self.powers) < len(codes):
            n = np.uint64(int(_MULTIPLIER)), np.uint64(pow(int(_MULTIPLIER), -1, 2**64))
            self.powers, self.inverses = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * len(codes), x)])) for x in n)
        edge = np.diff(np.concatenate([[True], _WHITE[codes], [True]]).view(np.int8))
        starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * self.powers[: len(codes)])])
        return starts, stops, mix64((sums[stops] - sums[starts]) * self.inverses[starts])


def gram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    total = np.zeros(len(hashes) - width + 1, np.uint64)
    for i in range(width):
        total = total * _MULTIPLIER + hashes[i : i + len(total)]
    return mix64(total)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbouring values, by doubling."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def anchors(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor of each stretch (a run of windows with one anchor), its first window, the window after its last, and anchors that stand at two places of a stretch.

    Equal windows have equal anchors, so a window can only repeat if its anchor does. A sixth to a seventh as many stretches as
    words come out of usual text. The anchors are signed longs.
    """
    if len(hashes) < window:
        none = np.empty(0, np.int64)
        return none, none, none, none
    grams, reach = gram_hashes(hashes, gram), window - gram + 1
    of_window = least(grams, reach)
    first = np.flatnonzero(np.concatenate([[True], of_window[1:] != of_window[:-1]]))
    own, stop = of_window[first].view(np.int64), np.append(first[1:], len(of_window))
    # Places of anchors: where a run of words has the greatest hash that windows around it have as their least one.
    edge = np.full(reach - 1, np.iinfo(np.uint64).max)
    chosen = grams[grams == ~least(~np.concatenate([~edge, of_window, ~edge]), reach)] if reach > 1 else grams
    twice = np.empty(0, np.int64)
    if len(chosen) > len(first):
        chosen = np.sort(chosen)
        twice = own[np.isin(own, chosen[1:][chosen[1:] == chosen[:-1]].view(np.int64))]
    return own, first, stop, twice


def repeated_anchors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """anchor and n (stretches, over all documents) of the anchors that may have a window twice; those twice in a stretch count double."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, held, size = Places(), [], 0

        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], schema=_COUNTS)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                own, _, _, twice = anchors(places.of(text.encode("utf-8", "surrogatepass"))[2], window, gram)
                held += [own, twice]
                size += len(own)
                if size >= MOST_COUNTED:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    counts = docs.select("text").mapInArrow(count, from_arrow_schema(_COUNTS)).groupBy("anchor").agg(F.sum("n").alias("n"))
    return cut(counts.where("n > 1"))


def stretches(docs: DataFrame, repeated: DataFrame, window: int = WINDOW, gram: int = GRAM, piece: int = PIECE) -> DataFrame:
    """The words of all stretches whose anchor repeats, dealt by anchor and, within an anchor, sorted by place.

    A filter of a bounded size says which anchors repeat: some others pass as well, more as it fills, which costs
    shuffling and changes no result. Anchors with a large share of all stretches are dealt to several tasks by salt.
    """
    told = repeated.agg(F.count("*").alias("n"), F.sum("n").alias("stretches")).first()
    longs = min(max(1 << (max(told["n"], 1) // 4 - 1).bit_length(), 16), FILTER_LONGS)
    most = max(piece, int((told["stretches"] or 0) * HOT_SHARE))
    word = F.shiftright("anchor", 6).bitwiseAND(F.lit(longs - 1)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("anchor").bitwiseAND(F.lit(63)).cast("int"))
    got = repeated.groupBy(word.alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(longs, np.uint64)
    bits[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    hot = {r["anchor"]: -(-r["n"] // most) for r in repeated.where(F.col("n") > most).collect()}
    shared = docs.sparkSession.sparkContext.broadcast((bits, hot))

    def rows(read: Iterator[tuple]) -> Iterator[tuple]:
        (bits, hot), places = shared.value, Places()
        for doc_id, text, text_hash in read:
            data = text.encode("utf-8", "surrogatepass")
            starts, stops, hashes = places.of(data)
            own, first, stop, _ = anchors(hashes, window, gram)
            key = own.view(np.uint64)
            some = np.flatnonzero(bits[(key >> np.uint64(6)).astype(np.int64) & (len(bits) - 1)] >> (key & np.uint64(63)) & np.uint64(1))
            first, stop = first[some], stop[some]
            for anchor, a, i, j in zip(own[some].tolist(), first.tolist(), starts[first].tolist(), stops[stop + window - 2].tolist(), strict=True):
                yield anchor, text_hash % hot[anchor] if anchor in hot else -1, doc_id, text_hash, a, b" ".join(data[i:j].split())

    found = map_rows(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), rows, _STRETCHES)
    return found.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", F.col("doc_id").asc_nulls_first(), "text_hash", "start")


class Shard:
    """Stretches of some anchors: the passages that repeat among them, compiled to an automaton over numbered words.

    Equal stretches are held once. A passage is a whole stretch that stands at several places, or a window that different
    stretches have, or that one has twice.
    """

    def __init__(self, window: int, stretches: Iterable[tuple[tuple, bytes]] = ()):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.numbers: dict[bytes, tuple[int, ...]] = {}  # the distinct stretches
        self.held: list[tuple[tuple, bytes]] = []  # place, stretch
        self.add(stretches)

    def add(self, stretches: Iterable[tuple[tuple, bytes]]) -> None:
        """Add (place, words) of an anchor, in order of place."""
        for place, words in stretches:
            if words not in self.numbers:
                self.numbers[words] = tuple([self.words.setdefault(w, len(self.words)) for w in words.split(b" ")])
            self.held.append((place, words))

    def windows(self, numbers: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        size = self.window
        return (numbers[k : k + size] for k in range(len(numbers) - size + 1))

    def confirmed(self) -> tuple[set[tuple[int, ...]], set[tuple[int, ...]]]:
        """Stretches at several places, and windows that repeat in other ways, compared word by word."""
        often, once, twice = set(), set(), set()
        seen: set[bytes] = set()
        for _, words in self.held:
            if words in seen:
                often.add(self.numbers[words])
            seen.add(words)
        for numbers in self.numbers.values():
            for w in self.windows(numbers):
                (twice if w in once else once).add(w)
        return often, twice

    def located(self) -> dict[bytes, list[tuple[int, tuple[int, ...]]]]:
        """For each distinct stretch the passages in it, as the automaton meets them: index of the last word, and the passage."""
        often, twice = self.confirmed()
        if not often and not twice:
            return {}
        passages = list(often | twice)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, passage in enumerate(passages):
            automaton.add_word(passage, k)
        automaton.make_automaton()
        return {words: [(end, passages[k]) for end, k in automaton.iter(numbers)] for words, numbers in self.numbers.items()}

    def repeats(self) -> Iterator[tuple[tuple, int, int]]:
        """(place, first, stop) of runs of windows that start earlier as well."""
        found = self.located()
        if not found:
            return
        seen: set[tuple[int, ...]] = set()
        for place, words in self.held:
            numbers = self.numbers[words]
            if numbers in seen:  # the whole stretch stood earlier, and so did each of its windows
                yield place, 0, len(numbers) - self.window + 1
                continue
            first = stop = -1
            for end, passage in found[words]:
                if len(passage) == self.window and passage in seen:
                    at = end - self.window + 1
                    if at != stop:
                        if stop >= 0:
                            yield place, first, stop
                        first = at
                    stop = at + 1
                elif len(passage) == self.window or passage is numbers or passage == numbers:
                    seen.add(passage)
            if stop >= 0:
                yield place, first, stop

    def firsts(self) -> Iterator[tuple[tuple, int, int, int]]:
        """(place, window, two halves of a 128-bit hash of its words) of the first occurrence of each window."""
        names = list(self.words)
        done: set[tuple[int, ...]] = set()
        met: set[bytes] = set()
        for place, words in self.held:
            if words in met:
                continue
            met.add(words)
            for k, w in enumerate(self.windows(self.numbers[words])):
                if w not in done:
                    done.add(w)
                    digest = xxhash.xxh3_128_digest(b" ".join([names[x] for x in w]))
                    yield place, k, int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def locate(dealt: DataFrame, window: int = WINDOW, piece: int = PIECE, shard: int = SHARD) -> DataFrame:
    """Runs of repeated windows by document: doc_id, text_hash, start and stop, counted in windows.

    Each task reads its stretches in order and serves some thousands of them by one automaton after another, so it
    holds a bounded number. The stretches of one anchor stand in order of place, so of equal windows the first one met is the
    one that stays. An anchor with a salt, or with more stretches than a piece, is served in several pieces: then each
    piece also tells where it met each window first, and of these the first over all pieces stays.
    """

    def rows(read: Iterator[tuple]) -> Iterator[tuple]:
        def told(held: Shard, split: bool) -> Iterator[tuple]:
            for (doc_id, text_hash, start), a, b in held.repeats():
                yield doc_id, text_hash, start + a, start + b, None, None
            if split:
                for (doc_id, text_hash, start), k, w1, w2 in held.firsts():
                    yield doc_id, text_hash, start + k, start + k + 1, w1, w2

        held = Shard(window)
        for (_, salt), group in groupby(read, key=lambda r: r[:2]):
            own, split, last = [], salt >= 0, None
            for r in group:
                place = r[2:5]
                if place == last:  # a row that repeats doc_id and text is the same document
                    continue
                last = place
                if len(own) >= piece:
                    split = True
                    yield from told(Shard(window, own), True)
                    own = []
                own.append((place, r[5]))
            if split:
                yield from told(Shard(window, own), True)
            else:
                held.add(own)
                if len(held.held) >= shard:
                    yield from told(held, False)
                    held = Shard(window)
        yield from told(held, False)

    found = cut(map_rows(dealt, rows, _FOUND))
    # Of the first windows of the pieces all but the first stand later: at most one row a piece and window meets here.
    place = W.partitionBy("w1", "w2").orderBy(F.col("doc_id").asc_nulls_first(), "text_hash", "start")
    later = found.where("w1 is not null").withColumn("at", F.row_number().over(place)).where("at > 1")
    return found.where("w1 is null").select("doc_id", "text_hash", "start", "stop").unionByName(later.select("doc_id", "text_hash", "start", "stop"))


def drop_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, piece: int = PIECE) -> DataFrame:
    """``docs`` with kept (the words that stay, joined by single spaces), n_words and n_removed.

    A word goes if a run of ``window`` words around it also starts earlier: in a document of smaller doc_id (null
    before all), or earlier in the same one. Rows of equal doc_id stand in the order of a hash of their text; rows with equal
    doc_id and text are one document given repeatedly and get equal results. A null text has no words and keeps an
    empty text. An empty table gives an empty result. All columns stay; those named kept, n_words and n_removed are replaced.

    A document is read for its anchors, for its stretches whose anchor repeats, and for what is left of it. Only those
    stretches, and the texts of documents that may lose words, are shuffled.
    """
    own, new = renamed(docs.drop("kept", "n_words", "n_removed"))
    slim = own.select(F.col(new["doc_id"]).cast("long").alias("doc_id"), F.coalesce(F.col(new["text"]).cast("string"), F.lit("")).alias("text"))
    found = locate(stretches(slim, repeated_anchors(slim, window, gram), window, gram, piece), window, piece)
    gone = cut(found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "stop")).alias("gone")))
    text = F.coalesce(F.col(new["text"]).cast("string"), F.lit(""))
    told = marked(own.withColumns({"_text": text, "_hash": F.xxhash64(text)}), "_hash", gone.select("text_hash").distinct())
    some = told.where("_maybe").join(gone, F.col(new["doc_id"]).cast("long").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")), "left")
    columns = [*new.values(), "_text", "gone"]
    rest = told.where("not _maybe").withColumn("gone", F.lit(None).cast(gone.schema["gone"].dataType))
    whole = some.select(columns).unionByName(rest.select(columns))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lost = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            kept, n_words, n_removed = [], [], []
            for text, runs in zip(texts, lost, strict=True):
                words = words_of(text)
                n_words.append(len(words))
                if runs:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, [r["start"] for r in runs], 1)
                    np.add.at(change, [r["stop"] + window - 1 for r in runs], -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*batch.schema.names[:-2], "kept", "n_words", "n_removed"])

    schema = T.StructType([f for f in own.schema.fields] + from_arrow_schema(pa.schema([("kept", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])).fields)
    return whole.mapInArrow(clean, schema).toDF(*new, "kept", "n_words", "n_removed")


#: The same in DuckDB's SQL, with each window as a string, put together from shorter runs of words by doubling.
SQL = rf"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
r1 AS (SELECT doc_id, unnest(w) AS s1, unnest(range(1, len(w) + 1)) AS i FROM texts),
r2 AS (SELECT *, s1 || ' ' || lead(s1) OVER (PARTITION BY doc_id ORDER BY i) AS s2 FROM r1),
r4 AS (SELECT *, s2 || ' ' || lead(s2, 2) OVER (PARTITION BY doc_id ORDER BY i) AS s4 FROM r2),
r8 AS (SELECT *, s4 || ' ' || lead(s4, 4) OVER (PARTITION BY doc_id ORDER BY i) AS s8 FROM r4),
r16 AS (SELECT *, s8 || ' ' || lead(s8, 8) OVER (PARTITION BY doc_id ORDER BY i) AS s16 FROM r8),
r20 AS (SELECT doc_id, s1, i, s16 || ' ' || lead(s4, 16) OVER (PARTITION BY doc_id ORDER BY i) AS passage FROM r16),
nth AS (SELECT doc_id, s1, i, passage IS NOT NULL AND row_number() OVER (PARTITION BY passage ORDER BY doc_id, i) > 1 AS again FROM r20),
told AS (
  SELECT doc_id, s1, i, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM nth)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(count(*) FILTER (t.gone) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(t.s1, ' ' ORDER BY t.i) FILTER (NOT t.gone), '')) AS kept_sha256
FROM texts d LEFT JOIN told t ON t.doc_id = d.doc_id GROUP BY d.doc_id, len(d.w)
"""
