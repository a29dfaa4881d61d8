"""Packing token sequences: non-negative least squares over shallow length combinations."""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from saltmarsh.llm.common import WORDS, cut, map_rows

WINDOW = 2048
END_ID = 1
#: Bytes of tokenised words that a Python worker remembers, over all tasks that it runs, and what an entry takes beside its characters and ids.
MOST_BYTES, ENTRY_BYTES = 96 * 2**20, 190

#: Words that are encoded at a time, so that what the library holds for them stays small.
ENCODED = 10_000

CONTROLS = re.compile("[\x1c-\x1f]").search

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])
_PLACED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def latin(text: str) -> bool:
    """Whether all characters are below U+0100, which is quicker to tell than what a pattern finds."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Memory(dict):
    """Chunk to ids. What is not here moves up from the ``older`` memory, or is noted as ``unknown`` and None."""

    def __init__(self, older: dict):
        super().__init__()
        self.older, self.unknown, self.bytes = older, set(), 0

    def __missing__(self, chunk: str) -> bytes | None:
        ids = self.older.pop(chunk, None)
        if ids is None:
            self.unknown.add(chunk)
        else:
            self.put([(chunk, ids)])
        return ids

    def put(self, entries: list[tuple[str, bytes]]) -> None:
        self.update(entries)
        self.bytes += sum(ENTRY_BYTES + len(chunk) + len(ids) for chunk, ids in entries)


class Words:
    """White-space-free chunk of text to its token ids as little-endian unsigned 32-bit integers.

    The vocabulary's normaliser and pre-tokenizer work within such chunks, so a text's ids are those
    of its chunks one after another. Chunks are in lower case, and new ones are cut by the vocabulary's own
    pre-tokenizer pattern, so that each run of letters is merged once, however many chunks hold it.
    Two memories hold ``most`` bytes together, give or take what one call of ``ids`` brings: when the newer is half
    of that it becomes the older, and the older, with what was not asked for since, is forgotten.
    """

    #: The pre-tokenizer's pattern, as the vocabulary file states it.
    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
    #: Characters from where lower case may depend on the library or characters may compose, and what starts a special token.
    ODD = re.compile("[\u0180-\U0010ffff]|<\\|").search
    #: A full stop or comma that may belong to the signs before it.
    JOINED = re.compile("[\x00-\x08\x0e-\x1f!-/:-@\\[-`{-\u00bf\u00d7\u00f7\u0180-\U0010ffff][.,]\\s").search

    def __init__(self, path: str, most: int = MOST_BYTES):
        from tokenizers import Tokenizer

        self.most, self.memory = most, Memory({})
        tokenizer = Tokenizer.from_file(path)
        self.encode = tokenizer.encode_batch_fast
        ends = [i for word, i in tokenizer.get_vocab().items() if word.endswith("</w>")]
        self.ends = np.zeros(max(ends) + 1, bool)
        self.ends[ends] = True

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text, those without an odd character in lower case; stops and commas that end a word stand alone."""
        # str.split also parts at four control characters that the vocabulary does not take for white space.
        split = WORDS if CONTROLS(text) else str.split
        if (not latin(text) or "<|" in text) and self.ODD(text):
            return [c if self.ODD(c) else c.lower() for c in split(text)]
        text = text.lower()
        if not self.JOINED(text):
            for sign in ".,":
                text = text.replace(f"{sign} ", f" {sign} ").replace(f"{sign}\n", f" {sign}\n")
        return split(text)

    def learn(self, chunks: set[str]) -> None:
        """Take in chunks that are not known yet, all at once."""
        odd = [*filter(self.ODD, chunks)] if self.ODD(" ".join(chunks)) else []
        plain = chunks.difference(odd)
        letters = set(filter(str.isalpha, plain))
        cuts = [(c, self.PARTS(c)) for c in plain.difference(letters)]
        fresh = [p for p in letters.union(*(parts for _, parts in cuts)) if self.memory[p] is None]
        self.memory.unknown.clear()
        for k in range(0, len(fresh), ENCODED):
            new = fresh[k : k + ENCODED]
            # Encoded as one text; the last id of each part, and no other, is one that ends a word.
            ids = np.array(self.encode([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
            data, stops = ids.tobytes(), (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            self.memory.put([(p, data[i:j]) for p, i, j in zip(new, [0, *stops[:-1]], stops, strict=True)])
        self.memory.put([(c, b"".join(map(self.memory.__getitem__, parts))) for c, parts in cuts])
        self.memory.put([(c, struct.pack(f"<{len(e.ids)}I", *e.ids)) for c, e in zip(odd, self.encode(odd, add_special_tokens=False), strict=True)])

    def ids(self, held: list[list[str]]) -> Iterator[bytes]:
        """Token ids of texts that are given by their chunks."""
        if self.memory.bytes > self.most // 2:
            self.memory.older = {}
            self.memory = Memory(self.memory)
        memory = self.memory
        found = [[*map(memory.__getitem__, chunks)] for chunks in held]
        self.learn(set(memory.unknown))
        for chunks, ids in zip(held, found, strict=True):
            yield b"".join([memory[c] if i is None else i for c, i in zip(chunks, ids, strict=True)] if None in ids else ids)


@lru_cache(maxsize=1)
def words_of(path: str) -> Words:
    """The memory of a Python worker, which Spark gives one task after another."""
    return Words(path)


def ids_of(texts: Iterator[str], path: str, block: int = 500_000) -> Iterator[bytes]:
    """Token ids of each text, about ``block`` characters of texts at a time."""
    words = words_of(path)
    held, size = [], 0
    for text in texts:
        held.append(words.chunks(text))
        size += len(text)
        if size >= block:
            yield from words.ids(held)
            held, size = [], 0
    yield from words.ids(held)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(Path(public_tokenizers.path(name)))


def cut_pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Tokenise each text (null: empty), add the end id, and cut it into full windows and one rest.

    Returns doc_id, start, length, ids_crc32, doc_tokens and, to number the pieces of each length,
    the task's number (part) and the piece's number among those of its length in the task (nth).
    """
    path = path or tokenizer_path()
    end = struct.pack("<I", END_ID)

    def rows(texts: Iterator[tuple]) -> Iterator[tuple]:
        part, seen, doc_ids = TaskContext.get().partitionId(), Counter(), deque()

        def read() -> Iterator[str]:
            for doc_id, text in texts:
                doc_ids.append(doc_id)
                yield text or ""

        for ids in ids_of(read(), path):
            doc_id, ids = doc_ids.popleft(), ids + end
            total = len(ids) // 4
            for start in range(0, total, window):
                piece = ids[4 * start : 4 * (start + window)]
                length = len(piece) // 4
                yield doc_id, start, length, zlib.crc32(piece), total, part, seen[length]
                seen[length] += 1

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, _PIECES)


def fill_counts(histogram: np.ndarray, window: int = WINDOW, rounds: int = 200) -> list[tuple[tuple[int, ...], int]]:
    """How often to use which combination of lengths; ``histogram[n]`` is the number of pieces of length n.

    Candidate combinations are shallow: all pairs that fill the window, and for each length two of its
    kind with what completes them, its half split, and a spread of triples. Non-negative least squares
    (projected gradient on the normal equations, as the matrix is sparse) gives how often each is
    wanted to use up the histogram; those numbers are rounded down and held to what there is. What is
    left is packed greedily, longest first, each time with the longest length that still fits, taking
    as many of the same combination at once as there are. The work depends on the number of lengths,
    not on that of documents.
    """
    left = histogram.astype(np.int64).copy()
    there = np.flatnonzero(left[:window])
    out: list[tuple[tuple[int, ...], int]] = [((window,), int(left[window]))] if left[window] else []
    left[window] = 0
    present = left > 0
    combos: set[tuple[int, ...]] = set()
    for a in there:
        if present[b := window - a]:
            combos.add(tuple(sorted((int(a), int(b)), reverse=True)))
        for b in {int(a), (window - int(a)) // 2, *map(int, there[:: max(1, len(there) // 24)])}:
            c = window - a - b
            if b > 0 and c > 0 and present[b] and present[c]:
                combos.add(tuple(sorted((int(a), int(b), int(c)), reverse=True)))
    wanted = sorted(combos)
    if wanted:
        column = np.repeat(np.arange(len(wanted)), [len(c) for c in wanted])
        row = np.concatenate([np.array(c) for c in wanted])
        goal, x = left.astype(float), np.zeros(len(wanted))
        times = lambda v: np.bincount(row, v[column], window + 1)
        back = lambda v: np.bincount(column, v[row], len(wanted))
        # A bound on the largest eigenvalue of the normal matrix: its largest row sum.
        step = 1 / back(times(np.ones(len(wanted)))).max()
        y, momentum = x, 1.0
        for _ in range(rounds):
            new = np.maximum(0, y + step * back(goal - times(y)))
            following = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
            y, x, momentum = new + (momentum - 1) / following * (new - x), new, following
        for k in np.argsort(-x, kind="stable"):
            combo = wanted[k]
            n = min(int(x[k]), *(int(left[v]) // combo.count(v) for v in combo))
            if n > 0:
                np.subtract.at(left, list(combo), n)
                out.append((combo, n))
    while left[:window].any():
        combo, room, free = [], window, left.copy()
        while room and len(fits := np.flatnonzero(free[1 : room + 1])):
            length = int(fits[-1]) + 1
            combo.append(length)
            free[length] -= 1
            room -= length
        n = min(int(left[v]) // combo.count(v) for v in combo)
        np.subtract.at(left, combo, n)
        out.append((tuple(combo), n))
    return out


class Slots:
    """Where the k-th piece of a length goes, from the list of combinations and their counts."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]):
        runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        first = 0
        for combo, n in plan:
            offset = 0
            for length in combo:
                runs[length].append((n, first, offset))
                offset += length
            first += n
        self.of = {v: (np.cumsum([0, *(r[0] for r in rs)]), [r[1] for r in rs], [r[2] for r in rs]) for v, rs in runs.items()}

    def place(self, length: int, rank: int) -> tuple[int, int]:
        ends, first, offset = self.of[length]
        k = int(np.searchsorted(ends, rank, "right")) - 1
        return first[k] + rank - int(ends[k]), offset[k]


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens.

    A null text is empty and has the end id alone; texts longer than a window are cut into full windows
    and a rest; rows with equal doc_id are packed each on its own. An empty table gives an empty
    result. Returns per piece doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    Only the histogram of piece lengths (at most ``window`` numbers) comes to the driver. Pieces of a
    length are numbered by the count of that length in earlier tasks plus their number in their own
    task, so no length is gathered in one task; a number then names a slot of the plan, which is
    shipped to the tasks and whose size depends on ``window`` alone.
    """
    pieces = cut(cut_pieces(docs, path, window))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(window + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        histogram[row["length"]] = row["count"]
    slots = pieces.sparkSession.sparkContext.broadcast(Slots(fill_counts(histogram, window)))
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("rank"))

    def rows(ranked_rows: Iterator[tuple]) -> Iterator[tuple]:
        place = slots.value.place
        for doc_id, start, length, crc, total, rank in ranked_rows:
            yield doc_id, start, length, crc, total, *place(length, rank)

    return map_rows(ranked, rows, _PLACED)
