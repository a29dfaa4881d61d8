"""N-gram Jaccard join: MinHash LSH forest for candidates, exact verification in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import from_arrow_schema

from saltmarsh.llm.common import WORDS, WordHashes, cut, map_rows, mix64, renamed, windows
from saltmarsh.llm.components import components
from saltmarsh.llm.line_dedup import marked

WIDTH, THRESHOLD = 5, 0.8
#: Tries of the forest, the length of a full signature in each, and the recall at the threshold that ends the shortening.
TREES, LONGEST_PREFIX, RECALL = 32, 10, 0.9999
#: MinHash values of each trie (its last ones) that estimate how alike two sets are, and the share of equal ones, far below any
#: that a pair at the threshold has by chance (more than four standard deviations), under which a tie is dropped.
SKETCHED, LEAST_ALIKE = 2, 0.58
#: Texts of a block, and shingles of a block for each of them, in the mean; two blocks are compared at a time.
BLOCK, SHINGLES = 256, 1024

_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("set_id", pa.binary()), ("size", pa.int32()), ("signature", pa.binary())])
_WALKED = pa.schema([("part", pa.int32()), ("tree", pa.int32()), ("label", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])
_LINKED = pa.schema([("set_id", pa.binary()), ("root", pa.binary()), ("links", pa.int64())])


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, longest: int = LONGEST_PREFIX, recall: float = RECALL) -> int:
    """How far matched prefixes are shortened: to the longest with which a pair at the threshold is found with the target recall."""
    for length in range(longest, 0, -1):
        if 1 - (1 - threshold**length) ** trees >= recall:
            return length
    return 1


class Shingles:
    """The distinct runs of WIDTH words of a text, as sorted hashes; all words as one run if there are fewer."""

    def __init__(self, width: int = WIDTH):
        self.width, self.hashes = width, WordHashes()

    def of(self, text: str | None) -> np.ndarray:
        words = self.hashes.of(WORDS(text or ""))
        return np.unique(windows(words, min(self.width, len(words)))) if len(words) else words


def set_id(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


class Forest:
    """MinHash signatures of shingle sets: ``longest`` values for each trie, each cut to a byte."""

    def __init__(self, trees: int, longest: int):
        draws = np.random.default_rng(20240229).integers(0, 2**63, (2, trees * longest), np.int64).astype(np.uint64)
        self.times, self.plus = draws[0] * np.uint64(2) + np.uint64(1), draws[1]

    def signature(self, shingles: np.ndarray) -> bytes:
        least = np.full(len(self.times), np.iinfo(np.uint64).max)
        for k in range(0, len(shingles), 512):
            np.minimum(least, (shingles[k : k + 512, None] * self.times + self.plus).min(0), out=least)
        return (mix64(least) >> np.uint64(56)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, width: int, trees: int, longest: int) -> DataFrame:
    """doc_id, a hash of the text, and of its shingle set the id, size and signature (null without words)."""

    def rows(texts: Iterator[tuple]) -> Iterator[tuple]:
        shingles, forest = Shingles(width), Forest(trees, longest)
        for doc_id, text, text_hash in texts:
            found = shingles.of(text)
            yield doc_id, text_hash, set_id(found), len(found), forest.signature(found) if len(found) else None

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("h")), rows, _SIGNED)


def common_prefix(above: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """How many leading bytes each row of ``labels`` has in common with that of ``above``."""
    return np.minimum.accumulate(above == labels, axis=1).sum(1)


def tied(sets: DataFrame, trees: int, longest: int, least: int) -> DataFrame:
    """Distinct ties (a, b) of ``sets`` (node, signature) that share a prefix of ``least`` values or more in some trie.

    A trie is its labels in sorted order: the labels of all tries are range-partitioned and sorted, so that
    many equal labels are dealt to several tasks, and each node of a trie is a run of rows. Prefixes start at
    full length, where a row is tied to the one before it if all values agree, and are shortened: a row is tied
    to the row before it if they share ``least`` values, to the first row of the deepest node that it shares
    with others and to that of the node at ``least``. So ties are linear in rows, and what shares a prefix is connected.
    """
    labels = sets.select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    labels = labels.select("tree", F.substring("signature", F.col("tree") * longest + 1, F.lit(longest)).alias("label"), "node")
    ordered = labels.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, heads = TaskContext.get().partitionId(), None, {}

        def end(tree: int, label: bytes, node: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, tree, label, node, None), _WALKED.types, strict=True)], schema=_WALKED)

        for batch in batches:
            if not len(batch):
                continue
            tree, node = batch["tree"].to_numpy(), batch["node"].to_numpy()
            label = np.frombuffer(b"".join(batch["label"].to_pylist()), np.uint8).reshape(len(batch), longest)
            if last is None:
                yield end(int(tree[0]), label[0].tobytes(), int(node[0]))
                last = (-1, label[0], node[0])
            above = np.concatenate([last[1][None], label[:-1]])
            shared = np.where(np.concatenate([[last[0]], tree[:-1]]) == tree, common_prefix(above, label), 0)
            before = np.concatenate([[last[2]], node[:-1]])
            pairs = [(node[shared >= least], before[shared >= least])]
            first = {}
            for depth in range(least, longest + 1):
                start = np.maximum.accumulate(np.where(shared < depth, np.arange(len(node)), -1))
                first[depth] = np.where(start >= 0, node[start], heads.get(depth, node[0]))
                heads[depth] = first[depth][-1]
            deepest = np.select([first[d] != node for d in range(longest, least, -1)], [first[d] for d in range(longest, least, -1)], node)
            pairs += [(node[x != node], x[x != node]) for x in (first[least], deepest)]
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            if len(a):
                none = [pa.nulls(len(a), t) for t in _WALKED.types[:3]]
                yield pa.RecordBatch.from_arrays([*none, pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], schema=_WALKED)
            last = (int(tree[-1]), label[-1], node[-1])
        if last is not None:
            yield end(last[0], last[1].tobytes(), int(last[2]))

    walked = cut(ordered.mapInArrow(walk, from_arrow_schema(_WALKED)).distinct())
    # Two rows for each task: its first and its last label. Neighbours across the border of two tasks are tied here.
    ends = sorted((r["part"], r["tree"], bytes(r["label"]), r["a"]) for r in walked.where("part is not null").collect())
    across = [Row(a=max(x[3], y[3]), b=min(x[3], y[3])) for x, y in zip(ends, ends[1:], strict=False) if x[0] < y[0] and x[1] == y[1] and x[2][:least] == y[2][:least] and x[3] != y[3]]
    return walked.where("part is null").select("a", "b").unionByName(sets.sparkSession.createDataFrame(across, "a long, b long")).distinct()


def alike(ties: DataFrame, sets: DataFrame, trees: int, longest: int, least: float) -> DataFrame:
    """Those of ``ties`` whose sets agree in a share of ``least`` of the last SKETCHED values of each trie."""
    sketch = F.concat(*(F.substring("signature", k * longest + longest - SKETCHED + 1, SKETCHED) for k in range(trees)))
    sketches = cut(sets.select("node", sketch.alias("sketch")))
    side = lambda key: sketches.select(F.col("node").alias(key), F.col("sketch").alias(f"of_{key}"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(len(batch), -1) for c in ("of_a", "of_b"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(1) >= least))

    return ties.join(side("a"), "a").join(side("b"), "b").select("a", "b", "of_a", "of_b").mapInArrow(keep, "a long, b long")


def linked(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, across: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Exact verification of one task's sets: for each, how many documents it is linked to here, and the least set in its group.

    With ``across`` only pairs of different ``side`` (0 or 1) count. Overlaps come from products of 0/1
    matrices, over the shingles that two or more sets hold, a slice of them at a time.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = often[column] > 1
    place = np.cumsum(often > 1) - 1
    row, column = row[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    overlap = np.zeros((n, n), np.float32)
    last = int(column[-1]) + 1 if len(column) else 0
    for k in range(0, last, 4096):
        i, j = np.searchsorted(column, [k, k + 4096])
        part = np.zeros((n, min(4096, last - k)), np.float32)
        part[row[i:j], column[i:j] - k] = 1
        overlap += part @ part.T
    links = overlap >= threshold * (sizes[:, None] + sizes[None, :] - overlap) - 1e-6
    np.fill_diagonal(links, False)
    if across:
        links &= side[:, None] != side[None, :]
    root = np.arange(n)
    while True:
        least = np.minimum(root, np.where(links, root[None, :], n).min(1))
        if (least == root).all():
            return links @ copies, root
        root = least


def _compared(members: DataFrame, width: int, threshold: float) -> DataFrame:
    """Links among the texts of each task (component, i, j): i and j are blocks of the component."""

    def rows(texts: Iterator[tuple]) -> Iterator[tuple]:
        shingles = Shingles(width)
        for (_, i, j), group in groupby(texts, key=lambda r: r[:3]):
            held: dict[bytes, tuple[np.ndarray, int, int]] = {}
            for *_, block, key, copies, text in group:
                found = shingles.of(text)
                if set_id(found) == key:  # not so for another row of the same doc_id
                    held[bytes(key)] = found, copies, int(block == j and i != j)
            ids = sorted(held)
            if len(ids) < 2:
                continue
            sets, copies, side = zip(*map(held.__getitem__, ids), strict=True)
            links, root = linked(list(sets), np.array(copies, np.int64), np.array(side), i != j, threshold)
            for k in np.flatnonzero(links):
                yield ids[k], ids[root[k]], int(links[k])

    keys = ["component", "i", "j"]
    return map_rows(members.select(*keys, "block", "set_id", "copies", "text").repartition(*keys).sortWithinPartitions(*keys), rows, _LINKED)


def classes(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, trees: int = TREES, longest: int = LONGEST_PREFIX, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Near-duplicate classes of documents whose word shingles have a Jaccard similarity of ``threshold`` or more.

    Returns for each row of ``docs`` doc_id, text_hash, class_id (the least doc_id of the class; a class
    is a connected group of links), class_hash (text_hash of the row that stands for the class) and
    n_links (other documents that it is linked to, copies included). Documents without a word (also
    null texts) are linked to none. Rows with equal doc_id are documents of their own; a null doc_id
    sorts last. An empty table gives an empty result. Other columns of ``docs`` are not used.

    Documents with equal shingle sets count as one set with copies. Sets that share a prefix in some
    trie (``tied``) and are not surely unlike (``alike``) make candidate components without listing pairs. All pairs
    of a component that can reach the threshold are verified exactly: its sets are cut into blocks by size, each class
    of sizes reaching from one to the next power of 1 / ``threshold``, and by a hash where these are large. Two blocks
    meet in a task of their own if their classes are the same or neighbours, as sets further apart in size
    cannot be near, so that a task holds two blocks, and gives a row for each set and not for each link.
    """
    signed = cut(signatures(docs, width, trees, longest))
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    sets = cut(signed.where("set_id is not null").groupBy("set_id").agg(F.count("*").alias("copies"), F.min(own).alias("first"), F.first("size").alias("size"), F.first("signature").alias("signature")).withColumn("node", F.xxhash64("set_id")))
    ties = tied(sets, trees, longest, prefix_length(threshold, trees, longest, recall))
    candidates = components(alike(ties, sets, trees, longest, LEAST_ALIKE * threshold / THRESHOLD))
    members = candidates.unionByName(candidates.select(F.col("root").alias("node"), "root").distinct())
    key = lambda doc_id, text_hash: F.xxhash64(doc_id, F.lit(0), text_hash)
    level = F.floor(F.log(F.col("size").cast("double")) / math.log(1 / threshold) + 1e-9).cast("long")
    found = cut(members.join(sets, "node").select(F.col("root").alias("component"), "set_id", "copies", "size", level.alias("level"), key("first.doc_id", "first.text_hash").alias("at")))
    by_level = W.partitionBy("component").orderBy("level")
    near = lambda f: F.when(F.abs(f("level").over(by_level) - F.col("level")) == 1, f("blocks").over(by_level)).otherwise(0)
    blocks = found.groupBy("component", "level").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("size") / (block * SHINGLES))).cast("long").alias("blocks"))
    blocks = blocks.select("component", "level", "blocks", near(F.lag).alias("below"), near(F.lead).alias("above"))
    code = lambda step, sub: (F.col("level") + step) * 2**32 + sub

    def at_level(step: int, n: str) -> Column:
        """Codes of all blocks of the level ``step`` away, of which there are ``n``."""
        return F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), lambda k: code(step, k))).otherwise(F.array().cast("array<long>"))

    others = F.concat(at_level(-1, "below"), at_level(0, "blocks"), at_level(1, "above"))
    placed = found.join(blocks, ["component", "level"]).withColumn("block", code(0, F.pmod(F.xxhash64("set_id", F.lit(7)), F.col("blocks")))).withColumn("others", others)
    slim = docs.select(F.xxhash64("text").alias("h"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = marked(slim.select(key("doc_id", "h").alias("at"), "text"), "at", found.select("at")).where("_maybe").select("at", "text").dropDuplicates(["at"])
    dealt = placed.join(texts, "at").withColumn("other", F.explode("others")).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    links = cut(_compared(dealt, width, threshold))
    groups = components(links.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("set_id").agg(F.sum("links").alias("n_links"))
    rooted = sets.select("set_id", "copies", "first").join(groups.withColumnRenamed("node", "set_id"), "set_id", "left").join(counts, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    head = rooted.groupBy("root").agg(F.min("first").alias("head"))
    judged = rooted.join(head, "root").select("set_id", F.col("head.doc_id").alias("class_id"), F.col("head.text_hash").alias("class_hash"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select("doc_id", "text_hash", "set_id").join(judged, "set_id", "left").select(
        "doc_id", "text_hash",
        F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_hash", "text_hash").alias("class_hash"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def keep_one(docs: DataFrame, **how: float) -> DataFrame:
    """``docs`` with one document of each class: the one with the least doc_id. Documents without a word stay, and all columns, whatever their names."""
    kept = classes(docs, **how).where((F.col("doc_id").eqNullSafe(F.col("class_id"))) & (F.col("text_hash") == F.col("class_hash"))).select("doc_id", "text_hash")
    rows, new = renamed(docs)
    doc_id, text = F.col(new["doc_id"]).cast("long"), F.col(new["text"]).cast("string")
    rows = rows.withColumns({"_own": F.xxhash64(text), "_word": F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))})
    once = rows.where("_word").join(kept, doc_id.eqNullSafe(F.col("doc_id")) & (F.col("_own") == F.col("text_hash")), "left_semi").dropDuplicates([new["doc_id"], "_own"])
    return once.unionByName(rows.where("not _word")).select(*new.values()).toDF(*docs.columns)
