"""Centroid clustering in exact integers: matrix products guarded by their magnitude, sums combined by treeAggregate."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from saltmarsh.llm.common import cut

#: Components of a vector, by what they are multiplied, clusters, rounds, and the number before a vec_id in the hash that picks the first centroids.
DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Vectors in one matrix product.
BLOCK = 4096
#: Magnitudes below which integers are exact as doubles, and below which they fit in a long.
EXACT_DOUBLE, EXACT_LONG = 2**53, 2**63

_BLOCKS = pa.schema([("ids", pa.binary()), ("no_id", pa.binary()), ("kind", pa.string()), ("vectors", pa.binary())])
_ASSIGNED = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("cluster_inertia", pa.int64()), ("inertia", pa.int64()), ("centroid_sha256", pa.string())])


def scaled(column: pa.ListArray, dimensions: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors with ``dimensions`` components, all finite, and their components times ``scale``, floored: doubles, or Python integers if too large for exact doubles."""
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dimensions), False).to_numpy(zero_copy_only=False))
    x = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimensions)  # a null turns into NaN
    good = np.isfinite(x).all(axis=1)
    at, x = at[good], x[good]
    if np.abs(x).max(initial=0) < EXACT_DOUBLE:
        return at, np.floor(x * scale)
    whole = [[int(v) * scale if abs(v) >= EXACT_DOUBLE else int(np.floor(v * scale)) for v in row] for row in x.tolist()]
    return at, np.array(whole, object).reshape(-1, dimensions)


def blocks_of(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """The vectors that count, many to a row, in the smallest of three forms: 16-bit or 64-bit integers, or decimal text for larger ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = scaled(batch.column(1), dimensions, scale)
            ids = batch.column(0).take(pa.array(at))
            no_id, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            size = np.abs(x).max(axis=1, initial=0)
            kinds = np.where(size < 2**15, 0, np.where(size < 2**62, 1, 2))
            rows = []
            for k, kind in enumerate(("<i2", "<i8", "text")):
                own = np.flatnonzero(kinds == k)
                if len(own):
                    held = x[own]
                    data = ";".join(",".join(str(int(v)) for v in row) for row in held).encode() if kind == "text" else held.astype(np.int64).astype(kind).tobytes()
                    rows.append((ids[own].astype("<i8").tobytes(), np.packbits(no_id[own]).tobytes(), kind, data))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _BLOCKS.types, strict=True)], schema=_BLOCKS)

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, from_arrow_schema(_BLOCKS))


def opened(block: tuple, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, whether they are null, and vectors (long or Python integers) of a row of ``blocks_of``."""
    ids = np.frombuffer(block[0], "<i8")
    no_id = np.unpackbits(np.frombuffer(block[1], np.uint8), count=len(ids)).astype(bool)
    if block[2] == "text":
        return ids, no_id, np.array([[int(v) for v in row.split(",")] for row in bytes(block[3]).decode().split(";")], object).reshape(-1, dimensions)
    return ids, no_id, np.frombuffer(block[3], block[2]).reshape(-1, dimensions).astype(np.int64)


def nearest(x: np.ndarray, centroids: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector by squared distance (the least number among ties), and that distance, both exact.

    Every sum within |x|^2 - 2 x.c + |c|^2 is an integer of at most (|x| + |c|)^2. Below 2^53 a matrix product of
    doubles is exact whatever the order of its sums; larger ones are taken in longs, and beyond 2^63 in Python's integers.
    """
    c = np.array(centroids, object).reshape(len(centroids), -1)
    most = len(c[0]) * (max(int(x.max()), -int(x.min())) + max(map(abs, c.flat))) ** 2
    kind = np.float64 if most < EXACT_DOUBLE else np.int64 if most < EXACT_LONG else object
    c, cluster, distance = c.astype(kind), [], []
    for k in range(0, len(x), BLOCK):
        part = x[k : k + BLOCK].astype(kind)
        if kind is np.float64:
            squares = np.einsum("ij,ij->i", part, part)[:, None] - 2 * (part @ c.T) + np.einsum("ij,ij->i", c, c)
        else:
            squares = np.stack([((part - own) ** 2).sum(axis=1) for own in c], axis=1)
        best = squares.argmin(axis=1)
        cluster.append(best)
        distance.append(squares[np.arange(len(best)), best].astype(object if kind is object else np.int64))
    return np.concatenate(cluster), np.concatenate(distance)


def total(x: np.ndarray) -> np.ndarray:
    """Sum over the first axis in Python's integers, in longs first where they cannot overflow."""
    if x.dtype != object and len(x) and len(x) * max(int(x.max()), -int(x.min())) < EXACT_LONG:
        return np.asarray(x.sum(axis=0, dtype=np.int64)).astype(object)
    return np.asarray(x.astype(object).sum(axis=0), object)


def sums(rdd: RDD, centroids: list[tuple[int, ...]], dimensions: int, of_distance: bool = False) -> tuple[list[int], np.ndarray]:
    """Vectors of each cluster and their sums by component (``of_distance``: of their distance), combined in a tree."""
    clusters = len(centroids)
    zero = ([0] * clusters, np.zeros((clusters, 1 if of_distance else dimensions), object))

    def add(state: tuple, block: tuple) -> tuple:
        x = opened(block, dimensions)[2]
        cluster, distance = nearest(x, centroids)
        values = distance[:, None] if of_distance else x
        counts = np.bincount(cluster, minlength=clusters).tolist()
        return [a + b for a, b in zip(state[0], counts, strict=True)], state[1] + np.stack([total(values[cluster == j]) for j in range(clusters)])

    return rdd.treeAggregate(zero, add, lambda a, b: ([m + n for m, n in zip(a[0], b[0], strict=True)], a[1] + b[1]))


def first_centroids(rdd: RDD, dimensions: int, clusters: int, seed: int) -> list[tuple[int, ...]]:
    """The vectors whose ids have the least hashes; equal ids are ordered by their vectors."""

    def add(state: list, block: tuple) -> list:
        ids, no_id, x = opened(block, dimensions)
        hashes = [hashlib.sha256(f"{seed}:{'' if none else i}".encode()).hexdigest() for i, none in zip(ids.tolist(), no_id.tolist(), strict=True)]
        last = heapq.nsmallest(clusters, hashes)[-1]
        return heapq.nsmallest(clusters, state + [(h, tuple(map(int, x[k]))) for k, h in enumerate(hashes) if h <= last])

    return [v for _, v in rdd.treeAggregate([], add, lambda a, b: heapq.nsmallest(clusters, a + b))]


def in_long(value: int) -> int | None:
    return value if value < EXACT_LONG else None


def cluster(vectors: DataFrame, dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """Nearest of ``clusters`` centroids of each vector after ``rounds`` rounds, in exact integers.

    ``vectors`` has vec_id and embedding (an array of numbers); other columns are not used. A vector counts
    if it has ``dimensions`` components, none null, NaN or infinite; others have no row in the result. Components
    are scaled and floored. The first centroids are the vectors whose ``seed:vec_id`` has the least sha256 (a null
    vec_id is empty text; vectors of equal vec_id are ordered by their components); with fewer vectors than
    ``clusters`` there are as many centroids as vectors. Rows that repeat count as often as they stand there. A
    tie goes to the smaller number, an empty cluster keeps its centroid. Distances or sums that do not fit in a long
    are null. An empty table gives an empty result.

    The vectors are packed once and written to the checkpoint folder (16-bit integers for usual ones), and each
    round reads that. What a task hands on is ``clusters`` counts and sums, whatever its rows.
    """
    blocks = cut(blocks_of(vectors, dimensions, scale))
    rdd = blocks.rdd.map(tuple)
    centroids = first_centroids(rdd, dimensions, clusters, seed)
    for _ in range(rounds if centroids else 0):
        counts, added = sums(rdd, centroids, dimensions)
        centroids = [tuple(int(v) // n for v in row) if n else old for n, row, old in zip(counts, added, centroids, strict=True)]
    own = [int(v) for v in sums(rdd, centroids, dimensions, of_distance=True)[1][:, 0]] if centroids else []
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertia, whole = [in_long(v) for v in own], in_long(sum(own))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, no_id, x = opened(block, dimensions)
                found, distance = nearest(x, centroids)
                told = pa.array([in_long(d) for d in distance], pa.int64()) if distance.dtype == object else pa.array(distance)
                columns = [pa.array(ids, pa.int64(), mask=no_id), pa.array(found.astype(np.int32)), told]
                columns += [pa.array(values, t).take(pa.array(found)) for values, t in ((inertia, pa.int64()), ([whole] * len(own), pa.int64()), (digests, pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, schema=_ASSIGNED)

    return blocks.mapInArrow(assign, from_arrow_schema(_ASSIGNED))


def _sql() -> str:
    """The same in DuckDB's SQL, one pair of common tables a round; exact while all sums are below 2^53."""
    square = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < {CLUSTERS})"""
    ]
    for r in range(ROUNDS + 1):
        steps.append(
            f"""d{r} AS MATERIALIZED (SELECT k.vec_id, k.v, c.c, CAST({square} AS BIGINT) AS distance FROM kept k, c{r} c),
a{r} AS MATERIALIZED (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, c) = 1)"""
        )
        if r < ROUNDS:
            steps.append(
                f"""m{r} AS (SELECT c, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS x FROM a{r}, (SELECT unnest(range(1, {DIMENSIONS + 1})) AS i) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT c, list(x ORDER BY i) AS v FROM m{r} GROUP BY c) m ON m.c = c.c)"""
            )
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.c = a.c"""
    )


SQL = _sql()
