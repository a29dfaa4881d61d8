"""What the text operators share: reading tables, cutting lineage, running Python over Arrow rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

#: A word: a run of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD_PATTERN).findall

_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder that the cluster shares, the session's ``spark.checkpoint.dir``."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named c0, c1, ..., so that none clashes with those that an operator adds; and the new name of each."""
    new = {name: f"c{k}" for k, name in enumerate(df.columns)}
    return df.toDF(*new.values()), new


def share(rows: int, of: int) -> Column:
    """Whether a 64-bit hash (column ``pick``) is among the lowest, so that about ``rows`` of ``of`` evenly drawn ones are."""
    return F.col("pick") <= min(round(rows / max(of, 1) * 2.0**64) - 2**63, 2**63 - 1)


def tuples(batches: Iterator[pa.RecordBatch], most: int = 256) -> Iterator[tuple]:
    """The rows of ``batches``, of which ``most`` at a time are Python's, as a batch may have 10,000 texts."""
    for batch in batches:
        for k in range(0, len(batch), most):
            yield from zip(*(c.to_pylist() for c in batch.slice(k, most).columns), strict=True)


def map_rows(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterator[tuple]], schema: pa.Schema, flush: int = 2000) -> DataFrame:
    """Run a generator over each partition's rows (as tuples, streamed), and return its tuples as a DataFrame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        for row in rows(tuples(batches)):
            kept.append(row)
            if len(kept) >= flush:
                yield _batch(kept, schema)
                kept = []
        if kept:
            yield _batch(kept, schema)

    return df.mapInArrow(run, from_arrow_schema(schema))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word to its 64-bit hash; forgets everything once ``most`` words are held, so memory stays bounded."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive words; none if there are fewer words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = mix64(total + hashes[i : i + n])
    return total
