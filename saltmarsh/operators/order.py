"""Exact quantiles and ranks of whole tables without one task that sees all of them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.sources.scratch import cut

#: Distinct values that the driver takes of the narrowed range, and how fine the approximate quantiles that narrow it are.
FEW, ACCURACY = 10_000, 10_000


def at_ranks(values: DataFrame, column: str, ranks: Sequence[int], few: int = FEW) -> dict[int, float]:
    """The values of ``column`` at ranks (0: the least) of its order; null and NaN do not count.

    Approximate quantiles give a range for each rank, counts tell how many values are below and inside it, and the range
    is narrowed until it holds one value or few distinct ones, which are counted. What comes to the driver is bounded.
    A count decides each step, so a range that missed its rank would be seen and widened again.
    """
    x = F.col(column).cast("double")
    rows = values.select(x.alias("x")).where("x is not null and not isnan(x)")
    spans = dict.fromkeys(ranks, (-math.inf, math.inf))
    found: dict[int, float] = {}
    while open_ := [r for r in spans if r not in found]:
        inside = lambda r: F.col("x").between(*map(F.lit, spans[r]))
        shape = rows.agg(*(c for r in open_ for c in (F.count_if(F.col("x") < spans[r][0]).alias(f"below{r}"), F.count_if(inside(r)).alias(f"in{r}")))).first()
        asks = []
        for r in open_:
            below, n = shape[f"below{r}"], shape[f"in{r}"]
            if spans[r][0] == spans[r][1]:
                found[r] = spans[r][0]
            elif n <= few:
                for v, k in sorted(tuple(v) for v in rows.where(inside(r)).groupBy("x").count().collect()):
                    below += k
                    if below > r:
                        found[r] = v
                        break
            else:
                share, slack = (r - below + 0.5) / n, 2.0 / ACCURACY
                lows = [max(share - slack, 0.0), min(share + slack, 1.0)]
                asks.append((r, F.percentile_approx(F.when(inside(r), F.col("x")), F.array(*map(F.lit, lows)), ACCURACY).alias(f"at{r}")))
        if asks:
            got = rows.agg(*(c for _, c in asks)).first()
            ends = rows.agg(*(c for r, _ in asks for c in (F.count_if(F.col("x") < got[f"at{r}"][0]).alias(f"low{r}"), F.count_if(F.col("x") <= got[f"at{r}"][1]).alias(f"high{r}")))).first()
            for r, _ in asks:
                low, high = got[f"at{r}"]
                old = spans[r]
                spans[r] = (low if ends[f"low{r}"] <= r else old[0], high if ends[f"high{r}"] > r else old[1])
                if spans[r] == old:  # heavy ties at the ends: the rank is one of theirs, or strictly between them
                    ties = rows.agg(F.count_if(F.col("x") <= low).alias("to_low"), F.count_if(F.col("x") < high).alias("to_high")).first()
                    spans[r] = (low, low) if r < ties["to_low"] else (high, high) if r >= ties["to_high"] else (math.nextafter(low, math.inf), math.nextafter(high, -math.inf))
    return found


def quantiles(values: DataFrame, column: str, shares: Sequence[float], few: int = FEW) -> list[float | None]:
    """Exact quantiles by linear interpolation between neighbouring ranks; None for all where there are no values."""
    x = F.col(column).cast("double")
    n = values.where(x.isNotNull() & ~F.isnan(x)).count()
    if not n:
        return [None] * len(shares)
    places = [p * (n - 1) for p in shares]
    at = at_ranks(values, column, sorted({r for h in places for r in (math.floor(h), math.ceil(h))}), few)
    mix = lambda h, a, b: a if a == b else (math.ceil(h) - h) * a + (h - math.floor(h)) * b
    return [mix(h, at[math.floor(h)], at[math.ceil(h)]) for h in places]


def totals_before(rows: DataFrame, keys: Sequence[str], amount: str, name: str = "before") -> DataFrame:
    """Adds ``name``, the sum of ``amount`` (long) over all rows that stand before a row in the order of ``keys``.

    Sorted by range, then each range starts from the total of those before it: one number a range comes to the
    driver. ``rows`` should have one row for each value of the keys, as equal ones meet in one range.
    """
    parts = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    sums = sorted(tuple(r) for r in parts.groupBy("_part").agg(F.sum(amount)).collect())
    starts = dict(zip((p for p, _ in sums), np.cumsum([0] + [n or 0 for _, n in sums]).tolist(), strict=False))
    at, part = parts.columns.index(amount), parts.columns.index("_part")
    names = [*rows.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: int | None = None
        for batch in batches:  # one range, in order
            if batch.num_rows:
                seen = starts[batch.column(part)[0].as_py()] if seen is None else seen
                amounts = batch.column(at).fill_null(0).to_numpy(zero_copy_only=False)
                after = seen + np.cumsum(amounts)
                yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != part), pa.array(after - amounts, pa.int64())], names=names)
                seen = int(after[-1])

    return parts.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())]))


def average_ranks(rows: DataFrame, group: str, value: str, group_count: str = "n_group", rank: str = "avg_rank") -> DataFrame:
    """Adds the average rank of ``value`` within ``group`` (ties share the mean of their places, 1 the least) and the group's count.

    Equal values are counted first, so ranks come from a running total over the distinct (group, value) in their order, less
    the total at which a group begins. A group is never gathered in one task, and many ties are one row.
    """
    ties = rows.groupBy(F.col(group).alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    placed = cut(totals_before(ties, ["_g", "_v"], "_n", "_before"))
    groups = placed.groupBy(F.col("_g").alias("_h")).agg(F.min("_before").alias("_start"), F.sum("_n").alias(group_count))
    few = groups.count() <= 100_000
    told = placed.join(F.broadcast(groups) if few else groups, F.col("_g").eqNullSafe(F.col("_h"))).select("_g", "_v", (F.col("_before") - F.col("_start") + (F.col("_n") + 1) / 2).alias(rank), group_count)
    return rows.join(told, F.col(group).eqNullSafe(F.col("_g")) & F.col(value).eqNullSafe(F.col("_v"))).drop("_g", "_v")


def interval(edges: Sequence[float | None], x: Column) -> Column:
    """Number of the interval between the distinct ``edges`` that holds x, lowest included in the first."""
    known = sorted({e for e in edges if e is not None})
    return F.greatest(F.lit(0), sum((F.when(x > e, 1).otherwise(0) for e in known), F.lit(0)) - 1)
