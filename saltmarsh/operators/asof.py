"""As-of joins by merging: asks and intervals in one sorted pass, heavy keys cut by time."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from saltmarsh.functions.scalar import pad_gvkey
from saltmarsh.operators.pit import LINK_PRIMARIES, LINK_TYPES, MOST_OPTION_SCORE

#: Rows of a key from which on it is cut by time, at least, and the share of all rows from which on, so that few keys are.
HEAVY_ROWS, HEAVY_SHARE = 50_000, 0.001
FOREVER, ALWAYS = 2**31 - 1, -(2**31)


def cuts(rows: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """k and bounds (ascending times) of the keys of ``rows`` (k, t) that are too heavy for one task.

    A key is heavy with a set share of all rows, so at most 1 / HEAVY_SHARE keys are listed, each with about as many
    slices as it has times ``heavy_rows`` rows, 1,000 at most; the table may be broadcast.
    """
    counts = rows.where("k is not null and t is not null").groupBy("k").agg(F.count("*").alias("n"))
    limit = F.greatest(F.lit(heavy_rows), F.col("total") * HEAVY_SHARE)
    heavy = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).where(F.col("n") > limit).select("k")  # one row on the right
    at = F.percentile_approx("t", F.array(*(F.lit(i / 1000) for i in range(1, 1000))), 10_000)
    every = F.greatest(F.floor(F.lit(1000) * heavy_rows / F.col("n")), F.lit(1)).cast("int")
    spread = rows.join(F.broadcast(heavy), "k").groupBy("k").agg(at.alias("at"), F.count("*").alias("n"))
    return spread.select("k", F.array_distinct(F.filter("at", lambda x, i: (i + 1) % every == 0)).alias("bounds"))


def sliced(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """``rows`` with slice: 0 for a key that is not cut, else the number of its bounds that are not after the time."""
    return rows.join(F.broadcast(bounds), "k", "left").withColumn("slice", F.coalesce(F.size(F.filter("bounds", lambda b: b <= F.col("t"))), F.lit(0))).withColumn("slice", F.greatest("slice", F.lit(0))).drop("bounds")


class Open:
    """The intervals that hold at a time, but those that end no later than a better one.

    The better an interval, the sooner it ends, so the best of those still open is first once ended ones are dropped from
    the front. The number held is the depth to which intervals overlap and does not grow with the rows.
    """

    def __init__(self) -> None:
        self.held: list[tuple[tuple, int, tuple]] = []  # order (less is better), end, the interval

    def add(self, order: tuple, end: int, interval: tuple) -> None:
        at = bisect_left(self.held, order, key=lambda x: x[0])
        if at and self.held[at - 1][1] >= end:
            return
        after = at
        while after < len(self.held) and self.held[after][1] <= end:
            after += 1
        self.held[at:after] = [(order, end, interval)]

    def best(self, time: int) -> tuple | None:
        gone = 0
        while gone < len(self.held) and self.held[gone][1] < time:
            gone += 1
        if gone:
            del self.held[:gone]
        return self.held[0][2] if self.held else None


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def merge_asof(asks: DataFrame, intervals: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """For each distinct (k, t) of ``asks`` the value v of the best interval of the key that holds the time; null if none does.

    ``asks`` has k (text) and t (a day as a number). ``intervals`` has k, s and e (first and last day; a null s or
    e is open), o (an array of longs: less is better, compared in order) and v (a struct that settles what still ties:
    its text form, the least first). Null keys and times get null.

    Both tables are dealt by key once and sorted by time. A task walks its rows with what is open so far, so work and
    memory are linear however often the intervals of a key are asked for. A heavy key is cut into slices of time: what
    is open at the start of a slice is found from the intervals alone (no more rows than intervals, and for each slice
    the depth of overlap) and is put in front of it.
    """
    value = intervals.schema["v"].dataType
    events = intervals.where("k is not null").select(
        "k", F.coalesce("s", F.lit(ALWAYS)).cast("int").alias("t"), F.lit(0).alias("ask"), F.coalesce("e", F.lit(FOREVER)).cast("int").alias("e"), "o", F.to_json("v").alias("tie"), "v"
    ).where("e >= t")
    asked = asks.select("k", F.col("t").cast("int").alias("t"), F.lit(1).alias("ask")).distinct()
    both = events.unionByName(asked, allowMissingColumns=True)
    bounds = cuts(both.select("k", "t"), heavy_rows).persist()
    rows = sliced(both, bounds)
    carried = carried_over(sliced(events, bounds).join(F.broadcast(bounds), "k"), value) if not bounds.isEmpty() else None
    if carried is not None:
        rows = rows.unionByName(carried)
    dealt = rows.repartition("k", "slice").sortWithinPartitions("k", "slice", "t", "ask")
    out = T.StructType([T.StructField("k", T.StringType()), T.StructField("t", T.IntegerType()), T.StructField("v", value)])
    schema = to_arrow_schema(out)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, pool = Open(), None, None  # pool: values of the open intervals, which are known by their place in it
        for batch in batches:
            if not batch.num_rows:
                continue
            k, slices, t, ask, values = (batch.column(c) for c in ("k", "slice", "t", "ask", "v"))
            key, part, asked_here = pc.fill_null(k.dictionary_encode().indices, -1).to_numpy(), slices.to_numpy(), ask.to_numpy() == 1
            new = np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]))
            new[0] = (k[0].as_py(), part[0]) != last
            last = k[-1].as_py(), part[-1]
            pool = values if pool is None else pa.concat_arrays([pool, values])
            before = len(pool) - len(values)
            spans = batch.filter(pa.array(~asked_here))
            added = zip(spans.column("o").to_pylist(), spans.column("tie").to_pylist(), spans.column("e").to_pylist(), strict=True)
            picked = []
            for at, (fresh, time, asks_for) in enumerate(zip(new.tolist(), t.to_pylist(), asked_here.tolist(), strict=True), before):
                if fresh:
                    held = Open()
                if asks_for:
                    picked.append(None if time is None else held.best(time))
                else:
                    order, tie, end = next(added)
                    held.add((*order, tie), end, at)
            rows = pa.array(np.flatnonzero(asked_here))
            yield pa.RecordBatch.from_arrays([k.take(rows), t.take(rows), pool.take(pa.array(picked, pa.int64()))], names=schema.names)
            pool = pool.take(pa.array([x[2] for x in held.held], pa.int64()))
            held.held = [(order, end, at) for at, (order, end, _) in enumerate(held.held)]

    return dealt.select("k", "slice", "t", "ask", "e", "o", "tie", "v").mapInArrow(walk, out)


def carried_over(events: DataFrame, value: T.DataType) -> DataFrame:
    """The intervals that are open at the start of each later slice of a heavy key, as rows of that slice.

    First each slice tells what it leaves open at its end; then the few rows of a key are walked slice by slice.
    """
    out = T.StructType([T.StructField(n, t) for n, t in (("k", T.StringType()), ("t", T.IntegerType()), ("ask", T.IntegerType()), ("e", T.IntegerType()), ("o", T.ArrayType(T.LongType())), ("tie", T.StringType()), ("v", value), ("slice", T.IntegerType()), ("bounds", T.ArrayType(T.IntegerType())))])
    schema = to_arrow_schema(out)
    columns = [f.name for f in out.fields]

    def left_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[tuple]:
            for (_, s), group in groupby(_rows(batches), key=lambda r: (r[0], r[7])):
                held, bounds = Open(), None
                for r in group:
                    held.add((*r[4], r[5]), r[3], r)
                    bounds = r[8]
                if s < len(bounds):
                    held.best(bounds[s])
                    yield from (x[2] for x in held.held)

        return _batches(told(), schema)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[tuple]:
            for _, rows in groupby(_rows(batches), key=lambda r: r[0]):
                held, ready, bounds = Open(), 0, []
                for r in [*rows, None]:
                    bounds = r[8] if r else bounds
                    for s in range(ready + 1, (r[7] if r else len(bounds)) + 1):  # slices that start before this row's
                        held.best(bounds[s - 1])
                        yield from ((*x[2][:7], s, None) for x in held.held)
                        ready = s
                    if r:
                        held.add((*r[4], r[5]), r[3], r)

        return _batches(told(), schema)

    ends = events.select(columns).repartition("k", "slice").sortWithinPartitions("k", "slice", "t").mapInArrow(left_open, out)
    return ends.repartition("k").sortWithinPartitions("k", "slice", "t").mapInArrow(carry, out).drop("bounds")


def next_after(asks: DataFrame, times: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """For each distinct (k, t) of ``asks`` the first t of ``times`` strictly after it, as next; null if there is none.

    One exchange of both tables: sorted by time from the end, an ask takes the time that the running window saw last. For
    the slices of a heavy key, what a later slice has first is found from one row a slice.
    """
    both = asks.select("k", "t").distinct().withColumn("ask", F.lit(0)).unionByName(times.where("k is not null and t is not null").select("k", "t").distinct().withColumn("ask", F.lit(1)))
    bounds = cuts(both.select("k", "t"), heavy_rows).persist()
    rows = sliced(both, bounds)
    seen = F.when(F.col("ask") == 1, F.col("t"))
    back = W.partitionBy("k", "slice").orderBy(F.col("t").desc_nulls_last(), "ask").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = rows.withColumn("next", F.last(seen, ignorenulls=True).over(back)).where("ask = 0")
    if not bounds.isEmpty():
        firsts = rows.join(F.broadcast(bounds.select("k")), "k", "left_semi").groupBy("k", "slice").agg(F.min(seen).alias("first"))
        later = firsts.select("k", "slice", F.min("first").over(W.partitionBy("k").orderBy("slice").rowsBetween(1, W.unboundedFollowing)).alias("later"))
        found = found.join(F.broadcast(later), ["k", "slice"], "left").withColumn("next", F.coalesce("next", "later"))
    return found.select("k", "t", F.when(F.col("t").isNotNull() & F.col("k").isNotNull(), F.col("next")).alias("next"))


def _days(c: str) -> Column:
    return F.unix_date(F.col(c).cast("date"))


def _latest(start: str, then: str) -> list[Column]:
    return [-_days(start).cast("long"), F.col(then).cast("long")]


def rules() -> dict[str, tuple]:
    """For each kind of id: which links count, their key, first and last day, what is better among those that hold (less first), and the value."""
    return {
        "gvkey": (F.col("linktype").isin(*LINK_TYPES) & F.col("linkprim").isin(*LINK_PRIMARIES) & F.col("lpermno").isNotNull() & F.col("linkdt").isNotNull(), pad_gvkey(F.col("gvkey")), "linkdt", "linkenddt", _latest("linkdt", "lpermno"), F.col("lpermno").cast("long")),
        "secid": (F.col("sdate").isNotNull(), F.col("secid").cast("string"), "sdate", "edate", _latest("sdate", "permno"), F.col("permno").cast("long")),
        "ibes_ticker": (F.lit(True), F.col("ticker"), "sdate", "edate", [F.coalesce(-F.col("score").cast("long"), F.lit(-(2**62))), F.col("lpermno").cast("long")], F.col("lpermno").cast("long")),
        "ticker": (F.col("namedt").isNotNull(), F.col("ticker"), "namedt", "nameenddt", _latest("namedt", "permno"), F.col("permno").cast("long")),
        "permno_secid": (F.col("score") <= MOST_OPTION_SCORE, F.col("permno").cast("string"), "sdate", "edate", [F.col("score").cast("long"), F.col("secid").cast("long")], F.col("secid").cast("long")),
        "permno_ticker": (F.col("namedt").isNotNull() & (F.trim("ticker") != ""), F.col("permno").cast("string"), "namedt", "nameenddt", [-_days("namedt").cast("long")], F.trim("ticker")),
        "permno_siccd": (F.col("namedt").isNotNull(), F.col("permno").cast("string"), "namedt", "nameenddt", [-_days("namedt").cast("long"), F.coalesce(F.col("siccd").try_cast("long"), F.lit(-1))], F.coalesce(F.col("siccd").try_cast("int"), F.lit(0))),
    }


def resolve_days(asks: DataFrame, links: DataFrame, id_type: str, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """identifier, day and value of every distinct (identifier, day) of ``asks``, by the rules of one kind of id; null where nothing is valid."""
    known = rules()
    if id_type not in known:
        raise ValueError(f"unknown id_type {id_type!r}; known: {', '.join(known)}")
    counts, key, start, end, order, value = known[id_type]
    intervals = links.where(counts).select(key.alias("k"), _days(start).alias("s"), _days(end).alias("e"), F.array(*order).alias("o"), F.struct(value.alias("value")).alias("v"))
    own = pad_gvkey(F.col("identifier")) if id_type == "gvkey" else F.col("identifier").cast("string")
    found = merge_asof(asks.select(own.alias("k"), _days("day").alias("t")), intervals, heavy_rows)
    return found.select(F.col("k").alias("identifier"), F.date_from_unix_date("t").alias("day"), "v.value")
