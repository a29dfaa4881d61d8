"""Point-in-time rules: strict date filters, validity intervals, and id resolution as of a day."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saltmarsh.functions.scalar import canonical_id, pad_gvkey

LINK_TYPES, LINK_PRIMARIES = ("LC", "LU", "LX"), ("P", "C")
MOST_OPTION_SCORE = 6
CALENDAR_PER_TRADING_DAY = 1.55


def before(df: DataFrame, t0: date, column: str) -> DataFrame:
    """Rows known strictly before a day; the filter reaches the scan."""
    return df.where(F.col(column) < F.lit(t0))


def valid_on(t0: date | Column, start: str, end: str, open_start: bool = False) -> Column:
    """Whether an interval holds a day. Bounds count; a null end is open, a null start only if asked."""
    day = t0 if isinstance(t0, Column) else F.lit(t0)
    begun = F.col(start) <= day
    return (begun | F.col(start).isNull() if open_start else begun) & ((F.col(end) >= day) | F.col(end).isNull())


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the order."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def gvkey_links(links: DataFrame, t0: date) -> DataFrame:
    """gvkey to permno by the link valid on the day, latest start first."""
    good = links.where(F.col("linktype").isin(*LINK_TYPES) & F.col("linkprim").isin(*LINK_PRIMARIES) & F.col("lpermno").isNotNull()).where(valid_on(t0, "linkdt", "linkenddt"))
    return first_by(good.withColumn("key", pad_gvkey(F.col("gvkey"))), ["key"], [F.desc("linkdt"), F.asc("lpermno")]).select("key", F.col("lpermno").cast("long").alias("permno"))


def secid_links(links: DataFrame, t0: date) -> DataFrame:
    """secid to permno, latest start first; a null start is not valid."""
    return first_by(links.where(valid_on(t0, "sdate", "edate")), ["secid"], [F.desc("sdate"), F.asc("permno")]).select(F.col("secid").cast("string").alias("key"), F.col("permno").cast("long").alias("permno"))


def ibes_links(links: DataFrame, t0: date) -> DataFrame:
    """Analyst ticker to permno, highest score first (an unknown score counts as highest)."""
    good = links.where(valid_on(t0, "sdate", "edate", open_start=True))
    return first_by(good, ["ticker"], [F.col("score").desc_nulls_first(), F.asc("lpermno")]).select(F.col("ticker").alias("key"), F.col("lpermno").cast("long").alias("permno"))


def ticker_links(names: DataFrame, t0: date) -> DataFrame:
    """Ticker to permno, latest name first, as tickers are given to other firms in time."""
    return first_by(names.where(valid_on(t0, "namedt", "nameenddt")), ["ticker"], [F.desc("namedt"), F.asc("permno")]).select(F.col("ticker").alias("key"), F.col("permno").cast("long").alias("permno"))


RESOLVERS = {"gvkey": gvkey_links, "secid": secid_links, "ibes_ticker": ibes_links, "ticker": ticker_links}


def resolve(id_type: str, links: DataFrame, t0: date) -> DataFrame:
    """The link table (key, permno) of one kind of id as of a day."""
    if id_type not in RESOLVERS:
        raise ValueError(f"unknown id_type {id_type!r}; known: {', '.join(RESOLVERS)}")
    return RESOLVERS[id_type](links, t0)


def resolve_batch(ids: DataFrame, tables: dict[str, DataFrame], t0: date) -> DataFrame:
    """identifier, id_type and canonical_id of every pair in ``ids``; null where nothing is valid."""
    pairs = ids.select("identifier", "id_type").distinct()
    links = None
    for kind, table in tables.items():
        one = resolve(kind, table, t0).select(F.lit(kind).alias("id_type"), "key", "permno")
        links = one if links is None else links.unionByName(one)
    key = F.when(F.col("id_type") == "gvkey", pad_gvkey(F.col("identifier"))).otherwise(F.col("identifier"))
    found = pairs.withColumn("key", key).join(links, ["id_type", "key"], "left")
    return found.select("identifier", "id_type", canonical_id(F.col("permno")).alias("canonical_id"))


def resolve_gvkeys(gvkeys: DataFrame, links: DataFrame, t0: date) -> DataFrame:
    """key and permno of every distinct gvkey, null where not resolved."""
    return gvkeys.select(pad_gvkey(F.col("gvkey")).alias("key")).distinct().join(gvkey_links(links, t0), "key", "left")


def permno_tickers(names: DataFrame, t0: date) -> DataFrame:
    good = names.where(valid_on(t0, "namedt", "nameenddt")).where(F.trim("ticker") != "")
    return first_by(good, ["permno"], [F.desc("namedt"), F.asc("ticker")]).select("permno", F.trim("ticker").alias("ticker"))


def permno_sectors(names: DataFrame, t0: date) -> DataFrame:
    """permno to siccd; a code that is missing or no number is 0."""
    one = first_by(names.where(valid_on(t0, "namedt", "nameenddt")), ["permno"], [F.desc("namedt"), F.asc("siccd")])
    return one.select("permno", F.coalesce(F.col("siccd").try_cast("int"), F.lit(0)).alias("siccd"))


def permno_secids(links: DataFrame, t0: date) -> DataFrame:
    """permno to secid, lowest score first, scores up to 6; both bounds may be open."""
    good = links.where(F.col("score") <= MOST_OPTION_SCORE).where((F.col("sdate").isNull() | (F.col("sdate") <= F.lit(t0))) & (F.col("edate").isNull() | (F.col("edate") >= F.lit(t0))))
    return first_by(good, ["permno"], [F.asc("score"), F.asc("secid")]).select("permno", "secid")


def resolve_over_time(asks: DataFrame, links: DataFrame, key: str, at: str, start: str, end: str, value: str) -> DataFrame:
    """Many days at once: for each (key, day) the value of the interval that holds the day and starts last, of several the greatest.

    One sorted pass over asks and intervals (``asof.merge_asof``): no ask is paired with all intervals of its key.
    """
    from saltmarsh.operators.asof import merge_asof

    day = lambda c: F.unix_date(F.col(c).cast("date"))
    order = F.array(-day(start).cast("long"), F.coalesce(-F.col(value).try_cast("long"), F.lit(0)))
    intervals = links.where(F.col(start).isNotNull()).select(F.col(key).cast("string").alias("k"), day(start).alias("s"), day(end).alias("e"), order.alias("o"), F.struct(F.col(value).alias("value")).alias("v"))
    found = merge_asof(asks.select(F.col(key).cast("string").alias("k"), day(at).alias("t")), intervals)
    return found.select(F.col("k").cast(asks.schema[key].dataType).alias(key), F.date_from_unix_date("t").alias(at), F.col("v.value").alias(value))


def vintage_for(t0: date) -> int:
    return t0.year - 1 - (t0.month < 7)


def window_bounds(t0: date, trading_days: int) -> tuple[date, date]:
    """First and last calendar day that surely hold so many trading days before a day."""
    return t0 - timedelta(days=int(trading_days * CALENDAR_PER_TRADING_DAY)), t0 - timedelta(days=1)
