"""Column functions, all of them built from Spark's own."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKER = "^[A-Z]{1,5}$"
HALF_LIFE_DAYS = 180
UNKNOWN_AGE_DAYS = 365


def finite(x: Column) -> Column:
    """NaN as null, so that a threshold never takes it for the largest number."""
    return F.when(~F.isnan(x), x)


def canonical_id(permno: Column) -> Column:
    """The text form of an id; null stays null, which means not resolved."""
    return F.concat(F.lit("permno:"), permno.cast("string"))


def parse_permno(cid: Column) -> Column:
    """The number in ``permno:<int>``; null for anything else."""
    return F.regexp_extract(F.trim(cid), r"^permno:(\d+)$", 1).try_cast("bigint")


def pad_gvkey(gvkey: Column) -> Column:
    """At least six digits; longer keys are not cut."""
    key = F.trim(gvkey.cast("string"))
    return F.when(F.length(key) < 6, F.lpad(key, 6, "0")).otherwise(key)


def slugify(text: Column) -> Column:
    """Lower case, words joined by hyphens, 80 characters at most. Letters of any script are kept."""
    kept = F.regexp_replace(F.trim(F.lower(text)), r"(?U)[^\w\s-]", "")
    hyphened = F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s_]+", "-"), "-{2,}", "-")
    return F.substring(F.regexp_replace(hyphened, "^-+|-+$", ""), 1, 80)


def tickers(tags: Column) -> Column:
    """Those of the tags that look like tickers, trimmed."""
    return F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t.rlike(TICKER))


def clip_unit(x: Column, low: Column, high: Column) -> Column:
    """Place of x between two bounds, held to [0, 1]; 0.5 where the bounds leave no room."""
    return F.when(high <= low, 0.5).otherwise(F.least(F.greatest(F.try_divide(x - low, high - low), F.lit(0.0)), F.lit(1.0)))


def recency(as_of: Column, updated: Column) -> Column:
    """Decay by half each 180 days; an unknown date counts as 365 days ago."""
    days = F.coalesce(F.datediff(as_of, updated), F.lit(UNKNOWN_AGE_DAYS))
    return F.exp(-days * math.log(2) / HALF_LIFE_DAYS)


def engagement(in_degree: Column) -> Column:
    return F.log1p(F.coalesce(in_degree, F.lit(0)) + 1)


def f_beta(precision: Column, recall: Column, beta: float = 0.5) -> Column:
    """Weighted harmonic mean of precision and recall; 0 if both are 0, null if either is null."""
    b = beta * beta
    value = F.try_divide((1 + b) * precision * recall, b * precision + recall)
    return F.when(precision.isNotNull() & recall.isNotNull(), F.coalesce(value, F.lit(0.0)))


def usd(x: Column) -> Column:
    """Dollars in billions or millions from those sizes on, else in whole dollars."""
    return F.when(x >= 1e9, F.format_string("$%.1fB", x / 1e9)).when(x >= 1e6, F.format_string("$%.1fM", x / 1e6)).otherwise(F.format_string("$%,.0f", x))


def winsorize(x: Column, limit: float = 5.0) -> Column:
    return F.least(F.greatest(x, F.lit(-limit)), F.lit(limit))


def vintage(as_of: Column) -> Column:
    """The newest yearly file that was published by a date: last year's from July on, before that the year before's."""
    return F.year(as_of) - F.when(F.month(as_of) < 7, 2).otherwise(1)


def clock(ts: Column) -> Column:
    """Hour and minute of a moment, in the session's zone, which is UTC."""
    return F.date_format(ts, "HH:mm")


def label(ticker: Column, looked_up: Column, cid: Column) -> Column:
    """What a flag is shown as: its tearsheet's ticker, or the one that was looked up, or its id."""
    return F.coalesce(ticker, looked_up, cid)


def shown(salience: Column, on_frontier: Column, least: float = 0.0, frontier_only: bool = False) -> Column:
    """Whether a flag passes the two filters of the list: salience of at least so much, and on the frontier."""
    return (salience >= least) & (on_frontier if frontier_only else F.lit(True))
