"""From signals to ranked candidates: composite, size buckets, salience, and option enrichment."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saltmarsh.functions.scalar import canonical_id, clip_unit, parse_permno
from saltmarsh.operators import signals
from saltmarsh.operators.asof import next_after
from saltmarsh.operators.order import average_ranks, interval, quantiles
from saltmarsh.sources.scratch import cut

#: Weights of the components of the composite.
WEIGHTS = {"vol_spike": 1.0, "abn_volume": 1.0, "dislocation": 1.0, "gap": 0.5, "iv_rank": 0.5}
MIN_IV_OBS = 10


def last_caps(bars: DataFrame) -> DataFrame:
    """Market value from each id's latest bar with a close and shares (in thousands)."""
    good = bars.where("close is not null and shrout is not null")
    return good.groupBy("permno").agg(F.max_by(F.col("close") * F.col("shrout") * 1000, "date").alias("mktcap"))


def cap_quintiles(records: DataFrame) -> DataFrame:
    """Adds cap_q, the quintile of mktcap (null counts as 0) over all records.

    The edges are exact quantiles by distributed selection. ``records`` is read several times: cut its lineage before.
    """
    cap = F.coalesce(F.col("mktcap"), F.lit(0.0))
    edges = quantiles(records.select(cap.alias("cap")), "cap", (0.0, 0.2, 0.4, 0.6, 0.8, 1.0))
    return records.withColumn("cap_q", interval(edges, cap))


def salience(records: DataFrame) -> DataFrame:
    """Adds bucket and salience: average rank of the composite within sector division and size, over the bucket's count.

    There are 50 buckets at most, so no bucket is gathered: ranks come from a running total over the order of all records.
    """
    division = F.least(F.greatest(F.floor(F.coalesce("siccd", F.lit(0)) / 1000), F.lit(0)), F.lit(9)).cast("string")
    bucketed = cap_quintiles(records).withColumn("bucket", F.concat_ws("_", division, F.col("cap_q").cast("string")))
    return average_ranks(bucketed, "bucket", "composite").withColumn("salience", F.col("avg_rank") / F.col("n_group")).drop("avg_rank", "n_group")


def components(bars: DataFrame, market: DataFrame) -> dict[str, DataFrame]:
    raw = {"vol_spike": signals.realized_vol_spike(bars), "abn_volume": signals.abnormal_volume(bars), "dislocation": signals.dislocation(bars, market), "gap": signals.gap(bars)}
    return {name: signals.zscore(one) for name, one in raw.items()}


def composite(ids: DataFrame, parts: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """permno, the z-score of each component (0 where absent) and their weighted sum."""
    use = WEIGHTS | (weights or {})
    if unknown := use.keys() - WEIGHTS.keys():
        raise KeyError(f"unknown weights: {', '.join(sorted(unknown))}")
    out = ids.select("permno").distinct()
    for name, one in parts.items():
        out = out.join(one.select("permno", F.col("z").alias(name)), "permno", "left")
    out = out.fillna(0.0, list(parts))
    return out.withColumn("composite", sum((use[n] * F.col(n) for n in parts), F.lit(0.0)))


def composites(bars: DataFrame, market: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``composite`` of the four signals for all ids of ``bars``, which are passed once: those without a signal stay, with 0."""
    wide = signals.zscores(signals.all_signals(bars, market, every_id=True))
    return weighted(wide, list(signals.NAMES), weights).select("permno", *signals.NAMES, "composite")


def iv_rank(atm: DataFrame, history: DataFrame, days: int, least: int = MIN_IV_OBS) -> DataFrame:
    """secid, today's at-the-money volatility and its place in the range of its last ``days`` observations.

    The place is null with fewer than ``least`` observations.
    """
    recent = history.where("impl_volatility > 0").withColumn("rn", F.row_number().over(W.partitionBy("secid").orderBy(F.desc("date")))).where(F.col("rn") <= days)
    span = recent.groupBy("secid").agg(F.min("impl_volatility").alias("low"), F.max("impl_volatility").alias("high"), F.count("*").alias("n")).where(F.col("n") >= least)
    now = atm.select("secid", F.col("impl_volatility").alias("iv"))
    joined = now.join(span, "secid", "left")
    return joined.select("secid", "iv", F.when(F.col("n").isNotNull(), clip_unit(F.col("iv"), F.col("low"), F.col("high"))).alias("iv_rank"))


def atm_surface(surface: DataFrame, t0: date) -> DataFrame:
    return surface.where((F.col("date") == F.lit(t0)) & (F.col("days") == 30) & (F.col("delta") == 50) & (F.col("impl_volatility") > 0))


def next_expiries(quotes: DataFrame, events: DataFrame) -> DataFrame:
    """secid, catalyst and the first expiry strictly after it, if there is one, from one sorted pass of both tables (``asof.next_after``)."""
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    asks = events.select(F.col("secid").cast("string").alias("k"), day("catalyst").alias("t"))
    found = next_after(asks, quotes.select(F.col("secid").cast("string").alias("k"), day("exdate").alias("t"))).where("next is not null")
    return found.select(F.col("k").cast(events.schema["secid"].dataType).alias("secid"), F.date_from_unix_date("t").alias("catalyst"), F.date_from_unix_date("next").alias("exdate"))


def straddles(quotes: DataFrame, events: DataFrame, t0: date) -> DataFrame:
    """secid and straddle: mid prices of the call and the put with the least delta in size at that expiry."""
    good = quotes.where(F.col("date") == F.lit(t0)).where(F.abs("delta").between(0.35, 0.65)).where("best_bid >= 0 and best_offer is not null and open_interest > 0")
    near = good.join(next_expiries(good, events), ["secid", "exdate"])
    mid = (F.col("best_bid") + F.col("best_offer")) / 2
    legs = near.groupBy("secid").agg(*(F.min_by(F.when(F.col("cp_flag") == side, mid), F.when(F.col("cp_flag") == side, F.struct(F.abs("delta").alias("d"), mid.alias("m")))).alias(side) for side in ("C", "P")))
    return legs.where("C > 0 and P > 0").select("secid", (F.col("C") + F.col("P")).alias("straddle"))


def enrich_options(ids: DataFrame, option_links: DataFrame, surface: DataFrame, quotes: DataFrame, events: DataFrame, bars: DataFrame, t0: date, days: int = 252) -> DataFrame:
    """permno, iv, iv_rank and implied_move of the ids that options say something about; never a gate."""
    from saltmarsh.operators.pit import permno_secids

    secids = ids.select("permno").join(permno_secids(option_links, t0), "permno")
    history = surface.where((F.col("date") < F.lit(t0)) & (F.col("days") == 30) & (F.col("delta") == 50))
    ranked = secids.join(iv_rank(atm_surface(surface, t0), history, days), "secid", "left")
    asks = events.select(parse_permno(F.col("canonical_id")).alias("permno"), "catalyst").join(secids, "permno")
    last = bars.where("close is not null").groupBy("permno").agg(F.max_by("close", "date").alias("s"))
    moves = straddles(quotes, asks, t0).join(secids, "secid").join(last, "permno").where("s > 0").select("permno", (F.col("straddle") / F.col("s")).alias("implied_move"))
    return ranked.join(moves, "permno", "left").where("iv is not null or implied_move is not null").select("permno", "iv", "iv_rank", "implied_move")


def weighted(wide: DataFrame, names: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """``wide`` with nulls of the z-scores ``names`` as 0, and composite, their weighted sum."""
    use = WEIGHTS | (weights or {})
    if unknown := use.keys() - WEIGHTS.keys():
        raise KeyError(f"unknown weights: {', '.join(sorted(unknown))}")
    return wide.fillna(0.0, names).withColumn("composite", sum((use[n] * F.col(n) for n in names), F.lit(0.0)))


def candidates(bars: DataFrame, market: DataFrame, sectors: DataFrame, t0: date, options: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Ranked candidates of all ids with any signal, by salience and then by id as text.

    No bars, or bars without signals, give an empty table of the same columns. The bars are passed once for all signals;
    what is known of each id is then written to the shared folder, as quantiles and ranks read it several times.
    """
    names = list(signals.NAMES)
    wide = signals.zscores(signals.all_signals(bars, market))
    if options is not None:
        names.append("iv_rank")
        wide = wide.join(signals.zscore(options.where("iv_rank is not null").select("permno", F.col("iv_rank").alias("value"))).withColumnRenamed("z", "iv_rank"), "permno", "left")
    records = weighted(wide, names, weights).join(sectors, "permno", "left")
    if options is not None:
        records = records.join(options.select("permno", "iv", F.col("iv_rank").alias("iv_place"), "implied_move"), "permno", "left")
    else:
        records = records.selectExpr("*", "cast(null as double) as iv", "cast(null as double) as iv_place", "cast(null as double) as implied_move")
    return salience(cut(records)).select(
        canonical_id(F.col("permno")).alias("canonical_id"),
        F.when(F.col("implied_move").isNotNull(), "straddle").otherwise("attention").alias("measure"),
        "salience", F.lit(True).alias("coverage"), F.lit(t0).alias("as_of"), F.col("composite").alias("attention"),
        (F.col("iv").isNotNull() | F.col("implied_move").isNotNull()).alias("has_options"), "implied_move", F.col("iv_place").alias("iv_rank"),
        F.create_map(*(x for n in names for x in (F.lit(n), F.col(n)))).alias("components"),
    ).orderBy(F.desc("salience"), "canonical_id")
