"""Stored tables: upserts by merge key, session flags and their children, the event log, and the ticker cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.operators.pit import first_by
from saltmarsh.schemas import SESSION_EVENTS, struct
from saltmarsh.sources.versions import Change, VersionedStore

MERGE_KEYS = {
    "COMPETES_WITH": ["src", "dst", "provenance", "vintage"],
    "VERTICAL": ["src", "dst", "provenance", "vintage"],
    "SUPPLIES": ["src", "dst", "fiscal_year", "provenance"],
    "COMOVES_WITH": ["src", "dst", "provenance"],
}


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new rows with one row for each key, the new one where both have it."""
    both = old.withColumn("_load", F.lit(0)).unionByName(new.withColumn("_load", F.lit(1)), allowMissingColumns=True)
    return first_by(both, keys, [F.desc("_load"), F.xxhash64(*both.columns).asc()]).drop("_load")


def edge_store(spark: SparkSession, path: str) -> VersionedStore:
    return VersionedStore(spark, path, {kind: ["src", "dst"] for kind in MERGE_KEYS})


def upsert_edges(spark: SparkSession, path: str, new: DataFrame, kind: str) -> int:
    """Merge edges of one kind into its table of the versioned store at ``path``, by the kind's merge key, and return the version."""
    keys = MERGE_KEYS[kind]
    rows = first_by(new, keys, [F.xxhash64(*new.columns).asc()])
    return edge_store(spark, path).commit({kind: Change(rows, keys)})


def write_sessions(rows: DataFrame, path: str) -> None:
    """Replace the partitions of the sessions in ``rows`` and leave all others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(path)


def ranked_flags(flags: DataFrame) -> DataFrame:
    """Flags with their rank in the session, 1 being the most salient."""
    from pyspark.sql import Window as W

    return flags.withColumn("rank", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("salience"), "canonical_id")))


def nested_session(flags: DataFrame, tearsheets: DataFrame, headlines: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """One row a session with its flags by rank, each with its reason, its path, its tearsheet (or null) and all its headlines by rank.

    ``sessions`` has one row for each session (created_at, as_of, k, d_e, n_flags, ticker_lookup, or what there is), which stand
    first; a session without flags then has an empty list. All columns of the children are kept in their structs.
    """
    keys = ["session_id", "canonical_id"]
    own = lambda df, first=(): F.struct(*first, *(c for c in df.columns if c not in (*keys, *first)))
    news = headlines.groupBy(*keys).agg(F.array_sort(F.collect_list(own(headlines, ("rank",)))).alias("headlines"))
    sheet = tearsheets.select(*keys, own(tearsheets).alias("tearsheet"))
    joined = flags.join(sheet, keys, "left").join(news, keys, "left")
    joined = joined.withColumn("headlines", F.coalesce("headlines", F.array().cast(news.schema["headlines"].dataType)))
    item = F.struct("rank", "canonical_id", *(c for c in flags.columns if c not in (*keys, "rank")), "tearsheet", "headlines")
    nested = joined.groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias("flags"))
    if sessions is None:
        return nested
    return sessions.join(nested, "session_id", "left").withColumn("flags", F.coalesce("flags", F.array().cast(nested.schema["flags"].dataType)))


def tearsheet(details: DataFrame, last_bars: DataFrame) -> DataFrame:
    """Company details with the last day's change; no percentage where the open is missing or zero."""
    change = F.col("close") - F.col("open")
    return details.join(last_bars.select("canonical_id", "open", "close"), "canonical_id", "left").select(*details.columns, F.col("close").alias("prev_close"), change.alias("change"), F.try_divide(change * 100, F.nullif(F.col("open"), F.lit(0.0))).alias("change_pct"))


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new``, and the rows of ``old`` with other keys: all children that ``new`` gives for a key take the place of the old ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def without_sessions(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` but those of the sessions in ``gone``; sessions that are not there are no error."""
    return rows.join(gone.select("session_id").distinct(), "session_id", "left_anti")


def list_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("session_id").agg(F.max("created_at").alias("created_at"), F.count("*").alias("n_flags")).orderBy(F.desc("created_at"), "session_id")


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event log; lines that are blank or no JSON are left out. ``seq`` is the order of timestamp and turn."""
    rows = spark.read.schema(struct(SESSION_EVENTS)).option("mode", "DROPMALFORMED").json(path).where("event is not null and session_id is not null")
    return rows.withColumn("seq", F.struct("timestamp", "turn"))


def cached_tickers(store: VersionedStore, ids: DataFrame, look_up: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """canonical_id and ticker of all ids, from the cache in ``store`` (table tickers) and, for those it lacks, from ``look_up``.

    What is looked up (canonical_id, ticker) is added to the cache in one commit, so the next call finds it; ids that nothing
    is known of have a null ticker and are asked for again.
    """
    asked = ids.select("canonical_id").where("canonical_id is not null").distinct()
    cache = store.read("tickers") if store.current() else None
    found = look_up(missing_tickers(asked, cache) if cache is not None else asked).select("canonical_id", "ticker").where("ticker is not null")
    store.commit({"tickers": Change(first_by(found, ["canonical_id"], [F.asc("ticker")]), ["canonical_id"])})
    return asked.join(store.read("tickers"), "canonical_id", "left")


def missing_tickers(ids: DataFrame, cache: DataFrame) -> DataFrame:
    """Ids that the cache of tickers does not have yet."""
    return ids.select("canonical_id").distinct().join(cache, "canonical_id", "left_anti")
