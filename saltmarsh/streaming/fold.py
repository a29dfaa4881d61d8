"""The event log folded as it grows: keyed state, and a sink that takes each batch once."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from saltmarsh.sources.versions import Change, VersionedStore

#: One slot of a session: a turn's candidates, the final list, or one id of a set; the greatest seq counts.
SLOTS = "session_id string, kind string, slot string, seq long, ids array<string>"
#: A session's state is dropped after so long without events.
IDLE_MS = 6 * 3600 * 1000


def slots(events: DataFrame) -> DataFrame:
    """Logged events as slots. ``events``: event, session_id, turn, seq, candidates, flags, a_final_ids and flag_id."""
    one = lambda kind, slot, ids: F.struct(F.lit(kind).alias("kind"), slot.cast("string").alias("slot"), ids.cast("array<string>").alias("ids"))
    none = F.array().cast("array<struct<kind:string,slot:string,ids:array<string>>>")
    answer = lambda kind: F.array(one(kind, F.col("flag_id"), F.array("flag_id")))
    found = (
        F.when(F.col("event") == "candidates", F.array(one("candidates", F.col("turn"), F.col("candidates.canonical_id"))))
        .when(F.col("event") == "a_final", F.array(one("final", F.lit(""), F.col("a_final_ids"))))
        .when(F.col("event") == "flags", F.transform("flags.canonical_id", lambda x: one("flags", x, F.array(x))))
        .when(F.col("event").isin("accept"), answer("accept"))
        .when(F.col("event").isin("dismiss"), answer("dismiss"))
    )
    return events.select(F.col("session_id").cast("string").alias("session_id"), "seq", F.explode(F.coalesce(found, none)).alias("s")).select("session_id", "s.kind", "s.slot", "seq", "s.ids")


def newest_slots(events: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Of a stream of slots those that change the fold: a turn or a final list that is newer than all before, an id that is new.

    The state of a session is the greatest seq of each slot, so events that come late or twice are told from new ones.
    It is dropped after ``idle_ms`` without events (None: never, for a run that ends: with timeouts Spark goes on making
    batches); slots that pass again after that are harmless, as the sink compares seq too.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = {tuple(k): v for k, v in json.loads(state.get[0])} if state.exists else {}
        fresh: dict[tuple, tuple] = {}
        for frame in frames:
            for kind, slot, seq, ids in zip(frame["kind"], frame["slot"], frame["seq"], frame["ids"], strict=True):
                known = seen.get((kind, slot))
                if known is None or (seq > known and kind in ("candidates", "final")):
                    seen[kind, slot] = int(seq)
                    fresh[kind, slot] = (key[0], kind, slot, int(seq), ids)
        state.update((json.dumps([[list(k), v] for k, v in seen.items()]),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        if fresh:
            yield pd.DataFrame(list(fresh.values()), columns=["session_id", "kind", "slot", "seq", "ids"])

    return slots(events).groupBy("session_id").applyInPandasWithState(step, SLOTS, "seen string", "update", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def fold_store(spark, root: str) -> VersionedStore:  # noqa: ANN001
    return VersionedStore(spark, root, {"fold": ["session_id"]})


def start(events: DataFrame, store: VersionedStore, checkpoint: str, name: str = "fold", every: str | None = None, idle_ms: int = IDLE_MS) -> StreamingQuery:
    """Fold a stream of events into ``store``: what there is now, or from now on ``every`` so often ("1 minute").

    A batch that is given again after a restart is known by its number and not taken twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.commit({"fold": Change(batch, ["session_id", "kind", "slot"], latest="seq")}, note=f"{name}:{number}")

    stream = newest_slots(events, idle_ms if every else None).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()


def folded(store: VersionedStore) -> DataFrame:
    """The fold so far: kind, session_id, turn (of candidates) and id."""
    rows = store.read("fold").select("kind", "session_id", F.when(F.col("kind") == "candidates", F.col("slot").cast("long")).alias("turn"), F.explode("ids").alias("id"))
    return rows.distinct()
