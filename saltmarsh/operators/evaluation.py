"""Scores of logged sessions: precision and recall, coverage, acceptance, and their aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saltmarsh.functions.scalar import f_beta
from saltmarsh.operators.order import quantiles
from saltmarsh.sources.scratch import cut

BETA = 0.5


def fold(events: DataFrame) -> dict[str, DataFrame]:
    """Session events to tables: candidates (session_id, turn, id), flags, accepts, dismisses and final labels.

    ``events`` has seq, the order of writing. A repeated turn replaces that turn's candidates, flags of
    all turns add up, and the last final list counts.
    """
    lists = events.where("event = 'candidates'").groupBy("session_id", "turn").agg(F.max_by("candidates.canonical_id", "seq").alias("ids"))
    final = events.where("event = 'a_final'").groupBy("session_id").agg(F.max_by("a_final_ids", "seq").alias("ids"))
    return {
        "candidates": lists.select("session_id", "turn", F.explode("ids").alias("id")).distinct(),
        "flags": events.where("event = 'flags'").select("session_id", F.explode("flags.canonical_id").alias("id")).distinct(),
        "accept": events.where("event = 'accept'").select("session_id", F.col("flag_id").alias("id")).distinct(),
        "dismiss": events.where("event = 'dismiss'").select("session_id", F.col("flag_id").alias("id")).distinct(),
        "final": final.select("session_id", F.explode("ids").alias("id")).distinct(),
        "labelled": final.select("session_id"),
        "sessions": events.select("session_id").distinct(),
    }


def score(folded: dict[str, DataFrame], beta: float = BETA, label: str = "final") -> DataFrame:
    """One row a session: precision, recall, f_beta, time_to_coverage and accept_precision, to 6 places, and the counts behind them.

    Precision is null without flags, recall without labels, and both without a final list. Coverage time
    is the last turn in which a label is first among the candidates, null unless all are. An id that
    was accepted and dismissed counts on both sides.
    """
    count = lambda name, alias: folded[name].groupBy("session_id").agg(F.count("*").alias(alias))
    hits = folded["flags"].join(folded[label], ["session_id", "id"]).groupBy("session_id").agg(F.count("*").alias("hits"))
    first = folded["candidates"].groupBy("session_id", "id").agg(F.min("turn").alias("turn"))
    covered = folded[label].join(first, ["session_id", "id"], "left").groupBy("session_id").agg(F.when(F.count("*") == F.count("turn"), F.max("turn")).alias("time_to_coverage"), F.count("turn").alias("n_covered_in_candidates"))
    out = folded["sessions"].join(folded["labelled"].withColumn("has_label", F.lit(True)), "session_id", "left")
    for one in (count("flags", "n_flags"), count(label, "n_labels"), hits, covered, count("accept", "n_accept"), count("dismiss", "n_dismiss")):
        out = out.join(one, "session_id", "left")
    out = out.fillna(0, ["n_flags", "n_labels", "hits", "n_accept", "n_dismiss", "n_covered_in_candidates"])
    out = out.withColumn("precision", F.when(F.col("has_label"), F.try_divide("hits", "n_flags"))).withColumn("recall", F.when(F.col("has_label"), F.try_divide("hits", "n_labels")))
    return out.select(
        "session_id", "n_flags", "n_labels", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f_beta(F.col("precision"), F.col("recall"), beta), 6).alias("f_beta"),
        "time_to_coverage", F.round(F.try_divide(F.col("n_accept"), F.col("n_accept") + F.col("n_dismiss")), 6).alias("accept_precision"),
        F.col("n_accept").alias("n_accepts"), F.col("n_dismiss").alias("n_dismisses"), "n_covered_in_candidates",
    )


def aggregate(scores: DataFrame) -> DataFrame:
    """Over sessions: their number, means without nulls, and the median coverage time."""
    scores = cut(scores)
    means = [F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("precision", "recall", "f_beta", "accept_precision")]
    (median,) = quantiles(scores, "time_to_coverage", (0.5,))
    return scores.agg(F.count("*").alias("n_sessions"), *means).withColumn("median_time_to_coverage", F.lit(median).cast("double"))


def lift(flags: DataFrame, accepted: DataFrame) -> DataFrame:
    """Mean place of the accepted flags in their session's list, 0 being the top. ``flags``: session_id, id, salience."""
    place = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("salience"), "id")) - 1
    ranked = flags.withColumn("place", place / F.count("*").over(W.partitionBy("session_id")))
    return ranked.join(accepted, ["session_id", "id"], "left_semi").groupBy("session_id").agg(F.round(F.avg("place"), 6).alias("lift"))


def feedback_rates(feedback: DataFrame) -> DataFrame:
    """Share of each of the four answers (tier: act, watch, known, noise) by session."""
    tiers = ("act", "watch", "known", "noise")
    return feedback.groupBy("session_id").agg(F.count("*").alias("n"), *(F.round(F.count_if(F.col("tier") == t) / F.count("*"), 6).alias(f"{t}_rate") for t in tiers))


def drift(flags: DataFrame, back: int = 3) -> DataFrame:
    """How far each session's flags (namespace, session_no, id) repeat those of the ``back`` sessions before.

    novelty: share not seen in them; overlap: Jaccard similarity with their union. Null for a first session.
    """
    one = flags.select("namespace", "session_no", "id").distinct()
    sizes = one.groupBy("namespace", "session_no").agg(F.count("*").alias("n"))
    window = sizes.select("namespace", "session_no", F.explode(F.sequence(F.lit(1), F.lit(back))).alias("k")).withColumn("earlier", F.col("session_no") - F.col("k"))
    past = window.join(one.withColumnRenamed("session_no", "earlier"), ["namespace", "earlier"]).select("namespace", "session_no", "id").distinct()
    shared = one.join(past, ["namespace", "session_no", "id"]).groupBy("namespace", "session_no").agg(F.count("*").alias("shared"))
    before = past.groupBy("namespace", "session_no").agg(F.count("*").alias("m"))
    joined = sizes.join(before, ["namespace", "session_no"], "left").join(shared, ["namespace", "session_no"], "left").fillna(0, ["shared"])
    return joined.select("namespace", "session_no", "n", F.when(F.col("m").isNotNull(), F.round(1 - F.col("shared") / F.col("n"), 6)).alias("novelty"), F.round(F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")), 6).alias("overlap"))


def sliced_precision(judged: DataFrame, slices: list[str]) -> DataFrame:
    """Precision of judged flags (column accepted) overall and by each slice column."""
    grouped = judged.groupingSets([[], *([s] for s in slices)], *slices)
    return grouped.agg(F.count("*").alias("n"), F.round(F.count_if("accepted") / F.count("*"), 6).alias("precision"))
