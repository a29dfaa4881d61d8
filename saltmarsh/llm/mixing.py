"""Mixing sources to target weights: random keys, prefix sums, and a cut at each source's exact budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from saltmarsh.llm.common import WORD_PATTERN, cut, renamed

#: Relative weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
MOST_EPOCHS = 3
#: Rows that share one prefix-sum bucket, on average.
ROWS_PER_BUCKET = 4096
#: The table of sources is broadcast up to so many rows (a few MB), and joined by a shuffle beyond.
MOST_BROADCAST_ROWS = 50_000


def count_words(text: Column) -> Column:
    """Words of a text; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Words to take of each source. ``sizes`` has one row per source: _key, source, source_size.

    All words are shared out by weight. A target stops at ``most_epochs`` times its source's size and
    the excess is shared again by weight. With the sources sorted by cap per weight, those that stop
    are a prefix, so running sums give the share per unit of weight without iterating. The table has
    one small row per source, which is why its windows may run in one task.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_cap = W.orderBy(F.col("_cap") / F.col("_weight"), F.col("_rank"))
    before, rest = by_cap.rowsBetween(W.unboundedPreceding, -1), by_cap.rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    share = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_weight").over(rest)
    stopped = F.col("_cap") / F.col("_weight") <= F.col("_share")
    return (
        sizes.withColumn("_rank", F.row_number().over(by_name))
        .withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") - 1) % len(weights) + 1))
        .withColumn("_cap", F.col("source_size") * most_epochs)
        .withColumn("_share", share)
        .withColumn("_level", F.max(F.when(~stopped, F.col("_share"))).over(everything))
        .withColumn("target", F.when(stopped, F.col("_cap").cast("double")).otherwise(F.col("_weight") * F.col("_level")))
        .select("_key", "source_size", "_n", "target")
    )


def with_sizes(docs: DataFrame) -> DataFrame:
    """Adds size (words of the text) and _tie (a hash of the text, to order rows of equal doc_id); columns of these names are replaced."""
    return docs.withColumns({"size": count_words(F.col("text")), "_tie": F.xxhash64("text")})


def mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds source_size, target and taken (words the mix takes of a row, repeats counted) to ``sized``.

    ``sized`` has doc_id, source, size and _tie (see ``with_sizes``) and any other columns, which are
    kept. A null source is a source of its own that sorts last; a null text has no words. Whole epochs
    of a source are taken as often as they fit; of the last one, rows are taken in the order of a hash
    of doc_id until the budget floor(target) is met exactly, so that one row may be taken in part. Rows
    with equal doc_id tie, and stand in order of size and _tie. An empty table gives an empty result.
    Columns source_size, target and taken of ``sized`` are replaced.

    The order is found without gathering a source in one task: the hash range of each source is cut
    into buckets of about ``rows_per_bucket`` rows, the sums of the buckets are added up, and each
    bucket adds its own rows to what came before it.
    """
    own = [c for c in sized.columns if c not in ("source_size", "target", "taken")]
    keyed = sized.select(
        *own,
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_key"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_draw"),
    )
    slim = keyed.select("_key", "source", "size", "_draw")
    sizes = slim.groupBy("_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    targets = cut(source_targets(sizes, weights, most_epochs))
    if targets.count() <= MOST_BROADCAST_ROWS:
        targets = F.broadcast(targets)
    place = F.conv(F.substring("_draw", 1, 8), 16, 10).cast("long")
    bucket = F.floor(place * F.ceil(F.col("_n") / rows_per_bucket) / F.lit(2**32)).cast("long")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(targets, "_key").withColumn("_bucket", bucket)

    up_to = W.partitionBy("_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed(slim)
        .groupBy("_key", "_bucket")
        .agg(F.sum("size").alias("_sum"))
        .select("_key", "_bucket", F.coalesce(F.sum("_sum").over(up_to), F.lit(0)).alias("_offset"))
    )
    inside = W.partitionBy("_key", "_bucket").orderBy("_draw", "size", "_tie").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    part = F.least(F.greatest(budget - epochs * F.col("source_size") - before, F.lit(0)), F.col("size"))
    return placed(keyed).join(offsets, ["_key", "_bucket"]).select(*own, "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def mixed_corpus(docs: DataFrame) -> DataFrame:
    """The mixed corpus itself: a row of ``docs`` for each epoch that it is taken in, with all columns, whatever their names.

    Of a document that is taken in part in its last epoch, the first words are left, joined by single
    spaces, and its n_chars (if there is such a column) becomes the length of what is left.
    """
    rows, new = renamed(docs)
    text = F.col(new["text"]).cast("string")
    named = rows.select(*new.values(), F.col(new["doc_id"]).alias("doc_id"), F.col(new["source"]).alias("source"), count_words(text).alias("size"), F.xxhash64(text).alias("_tie"))
    mixed = mix(named)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)))).otherwise(0).cast("int")
    left = (F.col("taken") - whole * F.col("size")).cast("int")
    copies = F.when(left > 0, F.array_append(F.array_repeat(F.lit(-1), whole), left)).otherwise(F.array_repeat(F.lit(-1), whole))
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0)), 1, F.greatest(F.col("_left"), F.lit(0))), " ")
    out = mixed.select(*new.values(), F.explode(copies).alias("_left")).withColumn(new["text"], F.when(F.col("_left") < 0, text).otherwise(first))
    if "n_chars" in new:
        out = out.withColumn(new["n_chars"], F.when(F.col("_left") < 0, F.col(new["n_chars"])).otherwise(F.length(new["text"])).cast("long"))
    return out.select(*new.values()).toDF(*docs.columns)
