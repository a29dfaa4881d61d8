"""Seeds: ids that an analyst's pages point to, weighted by age and links."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions.scalar import canonical_id, engagement, recency, tickers
from saltmarsh.operators.knowledge import with_in_degree
from saltmarsh.operators.pit import before, first_by, ticker_links


def read_seeds(pages: DataFrame, links: DataFrame, names: DataFrame, t0: date) -> DataFrame:
    """canonical_id, weight and slug: for each id the heaviest page from before the day whose tags name it.

    Tags that look like tickers are resolved as of the day; those that are not valid then are left out.
    """
    tagged = with_in_degree(before(pages, t0, "updated_at"), links).withColumn("ticker", F.explode(F.array_distinct(tickers(F.col("tags")))))
    found = tagged.join(ticker_links(names, t0), F.col("ticker") == F.col("key"))
    weighed = found.select(canonical_id(F.col("permno")).alias("canonical_id"), (recency(F.lit(t0), F.col("updated_at")) * engagement(F.col("in_degree"))).alias("weight"), "slug")
    return first_by(weighed, ["canonical_id"], [F.desc("weight"), F.asc("slug")])


def mention_weights(mentions: DataFrame, t0: date, half_life: float = 30.0) -> DataFrame:
    """From mentions (namespace, canonical_id, seen_on, conviction, prominence, slug): decayed sums, the top of each namespace being 1."""
    age = F.datediff(F.lit(t0), F.col("seen_on"))
    one = F.pow(F.lit(2.0), -age / half_life) * F.col("conviction") * F.col("prominence")
    summed = before(mentions, t0, "seen_on").withColumn("one", one).groupBy("namespace", "canonical_id").agg(
        F.sum("one").alias("raw"), F.min("seen_on").alias("first_seen"), F.max("seen_on").alias("last_seen"), F.count_distinct("slug").alias("n_pages"), F.max_by("slug", F.struct("one", "slug")).alias("top_slug")
    )
    top = summed.groupBy("namespace").agg(F.max("raw").alias("top"))
    return summed.join(top, "namespace").select("namespace", "canonical_id", F.coalesce(F.try_divide("raw", "top"), F.lit(0.0)).alias("weight"), "first_seen", "last_seen", "n_pages", "top_slug")
