"""The knowledge base: versioned pages, links between them, listing and search."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("strategy", "knowledge")


def with_in_degree(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Adds in_degree, the number of links to a page in its namespace."""
    counts = links.groupBy(F.col("to_slug").alias("slug"), "namespace").agg(F.count("*").alias("in_degree"))
    return pages.join(counts, ["slug", "namespace"], "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))


def latest(pages: DataFrame) -> DataFrame:
    """Each page's last version; all versions are kept, so that any earlier day can be seen again."""
    columns = [c for c in pages.columns if c not in ("slug", "namespace")]
    last = pages.groupBy("slug", "namespace").agg(F.max_by(F.struct(*columns), "version").alias("_last"))
    return last.select("slug", "namespace", "_last.*").select(*pages.columns)


def put_pages(pages: DataFrame, new: DataFrame, now: datetime) -> DataFrame:
    """The rows to append for new or changed pages: the next version of each, with its first creation time.

    A kind that is not known is an error when the rows are made. Of several changes to one page at once
    the greatest by all columns counts.
    """
    known = latest(pages).select("slug", "namespace", F.col("version").alias("_version"), F.col("created_at").alias("_created"))
    kind = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind "), F.coalesce("kind", F.lit("null")))))
    fields = ["title", "body", "tags", "source"]
    one = new.withColumn("kind", kind).groupBy("slug", "namespace").agg(F.max(F.struct("kind", *fields)).alias("_new")).select("slug", "namespace", "_new.*")
    return one.join(known, ["slug", "namespace"], "left").select(
        "slug", "namespace", (F.coalesce("_version", F.lit(0)) + 1).cast("long").alias("version"), "title", "body", "kind", "tags", "source", F.coalesce("_created", F.lit(now)).alias("created_at"), F.lit(now).alias("updated_at")
    )


def get_page(pages: DataFrame, links: DataFrame, slug: str, namespace: str) -> DataFrame:
    """One page with the sorted slugs it links to. That there is no such page is an error when the row is made."""
    found = latest(pages.where((F.col("slug") == slug) & (F.col("namespace") == namespace))).select(F.struct("*").alias("page"))
    # The aggregate has a row also where there is nothing, and so can tell.
    missing = F.raise_error(F.lit(f"no page {slug!r} in namespace {namespace!r}")).cast(found.schema["page"].dataType)
    page = found.agg(F.first("page").alias("page")).select(F.coalesce("page", missing).alias("page")).select("page.*")
    out = links.where((F.col("from_slug") == slug) & (F.col("namespace") == namespace)).groupBy(F.col("from_slug").alias("slug")).agg(F.array_sort(F.collect_set("to_slug")).alias("links"))
    return page.join(out, "slug", "left").withColumn("links", F.coalesce("links", F.array().cast("array<string>")))


def new_links(pages: DataFrame, links: DataFrame, asked: DataFrame, now: datetime) -> DataFrame:
    """Those of the asked links (from_slug, to_slug, namespace) whose two pages exist and that are not there yet."""
    there = pages.select("slug", "namespace").distinct()
    both = asked.select("from_slug", "to_slug", "namespace").distinct()
    for end in ("from_slug", "to_slug"):
        both = both.join(there.withColumnRenamed("slug", end), [end, "namespace"], "left_semi")
    return both.join(links, ["from_slug", "to_slug", "namespace"], "left_anti").select("from_slug", "to_slug", "namespace", F.lit(now).alias("created_at"))


def list_pages(pages: DataFrame, links: DataFrame, namespace: str, since: datetime | None = None, until: datetime | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """Pages created in [since, until) with their in-degree, newest first, ties by slug."""
    some = latest(pages.where(F.col("namespace") == namespace))
    if since is not None:
        some = some.where(F.col("created_at") >= F.lit(since))
    if until is not None:
        some = some.where(F.col("created_at") < F.lit(until))
    return with_in_degree(some, links).orderBy(F.desc("created_at"), "slug").offset(offset).limit(limit)


def search(pages: DataFrame, query: str, namespace: str, kind: str | None = None, limit: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The best pages for a query by BM25 over title and body, ties by slug. Scores are those of this formula, not of another engine's."""
    words = F.filter(F.split(F.lower(F.concat_ws(" ", "title", "body")), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    some = latest(pages.where(F.col("namespace") == namespace))
    some = (some if kind is None else some.where(F.col("kind") == kind)).withColumn("words", words)
    asked = [w for w in dict.fromkeys("".join(c.lower() if c.isalnum() else " " for c in query).split())]
    stats = some.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"))
    hits = some.select("slug", F.size("words").alias("size"), F.explode("words").alias("word")).where(F.col("word").isin(*asked) if asked else F.lit(False)).groupBy("slug", "size", "word").agg(F.count("*").alias("tf"))
    df = hits.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    one = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    scored = hits.join(df, "word").crossJoin(F.broadcast(stats)).groupBy("slug").agg(F.sum(one).alias("score"))  # one row on the right
    return some.drop("words").join(scored, "slug").orderBy(F.desc("score"), "slug").limit(limit)
