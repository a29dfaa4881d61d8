"""Full-text search over a stored inverted index, many queries at once."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.sources.scratch import cut

K1, B = 1.2, 0.75
#: Folders of terms, and pages and words of a block at most, in the mean: a row of postings has no more than the pages of one block, and one task holds a block.
PARTS, BLOCK_PAGES, BLOCK_WORDS = 64, 4_000, 4_000_000
#: Files of a folder at most, the folder of the blocks' pages, and queries that are scored at once, in the mean.
FILES, PAGES, QUERIES = 4, -1, 1_000
#: Asked terms that are broadcast to the postings, at most.
FEW_TERMS = 200_000
#: A term's pages in a block, or, without a term, the block's pages.
POSTINGS = "namespace string, block int, term string, held int, bound double, pages array<int>, tfs array<int>, slugs array<string>, kinds array<string>, norms array<double>"
#: Blocks that are read first, to learn which score it takes to be among a query's best.
FIRST_BLOCKS = 2
#: Scores are whole millionths, so that sums do not depend on their order.
UNIT = 1_000_000


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def part_of(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def points(idf: Column, weight: Column) -> Column:
    """What a term adds to a score, in whole units. It grows with the weight, so the greatest weight bounds it."""
    return F.round(idf * weight * UNIT).cast("long")


def build(pages: DataFrame, path: str, parts: int = PARTS, block_pages: int = BLOCK_PAGES, k1: float = K1, b: float = B) -> None:
    """Write the index of ``pages`` (slug, namespace, kind, title, body) to ``path``.

    Pages are dealt by block (a hash of the slug) once, as their words; a task turns the words of a block into its postings.
    ``postings`` has a row for each term of a namespace and each block: the numbers of the pages that have it, how often each
    does, and bound, the greatest weight. The weight is BM25's part that depends on the page; ``terms`` has
    the part that depends on the term, which only counting all pages tells. Both lie in folders by a hash of the term
    and in order of the term, so a query reads the folders of its terms. What belongs to a page's number (slug, kind and norm,
    the page's share of the weight) is in a row without a term for each block, in the folder PAGES. Null titles and bodies are empty;
    a page without words is counted and never found.
    """
    spark = pages.sparkSession
    worded = pages.select("slug", "namespace", "kind", tokens(F.concat_ws(" ", "title", "body")).alias("words"))
    stats = cut(worded.groupBy("namespace").agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"), F.sum(F.size("words")).alias("total")))
    most = stats.agg(F.max("n").alias("n"), F.max("total").alias("total")).first()
    blocks = max(1, -(-(most["n"] or 0) // block_pages), -(-(most["total"] or 0) // BLOCK_WORDS))
    means = F.broadcast(stats) if stats.count() <= 100_000 else stats
    block = F.pmod(F.xxhash64("slug"), F.lit(blocks)).cast("int")
    texts = worded.where(F.size("words") > 0).select("namespace", block.alias("block"), "slug", "kind", F.array_join("words", " ").alias("text")).join(means.select("namespace", "mean"), "namespace")
    dealt = texts.repartition(tasks(spark, blocks), "namespace", "block").groupBy("namespace", "block")
    rows = dealt.applyInArrow(lambda table: block_postings(table, k1, b), POSTINGS).withColumn("part", F.when(F.col("term").isNull(), PAGES).otherwise(part_of(F.col("term"), parts)))
    rows.repartition("part", F.pmod("block", F.lit(FILES))).sortWithinPartitions("part", "namespace", "term").write.option("compression", "zstd").partitionBy("part").parquet(f"{path}/postings")
    counted = spark.read.parquet(f"{path}/postings").where(F.col("part") != PAGES).groupBy("part", "namespace", "term").agg(F.sum("held").alias("df")).join(means, "namespace")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    counted.select("part", "namespace", "term", "df", idf.alias("idf")).repartition("part").sortWithinPartitions("part", "namespace", "term").write.partitionBy("part").parquet(f"{path}/terms")
    spark.createDataFrame([(parts, blocks, k1)], "parts int, blocks int, k1 double").coalesce(1).write.parquet(f"{path}/layout")


def tasks(spark: SparkSession, blocks: int) -> int:
    """Tasks that blocks are dealt to: blocks have few bytes for their work, so they are not left to be coalesced by size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * blocks)


def weights(tf: np.ndarray, norm: np.ndarray, k1: float) -> np.ndarray:
    return tf * (k1 + 1) / (tf + norm)


def block_postings(table: pa.Table, k1: float, b: float) -> pa.Table:
    """Postings of one block out of its pages' words, and the row of its pages. Pages are numbered by slug, so ties by slug are ties by number."""
    words = pc.split_pattern(table["text"].combine_chunks(), " ")
    size = pc.list_value_length(words).to_numpy().astype(np.int64)
    rows = pa.table({"slug": table["slug"], "kind": table["kind"], "size": size})
    # Rows of one slug, kind and size are one page, as they are in a count by these.
    seen = rows.append_column("n", pa.array(np.ones(len(size)))).group_by(["slug", "kind", "size"]).aggregate([("n", "sum")])
    at = pc.sort_indices(seen, sort_keys=[("slug", "ascending"), ("kind", "ascending"), ("size", "ascending")], null_placement="at_start")
    seen = seen.take(at)
    order = pc.sort_indices(rows, sort_keys=[("slug", "ascending"), ("kind", "ascending"), ("size", "ascending")], null_placement="at_start").to_numpy()
    number = np.empty(len(size), np.int64)
    number[order] = np.repeat(np.arange(len(seen)), seen["n_sum"].to_numpy().astype(np.int64))
    coded = words.flatten().dictionary_encode()
    key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(seen) + np.repeat(number, size), return_counts=True)
    term, page = np.divmod(key, len(seen))
    norm = k1 * (1 - b + b * seen["size"].to_numpy() / table["mean"][0].as_py())
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    ends = np.append(starts, len(term)).astype(np.int32)
    n, whole = len(starts), pa.array([0, len(seen)], pa.int32())
    lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32), kind))
    own = lambda c, k: pa.table({"namespace": pa.repeat(table["namespace"][0], k), "block": pa.repeat(table["block"][0], k)} | c)
    nothing = lambda kind, k=n: pa.nulls(k, kind)
    held = own({
        "term": coded.dictionary.take(pa.array(term[starts])), "held": pa.array(np.diff(ends), pa.int32()), "bound": np.maximum.reduceat(weights(tf, norm[page], k1), starts),
        "pages": lists(page, pa.int32()), "tfs": lists(tf, pa.int32()), "slugs": nothing(pa.list_(pa.string())), "kinds": nothing(pa.list_(pa.string())), "norms": nothing(pa.list_(pa.float64())),
    }, n)
    numbers = nothing(pa.list_(pa.int32()), 1)
    listed = own({
        "term": nothing(pa.string(), 1), "held": nothing(pa.int32(), 1), "bound": nothing(pa.float64(), 1), "pages": numbers, "tfs": numbers,
        "slugs": pa.ListArray.from_arrays(whole, seen["slug"].combine_chunks()), "kinds": pa.ListArray.from_arrays(whole, seen["kind"].combine_chunks()), "norms": pa.ListArray.from_arrays(whole, pa.array(norm)),
    }, 1)
    return pa.concat_tables([held, listed])


def block_best(postings: pa.Table, asked: pa.Table, k1: float, limit: int) -> pa.Table:
    """query_id, slug and score of the ``limit`` best pages of one block for each of the queries ``asked`` (query_id, kind, term)."""
    pages, of_term = None, {}
    for batch in postings.to_batches():
        for i, (term, idf) in enumerate(zip(batch["term"].to_pylist(), batch["idf"].to_pylist(), strict=True)):
            if term is None:
                pages = {c: batch[c][i].values for c in ("slugs", "kinds", "norms")}
            else:
                of_term[term] = idf, batch["pages"][i].values.to_numpy(), batch["tfs"][i].values.to_numpy()
    if pages is None or not of_term:
        return pa.table({"query_id": asked["query_id"].slice(0, 0), "slug": pa.array([], pa.string()), "score": pa.array([], pa.int64())})
    norm = pages["norms"].to_numpy()
    for term, (idf, page, tf) in of_term.items():
        exact = idf * weights(tf, norm[page], k1) * UNIT
        down = np.floor(exact)
        of_term[term] = page, down + (exact - down >= 0.5)
    slugs, n = pages["slugs"], len(norm)
    coded = slugs.dictionary_encode(null_encoding="encode")
    firsts = np.flatnonzero(np.diff(coded.indices.to_numpy(), prepend=-1))  # several pages may have one slug
    queries = asked["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    terms = defaultdict(lambda: defaultdict(list))
    for query, kind, term in zip(queries.indices.to_pylist(), asked["kind"].to_pylist(), asked["term"].to_pylist(), strict=True):
        if term in of_term:
            terms[query][kind].append(term)
    found_of, slug_of, score_of = [], [], []
    for query, by_kind in terms.items():
        score, met = np.zeros(n), np.zeros(n, bool)
        for kind, held in by_kind.items():
            page = np.concatenate([of_term[t][0] for t in held])
            sums, times = np.bincount(page, np.concatenate([of_term[t][1] for t in held]), n), np.bincount(page, minlength=n) > 0
            if kind is not None:
                times &= pc.fill_null(pc.equal(pages["kinds"], kind), False).to_numpy(zero_copy_only=False)
            score += np.where(times, sums, 0)
            met |= times
        score, met = np.add.reduceat(score, firsts), np.logical_or.reduceat(met, firsts)
        some = np.flatnonzero(met)
        best = some[np.argsort(-score[some], kind="stable")[:limit]]
        found_of.append(np.full(len(best), query))
        slug_of.append(firsts[best])
        score_of.append(score[best])
    gathered = lambda parts: np.concatenate([*parts, np.empty(0)]).astype(np.int64)
    return pa.table({"query_id": queries.dictionary.take(pa.array(gathered(found_of))), "slug": slugs.take(pa.array(gathered(slug_of))), "score": gathered(score_of)})


class Index:
    """An index that ``build`` wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        layout = spark.read.parquet(f"{path}/layout").first()
        self.parts, self.blocks, self.k1 = layout["parts"], layout["blocks"], layout["k1"]

    def read(self, name: str, folders: list[int]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("part").isin(folders) if folders else F.lit(False))

    def asked(self, queries: DataFrame) -> tuple[DataFrame, list[int]]:
        """query_id, part, namespace, kind, term and idf of the terms that the index has, and the folders they lie in."""
        words = queries.select("query_id", "namespace", "kind", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).withColumn("part", part_of(F.col("term"), self.parts))
        folders = [r["part"] for r in words.select("part").distinct().collect()]  # no more than there are folders
        return words.join(self.read("terms", folders), ["part", "namespace", "term"]), folders

    def scored(self, asked: DataFrame, postings: DataFrame, chosen: DataFrame, limit: int, turns: int = 1) -> DataFrame:
        """query_id, slug and score of the ``limit`` best pages in each of the ``chosen`` (query_id, block).

        All postings of a block that a turn of queries asks for meet in one task, so a page's score is summed there and only
        the best leave it. Postings travel once for each turn; queries are dealt over turns of QUERIES in the mean.
        """
        keys = ["namespace", "block", "turn"]
        turn = F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int").alias("turn")
        wanted = asked.join(chosen, "query_id").withColumn("turn", turn)
        columns = [*keys, "term", "idf", "pages", "tfs", "slugs", "kinds", "norms"]
        terms = asked.select("part", "namespace", "term", "idf", turn).distinct()
        terms = F.broadcast(terms) if terms.count() <= FEW_TERMS else terms
        pairs = F.broadcast(chosen.select("block", turn).distinct())  # no more than blocks by turns
        rows = postings.join(terms, ["part", "namespace", "term"]).join(pairs, ["block", "turn"]).select(columns)
        listed = self.read("postings", [PAGES]).join(wanted.select(keys).distinct(), ["namespace", "block"]).withColumn("idf", F.lit(None).cast("double")).select(columns)
        n, k1 = tasks(self.spark, self.blocks * turns), self.k1
        left = rows.unionByName(listed).repartition(n, *keys).groupBy(keys)
        own = [f"_{k}" for k in keys]  # names of its own, as both sides come from ``wanted``
        right = wanted.select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), *(F.col(c).alias(c) for c in ("query_id", "kind", "term"))).repartition(n, *own).groupBy(own)
        out = T.StructType([wanted.schema["query_id"], T.StructField("slug", T.StringType()), T.StructField("score", T.LongType())])
        return left.cogroup(right).applyInArrow(lambda p, a: block_best(p, a, k1, limit), out)

    def search(self, queries: DataFrame, limit: int = 10, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
        """The ``limit`` best pages of each query by BM25: query_id, rank, slug and score, ties by slug.

        ``queries`` has query_id, text, namespace and kind (null: any). Each term counts once. A query without known terms has no rows.
        What a page can have of a block is bounded by the sum of its terms' bounds there. The blocks with the greatest
        sums over all queries are scored first, the same for all, so that few postings travel twice; after that only those are read whose sum
        reaches the query's last score so far, so all pages that belong to the result are found. No more than the ``limit`` best of a query and a block leave the task that scores it.
        """
        asked, folders = self.asked(queries)
        asked = cut(asked)
        turns = max(1, -(-asked.select("query_id").distinct().count() // QUERIES))
        postings = self.read("postings", folders)
        bounds = asked.join(postings.select("part", "namespace", "term", "block", "bound"), ["part", "namespace", "term"]).groupBy("query_id", "block").agg(F.sum(points(F.col("idf"), F.col("bound"))).alias("most"))
        bounds = cut(bounds)
        first = F.broadcast(bounds.groupBy("block").agg(F.sum("most").alias("sum")).orderBy(F.desc("sum"), "block").limit(first_blocks).select("block"))
        best = cut(top(self.scored(asked, postings, bounds.join(first, "block", "left_semi").select("query_id", "block"), limit, turns), limit))
        reached = best.groupBy("query_id").agg(F.when(F.count("*") >= limit, F.min("score")).alias("least"))
        left = cut(bounds.join(first, "block", "left_anti").join(reached, "query_id", "left").where("least is null or most >= least").select("query_id", "block"))
        if not left.isEmpty():
            best = top(best.drop("rank").unionByName(self.scored(asked, postings, left, limit, turns)), limit)
        return best.select("query_id", "rank", "slug", (F.col("score") / UNIT).alias("score"))


def top(scored: DataFrame, limit: int) -> DataFrame:
    """The best pages of each query. A rank that is bounded lets each task drop the rest before the exchange."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "slug"))).where(F.col("rank") <= limit)
