"""The domain's shapes made from a star schema of orders, line items, parts, suppliers and events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saltmarsh.sources.bars import returns

#: The day as of which the registered queries look.
T0 = date(2001, 7, 1)
EVENTS_T0 = date(2024, 1, 29)
#: Line items of a task that pairs suppliers: their pairs are a table in its memory.
LINES_A_TASK = 250_000


class Star:
    """Tables of one folder, and the shapes derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def bars(self, t0: date = T0) -> DataFrame:
        """Weekly bars of suppliers before a day: first and last price, range, quantity, return, and balance as shares.

        Lines are dealt by supplier once, which serves the weeks and the close before; weeks have few lines, so summing them up before the exchange saves little.
        """
        lines = self.table("lineitem").where(F.col("l_shipdate") < F.lit(t0)).select(F.col("l_suppkey").alias("permno"), "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("p"), F.col("l_quantity").alias("q"))
        order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "p")
        week = lines.repartition("permno").groupBy("permno", F.date_trunc("week", "l_shipdate").cast("date").alias("date")).agg(
            F.min_by("p", order).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", order).alias("close"), F.sum("q").alias("volume")
        )
        shares = self.table("supplier").select(F.col("s_suppkey").alias("permno"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("shrout"))
        return returns(week).join(shares, "permno", "left")

    def market(self, bars: DataFrame) -> DataFrame:
        return bars.groupBy("date").agg(F.avg("ret").alias("mkt")).where("mkt is not null")

    def sectors(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("permno"), (F.col("s_nationkey") * 400).alias("siccd"))

    def links(self) -> DataFrame:
        """A link history: each customer's clerk (the last digits of the order) until the next order."""
        orders = self.table("orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("d"), "o_orderkey")
        day = orders.groupBy("o_custkey", "d").agg(F.max("o_orderkey").alias("o_orderkey"))
        nxt = F.lead("d").over(W.partitionBy("o_custkey").orderBy("d"))
        return day.select(
            F.col("o_custkey").cast("string").alias("gvkey"), (F.col("o_orderkey") % 1000).alias("lpermno"), F.when(F.col("o_orderkey") % 7 == 0, "XX").otherwise("LC").alias("linktype"),
            F.when(F.col("o_orderkey") % 5 == 0, "C").otherwise("P").alias("linkprim"), F.col("d").alias("linkdt"), F.date_sub(nxt, 1).alias("linkenddt"), F.col("o_custkey").alias("secid"), (F.col("o_orderkey") % 9).alias("score"),
        )

    def names(self) -> DataFrame:
        """A name history: the first word of a part's type as ticker, valid for 2,000 days."""
        start = F.date_add(F.lit(date(1995, 1, 1)), (F.col("p_partkey") % 2000).cast("int"))
        return self.table("part").select(F.split("p_type", " ")[0].alias("ticker"), F.col("p_partkey").alias("permno"), (F.col("p_size") * 100).cast("string").alias("siccd"), start.alias("namedt"), F.date_add(start, 2000).alias("nameenddt"))

    def _meetings(self) -> DataFrame:
        """a, b and score of ``pairs`` with a < b. Lines are dealt by order once, for their distinct rows, their counts and the pairs."""
        lines = self.table("lineitem").select("l_orderkey", "l_suppkey")
        # Orders have few bytes and many pairs, so their parts are counted by rows and not left to be coalesced by size.
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // LINES_A_TASK))
        lines = lines.repartition(parts, "l_orderkey").distinct()
        alone = lines.groupBy("l_suppkey").agg(F.count("*").alias("n"))
        orders = lines.agg(F.count_distinct("l_orderkey").alias("orders"))
        both = lines.select("l_orderkey", F.col("l_suppkey").alias("a")).join(lines.select("l_orderkey", F.col("l_suppkey").alias("b")), "l_orderkey").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_ab"))
        joined = both.join(alone.withColumnsRenamed({"l_suppkey": "a", "n": "n_a"}), "a").join(alone.withColumnsRenamed({"l_suppkey": "b", "n": "n_b"}), "b").crossJoin(F.broadcast(orders))  # one row on the right
        return joined.select("a", "b", (F.col("n_ab") * F.col("orders") / (F.col("n_a") * F.col("n_b"))).alias("score"))

    def pairs(self) -> DataFrame:
        """Scored pairs of suppliers that ship lines of one order, in both directions: how much more often than by chance."""
        there, back = F.struct("a", "b", "score"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "score")
        return self._meetings().select(F.inline(F.array(there, back)))

    def graph(self, least: float = 1.4) -> DataFrame:
        """Peer edges of the pairs above a score, with the kind and a span that depend on the ends."""
        kept = self._meetings().where(F.col("score") >= least)
        kind = F.when((F.col("a") + F.col("b")) % 5 == 0, "SUPPLIES").when((F.col("a") + F.col("b")) % 5 == 1, "COMOVES_WITH").otherwise("COMPETES_WITH")
        span = F.when((F.col("a") + F.col("b")) % 10 == 0, F.concat(F.lit("supplier "), F.col("a").cast("string")))
        return kept.select(F.col("a").alias("src"), F.col("b").alias("dst"), kind.alias("kind"), F.round("score", 6).alias("weight"), (kind == "SUPPLIES").alias("directed"), F.date_add(F.lit(date(2001, 6, 1)), ((F.col("a") * F.col("b")) % 40).cast("int")).alias("as_of"), span.alias("source_span"))

    def session_events(self) -> DataFrame:
        """Session events (session, turn, kind, item) of users by day."""
        kinds = {"view": "candidates", "click": "flags", "purchase": "accept", "error": "dismiss", "signup": "a_final"}
        kind = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[F.col("event_type")]
        item = F.get_json_object("props", "$.k").try_cast("int")
        return self.table("events").select(F.col("user_id").alias("session_id"), F.dayofmonth("ts").cast("long").alias("turn"), kind.alias("event"), item.alias("id"), "event_id")

    def folded(self) -> dict[str, DataFrame]:
        """Session events as the tables that scoring takes."""
        events = self.session_events().where("id is not null")
        of = lambda kind: events.where(F.col("event") == kind)
        out = {name: of(kind).select("session_id", "id").distinct() for name, kind in (("flags", "flags"), ("accept", "accept"), ("dismiss", "dismiss"), ("final", "a_final"))}
        return out | {"candidates": of("candidates").select("session_id", "turn", "id").distinct(), "labelled": of("a_final").select("session_id").distinct(), "sessions": events.select("session_id").distinct()}

    def pages(self) -> tuple[DataFrame, DataFrame]:
        """Pages and links: an order is a page tagged by its parts' types, and links to the customer's order before it."""
        tags = self.table("lineitem").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.split("p_type", " ")[0])).alias("tags"))
        orders = self.table("orders").join(tags, F.col("o_orderkey") == F.col("l_orderkey"))
        slug = F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))
        pages = orders.select(slug.alias("slug"), F.lit("main").alias("namespace"), "tags", F.col("o_orderdate").cast("date").alias("updated_at"), F.col("o_orderdate").cast("date").alias("created_at"), F.lit(1).alias("version"))
        back = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
        links = self.table("orders").select(slug.alias("from_slug"), back.alias("b")).where("b is not null").select("from_slug", F.concat(F.lit("order-"), F.col("b").cast("string")).alias("to_slug"), F.lit("main").alias("namespace"))
        return pages, links
