"""Queries of the operators for large data: stored index, merged as-of joins, exact order statistics, versions, streams, shards, walks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.functions import scalar
from saltmarsh.operators import asof, edges, graph, order, search, signals
from saltmarsh.plans.queries import SEED_IDS, T0, _custkey_links, _flags, _logged, _pairs, _spans, _supplier_rows, r6
from saltmarsh.sources import bars as bar_sources
from saltmarsh.sources import store, versions
from saltmarsh.sources.derived import Star
from saltmarsh.sources.scratch import cut, fresh
from saltmarsh.streaming import fold

FIRST_DAY, LAST_DAY = date(1996, 3, 1), date(1998, 6, 30)


# ---- search


def page_index_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents for each benchmark item, out of an index of all documents, by BM25 over their words."""
    star, path = Star(spark, d), fresh(spark, "index")
    pages = star.table("documents").select(F.col("doc_id").cast("string").alias("slug"), F.lit("main").alias("namespace"), F.col("lang").alias("kind"), F.lit(None).cast("string").alias("title"), F.col("text").alias("body"))
    search.build(pages, path)
    asked = star.table("benchmark").select(F.col("item_id").alias("query_id"), "text", F.lit("main").alias("namespace"), F.lit(None).cast("string").alias("kind"))
    return search.Index(spark, path).search(asked).select("query_id", "rank", "slug", r6("score"))


# ---- as-of joins


def _by_day(star: Star) -> DataFrame:
    return star.table("orders").select(F.col("o_custkey").cast("string").alias("identifier"), F.date_add(F.col("o_orderdate").cast("date"), 50).alias("day"))


def ids_over_days(spark: SparkSession, d: str) -> DataFrame:
    """All kinds of ids resolved for each customer on the days 50 days after its orders, and part names on the days of orders."""
    star = Star(spark, d)
    asks, spans, names = _by_day(star), cut(_spans(star)), star.names()
    tickers = star.table("orders").select(F.element_at(F.array(*map(F.lit, ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("identifier"), F.col("o_orderdate").cast("date").alias("day"))
    parts = star.table("orders").select((F.col("o_orderkey") % 400).cast("string").alias("identifier"), F.col("o_orderdate").cast("date").alias("day"))
    of = {"gvkey": (asks, star.links()), "secid": (asks, spans), "ibes_ticker": (asks.select(F.concat(F.lit("T"), "identifier").alias("identifier"), "day"), spans), "permno_secid": (asks, spans), "ticker": (tickers, names), "permno_ticker": (parts, names), "permno_siccd": (parts, names)}
    out = None
    for kind, (asked, links) in of.items():
        one = asof.resolve_days(asked, links, kind).select(F.lit(kind).alias("id_type"), "identifier", "day", F.col("value").cast("string").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


# ---- quantiles and ranks


def price_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles of all line items' prices, of their quantities (which tie), and of the customers' balances."""
    star, shares = Star(spark, d), (0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0)
    rows = []
    for table, column in (("lineitem", "l_extendedprice"), ("lineitem", "l_quantity"), ("customer", "c_acctbal")):
        rows += [(column, p, q) for p, q in zip(shares, order.quantiles(star.table(table), column, shares), strict=True)]
    return spark.createDataFrame(rows, "column_name string, share double, value double").select("column_name", "share", F.round("value", 4).alias("value"))


def price_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Average rank of each order's whole price (ties share theirs) among the orders of its priority."""
    rows = Star(spark, d).table("orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.floor(F.col("o_totalprice") / 100).alias("price"))
    return order.average_ranks(rows, "priority", "price").select("o_orderkey", F.col("avg_rank"), F.col("n_group"))


# ---- bars by key


def stored_signals(spark: SparkSession, d: str) -> DataFrame:
    """The four signals as z-scores from bars that are stored by id, so that they are read without an exchange."""
    star = Star(spark, d)
    bars = bar_sources.store_bars(star.bars())
    wide = signals.zscores(signals.all_signals(bars, star.market(bars)))
    return wide.select("permno", *(r6(n) for n in signals.NAMES))


def yearly_bars(spark: SparkSession, d: str) -> DataFrame:
    """Supplier days of three years out of yearly tables, of which those after 1996 have one column more."""
    star, path = Star(spark, d), fresh(spark, "shards")
    days = star.table("lineitem").groupBy(F.col("l_suppkey").alias("secid"), F.col("l_shipdate").cast("date").alias("date")).agg(F.max("l_extendedprice").alias("price"), F.max("l_tax").alias("tax"))
    days = cut(days.where(F.year("date") < 2000))
    years = [r[0] for r in days.select(F.year("date")).distinct().collect()]
    for year in years:
        one = days.where(F.year("date") == year)
        (one if year > 1996 else one.drop("tax")).write.parquet(f"{path}/bars{year}")
    return bar_sources.YearlyTables(spark, f"{path}/bars{{year}}", years, "secid long, date date, price double, tax double").read(FIRST_DAY, LAST_DAY)


# ---- versions


def edges_stored(spark: SparkSession, d: str) -> DataFrame:
    """``edge_upsert`` through the store: two commits of edges, read as of each."""
    kept = cut(Star(spark, d).graph().withColumn("provenance", F.lit("derived")))
    root = fresh(spark, "edges")
    kept_edges = versions.VersionedStore(spark, root, {"edges": ["src", "dst"]})
    keys = ["src", "dst", "kind", "provenance"]
    first = kept_edges.commit({"edges": versions.Change(kept.where("src % 2 = 0"), keys)})
    second = kept_edges.commit({"edges": versions.Change(kept.where("src % 3 = 0").withColumn("weight", F.col("weight") + 1), keys)})
    out = [kept_edges.read("edges", v).select(F.lit(v).cast("long").alias("version"), "src", "dst", r6("weight")) for v in (first, second)]
    return out[0].unionByName(out[1])


def _session_rows(star: Star) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    flags = _flags(star).withColumn("canonical_id", scalar.canonical_id(F.col("id"))).drop("id")
    sessions = flags.groupBy("session_id").agg(F.count("*").alias("n_flags"))
    keys = flags.select("session_id", "canonical_id")
    sheets = keys.withColumn("company", F.concat(F.lit("company "), "canonical_id"))
    news = keys.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(2)))).withColumn("title", F.concat_ws(" ", F.lit("news"), F.col("rank").cast("string"), "canonical_id"))
    return sessions, flags, sheets, news


def _session_store(spark: SparkSession, d: str) -> versions.VersionedStore:
    """All sessions, then every third one replaced by its stronger flags, without headlines."""
    sessions, flags, sheets, news = map(cut, _session_rows(Star(spark, d)))
    store = versions.session_store(spark, fresh(spark, "sessions"))
    versions.replace_sessions(store, sessions, flags, sheets, news)
    third = flags.where("session_id % 3 = 0 and salience > 1")
    fewer = sessions.where("session_id % 3 = 0").withColumn("n_flags", F.lit(-1).cast("long"))
    versions.replace_sessions(store, fewer, third, sheets.join(third.select("session_id", "canonical_id"), ["session_id", "canonical_id"], "left_semi"), news.limit(0))
    return store


def _session_counts(store: versions.VersionedStore, version: int) -> DataFrame:
    count = lambda t: store.read(t, version).groupBy("session_id").agg(F.count("*").alias(t))
    out = store.read("sessions", version)
    for t in ("flags", "tearsheets", "headlines"):
        out = out.join(count(t), "session_id", "left")
    return out.fillna(0).select(F.lit(version).cast("long").alias("version"), "session_id", "n_flags", "flags", "tearsheets", "headlines")


def sessions_stored(spark: SparkSession, d: str) -> DataFrame:
    """Flags and children of each session, before and after a third of the sessions was replaced in one commit."""
    store = _session_store(spark, d)
    return _session_counts(store, 1).unionByName(_session_counts(store, 2))


def children_stored(spark: SparkSession, d: str) -> DataFrame:
    """Headlines of all flags after those of even ids were given one new headline each, and a session in five was deleted."""
    store = _session_store(spark, d)
    even = store.read("flags").where("try_cast(substring(canonical_id, 8) as int) % 2 = 0").select("session_id", "canonical_id")
    versions.replace_children(store, even.withColumn("company", F.lit("new")), even.select("*", F.lit(1).alias("rank"), F.lit("fresh").alias("title")))
    versions.delete_sessions(store, store.read("sessions").where("session_id % 5 = 0"))
    return store.read("flags").join(store.read("headlines"), ["session_id", "canonical_id"]).select("session_id", "canonical_id", "rank", "title")


# ---- streams


def streamed_fold(spark: SparkSession, d: str) -> DataFrame:
    """``event_fold`` from a stream: the log in files that are read a few at a time, folded with state into the store."""
    source, root = fresh(spark, "log"), fresh(spark, "fold")
    _logged(Star(spark, d)).repartition(6, "seq").write.json(source)
    events = spark.readStream.schema(_logged(Star(spark, d)).schema).option("maxFilesPerTrigger", 3).json(source)
    store = fold.fold_store(spark, root)
    fold.start(events, store, f"{root}/checkpoint").awaitTermination()
    return fold.folded(store).select("kind", F.col("session_id").cast("long").alias("session_id"), "turn", F.col("id").cast("int").alias("id"))


# ---- graphs


def paths_between(spark: SparkSession, d: str) -> DataFrame:
    """Shortest paths of at most 6 hops from the seeds to every fifth supplier."""
    star = Star(spark, d)
    start = spark.createDataFrame([(i,) for i in SEED_IDS], "node long")
    targets = star.table("supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("node"))
    found = graph.shortest_paths(start, graph.adjacency(star.graph(2.5), T0), 6, targets, steps=False)
    return found.select("node", "hops", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the graph as text, how often each is an end of an edge, and whether the list of ids has it once."""
    kept = cut(Star(spark, d).graph())
    ids = graph.nodes(kept).select(scalar.canonical_id(F.col("node")).alias("canonical_id"))
    ends = kept.select(F.explode(F.array("src", "dst")).alias("node")).groupBy(scalar.canonical_id(F.col("node")).alias("canonical_id")).agg(F.count("*").alias("n_ends"))
    twice = graph.duplicate_nodes(ids).select("canonical_id", F.lit(True).alias("twice"))
    return ids.join(ends, "canonical_id").join(twice, "canonical_id", "left").select("canonical_id", "n_ends", F.col("twice").isNull().alias("is_unique"))


# ---- loads that count what they write


def observed_peer_load(spark: SparkSession, d: str) -> DataFrame:
    """The counters of ``peer_load_counters``, taken while the edges are written."""
    star, path = Star(spark, d), fresh(spark, "peers")
    got = edges.load_peer_edges(_pairs(star), _custkey_links(star), T0, path, min_score=1.2)
    return spark.createDataFrame([tuple(got[k] for k in ("rows", "skipped_score", "unresolved", "written", "nodes"))], "rows long, skipped_score long, unresolved long, written long, nodes long")


def observed_comovement_load(spark: SparkSession, d: str) -> DataFrame:
    """Counters of the co-movement load, taken while the edges are written."""
    star, path = Star(spark, d), fresh(spark, "comoves")
    bars = cut(star.bars().select("permno", "date", "ret"))
    got = edges.load_comovement_edges(bars, star.market(bars), T0, path, window=252, least=60, threshold=0.1)
    names = ("edges_written", "pairs_above_threshold", "stocks_used", "stocks_dropped_min_obs", "nodes_merged")
    return spark.createDataFrame([tuple(got[k] for k in names)], ", ".join(f"{n} long" for n in names))


# ---- sources and what is shown


def rest_bars_read(spark: SparkSession, d: str) -> DataFrame:
    """Bars of a bar service's responses: one for each supplier but every seventh; every fifth supplier has no id."""
    star, path = Star(spark, d), fresh(spark, "responses")
    bars = star.bars()
    one = F.struct(F.unix_millis(F.col("date").cast("timestamp")).alias("t"), F.when(F.col("permno") % 2 == 0, F.col("open")).otherwise(0.0).alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").cast("double").alias("v"))
    ticker = lambda c: F.concat(F.lit("T"), c.cast("string"))
    bars.where("permno % 7 <> 0").groupBy(ticker(F.col("permno")).alias("ticker")).agg(F.collect_list(one).alias("results")).write.json(path)
    known = star.table("supplier").where("s_suppkey % 5 <> 0").select(ticker(F.col("s_suppkey")).alias("ticker"), F.col("s_suppkey").alias("permno"))
    return bar_sources.rest_bars(bar_sources.read_rest_bars(spark, path), known).select("permno", "date", "open", "close", r6("ret"))


def tickers_skipped(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers asked for that give no bars, and why."""
    star = Star(spark, d)
    ticker = lambda c: F.concat(F.lit("T"), c.cast("string"))
    asked = star.table("supplier").select(ticker(F.col("s_suppkey")).alias("ticker"), F.when(F.col("s_suppkey") % 5 > 0, F.col("s_suppkey")).alias("permno"))
    responses = star.table("lineitem").where("l_suppkey % 7 <> 0").groupBy(ticker(F.col("l_suppkey")).alias("ticker")).agg(F.when(F.max("l_suppkey") % 11 > 0, F.collect_list("l_orderkey")).alias("results"))
    return bar_sources.skipped_tickers(asked, responses)


def pair_file_read(spark: SparkSession, d: str) -> DataFrame:
    """Scored pairs from a text file with lines of other widths, which are counted by width."""
    star, path = Star(spark, d), fresh(spark, "pairs")
    part = star.table("part")
    line = F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("broken "), F.col("p_partkey"))).when(F.col("p_partkey") % 10 == 1, F.lit("  ")).otherwise(F.concat_ws(" \t", F.col("p_partkey"), F.col("p_size"), F.concat(F.lit("0."), F.col("p_size"))))
    part.select(F.explode(F.array(F.lit("Gvkey1 GVKEY2  score"), F.concat(F.lit(" "), line))).alias("value")).write.text(path)
    read = bar_sources.read_pairs(spark, path).agg(F.lit(3).alias("n_fields"), F.count("*").alias("n_lines"), F.round(F.sum(F.col("score").cast("double")), 4).alias("total"))
    return read.unionByName(bar_sources.bad_lines(spark, path).withColumn("total", F.lit(None).cast("double")))


def event_log_read(spark: SparkSession, d: str) -> DataFrame:
    """Events appended to a log in two batches, with lines that are no events among them, and what is read back of each session."""
    path = fresh(spark, "events")
    events = Star(spark, d).session_events().where("id is not null")
    logged = events.select("event", F.col("session_id").cast("string").alias("session_id"), F.timestamp_seconds(F.col("event_id")).alias("timestamp"), "turn", F.col("id").cast("string").alias("flag_id"))
    store.append_events(logged.where("turn <= 10"), path)
    store.append_events(logged.where("turn > 10"), path)
    events.select(F.lit("not an event {").alias("value")).write.mode("append").text(path)
    back = store.read_events(spark, path)
    return back.groupBy("session_id").agg(F.count("*").alias("n_events"), F.max_by("flag_id", "timestamp").alias("last_id"))


def tickers_read_through(spark: SparkSession, d: str) -> DataFrame:
    """Tickers of customers from a cache that is filled as it is read: how many are in it before, and after each of two reads."""
    star = Star(spark, d)
    cache = versions.VersionedStore(spark, fresh(spark, "tickers"), {"tickers": ["canonical_id"]})
    ids = star.table("customer").select(scalar.canonical_id(F.col("c_custkey")).alias("canonical_id"), "c_custkey")
    source = ids.where("c_custkey % 3 > 0").select("canonical_id", F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker"))
    look_up = lambda missing: missing.join(source, "canonical_id")
    store.cached_tickers(cache, ids.where("c_custkey % 2 = 0"), look_up)
    read = store.cached_tickers(cache, ids, look_up)
    first = cache.read("tickers", 1).select("canonical_id", F.lit(True).alias("was_cached"))
    return read.join(first, "canonical_id", "left").select("canonical_id", "ticker", F.coalesce("was_cached", F.lit(False)).alias("was_cached"))


def supplier_spans(spark: SparkSession, d: str) -> DataFrame:
    """The readable line of each supplier edge without a share, and the start of those with one."""
    found = edges.supplier_edges(_supplier_rows(spark, d, states=True))
    return found.select("src", "dst", "fiscal_year", F.when(F.col("weight").isNull(), F.col("source_span")).otherwise(F.regexp_extract("source_span", r"^(.* \()", 1)).alias("span"))


def flag_cards(spark: SparkSession, d: str) -> DataFrame:
    """Flags as a list shows them: label, money, time of day, and the two filters."""
    star = Star(spark, d)
    flags = star.table("orders").select("o_orderkey", scalar.canonical_id(F.col("o_custkey")).alias("cid"), (F.col("o_totalprice") / 400_000).alias("salience"), (F.col("o_orderkey") % 2 == 0).alias("near"), (F.floor("o_totalprice") * 5_000).alias("worth"))
    at = F.timestamp_seconds(F.col("o_orderkey") * 61)
    label = scalar.label(F.when(F.col("o_orderkey") % 3 == 0, "TICK"), F.when(F.col("o_orderkey") % 3 == 1, "LOOK"), F.col("cid"))
    kept = flags.where(scalar.shown(F.col("salience"), F.col("near"), 0.25, frontier_only=True))
    return kept.select("o_orderkey", label.alias("label"), scalar.clock(at).alias("clock"), F.regexp_extract(scalar.usd(F.col("worth")), r"([BM]?)$", 1).alias("unit"))


NAMES = (
    "rest_bars_read tickers_skipped pair_file_read event_log_read tickers_read_through supplier_spans flag_cards page_index_search ids_over_days price_quantiles price_ranks stored_signals yearly_bars edges_stored sessions_stored children_stored streamed_fold paths_between graph_nodes observed_peer_load observed_comovement_load"
).split()
