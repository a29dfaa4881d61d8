"""Registered queries: each takes a session and a folder of star-schema tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saltmarsh.functions import scalar
from saltmarsh.operators import edges, evaluation, graph, knowledge, pit, scoring, seeds, signals
from saltmarsh.sources import bars as bar_sources
from saltmarsh.sources import store
from saltmarsh.sources.derived import EVENTS_T0, T0, Star
from saltmarsh.sources.scratch import cut

SEED_IDS = (1, 2, 3)


def r6(name: str) -> F.Column:
    return F.round(name, 6).alias(name)


def bar_derivation(spark: SparkSession, d: str) -> DataFrame:
    return Star(spark, d).bars().select("permno", "date", "open", "high", "low", "close", "volume", r6("ret"), "shrout")


def market_series(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    return star.market(star.bars()).select("date", r6("mkt"))


def _signal(of):  # noqa: ANN001, ANN202
    def query(spark: SparkSession, d: str) -> DataFrame:
        return of(Star(spark, d)).select("permno", r6("value"))

    return query


rv_spike = _signal(lambda s: signals.realized_vol_spike(s.bars()))
abnormal_volume = _signal(lambda s: signals.abnormal_volume(s.bars()))
abnormal_volume_window = _signal(lambda s: signals.abnormal_volume(s.bars(), window=60))
gap = _signal(lambda s: signals.gap(s.bars()))


def dislocation(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    bars = star.bars()
    return signals.dislocation(bars, star.market(bars)).select("permno", r6("value"))


def zscore_signals(spark: SparkSession, d: str) -> DataFrame:
    return signals.zscore(signals.abnormal_volume(Star(spark, d).bars())).select("permno", r6("z"))


def top_vol_spikes(spark: SparkSession, d: str) -> DataFrame:
    z = signals.zscore(signals.realized_vol_spike(Star(spark, d).bars())).select("permno", r6("z"))
    return z.orderBy(F.desc("z"), "permno").limit(20)


def composite_attention(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    bars = cut(star.bars())  # the market and the signals both read them
    scored = scoring.composites(bars, star.market(bars))
    return scored.select("permno", *(r6(c) for c in (*signals.NAMES, "composite")))


def cap_quintile(spark: SparkSession, d: str) -> DataFrame:
    return scoring.cap_quintiles(cut(scoring.last_caps(Star(spark, d).bars()))).select("permno", "mktcap", "cap_q")


def bucket_salience(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    bars = star.bars()
    records = signals.abnormal_volume(bars).select("permno", F.round("value", 6).alias("composite")).join(star.sectors(), "permno", "left").join(scoring.last_caps(bars), "permno", "left")
    return scoring.salience(cut(records)).select("permno", "bucket", "composite", r6("salience"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    bars = cut(star.bars())  # the market and the signals both read them
    return scoring.candidates(bars, star.market(bars), star.sectors(), T0)


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """All columns of the candidates, in their order; the map of components as text."""
    parts = F.concat_ws(" ", *(F.format_string(f"{n}=%.4f", F.round(F.col("components")[n], 4) + F.lit(0.0)) for n in signals.NAMES))
    found = _candidates(spark, d)
    return found.select(*(c for c in found.columns if c not in ("salience", "attention", "components")), r6("salience"), r6("attention"), parts.alias("components")).orderBy(F.desc("salience"), "canonical_id")


def ranked_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("canonical_id", "measure", "coverage", "has_options", r6("attention"))


def asof_link_resolve(spark: SparkSession, d: str) -> DataFrame:
    return pit.gvkey_links(Star(spark, d).links(), date(1999, 6, 30))


def batch_resolve(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    keys = star.table("customer").select(F.col("c_custkey").cast("string").alias("identifier"), F.lit("gvkey").alias("id_type"))
    tags = star.table("part").select(F.split("p_type", " ")[0].alias("identifier"), F.lit("ticker").alias("id_type"))
    return pit.resolve_batch(keys.unionByName(tags), {"gvkey": star.links(), "ticker": star.names()}, date(1999, 6, 30))


def asof_over_time(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    asks = star.table("orders").select(F.col("o_custkey").cast("string").alias("gvkey"), F.date_add(F.col("o_orderdate").cast("date"), 100).alias("day")).distinct()
    return pit.resolve_over_time(asks, star.links(), "gvkey", "day", "linkdt", "linkenddt", "lpermno")


def option_link_resolve(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    links = star.links().select(F.col("lpermno").alias("permno"), "secid", "score", F.col("linkdt").alias("sdate"), F.col("linkenddt").alias("edate"))
    return pit.permno_secids(links, date(1999, 6, 30))


def ticker_map(spark: SparkSession, d: str) -> DataFrame:
    return pit.permno_tickers(Star(spark, d).names(), date(1999, 6, 30))


def sector_map(spark: SparkSession, d: str) -> DataFrame:
    return pit.permno_sectors(Star(spark, d).names(), date(1999, 6, 30))


def vintage_for(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return Star(spark, d).table("orders").groupBy(scalar.vintage(day).alias("vintage")).agg(F.count("*").alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def iv_rank_minmax(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    daily = star.table("events").groupBy(F.col("user_id").alias("secid"), F.col("ts").cast("date").alias("date")).agg(F.max("value").alias("impl_volatility"))
    atm = daily.where(F.col("date") == F.lit(EVENTS_T0))
    return scoring.iv_rank(atm, daily.where(F.col("date") < F.lit(EVENTS_T0)), 252).select("secid", "iv", r6("iv_rank"))


def next_expiry_asof(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    quotes = star.table("lineitem").select(F.col("l_suppkey").alias("secid"), F.col("l_shipdate").cast("date").alias("exdate"))
    asks = star.table("supplier").select(F.col("s_suppkey").alias("secid"), F.date_add(F.lit(date(1998, 1, 1)), (F.col("s_suppkey") % 900).cast("int")).alias("catalyst"))
    return scoring.next_expiries(quotes, asks)


def _custkey_links(star: Star) -> DataFrame:
    keys = star.table("supplier")
    return keys.select(F.col("s_suppkey").cast("string").alias("gvkey"), F.col("s_suppkey").alias("lpermno"), F.lit("LC").alias("linktype"), F.lit("P").alias("linkprim"), F.lit(date(1990, 1, 1)).alias("linkdt"), F.when(F.col("s_suppkey") % 10 == 0, F.lit(date(2000, 1, 1))).alias("linkenddt"))


def _pairs(star: Star) -> DataFrame:
    return star.pairs().select(F.col("a").cast("string").alias("gvkey1"), F.col("b").cast("string").alias("gvkey2"), F.col("score").cast("string").alias("score"))


def competes_edges_dedupe(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    return edges.peer_edges(_pairs(star), _custkey_links(star), T0, min_score=1.2).select("src", "dst", "kind", r6("weight"), "vintage")


def peer_load_counters(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    return edges.peer_counters(_pairs(star), _custkey_links(star), T0, 1.2)


def _supplier_rows(spark: SparkSession, d: str, states: bool = False) -> DataFrame:
    """Customer segments of the year 2000; ``states``: every thirteenth customer is a state and not a company."""
    star = Star(spark, d)
    lines = star.table("lineitem").join(star.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey"), "o_custkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), F.col("l_shipdate").cast("date").alias("day"))
    year = lines.where(F.col("day").between(date(2000, 1, 1), date(2000, 12, 31)))
    seg = year.groupBy(F.col("l_suppkey").cast("string").alias("gvkey"), F.col("o_custkey").alias("cid")).agg(F.sum("price").cast("double").alias("salecs"), F.max("day").alias("datadate"))
    seg = seg.select("gvkey", "cid", F.lit(1).alias("sid"), F.concat(F.lit("CUSTOMER "), F.col("cid").cast("string")).alias("cnms"), F.when(F.lit(states) & (F.col("cid") % 13 == 0), "STATE").otherwise("COMPANY").alias("ctype"), "salecs", "datadate")
    sales = year.where("l_suppkey % 11 <> 0").groupBy(F.col("l_suppkey").cast("string").alias("gvkey")).agg(F.sum("price").cast("double").alias("sale"))
    # The least supplier of a nation first: a customer meets one row and not all suppliers of its nation.
    least = star.table("supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("twin"))
    customers = star.table("customer").join(least, F.col("c_nationkey") == F.col("s_nationkey")).groupBy("c_custkey").agg(F.min("twin").alias("twin"))
    named = seg.join(customers, F.col("cid") == F.col("c_custkey")).select("gvkey", "cid", "sid", F.col("twin").cast("string").alias("cgvkey"), F.lit(date(2000, 1, 1)).alias("srcdate"))
    filings = star.table("supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").cast("string").alias("gvkey"), F.date_add(F.lit(date(2000, 12, 1)), (F.col("s_suppkey") % 250).cast("int")).alias("fdate"))
    return edges.supplier_rows(seg, sales, named, filings, _custkey_links(star), date(2001, 4, 1), 0.001)


def supplies_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges.supplier_edges(_supplier_rows(spark, d)).select("src", "dst", "fiscal_year", r6("weight"), "as_of", "lag_estimated")


def edge_skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    return edges.skip_counts(_supplier_rows(spark, d))


def comoves_residual_corr(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    bars = cut(star.bars())
    return edges.comovement_edges(bars, star.market(bars), T0, window=252, least=60, threshold=0.1).select("src", "dst", F.round("weight", 4).alias("weight"))


def expand_2hop(spark: SparkSession, d: str) -> DataFrame:
    start = spark.createDataFrame([(i,) for i in SEED_IDS], "node long")
    return graph.expand(start, graph.adjacency(Star(spark, d).graph(), T0))


def shortest_path_hops(spark: SparkSession, d: str) -> DataFrame:
    start = spark.createDataFrame([(i,) for i in SEED_IDS], "node long")
    return graph.shortest_paths(start, graph.adjacency(Star(spark, d).graph(), T0), 3, steps=False).select("node", "hops", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


def _volume_candidates(star: Star) -> DataFrame:
    value = signals.abnormal_volume(star.bars())
    return value.select(scalar.canonical_id(F.col("permno")).alias("canonical_id"), F.round("value", 6).alias("salience"), F.lit(True).alias("coverage"))


def _near(spark: SparkSession, d: str) -> DataFrame:
    return expand_2hop(spark, d).select(scalar.canonical_id(F.col("node")).alias("canonical_id"))


def _named(star: Star) -> DataFrame:
    return star.table("supplier").where("s_suppkey % 4 = 0").select(scalar.canonical_id(F.col("s_suppkey")).alias("canonical_id"))


def complement_topk(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    return graph.complement(_volume_candidates(star), _near(spark, d), _named(star), 15).select("canonical_id", "salience")


def reason_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    start = spark.createDataFrame([(i,) for i in SEED_IDS], "node long")
    paths = graph.shortest_paths(start, graph.adjacency(Star(spark, d).graph(), T0), 2)
    return paths.select("node", graph.reason(F.col("steps"), F.transform("path", scalar.canonical_id)).alias("reason"))


def flag_session(spark: SparkSession, d: str) -> DataFrame:
    """All columns of the session's flags; paths as text."""
    found = _flag_session(spark, d)
    return found.select("canonical_id", r6("salience"), "on_entity_frontier", "on_thesis_frontier", F.array_join("entity_path", ">").alias("entity_path"), "reason")


def _flag_session(spark: SparkSession, d: str) -> DataFrame:
    """The whole way from bars and edges to flags with a path and a reason."""
    star = Star(spark, d)
    start = spark.createDataFrame([(i,) for i in SEED_IDS], "node long")
    walk = graph.Walk(graph.adjacency(star.graph(), T0))
    near = graph.expand(start, walk).select(scalar.canonical_id(F.col("node")).alias("canonical_id"))
    top = cut(graph.complement(_candidates(spark, d), near, _named(star), 10))
    paths = graph.shortest_paths(start, walk, targets=top.select(scalar.parse_permno(F.col("canonical_id")).alias("node"))).select(scalar.canonical_id(F.col("node")).alias("canonical_id"), F.transform("path", scalar.canonical_id).alias("path"), "steps")
    return graph.flags(top, paths).drop("thesis_path")


def seed_weights(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    pages, links = star.pages()
    return seeds.read_seeds(pages, links, star.names(), date(1999, 6, 30)).select("canonical_id", r6("weight"), "slug")


def in_degree(spark: SparkSession, d: str) -> DataFrame:
    pages, links = Star(spark, d).pages()
    return knowledge.with_in_degree(pages, links).select("slug", "in_degree")


def page_listing(spark: SparkSession, d: str) -> DataFrame:
    pages, links = Star(spark, d).pages()
    return knowledge.list_pages(pages, links, "main", datetime(1997, 1, 1), datetime(1998, 1, 1), 10, 25).select("slug", "created_at", "in_degree")


def slugify(spark: SparkSession, d: str) -> DataFrame:
    return Star(spark, d).table("part").select("p_partkey", scalar.slugify(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("slug"))


def session_scores(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.score(Star(spark, d).folded())


def session_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.aggregate(session_scores(spark, d))


def _flags(star: Star) -> DataFrame:
    events = star.session_events().where("event = 'flags' and id is not null")
    return events.groupBy("session_id", "id").agg(F.count("*").cast("double").alias("salience"))


def lift(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    return evaluation.lift(_flags(star), star.folded()["accept"])


def sliced_precision(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    accepted = star.folded()["accept"].withColumn("accepted", F.lit(True))
    judged = star.folded()["flags"].join(accepted, ["session_id", "id"], "left").select(F.coalesce("accepted", F.lit(False)).alias("accepted"), (F.col("id") % 4).cast("long").alias("quartile"), (F.col("session_id") % 3).alias("sector"))
    return evaluation.sliced_precision(judged, ["quartile", "sector"])


def feedback_rates(spark: SparkSession, d: str) -> DataFrame:
    events = Star(spark, d).session_events().where("event in ('accept', 'dismiss') and id is not null")
    tier = F.when(F.col("event") == "accept", F.when(F.col("id") % 2 == 0, "act").otherwise("watch")).otherwise(F.when(F.col("id") % 2 == 0, "known").otherwise("noise"))
    return evaluation.feedback_rates(events.select("session_id", tier.alias("tier")))


def drift(spark: SparkSession, d: str) -> DataFrame:
    flags = Star(spark, d).session_events().where("event = 'flags' and id is not null").select(F.col("session_id").alias("namespace"), F.col("turn").alias("session_no"), "id")
    return evaluation.drift(flags)


def nested_session_read(spark: SparkSession, d: str) -> DataFrame:
    """All flags of all sessions as a reader of sessions gets them, one to a row."""
    star = Star(spark, d)
    cid = scalar.canonical_id(F.col("id"))
    path = F.when(F.col("id") % 3 > 0, F.array(scalar.canonical_id(F.col("session_id")), cid))
    flags = _flags(star).select("session_id", cid.alias("canonical_id"), "salience", F.concat(F.lit("peer of "), scalar.canonical_id(F.col("session_id"))).alias("reason"), path.alias("entity_path"), path.isNotNull().alias("on_entity_frontier"))
    ranked = store.ranked_flags(flags)
    sessions = star.session_events().groupBy("session_id").agg(F.max("turn").alias("k"), F.lit(2).alias("d_e"), F.create_map(F.lit("permno:1"), F.lit("ONE")).alias("ticker_lookup"))
    sheets = star.table("part").select((F.col("p_partkey") % 15).alias("session_id"), scalar.canonical_id(F.col("p_partkey") % 100).alias("canonical_id"), "p_name").groupBy("session_id", "canonical_id").agg(F.min("p_name").alias("company"), F.max("p_name").alias("summary"))
    news = star.table("part").select((F.col("p_partkey") % 30).alias("session_id"), scalar.canonical_id(F.col("p_size").cast("long")).alias("canonical_id"), F.col("p_name").alias("title"), F.col("p_partkey").cast("string").alias("url"), F.col("p_brand").alias("source"))
    news = news.withColumn("rank", F.row_number().over(W.partitionBy("session_id", "canonical_id").orderBy("title", "url")))
    nested = store.nested_session(ranked, sheets, news, sessions)
    return nested.select("session_id", "k", "d_e", F.col("ticker_lookup")["permno:1"].alias("looked_up"), F.explode_outer("flags").alias("f")).select(
        "session_id", "k", "d_e", "looked_up", "f.rank", "f.canonical_id", "f.reason", F.array_join("f.entity_path", ">").alias("path"), "f.on_entity_frontier", F.col("f.tearsheet.company").alias("company"), F.col("f.tearsheet.summary").alias("summary"),
        F.size("f.headlines").alias("n_headlines"), F.get("f.headlines.title", F.lit(0)).alias("first_title"), F.get("f.headlines.source", F.lit(0)).alias("first_source"),
    )


def edge_upsert(spark: SparkSession, d: str) -> DataFrame:
    kept = Star(spark, d).graph().withColumn("provenance", F.lit("derived"))
    old, new = kept.where("src % 2 = 0"), kept.where("src % 3 = 0").withColumn("weight", F.col("weight") + 1)
    return store.merged(old, new, store.MERGE_KEYS["COMOVES_WITH"]).select("src", "dst", r6("weight"))


def pit_pages(spark: SparkSession, d: str) -> DataFrame:
    pages, _ = Star(spark, d).pages()
    return pit.before(pages, date(1996, 1, 1), "updated_at").select("slug", F.size(scalar.tickers(F.col("tags"))).alias("n_tickers"))


def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    """The candidates with their salience and each component, in plain columns."""
    parts = ("vol_spike", "abn_volume", "dislocation", "gap")
    found = _candidates(spark, d)
    return found.select("canonical_id", "as_of", r6("salience"), r6("attention"), *(F.round(F.col("components")[c], 6).alias(c) for c in parts))


def _spans(star: Star) -> DataFrame:
    links = star.links()
    return links.select(F.col("lpermno").alias("permno"), "lpermno", "secid", F.concat(F.lit("T"), F.col("secid").cast("string")).alias("ticker"), F.when(F.col("score") > 0, F.col("score")).alias("score"), F.col("linkdt").alias("sdate"), F.col("linkenddt").alias("edate"))


def secid_resolve(spark: SparkSession, d: str) -> DataFrame:
    return pit.resolve("secid", _spans(Star(spark, d)), date(1999, 6, 30))


def ibes_resolve(spark: SparkSession, d: str) -> DataFrame:
    return pit.resolve("ibes_ticker", _spans(Star(spark, d)), date(1999, 6, 30))


def bulk_resolve(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    return pit.resolve_gvkeys(star.table("customer").select(F.col("c_custkey").cast("string").alias("gvkey")), star.links(), date(1999, 6, 30))


def vertical_edges(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    return edges.peer_edges(_pairs(star), _custkey_links(star), T0, kind="VERTICAL", provenance="vtnic", min_score=1.3).select("src", "dst", "kind", "provenance", r6("weight"))


def last_values_a_day(spark: SparkSession, d: str) -> DataFrame:
    """Of several lines that a supplier ships on a day the last price, and the last quantity of 10 or more."""
    rows = Star(spark, d).table("lineitem").select(F.col("l_suppkey").alias("permno"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").alias("close"), F.when(F.col("l_quantity") >= 10, F.col("l_quantity")).alias("volume"), F.struct("l_orderkey", "l_linenumber").alias("place"))
    return signals.one_bar_a_day(rows, F.col("place")).select("permno", "date", "close", "volume")


def winsorised_zscores(spark: SparkSession, d: str) -> DataFrame:
    z = signals.zscore(signals.abnormal_volume(Star(spark, d).bars()))
    return z.select("permno", F.round(scalar.winsorize(F.col("z"), 1.0), 6).alias("z"))


def date_ceilings(spark: SparkSession, d: str) -> DataFrame:
    """The last day and the rows of each dated table."""
    star = Star(spark, d)
    dated = (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))
    out = [star.table(t).agg(F.lit(t).alias("table_name"), F.max(F.col(c).cast("date")).alias("last_day"), F.count(c).alias("n_rows")) for t, c in dated]
    return out[0].unionByName(out[1]).unionByName(out[2])


def flag_report(spark: SparkSession, d: str) -> DataFrame:
    """``flag_session`` in plain columns."""
    return _flag_session(spark, d).select("canonical_id", r6("salience"), "on_entity_frontier", F.array_join("entity_path", ">").alias("path"), "reason")


def option_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Volatility, its rank and the implied move, with line items as quotes and as a volatility surface."""
    star = Star(spark, d)
    lines = star.table("lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    put = F.col("l_orderkey") % 2 == 1
    quotes = lines.select(
        F.col("l_suppkey").alias("secid"), F.when(F.col("l_linenumber") % 2 == 0, F.lit(T0)).otherwise(F.date_sub(F.lit(T0), 1)).alias("date"), F.date_add("day", 1095).alias("exdate"), F.when(put, "P").otherwise("C").alias("cp_flag"),
        (F.col("l_quantity") / F.when(put, -50).otherwise(50)).alias("delta"), (F.col("l_extendedprice") / 1000).alias("best_bid"), (F.col("l_extendedprice") / 1000 + 0.5).alias("best_offer"), (F.col("l_orderkey") % 3).alias("open_interest"),
    )
    days = F.when(F.col("l_linenumber") % 2 == 0, 30).otherwise(60)
    surface = lines.groupBy(F.col("l_suppkey").alias("secid"), F.col("day").alias("date"), days.alias("days")).agg((F.max("l_extendedprice") / 100000 + 0.1).alias("impl_volatility")).withColumn("delta", F.lit(50))
    ids = star.table("supplier").select(F.col("s_suppkey").alias("permno"))
    links = ids.select("permno", F.col("permno").alias("secid"), (F.col("permno") % 8).alias("score"), F.lit(date(1990, 1, 1)).alias("sdate"), F.lit(None).cast("date").alias("edate"))
    events = ids.select(scalar.canonical_id(F.col("permno")).alias("canonical_id"), F.date_add(F.lit(T0), (F.col("permno") % 60).cast("int")).alias("catalyst"))
    return scoring.enrich_options(ids, links, surface, quotes, events, star.bars(), T0).select("permno", r6("iv"), r6("iv_rank"), r6("implied_move"))


def _vendor(star: Star) -> bar_sources.TableBars:
    """Line items as a vendor's bars, prices with signs and returns with codes, and orders a day as the market."""
    sign = F.when(F.col("l_orderkey") % 4 == 0, -1.0).otherwise(1.0)
    ret = F.when(F.col("l_linenumber") == 1, "C").when(F.col("l_linenumber") == 2, "-1.5").otherwise(F.col("l_discount").cast("string"))
    price = sign * F.col("l_extendedprice")
    raw = star.table("lineitem").select(F.col("l_suppkey").alias("permno"), F.col("l_shipdate").cast("date").alias("date"), *(price.alias(c) for c in ("open", "high", "low", "prc")), F.col("l_quantity").alias("volume"), ret.alias("ret"), F.lit(None).cast("double").alias("shrout"))
    index = star.table("orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.when(F.count("*") % 3 == 0, "B").otherwise((F.count("*") / 100).cast("string")).alias("vwretd"))
    return bar_sources.TableBars(raw, index)


def vendor_bars(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    even = star.table("supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("permno"))
    return _vendor(star).bars(even, date(1996, 1, 1), date(1996, 12, 31)).select("permno", "date", "close", "volume", "ret")


def vendor_market(spark: SparkSession, d: str) -> DataFrame:
    return _vendor(Star(spark, d)).market(date(1996, 1, 1), date(1997, 12, 31))


def proxy_market(spark: SparkSession, d: str) -> DataFrame:
    return bar_sources.proxy_market(Star(spark, d).bars(), 7).select("date", r6("mkt"))


def bar_window(spark: SparkSession, d: str) -> DataFrame:
    """Bars of each id in the calendar days that surely hold 63 trading days before the day."""
    first, last = pit.window_bounds(T0, 63)
    return Star(spark, d).bars().where(F.col("date").between(F.lit(first), F.lit(last))).groupBy("permno").agg(F.count("*").alias("n_bars"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


def _versions(star: Star) -> DataFrame:
    """Pages in versions: the parts of a size, in their order."""
    made = F.date_add(F.lit(date(2000, 1, 1)), F.col("p_size")).cast("timestamp")
    slug = F.concat(F.lit("size-"), F.col("p_size").cast("string"))
    rows = star.table("part").where("p_partkey % 3 <> 0").select("p_partkey", slug.alias("slug"), F.lit("main").alias("namespace"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_brand", "p_type").alias("body"), F.lit("knowledge").alias("kind"), F.array("p_type").alias("tags"), F.lit(None).cast("string").alias("source"), made.alias("created_at"), made.alias("updated_at"))
    return rows.withColumn("version", F.row_number().over(W.partitionBy("slug").orderBy("p_partkey")).cast("long")).drop("p_partkey")


def _page_links(star: Star, ends: int) -> DataFrame:
    size, other = F.col("p_size").cast("string"), (F.col("p_partkey") % ends).cast("string")
    return star.table("part").select("p_partkey", F.concat(F.lit("size-"), size).alias("from_slug"), F.concat(F.lit("size-"), other).alias("to_slug"), F.lit("main").alias("namespace"))


def page_put(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    slug = F.concat(F.lit("size-"), (F.col("p_size") + 20).cast("string"))
    new = star.table("part").where("p_partkey % 3 = 0").select(slug.alias("slug"), F.lit("main").alias("namespace"), F.lit("strategy").alias("kind"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_brand", "p_type").alias("body"), F.array("p_type").alias("tags"), F.lit(None).cast("string").alias("source"))
    put = knowledge.put_pages(_versions(star), new, datetime(2001, 7, 1))
    return put.select("slug", "version", "kind", "title", "body", F.col("created_at").cast("date").alias("created_on"), F.col("updated_at").cast("date").alias("updated_on"))


def page_read(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    return knowledge.get_page(_versions(star), _page_links(star, 50), "size-7", "main").select("slug", "version", "title", "body", F.array_join("links", ",").alias("links"))


def page_search(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.search(_versions(Star(spark, d)), "red ring, Economy!", "main", limit=1000).select("slug", "title", r6("score"))


def links_created(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    asked = _page_links(star, 70)
    there = asked.where("p_partkey % 2 = 0").select("from_slug", "to_slug", "namespace").distinct()
    return knowledge.new_links(_versions(star), there, asked, datetime(2001, 7, 1)).select("from_slug", "to_slug")


def _logged(star: Star) -> DataFrame:
    """Session events as they are logged: lists of candidates, flags and final ids, in the order of their ids."""
    events = star.session_events().where("id is not null")
    of = lambda kind, value: F.when(F.col("event") == kind, value)
    item = lambda x: F.struct(x.alias("canonical_id"))
    return events.select(
        "event", "session_id", "turn", F.col("event_id").alias("seq"), of("candidates", F.array(item(F.col("id")), item(F.col("id") + 1))).alias("candidates"), of("a_final", F.array(F.col("id"), F.col("id") + 2)).alias("a_final_ids"),
        of("flags", F.array(item(F.col("id")), item(F.col("id") + 3))).alias("flags"), F.when(F.col("event").isin("accept", "dismiss"), F.col("id")).alias("flag_id"),
    )


def event_fold(spark: SparkSession, d: str) -> DataFrame:
    """What is left of the log: a turn's last candidates, all flags, accepts and dismisses, the last final list."""
    folded = evaluation.fold(_logged(Star(spark, d)))
    out = folded["candidates"].select(F.lit("candidates").alias("kind"), "session_id", "turn", "id")
    for kind in ("flags", "accept", "dismiss", "final"):
        out = out.unionByName(folded[kind].select(F.lit(kind).alias("kind"), "session_id", F.lit(None).cast("long").alias("turn"), "id"))
    return out


def accepted_scores(spark: SparkSession, d: str) -> DataFrame:
    """Sessions scored against what was accepted instead of the final list."""
    folded = Star(spark, d).folded()
    return evaluation.score(folded | {"labelled": folded["accept"].select("session_id").distinct()}, label="accept")


def mention_seeds(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    mentions = Star(spark, d).table("orders").select(
        F.col("o_orderpriority").alias("namespace"), scalar.canonical_id(F.col("o_custkey") % 100).alias("canonical_id"), F.col("o_orderdate").cast("date").alias("seen_on"),
        (1.0 + key % 3).alias("conviction"), (0.5 + key % 2).alias("prominence"), F.concat(F.lit("order-"), key.cast("string")).alias("slug"),
    )
    return seeds.mention_weights(mentions, date(1999, 6, 30)).select("namespace", "canonical_id", r6("weight"), "first_seen", "last_seen", "n_pages")


def filing_dates(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    companies = star.table("customer").select(F.col("c_custkey").cast("string").alias("gvkey"), F.when(F.col("c_custkey") % 10 > 0, (F.col("c_custkey") % 500).cast("string")).alias("cik"))
    filings = star.table("orders").select((F.col("o_custkey") % 700).cast("string").alias("cik"), F.col("o_orderdate").cast("date").alias("fdate"))
    return edges.first_filings(companies, filings)


def children_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Headlines of flags after some flags were given new ones."""
    parts = Star(spark, d).table("part")
    old = parts.where("p_partkey % 5 <> 0").select((F.col("p_partkey") % 30).alias("session_id"), scalar.canonical_id(F.col("p_size")).alias("canonical_id"), F.col("p_name").alias("title"), "p_partkey")
    new = parts.where("p_partkey % 5 = 0").select((F.col("p_partkey") % 60).alias("session_id"), scalar.canonical_id(F.col("p_size") + 1).alias("canonical_id"), F.col("p_brand").alias("title"), "p_partkey")
    return store.replaced(old, new, ["session_id", "canonical_id"]).select("session_id", "canonical_id", "title", "p_partkey")


def sessions_left(spark: SparkSession, d: str) -> DataFrame:
    """The list of sessions after a third of them was deleted."""
    flags = Star(spark, d).table("events").where("event_type = 'click'").select(F.col("user_id").alias("session_id"), F.col("ts").alias("created_at"))
    left = store.list_sessions(store.without_sessions(flags, flags.where("session_id % 3 = 0")))
    return left.select("session_id", F.col("created_at").cast("date").alias("last_day"), "n_flags")


def tearsheets(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    details = star.table("supplier").select(scalar.canonical_id(F.col("s_suppkey")).alias("canonical_id"), F.col("s_name").alias("company"))
    last = star.bars().groupBy("permno").agg(F.max_by(F.struct("open", "close"), "date").alias("b")).select(scalar.canonical_id(F.col("permno")).alias("canonical_id"), "b.*")
    return store.tearsheet(details, last).select("canonical_id", "company", "prev_close", r6("change"), r6("change_pct"))


def uncached_ids(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    ids = star.table("orders").select(scalar.canonical_id(F.col("o_custkey")).alias("canonical_id"))
    return store.missing_tickers(ids, star.table("supplier").select(scalar.canonical_id(F.col("s_suppkey")).alias("canonical_id"), F.col("s_name").alias("ticker")))
