"""Hand-computed cases for rules that tables alone do not show."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from saltmarsh.functions import scalar
from saltmarsh.operators import edges, evaluation, graph, knowledge, pit, scoring, seeds, signals
from saltmarsh.sources import bars as bar_sources
from saltmarsh.sources import store
from saltmarsh.sources.versions import VersionedStore

T0 = date(2024, 6, 14)


def days(n):
    return [date.fromordinal(date(2024, 1, 1).toordinal() + k) for k in range(n)]


def bar_rows(permno, closes, volume=1e6, opens=None):
    out, prev = [], None
    for d, c, o in zip(days(len(closes)), closes, opens or [None] * len(closes), strict=True):
        out.append((permno, d, o, c, c, c, volume, None if prev is None else c / prev - 1, 50.0))
        prev = c
    return out


BARS = "permno long, date date, open double, high double, low double, close double, volume double, ret double, shrout double"


def one(df, column):
    return [r[column] for r in df.collect()]


def test_short_histories_have_no_signal(spark):
    df = spark.createDataFrame(bar_rows(1, [100.0 + (k % 3) for k in range(12)]), BARS)
    assert signals.realized_vol_spike(df).count() == 0 and signals.abnormal_volume(df).count() == 0


def test_volatility_ratio_by_hand(spark):
    closes = [100.0]
    for k in range(40):
        closes.append(closes[-1] * (1 + (0.05 if k % 2 else -0.05) * (1 if k >= 30 else 0.2)))
    df = spark.createDataFrame(bar_rows(1, closes), BARS)
    rets = [b / a - 1 for a, b in zip(closes, closes[1:], strict=False)]
    sd = lambda x: math.sqrt(sum((v - sum(x) / len(x)) ** 2 for v in x) / (len(x) - 1))
    assert one(signals.realized_vol_spike(df), "value")[0] == pytest.approx(sd(rets[-10:]) / sd(rets))


def test_gap_needs_open_and_previous_close(spark):
    rows = bar_rows(1, [100.0, 100.0], opens=[None, 107.0]) + bar_rows(2, [100.0, 100.0]) + bar_rows(3, [100.0], opens=[1.0])
    assert {r["permno"]: r["value"] for r in signals.gap(spark.createDataFrame(rows, BARS)).collect()} == {1: pytest.approx(0.07)}


def test_zscore_of_one_or_equal_values_is_zero(spark):
    for values in ([5.0], [2.0, 2.0, 2.0]):
        assert set(one(signals.zscore(spark.createDataFrame(list(enumerate(values)), "permno long, value double")), "z")) == {0.0}
    assert signals.zscore(spark.createDataFrame([], "permno long, value double")).count() == 0


def test_nan_never_passes_a_threshold(spark):
    df = spark.createDataFrame([(float("nan"),), (0.5,)], "x double")
    assert df.where(scalar.finite(F.col("x")) >= 0.3).count() == 1


def test_dislocation_strips_the_market(spark):
    closes, market, m = [100.0], [], 0.0
    for k in range(30):
        m = 0.01 if k % 2 else -0.02
        market.append(m)
        closes.append(closes[-1] * (1 + 2 * m + (0.1 if k == 29 else 0)))
    df = spark.createDataFrame(bar_rows(1, closes), BARS)
    mkt = spark.createDataFrame(list(zip(days(31)[1:], market, strict=True)), "date date, mkt double")
    rets = [b / a - 1 for a, b in zip(closes, closes[1:], strict=False)]
    beta = sum(a * b for a, b in zip(market, rets, strict=True)) / sum(a * a for a in market)
    assert one(signals.dislocation(df, mkt), "value")[0] == pytest.approx(abs(rets[-1] - beta * market[-1]))
    assert signals.dislocation(df, mkt.limit(0)).count() == 0


def test_salience_ranks_within_bucket(spark):
    rows = [(1, 3.0, 3500, 1e9), (2, 1.0, 3500, 1e9), (3, 2.0, 3500, 1e9), (4, 2.0, None, None)]
    out = scoring.salience(spark.createDataFrame(rows, "permno long, composite double, siccd int, mktcap double"))
    got = {r["permno"]: r["salience"] for r in out.collect()}
    assert got[1] > got[3] > got[2] and got[4] == 1.0


def test_unknown_weight_is_an_error(spark):
    with pytest.raises(KeyError):
        scoring.composite(spark.range(1).select(F.col("id").alias("permno")), {}, {"x": 1.0})


def test_iv_rank_is_clipped_and_flat_ranges_are_half(spark):
    history = [(s, d, v) for s, vs in ((1, [0.2 + 0.01 * k for k in range(11)]), (2, [0.3] * 11), (3, [0.1] * 5)) for d, v in zip(days(11), vs, strict=False)]
    atm = spark.createDataFrame([(1, 0.9), (2, 0.3), (3, 0.2)], "secid long, impl_volatility double")
    out = scoring.iv_rank(atm, spark.createDataFrame(history, "secid long, date date, impl_volatility double"), 252)
    assert {r["secid"]: r["iv_rank"] for r in out.collect()} == {1: 1.0, 2: 0.5, 3: None}


def test_straddle_takes_first_expiry_after_the_event(spark):
    q = "secid long, date date, exdate date, cp_flag string, best_bid double, best_offer double, delta double, open_interest double"
    rows = [(1, T0, e, f, b, b + 1, d, 10.0) for e, f, b, d in ((date(2024, 6, 20), "C", 9.0, 0.5), (date(2024, 6, 28), "C", 4.0, 0.45), (date(2024, 6, 28), "C", 3.0, 0.4), (date(2024, 6, 28), "P", 2.0, -0.5), (date(2024, 7, 28), "P", 7.0, -0.5))]
    events = spark.createDataFrame([(1, date(2024, 6, 20))], "secid long, catalyst date")
    assert one(scoring.straddles(spark.createDataFrame(rows, q), events, T0), "straddle") == [3.5 + 2.5]


def test_link_validity_and_ties(spark):
    rows = [("1076", 14593, "LC", "P", date(2010, 1, 1), None), ("1076", 10000, "LC", "P", date(2000, 1, 1), date(2009, 12, 31)), ("1690", 5, "XX", "P", date(2000, 1, 1), None)]
    links = spark.createDataFrame(rows, "gvkey string, lpermno long, linktype string, linkprim string, linkdt date, linkenddt date")
    at = lambda d: {r["key"]: r["permno"] for r in pit.gvkey_links(links, d).collect()}
    assert at(date(2009, 12, 31)) == {"001076": 10000} and at(date(2010, 1, 1)) == {"001076": 14593}
    asked = spark.createDataFrame([("1076", "gvkey"), ("9", "gvkey")], "identifier string, id_type string")
    got = {r["identifier"]: r["canonical_id"] for r in pit.resolve_batch(asked, {"gvkey": links}, T0).collect()}
    assert got == {"1076": "permno:14593", "9": None}
    with pytest.raises(ValueError):
        pit.resolve("cusip", links, T0)


def test_null_scores_count_as_highest(spark):
    links = spark.createDataFrame([("A", 1, 5.0, None, None), ("A", 2, None, None, None)], "ticker string, lpermno long, score double, sdate date, edate date")
    assert one(pit.ibes_links(links, T0), "permno") == [2]


@pytest.mark.parametrize(("day", "year"), [(date(2000, 1, 1), 1998), (date(2004, 2, 29), 2002), (date(2011, 6, 30), 2009), (date(2011, 7, 1), 2010), (date(2011, 12, 31), 2010), (date(2012, 1, 1), 2010)])
def test_vintage(day, year):
    assert pit.vintage_for(day) == year


def test_supplier_rows_and_reasons(spark):
    seg = spark.createDataFrame([("1076", 1, 1, "WALMART INC", 500.0, date(2022, 12, 31), "COMPANY"), ("1690", 1, 1, "X", 5.0, date(2022, 12, 31), "COMPANY"), ("1690", 2, 1, "OHIO", 5.0, date(2022, 12, 31), "STATE"), ("1690", 3, 1, "?", 5.0, date(2022, 12, 31), None)], "gvkey string, cid int, sid int, cnms string, salecs double, datadate date, ctype string")
    sales = spark.createDataFrame([("001076", 3200.0)], "gvkey string, sale double")
    named = spark.createDataFrame([("1076", 1, 1, "1690", date(2022, 1, 1))], "gvkey string, cid int, sid int, cgvkey string, srcdate date")
    filings = spark.createDataFrame([("001076", date(2023, 2, 15))], "gvkey string, fdate date")
    links = spark.createDataFrame([("001076", 10000, "LC", "P", date(2000, 1, 1), None), ("001690", 14593, "LC", "P", date(2000, 1, 1), None)], "gvkey string, lpermno long, linktype string, linkprim string, linkdt date, linkenddt date")
    rows = edges.supplier_rows(seg, sales, named, filings, links, date(2023, 6, 1))
    (edge,) = edges.supplier_edges(rows).collect()
    assert (edge["src"], edge["dst"], edge["weight"], edge["as_of"], edge["lag_estimated"]) == (10000, 14593, 0.15625, date(2023, 2, 15), False)
    assert {r["reason"]: r["n"] for r in edges.skip_counts(rows).collect()} == {"loaded": 1, "customer": 1}
    late = edges.supplier_rows(seg, sales, named, filings, links, date(2023, 2, 15))
    assert {r["reason"]: r["n"] for r in edges.skip_counts(late).collect()} == {"postdated": 2}


def test_peer_pairs_keep_the_greatest_weight(spark):
    pairs = spark.createDataFrame([("001690", "001076", "0.20", "2020"), ("1076", "1690", "0.25", "2020"), ("1", "2", "bad", "2020"), ("1076", "1690", "0.9", "2021")], "gvkey1 string, gvkey2 string, score string, year string")
    links = spark.createDataFrame([("001076", 14593, "LC", "P", date(2000, 1, 1), None), ("001690", 10000, "LC", "P", date(2000, 1, 1), None)], "gvkey string, lpermno long, linktype string, linkprim string, linkdt date, linkenddt date")
    (edge,) = edges.peer_edges(pairs, links, date(2021, 8, 1)).collect()
    assert (edge["src"], edge["dst"], edge["weight"]) == (10000, 14593, 0.25)
    counted = edges.peer_counters(pairs, links, date(2021, 8, 1)).first()
    assert (counted["rows"], counted["skipped_score"], counted["written"], counted["nodes"]) == (3, 1, 1, 2)


def test_blocked_correlations_equal_the_self_join(spark):
    rows = [(k, d, math.sin(k * 1.7 + i * (1 + k % 3)) * (1 if (i * k) % 7 else 0.5)) for k in range(9) for i, d in enumerate(days(40)) if (i + k) % 6]
    res = spark.createDataFrame(rows, "permno long, date date, res double")
    a = {(r["src"], r["dst"]): (r["n"], r["corr"]) for r in edges.correlations(res).collect()}
    b = {(r["src"], r["dst"]): (r["n"], r["corr"]) for r in edges.blocked_correlations(res, 3).collect()}
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and a[k][1] == pytest.approx(b[k][1]) for k in a)


@pytest.fixture
def small_graph(spark):
    rows = [(1, 2, "COMPETES_WITH", 0.5, False, date(2024, 1, 1), None), (2, 3, "SUPPLIES", 0.1, True, date(2024, 1, 1), "A (10.0%)"), (3, 1, "COMOVES_WITH", 0.4, False, date(2024, 1, 1), None), (3, 4, "COMPETES_WITH", 0.2, False, date(2024, 1, 1), None), (4, 9, "SUPPLIES", 0.2, True, T0, None), (7, 8, "VERTICAL", 0.2, False, date(2024, 1, 1), None)]
    return graph.adjacency(spark.createDataFrame(rows, "src long, dst long, kind string, weight double, directed boolean, as_of date, source_span string"), T0)


def test_expansion_and_paths(spark, small_graph):
    start = spark.createDataFrame([(1,)], "node long")
    assert {r["node"]: r["hops"] for r in graph.expand(start, small_graph).collect()} == {1: 0, 2: 1, 3: 1, 4: 2}
    assert {r["node"]: r["path"] for r in graph.shortest_paths(start, small_graph).collect()} == {1: [1], 2: [1, 2], 3: [1, 3], 4: [1, 3, 4]}
    assert graph.expand(spark.createDataFrame([], "node long"), small_graph).count() == 0


def test_reasons_by_strength(spark, small_graph):
    got = {r["node"]: r["why"] for r in graph.shortest_paths(spark.createDataFrame([(4,)], "node long"), small_graph, 2).select("node", graph.reason(F.col("steps"), F.transform("path", scalar.canonical_id)).alias("why")).collect()}
    assert got == {4: "structurally connected", 3: "direct product-market peer of permno:4", 2: "named customer-supplier relationship: A (10.0%)", 1: "product-market peer within 2 hops of permno:4"}


def test_later_edges_do_not_change_an_earlier_day(spark, small_graph):
    assert small_graph.where("a = 9 or b = 9").count() == 0


def test_complement_leaves_out_the_named(spark):
    cands = spark.createDataFrame([("permno:20000", 0.5, True), ("permno:30000", 0.5, True), ("permno:10", 0.5, True), ("permno:9", 0.9, False)], "canonical_id string, salience double, coverage boolean")
    near = cands.select("canonical_id")
    named = spark.createDataFrame([("permno:30000",), (None,)], "canonical_id string")
    assert one(graph.complement(cands, near, named, 5), "canonical_id") == ["permno:10", "permno:20000"]


def test_seeds_prefer_the_fresh_page(spark):
    pages = spark.createDataFrame([("fresh", "n", [" AAPL "], date(2023, 12, 1)), ("stale", "n", ["AAPL"], date(2022, 1, 1)), ("later", "n", ["AAPL"], T0), ("other", "n", ["aapl", "TOOLONG"], date(2023, 1, 1))], "slug string, namespace string, tags array<string>, updated_at date")
    links = spark.createDataFrame([], "from_slug string, to_slug string, namespace string")
    names = spark.createDataFrame([("AAPL", 1, date(2000, 1, 1), None)], "ticker string, permno long, namedt date, nameenddt date")
    (seed,) = seeds.read_seeds(pages, links, names, T0).collect()
    assert seed["slug"] == "fresh" and seed["weight"] == pytest.approx(math.exp(-(T0 - date(2023, 12, 1)).days * math.log(2) / 180) * math.log(2))


def test_mention_weights(spark):
    rows = [("n", "a", date(2024, 5, 15), 1.0, 1.0, "p"), ("n", "b", date(2024, 4, 15), 1.0, 1.0, "q")]
    df = seeds.mention_weights(spark.createDataFrame(rows, "namespace string, canonical_id string, seen_on date, conviction double, prominence double, slug string"), T0)
    got = {r["canonical_id"]: r["weight"] for r in df.collect()}
    assert got == {"a": 1.0, "b": pytest.approx(0.5)}


PAGES = "slug string, namespace string, version long, title string, body string, kind string, tags array<string>, source string, created_at timestamp, updated_at timestamp"


def test_pages_are_versioned(spark):
    then, now = datetime(2024, 1, 1), datetime(2024, 2, 1)
    pages = spark.createDataFrame([("a", "n", 1, "T", "alpha beta", "strategy", [], None, then, then), ("b", "n", 1, "U", "beta", "knowledge", [], None, then, then)], PAGES)
    new = spark.createDataFrame([("a", "n", "T2", "alpha alpha", "strategy", ["X"], None), ("c", "n", "V", "gamma", "knowledge", [], None)], "slug string, namespace string, title string, body string, kind string, tags array<string>, source string")
    rows = knowledge.put_pages(pages, new, now)
    assert {(r["slug"], r["version"], r["created_at"]) for r in rows.collect()} == {("a", 2, then), ("c", 1, now)}
    both = pages.unionByName(rows)
    assert {r["slug"]: r["version"] for r in knowledge.latest(both).collect()} == {"a": 2, "b": 1, "c": 1}
    assert one(knowledge.search(both, "Alpha!", "n"), "slug") == ["a"]
    with pytest.raises(Exception, match="unknown kind"):
        knowledge.put_pages(pages, new.withColumn("kind", F.lit("x")), now).collect()


def test_links_need_both_pages_and_are_added_once(spark):
    now = datetime(2024, 2, 1)
    pages = spark.createDataFrame([(s, "n", 1, s, s, "strategy", [], None, now, now) for s in "ab"], PAGES)
    asked = spark.createDataFrame([("a", "b", "n"), ("a", "b", "n"), ("a", "z", "n")], "from_slug string, to_slug string, namespace string")
    none = spark.createDataFrame([], "from_slug string, to_slug string, namespace string, created_at timestamp")
    made = knowledge.new_links(pages, none, asked, now)
    assert made.count() == 1 and knowledge.new_links(pages, made, asked, now).count() == 0
    assert knowledge.get_page(pages, made, "a", "n").first()["links"] == ["b"]


def scored(spark, rows):
    df = spark.createDataFrame(rows, "seq long, event string, session_id string, turn long, flag_id string, a_final_ids array<string>, candidates array<struct<canonical_id:string>>, flags array<struct<canonical_id:string>>")
    return evaluation.score(evaluation.fold(df)).first()


def event(seq, kind, turn=None, ids=(), flag=None):
    listed = [(i,) for i in ids]
    return (seq, kind, "s", turn, flag, list(ids) if kind == "a_final" else None, listed if kind == "candidates" else None, listed if kind == "flags" else None)


def test_session_scores(spark):
    r = scored(spark, [event(1, "candidates", 1, ["a"]), event(2, "candidates", 2, ["a", "b"]), event(3, "flags", 1, ["a", "a"]), event(4, "flags", 2, ["a"]), event(5, "a_final", ids=["x"]), event(6, "a_final", ids=["a", "b"]), event(7, "accept", flag="a"), event(8, "accept", flag="b"), event(9, "dismiss", flag="c")])
    assert (r["precision"], r["recall"], r["time_to_coverage"], r["accept_precision"]) == (1.0, 0.5, 2, 0.666667)
    assert r["f_beta"] == pytest.approx(1.25 * 0.5 / (0.25 + 0.5), abs=1e-6)


def test_scores_without_labels_or_coverage(spark):
    r = scored(spark, [event(1, "flags", 1, ["a"])])
    assert (r["precision"], r["recall"], r["f_beta"]) == (None, None, None)
    r = scored(spark, [event(1, "candidates", 1, ["a"]), event(2, "a_final", ids=["a", "b"])])
    assert r["time_to_coverage"] is None and r["precision"] is None and r["recall"] == 0.0


def test_rest_bars_and_malformed_lines(spark, tmp_path):
    t0 = 1733097600000
    good = '{"ticker":"AAPL","results":[' + ",".join(f'{{"t":{t0 + 86400000 * k},"o":1,"h":1,"l":1,"c":{c},"v":5}}' for k, c in enumerate((100, 99, 0, 50))) + "]}"
    (tmp_path / "x.json").write_text(good + "\nnot json\n" + '{"ticker":"ZZZ","results":[]}\n')
    responses = bar_sources.read_rest_bars(spark, str(tmp_path / "x.json"))
    rows = bar_sources.rest_bars(responses, spark.createDataFrame([("AAPL", 10000)], "ticker string, permno long")).orderBy("date").collect()
    assert [r["ret"] for r in rows] == [None, pytest.approx(-0.01), None, None] and rows[2]["close"] is None


def test_vendor_bars_are_cleaned(spark):
    raw = spark.createDataFrame([(1, "2024-01-02", "1", "2", "0.5", "-10.4", "7", "-2.0", "5"), (1, "2024-01-03", None, None, None, "B", "7", "C", "5")], "permno long, date string, open string, high string, low string, prc string, volume string, ret string, shrout string")
    a, b = bar_sources.clean_bars(raw).orderBy("date").collect()
    assert (a["close"], a["ret"], b["close"], b["ret"]) == (10.4, None, None, None)


def test_pair_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("  GVKEY1 gvkey2\tVSCORE\n 001076   001690 0.15\n\nbroken line\n")
    (row,) = bar_sources.read_pairs(spark, str(tmp_path / "p.txt")).collect()
    assert row.asDict() == {"gvkey1": "001076", "gvkey2": "001690", "score": "0.15"}


def test_upserts_and_session_replacement(spark, tmp_path):
    new = lambda w: spark.createDataFrame([(1, 2, "COMOVES_WITH", w, "p"), (1, 3, "COMOVES_WITH", 0.1, "p")], "src long, dst long, kind string, weight double, provenance string")
    path = str(tmp_path / "edges")
    store.upsert_edges(spark, path, new(0.5), "COMOVES_WITH")
    store.upsert_edges(spark, path, new(0.7).where("dst = 2"), "COMOVES_WITH")
    assert {(r["dst"], r["weight"]) for r in store.edge_store(spark, path).read("COMOVES_WITH").collect()} == {(2, 0.7), (3, 0.1)}
    sessions = lambda rows: spark.createDataFrame(rows, "session_id string, x long")
    store.write_sessions(sessions([("a", 1), ("b", 2)]), str(tmp_path / "s"))
    store.write_sessions(sessions([("a", 9)]), str(tmp_path / "s"))
    assert {(r["session_id"], r["x"]) for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {("a", 9), ("b", 2)}


def test_event_log_skips_bad_lines(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"event":"accept","session_id":"s","timestamp":"2024-01-01T00:00:00Z","turn":1,"flag_id":"a"}\n\noops\n')
    assert store.read_events(spark, str(tmp_path / "log.json")).count() == 1


def test_slugs_and_ids(spark):
    df = spark.createDataFrame([("  Été à la_Plage! -- 2 ", "1234567", "permno:12"), ("x" * 99, "12", "permno:x")], "t string, g string, c string")
    rows = df.select(scalar.slugify(F.col("t")).alias("s"), scalar.pad_gvkey(F.col("g")).alias("g"), scalar.parse_permno(F.col("c")).alias("p"), scalar.usd(F.lit(2.5e9)).alias("u")).collect()
    assert [tuple(r) for r in rows] == [("été-à-la-plage-2", "1234567", 12, "$2.5B"), ("x" * 80, "000012", None, "$2.5B")]


def test_point_in_time_filter_reaches_the_scan(spark, data):
    df = pit.before(spark.read.parquet(f"{data}/orders.parquet"), date(1996, 1, 1), "o_orderdate")
    assert "LessThan(o_orderdate" in df._jdf.queryExecution().executedPlan().toString()


def test_a_missing_page_is_an_error(spark):
    pages = spark.createDataFrame([("a", "n", 1, "t")], "slug string, namespace string, version long, title string")
    links = spark.createDataFrame([], "from_slug string, to_slug string, namespace string")
    assert knowledge.get_page(pages, links, "a", "n").first()["links"] == []
    for slug, namespace in (("b", "n"), ("a", "m")):
        with pytest.raises(Exception, match="no page"):
            knowledge.get_page(pages, links, slug, namespace).collect()


def test_counts_behind_a_score(spark):
    r = scored(spark, [event(1, "candidates", 1, ["a", "c"]), event(2, "flags", 1, ["a"]), event(3, "a_final", ids=["a", "b"]), event(4, "accept", flag="a"), event(5, "accept", flag="a"), event(6, "dismiss", flag="c")])
    assert (r["n_accepts"], r["n_dismisses"], r["n_covered_in_candidates"], r["n_labels"], r["n_flags"]) == (1, 1, 1, 2, 1)


def test_nested_sessions_keep_all_fields(spark):
    flags = spark.createDataFrame([("s", "permno:1", 1, 0.9, "why", ["permno:2", "permno:1"]), ("s", "permno:3", 2, 0.1, "x", None)], "session_id string, canonical_id string, rank int, salience double, reason string, entity_path array<string>")
    sheets = spark.createDataFrame([("s", "permno:1", "ONE", 5.0)], "session_id string, canonical_id string, ticker string, price double")
    news = spark.createDataFrame([("s", "permno:1", 2, "b"), ("s", "permno:1", 1, "a")], "session_id string, canonical_id string, rank int, title string")
    sessions = spark.createDataFrame([("s", T0, 10, 2), ("empty", T0, 5, 1)], "session_id string, as_of date, k int, d_e int")
    got = {r["session_id"]: r for r in store.nested_session(flags, sheets, news, sessions).collect()}
    one, two = got["s"]["flags"]
    assert (got["s"]["k"], one["reason"], one["entity_path"], one["tearsheet"]["ticker"], [h["title"] for h in one["headlines"]]) == (10, "why", ["permno:2", "permno:1"], "ONE", ["a", "b"])
    assert (two["rank"], two["tearsheet"], two["headlines"], got["empty"]["flags"]) == (2, None, [], [])


def test_ticker_cache_is_filled_as_it_is_read(spark, tmp_path):
    cache, asked = VersionedStore(spark, str(tmp_path / "c"), {"tickers": ["canonical_id"]}), []

    def look_up(missing):
        asked.append(sorted(one(missing, "canonical_id")))
        return missing.where("canonical_id <> 'permno:3'").withColumn("ticker", F.concat(F.lit("T"), F.substring("canonical_id", 8, 9)))

    ids = lambda *n: spark.createDataFrame([(f"permno:{k}",) for k in n], "canonical_id string")
    store.cached_tickers(cache, ids(1, 2), look_up)
    got = {r["canonical_id"]: r["ticker"] for r in store.cached_tickers(cache, ids(2, 3, 4, 4), look_up).collect()}
    assert got == {"permno:2": "T2", "permno:3": None, "permno:4": "T4"} and asked[0] == ["permno:1", "permno:2"] and asked[-1] == ["permno:3", "permno:4"]


def test_tickers_without_bars_and_bad_lines(spark, tmp_path):
    asked = spark.createDataFrame([("A", 1), ("B", None), ("C", 3), ("D", 4)], "ticker string, permno long")
    responses = spark.createDataFrame([("A", [(1, 1.0)]), ("C", [])], "ticker string, results array<struct<t:long,c:double>>")
    assert {r["ticker"]: r["reason"] for r in bar_sources.skipped_tickers(asked, responses).collect()} == {"B": "unmapped", "C": "empty", "D": "no response"}
    (tmp_path / "p.txt").write_text("a b c\n1 2 3\n1 2\nA B C\n\n1 2 3 4\n3 4\n")
    assert {r["n_fields"]: r["n_lines"] for r in bar_sources.bad_lines(spark, str(tmp_path / "p.txt")).collect()} == {2: 2, 4: 1}


def test_how_flags_are_shown(spark):
    df = spark.createDataFrame([("T", "L", "permno:1", 0.3, True), (None, "L", "permno:2", 0.3, False), (None, None, "permno:3", 0.1, True)], "ticker string, looked_up string, cid string, salience double, near boolean")
    assert one(df.select(scalar.label(F.col("ticker"), F.col("looked_up"), F.col("cid")).alias("x")), "x") == ["T", "L", "permno:3"]
    assert one(df.where(scalar.shown(F.col("salience"), F.col("near"), 0.2)), "cid") == ["permno:1", "permno:2"]
    assert one(df.where(scalar.shown(F.col("salience"), F.col("near"), 0.2, frontier_only=True)), "cid") == ["permno:1"]
    assert one(spark.createDataFrame([(datetime(2024, 1, 2, 7, 5),)], "t timestamp_ntz").select(scalar.clock(F.col("t")).alias("x")), "x") == ["07:05"]
