"""The operators for large data against brute force, and what their plans and failures look like."""

import json
import math
import random
from collections import Counter, defaultdict, deque
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import asof, edges, graph, order, search, signals
from saltmarsh.operators.evaluation import fold as batch_fold
from saltmarsh.plans import scale
from saltmarsh.sources import bars as bar_sources
from saltmarsh.sources import versions
from saltmarsh.streaming import fold


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- as-of joins


def intervals(r, keys, n, days=400):
    """Intervals that nest, touch, tie and end before they start, with open ends; most are of one key."""
    rows = []
    for k in range(n):
        start = r.choice([None, *range(days)])
        end = None if r.random() < 0.2 else (start or 0) + r.choice([-1, 0, 0, 3, 30, 200])
        rows.append((keys[0] if r.random() < 0.9 else r.choice(keys), start, end, [r.randint(0, 5), k % 7], k))
    return rows


@pytest.mark.parametrize("heavy_rows", [50_000, 40])
def test_merge_equals_brute_force(spark, heavy_rows):
    """With the small bound the key that has 90 % of the rows is cut into slices, and what is open is carried across them."""
    r = random.Random(heavy_rows)
    keys = ["a", "b", "c", None]
    spans = intervals(r, keys, 600)
    asks = [(keys[0] if r.random() < 0.9 else r.choice(keys), r.choice([None, *range(-5, 700)])) for _ in range(900)]
    left = spark.createDataFrame(asks + asks[:50], "k string, t int")
    right = spark.createDataFrame(spans, "k string, s int, e int, o array<long>, x long").select("k", "s", "e", "o", F.struct("x").alias("v"))
    found = asof.merge_asof(left, right, heavy_rows)
    expected = {}
    for k, t in set(asks):
        good = [(o, str(x), x) for kk, s, e, o, x in spans if k is not None and t is not None and kk == k and (s is None or s <= t) and (e is None or e >= t) and (s is None or e is None or e >= s)]
        expected[k, t] = min(((o, f'{{"x":{x}}}', x) for o, _, x in good), default=(None,) * 3)[2]
    assert {(x["k"], x["t"]): x["v"] and x["v"]["x"] for x in found.collect()} == expected
    assert found.count() == len(expected)
    if heavy_rows == 40:
        both = right.select("k", F.coalesce("s", F.lit(0)).alias("t")).unionByName(left)
        (heavy,) = asof.cuts(both, heavy_rows).collect()
        assert heavy["k"] == "a" and len(heavy["bounds"]) > 10
        dealt = asof.sliced(both, asof.cuts(both, heavy_rows)).groupBy("k", "slice").count().agg(F.max("count")).first()[0]
        assert dealt < 200 < both.where("k = 'a'").count()


def test_carried_rows_are_few(spark):
    """What is carried is the depth of overlap for each slice, however many intervals a key has."""
    rows = [("a", d, d + 3, [-d]) for d in range(2000)]
    events = spark.createDataFrame(rows, "k string, s int, e int, o array<long>").select("k", F.col("s").alias("t"), F.lit(0).alias("ask"), "e", "o", F.lit("").alias("tie"), F.struct("s").alias("v"))
    bounds = asof.cuts(events.select("k", "t"), 100)
    carried = asof.carried_over(asof.sliced(events, bounds).join(F.broadcast(bounds), "k"), events.schema["v"].dataType)
    slices = len(bounds.first()["bounds"])
    assert slices >= 15 and carried.count() <= 4 * slices


@pytest.mark.parametrize("heavy_rows", [50_000, 40])
def test_next_after_equals_brute_force(spark, heavy_rows):
    r = random.Random(1)
    times = [(r.choice("aaaaab"), r.choice([None, *range(0, 900, 7)])) for _ in range(700)]
    asks = [(r.choice(["a", "a", "a", "b", "c", None]), r.choice([None, *range(-3, 950)])) for _ in range(500)]
    got = asof.next_after(spark.createDataFrame(asks, "k string, t int"), spark.createDataFrame(times, "k string, t int"), heavy_rows).collect()
    want = {(k, t): min((x for kk, x in times if t is not None and kk == k and x is not None and x > t), default=None) for k, t in asks}
    assert {(x["k"], x["t"]): x["next"] for x in got} == want and len(got) == len(want)


def test_unknown_kind_of_id(spark):
    with pytest.raises(ValueError, match="cusip"):
        asof.resolve_days(spark.createDataFrame([], "identifier string, day date"), spark.createDataFrame([], "x int"), "cusip")


# ---- order statistics


@pytest.mark.parametrize("few", [10_000, 3])
def test_quantiles_equal_numpy(spark, few):
    r = random.Random(3)
    shares = (0.0, 0.1, 0.2, 0.5, 0.77, 0.999, 1.0)
    for values in ([7.5], [2.0] * 50, [r.random() for _ in range(700)], [float(r.randint(0, 3)) for _ in range(400)], [0.0] * 300 + [1.0] + [2.0] * 300, [10.0**k * s for k in range(-8, 9) for s in (-1, 1)], [math.inf, -math.inf, 1.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (math.nan,)], "v double")
        got = order.quantiles(df, "v", shares, few)
        finite = [(a, b) for a, b in zip(got, np.quantile(values, shares).tolist(), strict=True) if math.isfinite(b)]
        assert [a for a, _ in finite] == pytest.approx([b for _, b in finite], rel=1e-12), values[:5]
    assert order.quantiles(spark.createDataFrame([(None,)], "v double"), "v", shares) == [None] * len(shares)


def test_selection_narrows_without_taking_rows(spark):
    """Ranks within a large table come from ranges that approximate quantiles narrow; only a few distinct values are looked at."""
    df = spark.range(40_000).select((F.pmod(F.col("id") * 7919, F.lit(40_000)) / 4).alias("v"))
    assert order.at_ranks(df, "v", [0, 12_345, 39_999], few=50) == {0: 0.0, 12_345: 12_345 / 4, 39_999: 39_999 / 4}


def test_average_ranks(spark):
    r = random.Random(5)
    rows = [(k, r.choice(["x", "y", None]), r.choice([None, *map(float, range(6))])) for k in range(300)] + [(1000, "z", 1.0)]
    got = order.average_ranks(spark.createDataFrame(rows, "k long, g string, v double"), "g", "v")
    low = lambda v: (v is not None, v or 0.0)
    for x in got.collect():
        same = [low(v) for _, g, v in rows if g == x["g"]]
        assert x["n_group"] == len(same) and x["avg_rank"] == sum(s < low(x["v"]) for s in same) + (sum(s == low(x["v"]) for s in same) + 1) / 2
    assert got.count() == len(rows) and "Window" not in plan(got)
    assert order.average_ranks(spark.createDataFrame([], "k long, g string, v double"), "g", "v").count() == 0


# ---- search


def bm25(pages, asked, limit, k1=1.2, b=0.75):
    words = {s: search_words(f"{t or ''} {x or ''}") for s, _, t, x in pages}
    kinds = {s: k for s, k, _, _ in pages}
    mean, n = sum(map(len, words.values())) / len(words), len(words)
    counts = {s: Counter(w) for s, w in words.items()}
    df = Counter(t for c in counts.values() for t in c)
    out = {}
    for q, text, kind in asked:
        scores = Counter()
        for t in set(search_words(text)):
            idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
            for s, c in counts.items():
                if t in c and kind in (None, kinds[s]):
                    scores[s] += math.floor(idf * (c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * len(words[s]) / mean))) * 1_000_000 + 0.5)
        out[q] = [(s, x / 1_000_000) for s, x in sorted(scores.items(), key=lambda y: (-y[1], y[0]))[:limit]]
    return {q: x for q, x in out.items() if x}


def search_words(text):
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


@pytest.mark.parametrize("block_pages", [20_000, 12])
def test_a_thousand_queries_equal_brute_force(spark, tmp_path, block_pages):
    """In one block, and in many of which most are left out by their bounds."""
    r = random.Random(9)
    vocabulary = [f"word{k}" for k in range(200)]
    draw = lambda n: " ".join(vocabulary[min(int(r.expovariate(0.03)), 199)] for _ in range(n))
    pages = [(f"p{k:03d}", r.choice(["a", "b"]), draw(3), draw(r.randint(0, 60))) for k in range(150)] + [("empty", "a", None, None), ("copy1", "b", "same text", "word1"), ("copy2", "b", "same text", "word1")]
    asked = [(k, draw(r.randint(1, 5)) + r.choice(["", " unknown", " Word1!"]), r.choice([None, None, "a"])) for k in range(998)] + [(998, "nothing here", None), (999, "SAME", None)]
    path = str(tmp_path / "index")
    search.build(spark.createDataFrame([(s, "main", k, t, x) for s, k, t, x in pages], "slug string, namespace string, kind string, title string, body string"), path, parts=16, block_pages=block_pages)
    index = search.Index(spark, path)
    queries = spark.createDataFrame([(q, t, "main", k) for q, t, k in asked], "query_id long, text string, namespace string, kind string")
    got = defaultdict(list)
    for x in index.search(queries, 5).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["slug"], x["score"]))
    assert got == bm25(pages, asked, 5)
    assert index.search(queries.withColumn("namespace", F.lit("other")), 5).count() == 0


def test_a_query_reads_the_folders_of_its_terms(spark, tmp_path):
    rows = [(f"p{k}", "main", "a", f"t{k}", "x") for k in range(60)]
    search.build(spark.createDataFrame(rows, "slug string, namespace string, kind string, title string, body string"), str(tmp_path / "index"), parts=16)
    index = search.Index(spark, str(tmp_path / "index"))
    asked, folders = index.asked(spark.createDataFrame([(1, "t5 t6", "main", None)], "query_id long, text string, namespace string, kind string"))
    postings = index.read("postings", folders)
    assert len(folders) <= 2 and asked.count() == 2
    assert all(f"part={p}" in {f.split("/")[-2] for f in postings.inputFiles()} for p in folders) and "PartitionFilters: [" in plan(postings) and "part#" in plan(postings).split("PartitionFilters: [")[1].split("]")[0]


# ---- versions


def small(spark, rows):
    return spark.createDataFrame(rows, "session_id string, x long")


def test_a_run_that_dies_leaves_the_version_before(spark, tmp_path):
    store = versions.VersionedStore(spark, str(tmp_path / "s"), {"t": ["session_id"], "u": ["session_id"]}, buckets=4)
    assert store.current() == 0 and store.commit({"t": versions.Change(small(spark, [("a", 1), ("a", 2), ("b", 3)]), ["session_id"]), "u": versions.Change(small(spark, [("a", 7)]), ["session_id"])}) == 1

    class Killed(Exception):
        pass

    class Dies(versions.VersionedStore):
        def publish(self, *_):
            raise Killed

    with pytest.raises(Killed):
        Dies(spark, store.root, store.tables, 4).commit({"t": versions.Change(small(spark, [("a", 9)]), ["session_id"]), "u": versions.Change(small(spark, [("a", 9)]), ["session_id"])})
    rows = lambda t, v=None: sorted(tuple(x) for x in store.read(t, v).collect())
    assert store.versions() == [1] and rows("t") == [("a", 1), ("a", 2), ("b", 3)] and rows("u") == [("a", 7)]
    store.commit({"t": versions.Change(small(spark, [("a", 5)]), ["session_id"], gone=spark.createDataFrame([("b",)], "session_id string"))})
    assert rows("t") == [("a", 5)] and rows("u") == [("a", 7)] and rows("t", 1) == [("a", 1), ("a", 2), ("b", 3)]
    with pytest.raises(ValueError, match="no version 9"):
        store.read("t", 9)


def test_one_of_two_writers_is_refused(spark, tmp_path):
    store = versions.VersionedStore(spark, str(tmp_path / "s"), {"t": ["session_id"]})
    staged = store.stage(0, {"t": versions.Change(small(spark, [("a", 1)]), ["session_id"])}, "one")
    store.commit({"t": versions.Change(small(spark, [("a", 2)]), ["session_id"])})
    with pytest.raises(versions.Conflict):
        store.publish(1, "one", None, *staged)
    assert store.read("t").first()["x"] == 2


def test_a_note_is_committed_once_and_latest_wins(spark, tmp_path):
    store = versions.VersionedStore(spark, str(tmp_path / "s"), {"t": ["session_id"]})
    change = lambda *rows: {"t": versions.Change(small(spark, list(rows)), ["session_id"], latest="x")}
    assert [store.commit(change(("a", 3), ("a", 1)), "n1"), store.commit(change(("a", 2), ("b", 1)), "n2"), store.commit(change(("a", 99)), "n1")] == [1, 2, 1]
    assert sorted(tuple(x) for x in store.read("t").collect()) == [("a", 3), ("b", 1)]


# ---- streams


def log(r, n):
    rows = []
    for seq in range(n):
        kind, ids = r.choice(["candidates", "flags", "accept", "dismiss", "a_final"]), [f"i{r.randint(0, 9)}" for _ in range(r.randint(0, 3))]
        listed = [{"canonical_id": i} for i in ids]
        rows.append({"seq": seq, "event": kind, "session_id": f"s{r.randint(0, 4)}", "turn": r.randint(1, 3), "flag_id": f"i{r.randint(0, 9)}" if kind in ("accept", "dismiss") else None, "a_final_ids": ids if kind == "a_final" else None, "candidates": listed if kind == "candidates" else None, "flags": listed if kind == "flags" else None})
    return rows


LOG = "seq long, event string, session_id string, turn long, flag_id string, a_final_ids array<string>, candidates array<struct<canonical_id:string>>, flags array<struct<canonical_id:string>>"


def test_any_split_and_a_restart_equal_the_batch_fold(spark, tmp_path):
    """Batches in any order, a batch that is given twice, and a stop between them."""
    r = random.Random(12)
    rows = log(r, 120)
    whole = batch_fold(spark.createDataFrame([tuple(x[c.split()[0]] for c in ("seq", "event", "session_id", "turn", "flag_id", "a_final_ids")) + ([(y["canonical_id"],) for y in x["candidates"]] if x["candidates"] is not None else None, [(y["canonical_id"],) for y in x["flags"]] if x["flags"] is not None else None) for x in rows], LOG))
    want = {(kind, *(x[c] for c in x.__fields__)) if kind == "candidates" else (kind, x["session_id"], None, x["id"]) for kind in ("candidates", "flags", "accept", "dismiss", "final") for x in whole[kind].collect()}
    shuffled = rows[:]
    r.shuffle(shuffled)
    source = tmp_path / "log"
    source.mkdir()
    store = fold.fold_store(spark, str(tmp_path / "store"))
    for part in range(3):  # the stream is stopped and started again between the parts
        (source / f"{part}.json").write_text("\n".join(json.dumps(x) for x in shuffled[part * 40 : (part + 1) * 40]))
        events = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).json(str(source))
        fold.start(events, store, str(tmp_path / "checkpoint")).awaitTermination(180)
    again = fold.slots(spark.read.schema(LOG).json(str(source / "0.json")))
    store.commit({"fold": versions.Change(again, ["session_id", "kind", "slot"], latest="seq")}, note="fold:0")
    assert len(store.versions()) == 3
    assert {tuple(x[c] for c in ("kind", "session_id", "turn", "id")) for x in fold.folded(store).collect()} == want


# ---- graphs


def walked(adjacent, start, depth):
    seen, queue = {s: (0, [s]) for s in start}, deque(sorted(start))
    while queue:
        n = queue.popleft()
        if seen[n][0] < depth:
            for m in sorted(adjacent[n]):
                if m not in seen:
                    seen[m] = (seen[n][0] + 1, seen[n][1] + [m])
                    queue.append(m)
    return seen


def test_walks_around_a_hub_equal_plain_search(spark):
    """Half of all edges are of node 0, whose neighbours are dealt to several tasks; a chain of 30 keeps the plan's size linear."""
    r = random.Random(2)
    ends = {(0, k) for k in range(1, 120)} | {(200 + k, 201 + k) for k in range(30)} | {(119, 200)} | {tuple(sorted(r.sample(range(1, 120), 2))) for _ in range(60)}
    df = spark.createDataFrame([(a, b, "COMPETES_WITH", 1.0, False, date(2000, 1, 1)) for a, b in ends], "src long, dst long, kind string, weight double, directed boolean, as_of date")
    adj = graph.adjacency(df)
    walk = graph.Walk(adj, hub_edges=40)
    (hub,) = walk.hubs.collect()
    assert hub["_hub"] == 0 and hub["_salts"] >= 3 and walk.ends.groupBy("_a", "_salt").count().agg(F.max("count")).first()[0] < 70
    assert {x["_b"] for x in walk.step(spark.createDataFrame([(0,)], "node long")).collect()} == set(range(1, 120))
    adjacent = defaultdict(set)
    for a, b in ends:
        adjacent[a].add(b)
        adjacent[b].add(a)
    seeds = spark.createDataFrame([(5,), (6,), (5,), (None,)], "node long")
    for depth in (1, 6):
        got = graph.expand(seeds, adj, depth)
        assert {x["node"]: x["hops"] for x in got.collect()} == {n: h for n, (h, _) in walked(adjacent, [5, 6], depth).items()}
    assert len(plan(graph.expand(seeds, adj, 12))) < 2.2 * len(plan(graph.expand(seeds, adj, 6)))
    whole = walked(adjacent, [5, 6], 7)
    targets = spark.createDataFrame([(5,), (17,), (119,), (203,), (204,), (229,), (999,)], "node long")
    both = graph.shortest_paths(seeds, adj, 7, targets)
    plain = {x["node"]: (x["hops"], x["path"]) for x in graph.shortest_paths(seeds, adj, 7).collect()}
    assert {n: h for n, (h, _) in plain.items()} == {n: h for n, (h, _) in whole.items()}
    assert {x["node"]: (x["hops"], x["path"]) for x in both.collect()} == {n: plain[n] for n in (5, 17, 119, 203, 204, 229) if n in plain}
    assert all(len(x["steps"]) == x["hops"] for x in both.collect())


def test_duplicate_nodes(spark):
    df = spark.createDataFrame([("permno:1",), ("permno:2",), ("permno:2",), (None,)], "canonical_id string")
    assert {(x["canonical_id"], x["n"]) for x in graph.duplicate_nodes(df).collect()} == {("permno:2", 2), (None, 1)}


# ---- bars


def test_one_pass_equals_the_four_signals(spark, data):
    star = scale.Star(spark, data)
    bars = star.bars().cache()
    holes = bars.withColumn("ret", F.when(F.col("permno") % 3 > 0, F.col("ret"))).withColumn("volume", F.when(F.dayofmonth("date") > 7, F.col("volume"))).withColumn("open", F.when(F.col("permno") != 4, F.col("open")))
    for some in (bars, holes):
        market = star.market(some)
        wide = {x["permno"]: x for x in signals.all_signals(some, market).collect()}
        parts = {"vol_spike": signals.realized_vol_spike(some), "abn_volume": signals.abnormal_volume(some), "dislocation": signals.dislocation(some, market), "gap": signals.gap(some)}
        for name, one in parts.items():
            want = {x["permno"]: x["value"] for x in one.collect()}
            assert {k: x[name] for k, x in wide.items() if x[name] is not None} == pytest.approx(want, rel=1e-9), name
            scores = {x["permno"]: x[name] for x in signals.zscores(signals.all_signals(some, market)).collect() if x[name] is not None}
            assert scores == pytest.approx({x["permno"]: x["z"] for x in signals.zscore(one).collect()}, abs=1e-9)


def test_stored_bars_need_no_exchange(spark, data):
    star = scale.Star(spark, data)
    stored = bar_sources.store_bars(star.bars(), buckets=4)
    market = star.market(stored).cache()
    text = plan(signals.all_signals(stored, market))
    bars_side = [line for line in text.split("\n") if "Exchange hashpartitioning(permno" in line]
    assert not bars_side and text.count("Window [") == 1


def test_only_the_years_of_the_span_are_opened(spark, tmp_path):
    for year in (2019, 2020, 2021, 2022):
        df = spark.createDataFrame([(1, date(year, m, 1), float(year), m) for m in range(1, 13)], "secid long, date date, price double, extra int")
        (df if year == 2021 else df.drop("extra")).write.parquet(str(tmp_path / f"v{year}"))
    tables = bar_sources.YearlyTables(spark, str(tmp_path / "v{year}"), [2019, 2020, 2021, 2022, 2030], "secid long, date date, price double, extra int")
    got = tables.read(date(2020, 6, 1), date(2022, 2, 1))
    assert sorted({f.split("/")[-2] for f in got.inputFiles()}) == ["v2020", "v2021", "v2022"]
    assert Counter(x["date"].year for x in got.collect()) == {2020: 7, 2021: 12, 2022: 2} and got.where("extra is not null").count() == 12
    assert tables.read(date(2001, 1, 1), date(2002, 1, 1)).count() == 0


def test_counters_of_a_load_are_of_the_job_that_writes(spark, tmp_path):
    pairs = spark.createDataFrame([("1", "2", "0.5"), ("2", "1", "0.7"), ("1", "9", "0.9"), ("1", "3", "0.1"), ("3", "3", "x")], "gvkey1 string, gvkey2 string, score string")
    links = spark.createDataFrame([(str(k), 100 + k, "LC", "P", date(1990, 1, 1), None) for k in (1, 2, 3)], "gvkey string, lpermno long, linktype string, linkprim string, linkdt date, linkenddt date")
    got = edges.load_peer_edges(pairs, links, date(2001, 7, 1), str(tmp_path / "e"), min_score=0.2)
    assert got == {"rows": 5, "skipped_score": 2, "unresolved": 1, "written": 1, "nodes": 2}
    assert edges.load_peer_edges(pairs.limit(0), links, date(2001, 7, 1), str(tmp_path / "f")) == {"rows": 0, "skipped_score": 0, "unresolved": 0, "written": 0, "nodes": 0}
