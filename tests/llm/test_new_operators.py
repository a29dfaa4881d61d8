"""Repeated passages, resampling and centroids against brute force, with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from saltmarsh.llm import centroids, registry, repeated_passages, resampling
from saltmarsh.llm.common import WORDS
from tests.llm.test_text_operators import SCHEMA, TRICKY, make, prose
from tests.oracle import assert_same, views


@pytest.mark.parametrize("name", ["op11_substring_automata", "op12_resample_radix", "op13_centroids_gemm"])
def test_query_equals_sql(spark, data, name):
    assert_same(registry.QUERIES[name](spark, data), views(data), registry.ORACLES[name])


# ---- 11: repeated passages


def kept_by_brute_force(texts, window):
    """(n_words, kept words) of each (doc_id, text), which must be in order."""
    seen, out = set(), []
    for doc_id, text in texts:
        words = WORDS(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        out.append((doc_id, len(words), [w for w, g in zip(words, gone, strict=True) if not g]))
    return out


def passages(seed, documents=60):
    """Documents of own words, passages that many share, a phrase shorter than a window in all, copies, and repeats within one."""
    r = random.Random(seed)
    own = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    shared = [own(r.choice([19, 20, 21, 55])) for _ in range(6)]
    phrase = own(17)
    texts = []
    for k in range(documents):
        words = own(r.randint(0, 40))
        for _ in range(r.randint(0, 3)):
            words += r.choice(shared) + own(r.choice([0, 1, 5]))
        words += phrase + own(r.randint(0, 30))
        if k % 9 == 0 and texts:
            words = r.choice(texts)[1].split()
        texts.append((k, r.choice([" ", "\n", "\t "]).join(words)))
    inner = own(25)
    return texts + [(documents, " ".join(inner + own(3) + inner)), (documents + 1, "a " * 100), (documents + 2, "a b " * 50), (documents + 3, None), (documents + 4, "")]


@pytest.mark.parametrize("piece", [10_000, 3])
def test_repeats_equal_brute_force(spark, piece):
    for window, gram in ((20, 8), (5, 2)):
        texts = passages(window)
        got = {r["doc_id"]: r for r in repeated_passages.drop_repeats(make(spark, texts), window, gram, piece).collect()}
        for doc_id, n, kept in kept_by_brute_force(texts, window):
            assert (got[doc_id]["n_words"], got[doc_id]["n_removed"], got[doc_id]["kept"]) == (n, n - len(kept), " ".join(kept)), (window, piece, doc_id)


def test_a_hot_anchor_is_dealt_by_salt(spark):
    """With a low bound the stretches of a phrase that all documents share go to several tasks, and nothing is lost."""
    texts = passages(3)
    df = make(spark, texts).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = repeated_passages.stretches(df, repeated_passages.repeated_anchors(df), piece=4)
    assert dealt.where("salt >= 0").select("anchor", "salt").distinct().groupBy("anchor").count().agg(F.max("count")).first()[0] > 3
    assert dealt.groupBy("anchor", "salt").count().agg(F.max("count")).first()[0] < 60


def test_repeats_of_difficult_rows(spark):
    """Null ids come first, rows of one id in an order of their own, repeated rows are one document, and clashing columns stay."""
    long = prose(1)
    df = make(spark, TRICKY).selectExpr("*", "'x' as anchor", "1 as gone", "'y' as kept", "2 as _text", "3 as _hash", "4 as text_hash")
    done = repeated_passages.drop_repeats(df)
    assert done.columns == [c for c in df.columns if c != "kept"] + ["kept", "n_words", "n_removed"]
    got = {(r["doc_id"], r["text"]): r for r in done.collect()}
    assert done.count() == len(TRICKY) and got[7, long]["n_removed"] == 0 and got[8, long + " tail"]["n_removed"] == 60 and got[8, long + " tail"]["kept"] == "tail"
    assert (got[5, "word " * 3000]["n_words"], got[5, "word " * 3000]["kept"]) == (3000, "word") and got[0, None]["kept"] == ""
    null_first = repeated_passages.drop_repeats(make(spark, [(None, long), (-5, long), (3, long)])).collect()
    assert {r["doc_id"]: r["n_removed"] for r in null_first} == {None: 0, -5: 60, 3: 60}
    assert repeated_passages.drop_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_automaton_finds_each_repeat():
    shard = repeated_passages.Shard(3, [((1, 0, 0), b"a b c d"), ((2, 0, 4), b"x a b c"), ((3, 0, 9), b"b c d b c d")])
    assert list(shard.repeats()) == [((2, 0, 4), 1, 2), ((3, 0, 9), 0, 1), ((3, 0, 9), 3, 4)]


# ---- 12: resampling


def drawn_by_brute_force(texts, target, percent=25, buckets=10_000):
    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(words), [zlib.crc32(f.encode()) % buckets for f in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]

    docs = [(i, *features(t)) for i, t in texts]
    s, t = [0] * buckets, [0] * buckets
    for _, _, found in docs:
        for b in found:
            s[b] += 1
    for text in target:
        for b in features(text)[1]:
            t[b] += 1
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + buckets) / ((s[b] + 1.0) * (sum(t) + buckets))))
    rows = []
    for i, n, found in docs:
        weight = math.floor(sum(map(gain, found)) / len(found)) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    first = able[: percent * len(able) // 100]
    return sorted(map(repr, [(*r[:4], k + 1) for k, r in enumerate(first)] + [(*r[:4], None) for r in rows if r[4] < 20] + [(*r[:4], None) for r in able[len(first) :]]))


def test_draw_equals_brute_force(spark):
    r = random.Random(2)
    texts = [(k, prose(k, r.randint(0, 90))) for k in range(150)] + [(-3, prose(7)), (None, prose(8)), (None, prose(8)), (2**62, prose(9)), (5, prose(10)), (5, prose(10)), (5, prose(11, 30)), (900, None), (901, ""), (902, "É ß é-Z_9 " * 12), (903, "x" * 50_000)]
    target = [prose(k, 40) for k in range(5, 9)] + [None, ""]
    df = make(spark, texts)
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    for percent in (25, 1, 100):
        got = resampling.resample(df, goal, percent)
        assert sorted(repr(tuple(x)) for x in got.collect()) == drawn_by_brute_force(texts, target, percent)
    assert resampling.resample(df, goal, 0).where("rank is not null").count() == 0


def test_draw_from_nothing(spark):
    empty, goal = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(empty, goal).count() == 0
    few = resampling.resample(make(spark, [(1, "one two"), (2, None)]).withColumns({"rank": F.lit(1), "score": F.lit("x"), "at": F.lit(2), "down": F.lit(0)}), goal)
    assert [r["rank"] for r in few.collect()] == [None, None] and few.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_selection_finds_every_key(spark):
    """Ties in the first columns, both signs, and the ends of the range."""
    r = random.Random(4)
    rows = [(r.choice([-3, 0, 2**40]), r.randint(0, 1), r.choice([-(2**63), 2**63 - 1, 5, -5]), r.randint(0, 3), k) for k in range(200)]
    df = spark.createDataFrame(rows, "down long, none long, id long, n_features long, at long").cache()
    for k in (1, 2, 77, 199, 200):
        key = resampling.kth_key(df, k)
        assert tuple(key) == sorted(rows)[k - 1] and df.where(resampling.up_to(key)).count() == k


# ---- 13: centroids


def clusters_by_brute_force(rows, dimensions, clusters, rounds, seed=3, scale=1024):
    kept = [(i, tuple(math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale for x in v)) for i, v in rows if v and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:clusters]
    cs = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(cs))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        cs = [tuple(sum(x) // own.count(k) for x in zip(*(v for (_, v), o in zip(kept, own, strict=True) if o == k), strict=True)) if k in own else c for k, c in enumerate(cs)]
    told = [(i, *near(v)) for i, v in kept]
    inertia = [sum(d for _, d, k in told if k == j) for j in range(len(cs))]
    fits = lambda x: x if x < 2**63 else None
    return sorted(repr((i, k, fits(d), fits(inertia[k]), fits(sum(inertia)), hashlib.sha256(",".join(map(str, cs[k])).encode()).hexdigest())) for i, d, k in told)


@pytest.mark.parametrize("size", [1.0, 3e4, 1e9, 1e30])
def test_clusters_equal_brute_force(spark, size):
    """Of sizes that need doubles, longs and Python's integers, with vectors that do not count, repeats, ties and null ids."""
    r = random.Random(6)
    rows = [(k, [r.choice([-1, 1]) * r.random() * size for _ in range(4)]) for k in range(60)] + [(60 + k, [0.5, -0.5, 0.25, 0.0]) for k in range(9)]
    rows += [(7, [size] * 4), (7, [size] * 4), (None, [size, 0.0, 0.0, -size]), (100, None), (101, []), (102, [1.0] * 3), (103, [1.0, None, 1.0, 1.0]), (104, [1.0, math.nan, 1.0, 1.0]), (105, [1.0, math.inf, 1.0, 1.0])]
    df = spark.createDataFrame([(*x, "c") for x in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    got = centroids.cluster(df, dimensions=4, clusters=5, rounds=4)
    assert sorted(repr(tuple(x)) for x in got.collect()) == clusters_by_brute_force(rows, 4, 5, 4)


def test_few_vectors_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([], schema)).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, None), (2, [1.0])], schema)).count() == 0
    got = centroids.cluster(spark.createDataFrame([(k, [float(k)] * 64) for k in range(3)], schema)).collect()
    assert len(got) == 3 and {x["distance"] for x in got} == {0} and {x["cluster"] for x in got} == {0, 1, 2}


def test_matrix_product_is_exact_up_to_its_bound():
    """Just below the bound the doubles agree with Python's integers; ties go to the smaller number."""
    r = random.Random(8)
    most = math.isqrt((2**53 - 1) // 64) // 2
    x = np.array([[r.randint(-most, most) for _ in range(64)] for _ in range(50)])
    cs = [tuple(r.choice([-most, most, r.randint(-most, most)]) for _ in range(64)) for _ in range(4)]
    cs.append(cs[1])
    cluster, distance = centroids.nearest(x, cs)
    for row, k, d in zip(x.tolist(), cluster, distance, strict=True):
        best = min((sum((a - b) ** 2 for a, b in zip(row, c, strict=True)), j) for j, c in enumerate(cs))
        assert (int(d), int(k)) == best
