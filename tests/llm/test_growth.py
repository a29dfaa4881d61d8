"""Near lines of a bucket of many groups; work and memory that must not grow with a text's lines or a batch's rows."""

import random
import time
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from saltmarsh.llm import line_dedup
from saltmarsh.llm.common import map_rows


def test_near_lines_apart_from_all_heads_are_found(spark, monkeypatch):
    """40 pairs of near lines with the same six outer words are one bucket, in which no line is near one of another pair."""
    monkeypatch.setattr(line_dedup, "PART", 7, raising=False)  # so that parts meet as well
    r = random.Random(5)
    middle = lambda: " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=14)) for _ in range(5))
    rows = []
    for k in range(40):
        line = f"on a to {middle()} of an it"
        rows += [(2 * k, f"{line}\nalone"), (2 * k + 1, line[:20] + "Q" + line[21:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["n_removed"] for x in line_dedup.dedup_lines(docs).collect()}
    assert got == {2 * k: int(k > 0) for k in range(40)} | {2 * k + 1: 1 for k in range(40)}


def test_a_text_that_loses_many_lines_takes_linear_time(spark):
    """op9: each other line of one text goes, so that 10,000 runs of lines stay."""
    line = lambda k: f"{k:05d}{k * 7919 % 100003:05d}{k * 104729 % 100019:05d}"
    text = "\n".join(f"{line(k)}\n-" for k in range(10_000))
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    line_dedup.dedup_lines(docs.limit(1)).collect()
    began = time.time()
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[2]["n_removed"] == 10_000 and got[2]["text"] == "\n".join("-" * 10_000)
    assert got[1]["n_removed"] == 0 and got[1]["text"] == text and got[1]["n_lines"] == 20_000
    assert time.time() - began < 40


def test_blocks_as_columns_equal_those_of_lists(spark):
    """op9: w0, w1 and w2 hold the blocks that word_blocks gives, for lines too short for the two that content places."""
    lines = [(n, [f"w{i * n % 13}x{i}" for i in range(n)]) for n in range(1, line_dedup.LONG)]
    told = line_dedup.with_blocks(spark.createDataFrame(lines, "k long, words array<string>"))
    got = {r["k"]: (r["size"], list(r["b"])) for r in line_dedup.simhashes(told.withColumn("more", F.lit(None).cast("array<int>"))).collect()}
    hashed = spark.createDataFrame(lines, "k long, words array<string>").select("k", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")).where(F.size("hashes") >= line_dedup.WORDS)
    size = F.least(F.floor(F.size("hashes") / line_dedup.BLOCKS), F.lit(line_dedup.BLOCK_WORDS)).cast("int")
    assert got == {r["k"]: (r["b"][0], r["b"][1:]) for r in hashed.select("k", line_dedup.word_blocks(size).alias("b")).collect()}


def test_only_keys_that_another_line_may_have_are_made(spark):
    """op9 (CPU over budget): 200 lines of 30 words of their own have no key (15 each before), and two with the same first 8 words share one."""
    hashed = lambda lines: line_dedup.simhashes(line_dedup.with_blocks(spark.createDataFrame(list(enumerate(lines)), "k long, words array<string>")))
    own = [[f"w{k}x{i}" for i in range(30)] for k in range(200)]
    assert line_dedup.block_keys(hashed(own)).count() == 0
    keys = [(r["key"], r["k"]) for r in line_dedup.block_keys(hashed([*own, own[0][:8] + [f"v{i}" for i in range(22)]])).collect()]
    assert sorted(k for _, k in keys) == [0, 200] and len({key for key, _ in keys}) == 1


def test_a_line_is_parted_into_words_as_signs_say(spark):
    """op9: each ASCII character but letters and digits parts words, and nothing beyond ASCII does."""
    signs = "".join(chr(c) for c in range(1, 128) if chr(c) != "\n" and not chr(c).isalnum())
    rows = [(1, f"Aa{s}b9") for s in signs] + [(2, f"{signs}\n\n{signs}x"), (3, "\u00a0\u2003 \U0001f600a")]
    got = line_dedup.numbered_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "pos", "words").distinct().collect()
    assert sorted((r["doc_id"], r["pos"], r["words"]) for r in got) == [(1, 0, ["aa", "b9"]), (2, 2, ["x"]), (3, 0, ["\u00a0\u2003", "\U0001f600a"])]


def test_lines_in_several_buckets_are_compared_once(spark):
    """op9: near_apart listed a pair before as often as it shares a bucket, if not for its distinct; lines of one group are no pair."""
    shared = spark.createDataFrame([(key, k) for key in (5, -7, 9) for k in (1, 2, 3)] + [(11, 1), (11, 4)], "key long, k long")
    texts = spark.createDataFrame([(k, "one two three four five " + "x" * k, None) for k in range(1, 5)], "k long, norm string, code string")
    groups = spark.createDataFrame([(3, 2)], "node long, root long")
    got = line_dedup.near_apart(shared, groups, texts, 0.8).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(1, 2), (1, 3), (1, 4)]


def test_rows_of_a_large_batch_are_not_all_held(monkeypatch):
    """pipeline: 10,000 texts of one Arrow batch reach the generator a few at a time."""

    class Frame:
        def mapInArrow(self, run, schema):
            return run

    schema = pa.schema([("n", pa.int64())])
    monkeypatch.setattr("saltmarsh.llm.common.from_arrow_schema", lambda schema: schema)
    run = map_rows(Frame(), lambda rows: ((len(text),) for (text,) in rows), schema)
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 2000] * 10_000)], ["text"])
    tracemalloc.start()
    total = sum(sum(b["n"].to_pylist()) for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 20_000_000 and peak < 4_000_000
