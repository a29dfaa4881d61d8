"""Fuzzy line deduplication with SimHash blocks and edit similarity, in DataFrame operations only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import cut, renamed
from saltmarsh.llm.components import components

#: Lines are near if their edit similarity is this or more: counted in words if both have LONG words, else in characters.
SIMILARITY = 0.8
#: Blocks of a SimHash, and how many equal ones make a key of a line, by the words in a block (0: a block is of characters).
BLOCKS, EQUAL = 6, {0: 3, 1: 4, 2: 3, 3: 2, 4: 2}
#: Words in a block at most, and characters where a line has fewer than WORDS words.
BLOCK_WORDS, BLOCK_CHARS, WORDS = 4, 8, 6
#: Lines of so many words have two of their blocks where their content says so, and are compared by words.
LONG = 32
#: Lines shorter than this are only matched exactly, as none but an equal line can have the similarity 0.8.
LEAST_CHARS = 5
#: What stands between words: runs of ASCII signs and white space. Characters beyond ASCII count as letters.
#: In this form as ``split`` makes the pattern anew for each line, which takes long where all signs are listed.
SIGNS, LETTER = r"[\P{Alnum}&&\p{ASCII}]+", r"[\p{Alnum}\P{ASCII}]"
#: Lines of a part of a bucket, where all pairs of parts meet.
PART = 1000
#: The filter on line keys has so many 64-bit words at most (2 MB broadcast).
FILTER_WORDS = 2**17


def simhash(hashes: list[Column], words: Column) -> Column:
    """SimHash of the first ``words`` of four words' hashes: each bit that more than half of them have."""
    a, b, c, d = hashes
    both = a.bitwiseAND(b)
    three = both.bitwiseOR(c.bitwiseAND(a.bitwiseOR(b)))
    four = both.bitwiseAND(c.bitwiseOR(d)).bitwiseOR(c.bitwiseAND(d).bitwiseAND(a.bitwiseOR(b)))
    return F.when(words == 1, a).when(words == 2, both).when(words == 3, three).otherwise(four)


def upper(bits: Column) -> Column:
    """The upper half of 64 bits."""
    return F.shiftright(bits, 32).cast("int")


def word_blocks(words: Column) -> Column:
    """A line's SimHash over ``words`` words a block, as integers: the number of words, then the blocks.

    An edit changes the bits of the block that it falls in and of no other, where the bits of a SimHash over
    the whole line would change here and there in most blocks. The first blocks are counted from the
    line's start and the others from its end, so that words put in or left out between them move none.
    """
    blocks = F.transform(F.array(*starts(words)), lambda i: upper(simhash([F.get("hashes", i + k) for k in range(BLOCK_WORDS)], words)))
    return F.concat(F.array(words.cast("int")), blocks)


def starts(words: Column) -> list[Column]:
    """Where the blocks of ``words`` words start."""
    n = F.size("hashes")
    return [F.lit(0), words, n - words, n - 2 * words, 2 * words, n - 3 * words]


def with_own(lines: DataFrame) -> DataFrame:
    """``lines`` (hashes, n and size, the words in a block) with w0, w1, w2: their ``word_blocks`` of that size, two in each.

    Most lines have no others, so these are plain columns, for which Spark makes code, which it does not for functions of
    arrays. Long lines have the last two blocks at the least and at the greatest word hash of what lies between the others.
    """
    inner = F.when(F.col("n") >= LONG, F.slice("hashes", 2 * BLOCK_WORDS + 1, F.col("n") - 4 * BLOCK_WORDS))
    at = lambda pick: F.array_position("inner", pick("inner")).cast("int") + (2 * BLOCK_WORDS - 1)
    first = starts(F.col("size"))
    first[4:] = [F.coalesce(at(pick), start) for pick, start in zip((F.array_min, F.array_max), first[4:], strict=True)]
    placed = lines.withColumn("inner", inner).withColumns({f"s{j}": start for j, start in enumerate(first)})
    # Blocks of fewer words repeat theirs, which leaves what all or most of them have.
    steps = {2: F.when(F.col("size") > 1, 1).otherwise(0), 3: F.when(F.col("size") > 2, 2).otherwise(0), 4: F.when(F.col("size") == 4, 3).when(F.col("size") == 2, 1).otherwise(0)}
    of = lambda j, k: F.get("hashes", F.col(f"s{j}") + F.col(f"step{k}")) if k > 1 else F.get("hashes", F.col(f"s{j}"))
    word = lambda j, k: F.when(F.col("size") == 3, F.lit(-1).cast("long")).otherwise(of(j, k)) if k == 4 else of(j, k)
    held = placed.withColumns({f"step{k}": step for k, step in steps.items()}).withColumns({f"h{j}{k}": word(j, k) for j in range(BLOCKS) for k in range(1, BLOCK_WORDS + 1)})
    bits = [simhash([F.col(f"h{j}{k}") for k in range(1, BLOCK_WORDS + 1)], F.lit(BLOCK_WORDS)) for j in range(BLOCKS)]
    packed = {f"w{j}": bits[2 * j].bitwiseAND(F.lit(-(2**32))).bitwiseOR(F.shiftrightunsigned(bits[2 * j + 1], 32)) for j in range(BLOCKS // 2)}
    return held.withColumns(packed).select(*lines.columns, *packed)


def char_blocks() -> Column:
    """The same for lines of few words (``norm``): hashes of runs of characters."""
    n = F.length("norm")
    size = F.least(F.greatest(F.floor(n / BLOCKS), F.lit(1)), F.lit(BLOCK_CHARS)).cast("int")
    starts = F.array(F.lit(0), size, n - size, n - 2 * size, 2 * size, n - 3 * size)
    return F.concat(F.array(F.lit(0)), F.transform(starts, lambda i: upper(F.xxhash64(F.substring("norm", i + 1, size)))))


def with_blocks(lines: DataFrame) -> DataFrame:
    """``lines`` (with words) with size, w0, w1, w2, more and but_one, which are null where they do not apply.

    The first four are the line's SimHash: the words in a block, and the blocks, two in each long. more has
    further SimHashes one after another: a line at the border of two sizes of block has both, and one of few
    words those of characters. but_one has keys of lines of few words, in which each word is a block and all
    blocks but one are equal. Lines that are too short have none.
    """
    n = F.size("words")
    few, enough = n < WORDS + 3, (n >= 3) | (F.length("norm") >= LEAST_CHARS)
    size = F.least(F.floor(n / BLOCKS), F.lit(BLOCK_WORDS)).cast("int")
    split = lines.withColumns({"hashes": F.transform("words", lambda w: F.xxhash64(w)), "norm": F.when(few, F.array_join("words", " ")), "n": n, "size": F.when(n >= WORDS, size)})
    border = (n >= 2 * BLOCKS) & (n < BLOCKS * BLOCK_WORDS + 2) & (n % BLOCKS < 2)
    further = F.when(border, word_blocks(size - 1)).when(enough & (n < WORDS + 2), char_blocks())
    # All of the words as blocks of their own, and all but each one of them.
    but_one = F.when(few & enough & (n > 1), F.transform(F.sequence(F.lit(0), n), lambda k: F.xxhash64(F.filter("hashes", lambda _, i: i != k))))
    # A generator, as the optimiser would put what a plain column holds in each place that asks for it.
    return with_own(split).select(*lines.columns, "size", *(f"w{j}" for j in range(BLOCKS // 2)), F.inline(F.array(F.struct(further.alias("more"), but_one.alias("but_one")))))


def simhashes(lines: DataFrame) -> DataFrame:
    """k, size and b (the blocks) of each SimHash of ``lines``."""
    halves = [F.shiftright(f"w{j}", 32).cast("int") if half == 0 else F.shiftright(F.shiftleft(f"w{j}", 32), 32).cast("int") for j in range(BLOCKS // 2) for half in range(2)]
    own = lines.where("size is not null").select("k", "size", F.array(*halves).alias("b"))
    more = lines.where("more is not null").select("k", F.get("more", F.lit(0)).alias("size"), F.slice("more", 2, BLOCKS).alias("b"))
    return own.unionByName(more)


def shared_blocks(hashed: DataFrame) -> DataFrame:
    """k, size and v of the SimHashes in ``hashed``: in v those of its blocks that another line has at the same place, in order.

    A block is a long here: its bits, the words in a block and its place. A key of a block that no other line has is no
    other line's either, so most of a line's keys need not be made.
    """
    blocks = F.array(*(F.shiftleft(F.get("b", F.lit(j)).cast("long"), 8).bitwiseOR((F.col("size") * 8 + j).cast("long")) for j in range(BLOCKS)))
    rows = hashed.select("k", F.explode(blocks).alias("v")).repartition("v")
    several = rows.groupBy("v").agg(F.min("k").alias("k0"), F.max("k").alias("k1")).where("k0 < k1").select("v").hint("shuffle_hash")
    size = F.shiftright("v", 3).bitwiseAND(F.lit(31)).cast("int")
    return rows.join(several, "v").groupBy("k", size.alias("size")).agg(F.array_sort(F.collect_list(F.struct(F.col("v").bitwiseAND(F.lit(7)).alias("at"), "v"))).alias("v")).select("k", "size", F.col("v.v").alias("v"))


def block_keys(hashed: DataFrame) -> DataFrame:
    """key and k: a key for each choice of EQUAL blocks of each SimHash in ``hashed`` that other lines have each of.

    By the pigeonhole principle two lines share a key if their edits leave that many blocks of a SimHash
    untouched, so surely if no more than BLOCKS - EQUAL places of one of the other's words are edited.
    """
    picked = F.lit(None)
    for size, equal in EQUAL.items():
        chosen = combinations(range(BLOCKS), equal)
        picked = F.when(F.col("size") == size, F.array(*(F.array(*map(F.lit, (c + (-1,) * BLOCKS)[:BLOCKS])) for c in chosen))).otherwise(picked)
    rows = shared_blocks(hashed).select("k", "v", F.explode(picked).alias("c")).where(F.array_max("c") < F.size("v"))
    return rows.select(F.xxhash64(*(F.get("v", F.get("c", F.lit(i))) for i in range(max(EQUAL.values())))).alias("key"), "k")


def numbered_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, pos, words and k (a hash of the words) of the lines with a word or number in them.

    The words in lower case are a line's normal form.
    """
    return numbered(split_lines(docs))


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, pos and line (in lower case) of all lines of ``docs``.

    The outer explode keeps the optimiser from splitting the texts twice to look for empty arrays.
    """
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode_outer(F.split(F.lower("text"), "\n")).alias("pos", "line"))


def numbered(lines: DataFrame) -> DataFrame:
    """``numbered_lines`` of ``split_lines``; the filter does not ask for the words, as they would be made twice."""
    words = lines.where(F.col("line").rlike(LETTER)).withColumn("words", F.array_remove(F.split("line", SIGNS), ""))
    return words.select("doc_id", "text_hash", "pos", "words", F.xxhash64("words").alias("k"))


#: Bits of a line's position in its home; all further lines of a text have the last number.
HOME_BITS = 20


def home_of(text_hash: str, pos: str) -> Column:
    """A place as one long: the upper bits of the text's hash, then the position."""
    last = 2**HOME_BITS - 1
    return F.col(text_hash).bitwiseAND(F.lit(-last - 1)).bitwiseOR(F.least(F.col(pos), F.lit(last)).cast("long"))


def text_bits(home: Column | str) -> Column:
    """The part of ``home_of`` that is the text's, of a place or of a text's hash."""
    return F.shiftright(home, HOME_BITS)


def first_place() -> Column:
    """A line's place, ordered by doc_id (null last), text hash and position."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "pos")


def places_of(docs: DataFrame) -> DataFrame:
    """Each line's key k, place and SimHashes (``with_blocks``)."""
    return with_blocks(numbered_lines(docs)).drop("words")


def distinct_lines(places: DataFrame) -> DataFrame:
    """k, n (places), home (the least of them, ``home_of``), size and w0, w1, w2 of each distinct line of ``places``."""
    same = [F.max(c).alias(c) for c in ("size", *(f"w{j}" for j in range(BLOCKS // 2)))]
    return places.groupBy("k").agg(F.count("*").alias("n"), F.min(home_of("text_hash", "pos")).alias("home"), *same)


def bitmap(keys: Column) -> tuple[Column, Column]:
    """Word and bit of a key in a bitmap of a fixed size."""
    return F.shiftright(keys, 6).bitwiseAND(F.lit(FILTER_WORDS - 1)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), keys.bitwiseAND(F.lit(63)).cast("int"))


def marked(rows: DataFrame, key: str, among: DataFrame) -> DataFrame:
    """``rows`` with _maybe: false where ``key`` is surely not among the first column of ``among``.

    Made from a bitmap of FILTER_WORDS longs at most, which is broadcast. With more keys it says maybe
    more often, so it saves shuffling and never loses a row.
    """
    word, bit = bitmap(F.col(among.columns[0]))
    bits = F.broadcast(among.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits")))
    word, bit = bitmap(F.col(key))
    return rows.withColumn("_word", word).join(bits, "_word", "left").withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits")


def with_codes(lines: DataFrame) -> DataFrame:
    """k, norm (the line's words) and code of ``lines``; code is for lines of LONG words a string with one character for each.

    Its 54,784 characters are those from U+0100 to below the surrogates, picked by a hash, so that different words
    have the same one by chance rarely enough not to matter to a share of words. norm is dropped where it is not needed.
    """
    hexes = F.transform("words", lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(0xD600)) + 0x100), 4, "0"))
    code = F.when(F.size("words") >= LONG, F.decode(F.unhex(F.array_join(hexes, "")), "UTF-16BE"))
    return lines.select("k", F.when(F.size("words") < 2 * LONG, F.array_join("words", " ")).alias("norm"), code.alias("code"))


def near(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b: line keys) whose lines have the edit similarity: 1 - distance / longer length.

    Two lines of LONG words or more are told apart by words, all others by characters. Most near pairs are
    so within a narrow band of edits, which is tried first.
    """
    side = lambda key, c: texts.select(F.col("k").alias(key), F.col("norm").alias(f"n{c}"), F.col("code").alias(f"c{c}"))
    joined = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    return cut(joined.where(alike(similarity)).select("a", "b"))


def alike(similarity: float) -> Column:
    """Whether the lines nx, cx and ny, cy (norm and code) have the edit similarity."""
    long = F.col("cx").isNotNull() & F.col("cy").isNotNull()
    x, y = (F.when(long, F.col(f"c{c}")).otherwise(F.col(f"n{c}")) for c in "xy")
    most = F.floor(F.greatest(F.length(x), F.length(y)) * (1 - similarity) + 1e-9).cast("int")
    inside = lambda band: F.call_function("levenshtein", x, y, band) >= 0
    return (F.abs(F.length(x) - F.length(y)) <= most) & (inside(F.least(most, F.lit(16))) | ((most > 16) & inside(most)))


def texts_of(keys: DataFrame, lines: DataFrame, docs: DataFrame) -> DataFrame:
    """k, norm and code of the lines ``keys``.

    A line is read at one place (``home``). Documents that surely have no such place are not even split, and lines that
    surely stand at none are not parted into words.
    """
    homes = cut(keys.join(lines.select("k", "home"), "k"))
    some = marked(docs.withColumn("_h", text_bits(F.xxhash64("text"))), "_h", homes.select(text_bits("home")).distinct()).where("_maybe").select("doc_id", "text")
    # Hashed, as the filter looks at the lower bits, where the positions are.
    placed = split_lines(some).withColumn("_home", F.xxhash64(home_of("text_hash", "pos")))
    found = numbered(marked(placed, "_home", homes.select(F.xxhash64("home"))).where("_maybe")).select("k", "words")
    return cut(with_codes(found).join(homes, "k", "left_semi").dropDuplicates(["k"]))


def buckets(ties: DataFrame) -> DataFrame:
    """``ties`` (key, k) whose key several lines have, each with the least (k0) and the greatest (k1) of them.

    Dealt by key once: the count and the join both use this exchange. Few keys are shared, so the join holds
    those of a partition and streams the ties past them, unsorted.
    """
    ties = ties.repartition("key")
    several = ties.groupBy("key").agg(F.min("k").alias("k0"), F.max("k").alias("k1")).where("k0 < k1").hint("shuffle_hash")
    return cut(ties.join(several, "key").distinct())


def near_line_groups(places: DataFrame, lines: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Connected groups of near lines: node and root for the keys that are not their group's root.

    Lines that share a block key are a bucket. Each line of a bucket is held against two heads of the bucket,
    which finds most of what belongs together. The lines that are not near the first head then have two
    heads of their own. What is left are buckets of several groups: there all lines that are not in one group yet
    are held against each other (``near_apart``), so no near pair that shares a key is left out. Only these comparisons
    can grow with the square of a bucket; their pairs are not listed.
    """
    more = cut(places.where("more is not null or but_one is not null").select("k", "more", "but_one").dropDuplicates(["k"]))
    hashed = simhashes(lines.select("*", F.lit(None).cast("array<int>").alias("more"))).unionByName(simhashes(more.select("*", F.lit(None).cast("int").alias("size"), *(F.lit(None).cast("long").alias(f"w{j}") for j in range(BLOCKS // 2)))))
    shared = buckets(block_keys(hashed).unionByName(more.where("but_one is not null").select(F.explode("but_one").alias("key"), "k")))
    texts = texts_of(shared.select("k").distinct(), lines, docs)
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    def held(rows: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Pairs of ``rows`` with their heads but those held against each other ``before``, the near ones, and the rows that are not near the first."""
        pairs = rows.select("k", F.explode(F.array("k0", "k1")).alias("h")).where("k <> h").select(*pair("k", "h")).distinct()
        pairs = cut(pairs.join(before, ["a", "b"], "left_anti") if before else pairs)
        found = near(pairs, texts, similarity)
        lone = rows.where("k <> k0").select("key", "k", *pair("k", "k0")).join(found, ["a", "b"], "left_anti").select("key", "k")
        return pairs, found, lone

    tried, edges, lone = held(shared, None)
    _, more_edges, _ = held(buckets(lone), tried)
    edges = edges.unionByName(more_edges)
    groups = components(edges)
    # A group's lines are tied to its root here, which takes fewer rounds than the pairs that made it.
    return components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(near_apart(shared, groups, texts, similarity)))


def near_apart(shared: DataFrame, groups: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """All near pairs (a, b) of lines that share a key and are in different ``groups`` (node, root).

    Most buckets are of one group and drop out. The others are dealt in parts of PART lines, and each two parts of a bucket
    meet as a group of their own, with their texts. The join compares and puts out near pairs only, so what is written grows
    with the parts, and no task holds a bucket's pairs.
    """
    rooted = shared.join(groups.withColumnRenamed("node", "k"), "k", "left").select("key", "k", F.coalesce("root", "k").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("r0 < r1").select("key", "parts")
    inside = rooted.join(mixed, "key").groupBy("k").agg(F.min("root").alias("root"), F.array_sort(F.collect_list(F.struct("key", "parts"))).alias("ins"))
    each = inside.join(texts, "k").select("k", "root", "norm", "code", F.col("ins.key").alias("keys"), F.posexplode("ins").alias("at", "in"))
    dealt = cut(each.select("in.key", "k", "root", "norm", "code", F.slice("keys", F.lit(1), F.col("at")).alias("lesser"), "in.parts", F.pmod("k", "in.parts").cast("int").alias("part")))
    side = lambda c, own, other: dealt.select("key", *(F.col(x).alias(f"{y}{c}") for x, y in (("k", "k"), ("root", "r"), ("norm", "n"), ("code", "c"), ("lesser", "s"))), F.col("part").alias(own), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(other))
    # Two lines that share several of these buckets are compared in the one with the least key.
    once = ~F.arrays_overlap("sx", "sy")
    return cut(side("x", "p", "q").join(side("y", "q", "p"), ["key", "p", "q"]).where((F.col("kx") < F.col("ky")) & (F.col("rx") != F.col("ry")) & once & alike(similarity)).select(F.col("kx").alias("a"), F.col("ky").alias("b")))


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one occurrence of each group of near lines, plus n_lines and n_removed.

    Lines are what newlines part. They are compared by their words (``numbered_lines``): equal words are one
    line; lines of LEAST_CHARS characters or more are near if they share a block key (``block_keys``; the
    README gives the measured recall) and their edit similarity is ``similarity`` or more; a group is what near
    pairs connect. The occurrence that stays is the first by doc_id (null last), text hash and position, with
    its own text. Lines without a letter or digit always stay. A null text stays null, with 0 lines.
    Rows with equal doc_id and text are one document given repeatedly and get equal results. An empty
    table gives an empty result. All columns are kept; n_lines and n_removed of ``docs`` are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    own = [f"c{k}" for k in range(len(names))]  # so that no column's name clashes with those made here
    doc_id, text_ = (own[names.index(c)] for c in ("doc_id", "text"))
    slim = docs.select("doc_id", "text")
    places = cut(places_of(slim))
    lines = cut(distinct_lines(places))
    groups = near_line_groups(places, lines, slim, similarity)
    rooted = lines.select("k", "n").join(groups.withColumnRenamed("node", "k"), "k", "left").select("k", F.coalesce("root", "k").alias("root"), "n")
    kept = cut(rooted.join(rooted.groupBy("root").agg(F.sum("n").alias("total")).where("total > 1"), "root").select("k", "root"))
    # Places of lines that surely have no like stay out of the join.
    often = cut(marked(places.select("k", "doc_id", "text_hash", "pos"), "k", kept.select("k")).where("_maybe").join(kept, "k").select("root", first_place().alias("place")))
    heads = often.groupBy("root").agg(F.min("place").alias("head"))
    gone = often.join(heads, "root").where("place <> head").select("place.doc_id", "place.text_hash", "place.pos")
    gone = gone.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("_gone")).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    # Documents that surely lose no line skip the join.
    gone = cut(gone)
    told = marked(docs.drop("n_lines", "n_removed").toDF(*own).withColumn("_h", F.xxhash64(text_)), "_h", gone.select("_hash").distinct())
    joined = told.where("_maybe").join(gone, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")), "left").select(*own, "_gone")
    whole = joined.unionByName(told.where("not _maybe").select(*own, F.lit(None).cast("array<int>").alias("_gone")))
    # What stands between two removed lines stays; cut out by positions, so long texts take linear time.
    # Both arrays are columns below the lambda, which would split and sort anew for each run.
    whole = whole.withColumns({"_gone": F.array_sort("_gone"), "_lines": F.when(F.col("_gone").isNotNull(), F.split(text_, "\n"))})
    runs = F.transform(F.sequence(F.lit(0), F.size("_gone")), lambda i: F.slice("_lines", F.when(i == 0, 0).otherwise(F.get("_gone", i - 1) + 1) + 1, F.when(i == F.size("_gone"), F.size("_lines")).otherwise(F.get("_gone", i)) - F.when(i == 0, 0).otherwise(F.get("_gone", i - 1) + 1)))
    text = F.when(F.col("_gone").isNull(), F.col(text_)).otherwise(F.array_join(F.flatten(runs), "\n"))
    return whole.select(
        *((text if c == text_ else F.col(c)).alias(name) for c, name in zip(own, names, strict=True)),
        F.coalesce(F.octet_length(text_) - F.octet_length(F.replace(text_, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def clean_lines(docs: DataFrame) -> DataFrame:
    """``docs`` after ``dedup_lines``, without those that are left without any line they had, and with their own columns only.

    n_chars (if there is such a column) of a changed text becomes its length.
    """
    rows, new = renamed(docs)
    rows = rows.withColumnsRenamed({new["doc_id"]: "doc_id", new["text"]: "text"})
    done = dedup_lines(rows)
    done = done.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[\p{L}\p{N}]"))
    if "n_chars" in new:
        done = done.withColumn(new["n_chars"], F.when(F.col("n_removed") == 0, F.col(new["n_chars"])).otherwise(F.length("text")).cast("long"))
    return done.select(*rows.columns).toDF(*docs.columns)
