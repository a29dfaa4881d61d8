"""The text operators against brute force on small tables, with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from saltmarsh.llm import html_template, imatch, jaccard_join, line_dedup, mixing, packing, pii, quality_classifier, quality_rules, stats, toxicity
from saltmarsh.llm.common import WORDS, WordHashes
from saltmarsh.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, size string, run int, _gone int"


#: Columns that documents may have besides their own, by the names that operators use inside.
CLASHING = ["_id", "_hash", "_hash_", "_own", "_word", "_key", "_n", "_left", "_tie", "_draw", "_bucket", "size", "target", "taken", "source_size", "n_lines", "n_removed", "k", "pos", "pick", "text_hash", "c0", "c1", "_gone", "_h", "at"]


def make(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, "s"), None if t is None else len(t), "x", "y", 1, 2) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, words=60):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "stone", "river", "cloud", "paper", "green", "quiet", "the", "of"]) + str(r.randint(0, 40)) * (r.random() < 0.6) for _ in range(words))


TRICKY = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "é́ ß İ <|endoftext|> x\x1cy　z"), (5, "word " * 3000), (6, "long" * 5000), (7, prose(1)), (7, prose(1)), (8, prose(1) + " tail"), (9, prose(2)), (10, "a\nb\na\n\n"),
    (None, prose(3)), (11, "A!! B!! C!! " * 20), (12, "!!! ### $$$"),
]


@pytest.fixture(scope="module")
def tricky(spark):
    return make(spark, TRICKY)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(13)] + [(3, None, None)], "doc_id long, quality int, toxic int")


def test_components_equal_union_find(spark):
    r = random.Random(5)
    pairs = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(9)] + [(3, 3), (None, 4)]
    least = {}

    def find(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            least[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: find(n) for n in least if find(n) != n}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1: personal data

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_by_rule(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda s: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(s[::-1])) % 10 == 0
    out = [(0, *m.span()) for m in EMAIL.finditer(t)] + [(1, *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    r = random.Random(1)
    for _ in range(20000):
        t = "".join(r.choice("ab1 2.5@-+()%04.١") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == base_by_rule(t)
    assert pii.base_spans("4111 1111 1111 1111 a@b.c +1 (017) 555-7713 1.2.3.256") == base_by_rule("4111 1111 1111 1111 a@b.c +1 (017) 555-7713 1.2.3.256")


def test_long_runs_take_linear_time():
    began = time.time()
    field = pii.Field()
    for t in ("a1 " * 40_000, "12345 " * 20_000, "x" * 200_000 + "1 " + "y" * 200_000):
        pii.added_spans(t, pii.base_spans(t), field)
    assert time.time() - began < 30
    for t in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+1 " * 100_000, "1." * 100_000):
        pii.base_spans(t)


def test_field_carries_labels_to_like_tokens(spark, tricky, empty):
    r = random.Random(2)
    number = lambda: f"(0{r.randint(10, 99)}) 555-{r.randint(1000, 9999)}"
    docs = make(spark, [(k, f"say {prose(k, 10)} +1 {number()} or {r.randint(1, 99)} items") for k in range(60)] + [(99, "dial +1 (017) 555-7713 now, then (017) 555-7713 again")])
    row = {x["doc_id"]: x for x in pii.find(docs).collect()}[99]
    assert (row["n_phone"], row["spans"]) == (1, "phone:5:22,phone:33:47")
    assert row["base_sha256"] == hashlib.sha256(b"phone:5:22").hexdigest()
    got = pii.find(tricky)
    assert got.count() == len(TRICKY) and got.where("spans <> ''").count() == 0
    assert pii.find(empty).count() == 0


# ---- 2: fingerprints


def test_fingerprints_edit_with_the_next_document(spark, tricky, empty):
    got = imatch.fingerprints(tricky).collect()
    order = sorted(((i, t or "") for i, t in TRICKY), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    prints = {r["doc_id"]: r["fingerprint"] for r in got if r["doc_id"] in (7,)}
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 7}) == 1 and prints
    assert imatch.fingerprints(empty).count() == 0
    (alone,) = imatch.fingerprints(make(spark, [(5, "abcd")])).collect()
    assert alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


def test_likeness_falls_with_edits():
    hashes = WordHashes()
    words = [f"w{k}" for k in range(400)]
    band = np.sort(hashes.of(words))
    mark = lambda ws: imatch.Fingerprint(" ".join(ws), np.sort(hashes.of(sorted(set(ws)))), band)
    whole = mark(words[:200])
    assert whole.like(mark(words[:200][::-1])) == 1.0
    assert whole.like(mark(words[10:200])) > whole.like(mark(words[100:300])) > whole.like(mark(words[200:]))


def test_copies_do_not_make_terms_common(spark):
    texts = [prose(k, 60) for k in range(60)]
    band, common = imatch.lexicon(make(spark, [(k, t) for k, t in enumerate([*texts, *[" ".join(f"hot{k}" for k in range(40))] * 40, "hot1 hot2 hot3 x1", *[None] * 30])]))
    hot = WordHashes().of(["hot1", "hot2", "hot3"])
    assert np.isin(hot, band).all() and not np.isin(hot, common).any()


def test_texts_without_terms_of_the_band_keep_their_likeness():
    hashes, none = WordHashes(), np.empty(0, np.uint64)
    words = [f"w{k}" for k in range(60)]
    mark = lambda ws, common: imatch.Fingerprint(" ".join(ws), np.sort(hashes.of(sorted(set(ws)))), none, common)
    for common in (none, np.sort(hashes.of(words)), np.sort(hashes.of(words[:20]))):
        whole = mark(words, common)
        assert whole.like(mark(words, common)) == 1.0
        assert whole.like(mark([*words[:59], "new"], common)) > 0.3 > whole.like(mark([f"v{k}" for k in range(60)], common))


# ---- 3: n-gram Jaccard join


def shingles(t):
    w = WORDS(t or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def edited(t, seed, n):
    r, w = random.Random(seed), t.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randint(0, 999)}"
    return " ".join(w)


def test_classes_equal_all_pairs(spark, tricky, empty):
    texts = [(k, prose(k, 120)) for k in range(40)] + [(100 + k, edited(prose(k % 8, 120), k, k % 5)) for k in range(60)] + [(200, None), (201, ""), (202, "two words"), (203, "two words")]
    sets = {i: shingles(t) for i, t in texts}
    links = {i: [j for j in sets if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in sets}
    root = {i: i for i in sets}
    for _ in sets:
        root = {i: min([root[i], *(root[j] for j in links[i])]) for i in sets}
    for block in (256, 3):
        got = jaccard_join.classes(make(spark, texts), block=block).collect()
        assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == {i: (root[i], len(links[i])) for i in sets}
    kept = {r["doc_id"] for r in jaccard_join.keep_one(make(spark, texts)).collect()}
    assert kept == set(root.values())
    nulls = jaccard_join.classes(make(spark, [(None, prose(1)), (None, prose(2)), (-1, prose(3)), (None, prose(1))])).collect()
    assert sorted((r["n_links"], r["class_id"] or 0) for r in nulls) == [(0, -1), (0, 0), (1, 0), (1, 0)]
    assert jaccard_join.classes(tricky).count() == len(TRICKY) and jaccard_join.classes(empty).count() == 0
    assert jaccard_join.keep_one(tricky).columns == tricky.columns and jaccard_join.keep_one(tricky).count() == len(TRICKY) - 2  # the repeat of 7, and 8


def test_prefix_reaches_the_target_recall():
    p = jaccard_join.prefix_length()
    found = lambda n: 1 - (1 - 0.8**n) ** jaccard_join.TREES
    assert found(p) >= jaccard_join.RECALL > found(p + 1)


def test_ties_connect_what_shares_a_prefix(spark):
    """Components of the ties are those of all pairs of signatures that share three values at the start of some trie."""
    r = np.random.default_rng(2)
    signature = r.integers(0, 3, (150, 12)).astype(np.uint8)
    sets = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(signature)], "node long, signature binary")
    got = {x["node"]: x["root"] for x in components(jaccard_join.tied(sets, 3, 4, 3)).collect()}
    root = list(range(150))
    for _ in range(150):
        for t in range(3):
            least = {}
            for k, x in enumerate(signature):
                key = x[4 * t : 4 * t + 3].tobytes()
                least[key] = min(least.get(key, 999), root[k])
            root = [min(root[k], least[x[4 * t : 4 * t + 3].tobytes()]) for k, x in enumerate(signature)]
    assert got == {k: root[k] for k in range(150) if root[k] != k}


def test_recall_of_pairs_near_the_threshold_and_chains_of_weak_likeness(spark):
    texts, r = [], random.Random(8)
    word = lambda: f"w{r.randint(0, 10**6)}"
    for k in range(60):  # pairs at about 0.8 to 0.95
        ws = [word() for _ in range(200)]
        other = list(ws)
        for at in range(5, 5 + 20 * (1 + k % 4), 20):
            other[at] = word()
        texts += [(2 * k, " ".join(ws)), (2 * k + 1, " ".join(other))]
    chain = [word() for _ in range(1500)]
    texts += [(1000 + k, " ".join(chain[5 * k : 5 * k + 60])) for k in range(280)]  # neighbours at about 0.84, the next at 0.7
    got = {x["doc_id"]: x["n_links"] for x in jaccard_join.classes(make(spark, texts), block=16).collect()}
    sets = {i: shingles(t) for i, t in texts}
    near = [(i, j) for i in sets for j in sets if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = Counter(x for p in near for x in p)
    assert sum(got.values()) >= 0.98 * sum(want.values()) and all(got[i] <= want[i] for i in got) and len(near) > 300


# ---- 4: quality rules


def test_base_counts_equal_the_rule(spark, tricky, labels, empty):
    def rule(t):
        t = t or ""
        w, lines = WORDS(t), [x for x in t.split("\n") if WORDS(x)]
        spans = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if spans[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)

    got = quality_rules.apply_rules(tricky, labels).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter((i, *rule(t)) for i, t in TRICKY)
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["kept"] and r["base_failed"]) for r in got)
    none = quality_rules.apply_rules(tricky, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in none)
    assert quality_rules.apply_rules(empty, labels).count() == 0


def test_trees_are_monotonic_and_learn():
    r = np.random.default_rng(0)
    x = r.random((2000, 3))
    y = ((x[:, 0] < 0.6) & (x[:, 1] > 0.3)).astype(float)
    y[r.random(2000) < 0.1] = 1
    model = quality_rules.fit(x, y, np.array([-1, 0, 0]))
    assert ((model.scores(x) >= 0.5) == ((x[:, 0] < 0.6) & (x[:, 1] > 0.3))).mean() > 0.95
    line = np.linspace(0, 1, 200)
    for a, b in r.random((30, 2)):
        assert (np.diff(model.margins(np.column_stack([line, np.full(200, a), np.full(200, b)]))) <= 1e-12).all()


# ---- 5: packing


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    draw, path = random.Random(5), packing.tokenizer_path()
    signs = [*"abcXYZ.,.,'  \n\t'sstmdlrve0123()_-\"<|>\x1c\x1f\x85\xa0éÀßİıŉſ²ªº×÷¿´Ω中😀ﬁ\u0307\u0301", "foo", "bar, ", "baz. ", "it's, ", "<|endoftext|>", ".\n", ",\n"]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randrange(40))) for _ in range(5000)]
    library = Tokenizer.from_file(path)
    for text, ids in zip(texts, packing.ids_of(iter(texts), path, block=3000), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_ids_with_a_memory_that_forgets():
    from tokenizers import Tokenizer

    draw, path, most = random.Random(6), packing.tokenizer_path(), 40_000
    words, library = packing.Words(path, most), Tokenizer.from_file(path)
    common = ["the", "of", "it's", "x1.", "Ünder"]
    for _ in range(60):
        texts = [" ".join(draw.choice([*common, f"w{draw.randrange(10**6)}é", "".join(draw.choices("abcdefgh", k=9))]) for _ in range(30)) for _ in range(3)]
        for text, ids in zip(texts, words.ids([words.chunks(t) for t in texts]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert not words.memory.unknown and words.memory.bytes < most // 2 + 40_000
    assert isinstance(words.memory.older, packing.Memory) and "the" in words.memory



def test_packing_keeps_every_token_once(tricky, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids = {i: [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for j, t in TRICKY if j == i] for i, _ in TRICKY}
    got = packing.pack(tricky).collect()
    want = Counter()
    for i, many in ids.items():
        for doc in many:
            for start in range(0, len(doc), packing.WINDOW):
                piece = np.array(doc[start : start + packing.WINDOW], "<u4")
                want[i, start, len(piece), zlib.crc32(piece.tobytes()), len(doc)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert packing.pack(empty).count() == 0


def test_plan_uses_up_the_histogram_with_little_padding():
    r = np.random.default_rng(3)
    histogram = np.bincount(np.minimum(r.geometric(0.003, 20000), 2048), minlength=2049)
    plan, used = packing.fill_counts(histogram), np.zeros(2049, int)
    for combo, n in plan:
        assert sum(combo) <= 2048
        for length in combo:
            used[length] += n
    assert (used == histogram).all()
    tokens = (histogram * np.arange(2049)).sum()
    assert sum(n for _, n in plan) * 2048 < 1.01 * tokens


# ---- 6: html


def test_article_without_furniture():
    page = '<html><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><nav><a>Home</a></nav><div class="wrap"><article><h1>T &amp; x</h1><p>One two<br>three <b>bo</b>ld.<p>Next &eacute;&nbsp;x<ul><li>a<li>b</ul><div class="ad-box">Buy</div><form>q</form></article></div><aside>side</aside><section id="comments"><p>hi</p></section><footer>f</footer><script>var t="</p>";</script>'
    parsed = html_template.parse(page)
    assert html_template.Template([parsed]).extract(parsed) == "T & x\nOne two three bold.\nNext é x\na\nb"


@pytest.mark.parametrize("name", ["layout sidebar-left", "page-notice-board", "search-results-article", "post-comments-enabled", "social-post"])
def test_wrappers_named_like_furniture_keep_the_text(name):
    text, side = prose(1, 40), '<div class="sidebar"><p>Some other links</p></div><div id="comments"><article class="comment">I like it</article></div>'
    for page in (f'<div class="{name}"><article><p>{text}</p></article>{side}</div>', f'<main><div class="{name}"><p>{text}</p></div></main>{side}', f'<div id="x" class="{name}"><div><p>{text}</p></div></div>{side.replace("article", "p")}'):
        parsed = html_template.parse(f"<html><body>{page}</body></html>")
        assert html_template.Template([parsed]).extract(parsed) == text


@pytest.mark.parametrize("inner, seen", [('<svg class="icon" />', ""), ("<math/>", ""), ("<math><mi>x</mi></math>", "x"), ("<object>", ""), ("<object>instead</object>", "instead"), ("<select><option>no", ""), ("<video>", ""), ("<svg><text>no</text></svg>", ""), ("<canvas>no</canvas>", "")])
def test_unclosed_elements_do_not_take_the_page(inner, seen):
    parsed = html_template.parse(f"<html><body><article><p>one {inner}</p><p>two</p></article></body></html>")
    assert html_template.Template([parsed]).extract(parsed) == f"one {seen}".strip() + "\ntwo"


def test_template_of_pages_without_an_article(spark):
    page = lambda k: f'<html><body><div class="top">Site name here</div><div class="body"><p>{prose(k, 30)}</p><p>{prose(100 + k, 20)}</p></div><div class="end">All rights reserved</div></body></html>'
    rows = [(k, f"http://host/{k}", page(k)) for k in range(9)] + [(20, None, None), (21, "http://h/", ""), (22, "x", "plain <b>text"), (23, "http://q/", "<p " * 2000), (24, "http://q/", "<div>" * 3000 + "deep")]
    got = {r["page_id"]: r for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k]["text"] == f"{prose(k, 30)}\n{prose(100 + k, 20)}" for k in range(9))
    assert [got[k]["text"] for k in (20, 21, 22, 24)] == ["", "", "plain text", "deep"] and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_template.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    clash = spark.createDataFrame([(1, "http://h/", "<p>a", 5, "q", 7)] * 3 + [(None, "http://h/", "<p>b", 5, "q", 7)], "page_id long, url string, html string, part int, host string, count int")
    assert sorted(r["text"] for r in html_template.extract(clash).collect()) == ["a", "a", "a", "b"]


def test_classes_find_the_text_of_several_layouts():
    """Pages without an article, of two layouts with unnamed parts around the text; without the classes these stay in it."""
    side = lambda k: f"{prose(500 + k, 6)}"
    one = lambda k: f'<html><body><div class="a"><p>{side(k)}</p></div><div class="b"><p>{prose(k, 40)}</p><p>{prose(100 + k, 30)}</p></div><div class="c">{side(k + 50)}</div></body></html>'
    two = lambda k: f'<html><body><table><tr><td class="x">{side(k)}</td><td class="y"><p>{prose(k, 40)}</p><div>{prose(100 + k, 30)}</div></td></tr></table></body></html>'
    pages = [html_template.parse(one(k)) for k in range(8)] + [html_template.parse(two(k)) for k in range(20, 26)]
    want = [f"{prose(k, 40)}\n{prose(100 + k, 30)}" for k in (*range(8), *range(20, 26))]
    whole, off = html_template.Template(pages), html_template.Template(pages, support=10**9)
    assert [whole.extract(p) for p in pages] == want
    assert not any(off.extract(p) == w for p, w in zip(pages, want, strict=True))


def test_classes_equal_brute_force():
    r = random.Random(3)
    for _ in range(300):
        pages = [[r.choice("abcdef") for _ in range(r.randint(0, 7))] for _ in range(r.randint(1, 4))]
        vectors = {t: tuple(p.count(t) for p in pages) for p in pages for t in p}
        assert html_template.occurrence_vectors(pages) == vectors
        for c in html_template.valid_classes(pages, 2):
            v = vectors[c[0]]
            assert all(vectors[t] == v for t in c) and sum(n > 0 for n in v) >= 2
            assert all([t for t in p if t in c] == c * n for p, n in zip(pages, v, strict=True))


def test_unmatched_tags_and_depth_take_linear_time():
    began = time.time()
    for page in ("<div>" * 20_000 + "x" + "</b>" * 20_000, "<b>" * 20_000 + "</i>" * 20_000 + "<p>x" * 2000, "<ul><li>x" * 5000, '<div class="ad">' * 5000 + "x"):
        parsed = html_template.parse(page)
        html_template.Template([parsed]).extract(parsed)
    assert time.time() - began < 20


def test_copies_are_no_template_but_repeated_blocks_of_an_article_are():
    text = lambda page, among: html_template.Template([html_template.parse(x) for x in among]).extract(html_template.parse(page))
    copy = f'<html><body><div class="body"><p>{prose(1, 30)}</p></div></body></html>'
    assert text(copy, [copy] * 6) == prose(1, 30)
    pages = [f'<html><body><article><p>{prose(k, 30)}</p><div class="x">Join our list today</div></article></body></html>' for k in range(6)]
    assert [text(x, pages) for x in pages] == [prose(k, 30) for k in range(6)]


# ---- 7: quality classifier


def test_em_finds_the_accurate_labellers():
    r = np.random.default_rng(1)
    truth, width = r.random(4000) < 0.7, len(quality_classifier.LABELLERS)
    right = np.linspace(0.95, 0.6, width)
    votes = np.where(r.random((4000, width)) < right, np.where(truth, 1, 2)[:, None], np.where(truth, 2, 1)[:, None])
    codes, at, counts = np.unique((votes * 3 ** np.arange(width - 1, -1, -1)).sum(1), return_inverse=True, return_counts=True)
    odds, prior = quality_classifier.accuracies(codes, counts.astype(float))
    assert ((quality_classifier.posterior(codes, odds, prior) >= 0.5)[at] == truth).mean() > 0.95


def test_classifier_on_labelled_documents(spark, data, tricky, empty):
    docs, known = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = quality_classifier.classify(docs).join(known, "doc_id").select("kept", "quality").collect()
    good, bad = [r["kept"] for r in got if r["quality"] == 1], [r["kept"] for r in got if r["quality"] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.3
    assert quality_classifier.keep_good(docs).columns == docs.columns
    clash = docs.limit(150).withColumns({c: F.col("doc_id") * 2 for c in CLASHING})
    for stage in (quality_classifier.keep_good, jaccard_join.keep_one, mixing.mixed_corpus, line_dedup.clean_lines):
        out = stage(clash)
        assert out.columns == clash.columns and 0 < out.count() == out.where(" and ".join(f"{c} = 2 * doc_id" for c in CLASHING)).count()
    rows = quality_classifier.classify(tricky).collect()
    assert len(rows) == len(TRICKY) and not any(r["kept"] for r in rows if r["doc_id"] in (0, 1, 2))
    assert quality_classifier.keep_good(empty).count() == 0


# ---- 8: toxicity


def test_disguised_words_are_restored(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    corpus = docs.select("text").unionByName(spark.createDataFrame([("idiot moron stupid trash loser clown " * 20,)], "text string"))
    restorer = toxicity.Restorer(toxicity.language_model(toxicity.trigram_counts(corpus)))
    told = {"m0r0n": "moron", "stuuupid": "stupid", "tr4$h": "trash", "l.o.s.e.r": "loser", "cl0wn.": "clown", "the###": "the"}
    assert {k: restorer.words(k)[0] for k in told} == told
    assert restorer.words("you i d i o t there") == ["you", "idiot", "there"] and restorer.words("1 d 1 0 t") == ["idiot"] and restorer.words("st u p 1 d") == ["stupid"]
    assert restorer.words("m" + "o" * 300 + "r0n") == ["moron"] and restorer.words("a" * 100_000 + "1")[0][:1] == "a"
    assert restorer.words("plain Words, here") == ["plain", "words", "here"]


def auc(rows):
    """Chance that a toxic row scores above a clean one, ties half."""
    bad, good = ([r["score"] for r in rows if r["toxic"] == k] for k in (1, 0))
    return np.mean([(x > y) + (x == y) / 2 for x in bad for y in good])


def test_held_out_toxicity(spark, data, tricky, labels, empty):
    """On documents that were not learnt from: by order and by the toxic ones found, so that no constant answer passes."""
    more = data.replace("sf0.001", "sf0.01")
    docs, known = spark.read.parquet(f"{more}/documents.parquet"), spark.read.parquet(f"{more}/labels.parquet")
    got = toxicity.score_documents(docs, known).join(known, "doc_id").collect()
    held = [r for r in got if r["held_out"] and r["toxic"] is not None]
    toxic = [r for r in held if r["toxic"] == 1]
    assert len(toxic) >= 5 and auc(held) >= 0.9
    assert np.mean([r["predicted"] for r in toxic]) >= 0.6 and np.mean([r["predicted"] for r in held if r["toxic"] == 0]) <= 0.05
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.score_documents(tricky, labels).count() == len(TRICKY) and toxicity.score_documents(tricky, labels.limit(0)).count() == len(TRICKY)
    assert toxicity.score_documents(empty, labels).count() == 0


# ---- 9: line dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def normal(line):
    return re.sub(r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ", line.lower()).strip()


def test_line_dedup_equals_all_pairs_by_edit_similarity_alone(spark, empty):
    long_line = prose(50, 300)
    lines = [prose(k, 30) for k in range(12)]
    docs = [(k, "\n".join([lines[k % 12], edited(lines[(k + 3) % 12], k, k % 3), "***", "Short one!", lines[k % 12].upper() + "!"])) for k in range(30)] + [(40, long_line), (41, edited(long_line, 1, 3)), (42, None), (43, ""), (44, "\n\n"), (None, lines[5])]
    places = sorted(((i is None, i or 0, pos), i, normal(x)) for i, t in docs for pos, x in enumerate((t or "").split("\n")) if normal(x))
    norms = sorted({x for *_, x in places})
    root = {x: x for x in norms}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(norms):
        for y in norms[:i]:
            if len(x) >= line_dedup.LEAST_CHARS <= len(y) and distance(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    first, gone = {}, {}
    for place, i, x in places:
        if first.setdefault(find(x), place) is not place:
            gone.setdefault(i, set()).add(place[2])
    want = {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in docs}
    df = make(spark, docs)
    got = line_dedup.dedup_lines(df)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    assert len({find(x) for x in norms}) < len(norms)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_recall_of_near_lines(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))
    cases, docs, near_pairs = ((5, 1), (8, 1), (12, 1), (20, 1), (20, 2), (23, 1), (31, 2), (40, 2), (50, 3), (80, 8), (200, 5), (200, 20)), [], Counter()
    for k, case in enumerate(cases):
        for kind in ("new", "out", "in", "letter"):
            lines = [[word() for _ in range(case[0])] for _ in range(50)]
            near = [list(ws) for ws in lines]
            for ws, old in zip(near, lines, strict=True):
                for at in sorted(r.sample(range(case[0]), case[1]), reverse=True):
                    ws[at : at + 1] = {"new": [word()], "out": [], "in": [ws[at], word()], "letter": [ws[at] + "x"]}[kind]
                # Ten letters at most for each edit of a word, so these are surely near.
                near_pairs[2 * len(docs)] += 10 * case[1] <= 0.2 * len(" ".join(old)) or distance(" ".join(ws), " ".join(old)) <= 0.2 * max(len(" ".join(ws)), len(" ".join(old)))
            docs.append((2 * len(docs), "\n".join(map(" ".join, lines)), "\n".join(map(" ".join, near))))
    got = {row["doc_id"]: row["n_removed"] for row in line_dedup.dedup_lines(make(spark, [x for i, a, b in docs for x in ((i, a), (i + 1, b))])).collect()}
    found = [got[i + 1] / max(near_pairs[i], 1) for i, *_ in docs]
    assert all(got[i] == 0 and got[i + 1] <= near_pairs[i] for i, *_ in docs)
    assert sum(got.values()) >= 0.95 * sum(near_pairs.values()), found
    assert sum(x >= 0.9 for x, (i, *_) in zip(found, docs, strict=True) if near_pairs[i] >= 8) >= 0.85 * sum(n >= 8 for n in near_pairs.values()), found


def test_short_and_repeated_lines(spark):
    short = ["subscribe to our newsletter", "subscribe to our newsletters", "something else entirely", "one", "two", "ones", "w" * 5000, "w" * 5000 + "v", "one\none"]
    for times in (1, 3):
        got = {row["doc_id"]: row["n_removed"] for row in line_dedup.dedup_lines(make(spark, [(k, t) for k, t in enumerate(short)] * times)).collect()}
        assert [got[k] for k in range(len(short))] == [0, 1, 0, 0, 0, 0, 0, 1, 2]


def test_a_block_has_the_bits_of_most_of_its_words(spark):
    words = [f"w{k}" for k in range(24)]
    (row,) = line_dedup.with_blocks(spark.createDataFrame([(words,)], "words array<string>")).collect()
    hashes = [r["h"] for r in spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, w string").orderBy("k").select(F.xxhash64("w").alias("h")).collect()]
    bits = lambda hs: sum(1 << k for k in range(32, 64) if 2 * sum(h >> k & 1 for h in hs) > len(hs)) >> 32
    (own,) = line_dedup.simhashes(line_dedup.with_blocks(spark.createDataFrame([(1, words)], "k long, words array<string>")).withColumn("more", F.lit(None).cast("array<int>"))).collect()
    for size, got in ((own["size"], own["b"]), (row["more"][0], row["more"][1:])):
        starts = (0, size, 24 - size, 24 - 2 * size, 2 * size, 24 - 3 * size)
        assert [x % 2**32 for x in got] == [bits(hashes[i : i + size]) for i in starts]
    assert (own["size"], row["more"][0]) == (4, 3)


def test_native_plan_has_no_python(spark):
    df = make(spark, [(1, prose(1))])
    plan = line_dedup.places_of(df)._jdf.queryExecution().executedPlan().toString() + line_dedup.dedup_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- 10: mixing


def test_mix_meets_its_targets(spark, tricky, empty):
    texts = [(k, " ".join("w" * 1 for _ in range(1 + k % 17))) for k in range(400)] + [(500, None), (501, "")]
    sources = {k: ("a" if k < 20 else "b" if k < 140 else "c" if k < 300 else None) for k, _ in texts}
    df = make(spark, texts, sources)
    size, total = Counter(), 0
    for k, t in texts:
        size[sources[k]] += len(WORDS(t or ""))
    total, left, weight, target = sum(size.values()), None, dict(zip(("a", "b", "c", None), (5, 2, 1, 5), strict=True)), {}
    while True:  # reshare until none is above its cap
        open_ = [s for s in size if s not in target]
        left = total - sum(target.values())
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * size[s]]
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        target |= {s: 3 * size[s] for s in over}
    for per_bucket in (4096, 7):
        rows = mixing.mix(mixing.with_sizes(df), rows_per_bucket=per_bucket).collect()
        taken = Counter()
        for r in rows:
            taken[sources[r["doc_id"]]] += r["taken"]
            assert r["target"] == pytest.approx(target[sources[r["doc_id"]]]) and r["taken"] <= 3 * r["size"]
        assert all(taken[s] == int(target[s] + 1e-9) for s in size)
    words = mixing.mixed_corpus(df).select("source", mixing.count_words(F.col("text")).alias("n")).groupBy("source").sum("n").collect()
    assert {r[0]: r[1] for r in words} == dict(taken)
    assert mixing.mix(mixing.with_sizes(empty)).count() == 0 and mixing.mix(mixing.with_sizes(tricky)).count() == len(TRICKY)


def test_features_of_texts_without_words():
    for t in (None, "", " \n "):
        words, counts, features = stats.Reader().read(t)
        assert words == [] and counts[0] == 0 and len(features) == len(stats.FEATURES) and np.isfinite(features).all()
