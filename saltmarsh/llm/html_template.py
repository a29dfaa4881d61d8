"""HTML extraction: valid classes of tokens with equal occurrence vectors over same-host pages nest into a template, whose main slot is the text."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import cut, map_rows

#: Pages of a host that share a template, on average; larger hosts are dealt to several groups.
GROUP = 32
#: Distinct pages that must support a class of tokens, or text as the template's own. Fewer are no evidence.
SUPPORT = 3
#: Elements with names of furniture one inside another that are told apart; all within the last of them belongs to it.
MOST_NAMED = 100
#: Hosts with more pages than GROUP are broadcast up to so many, and joined by a shuffle beyond.
MOST_BROADCAST_ROWS = 50_000

# Names of HTML elements and of roles, and words that name page furniture in class and id attributes.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset("aside button dialog footer form head menu nav search".split())
FURNITURE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus dropdown footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar sidebars signup social sponsor sponsored sponsors subscribe subscription teaser toolbar topbar widget widgets".split()
)
#: Elements without text of the page. They end with their parent at the latest, those of BROKEN also where a block starts.
SKIPPED = frozenset("template svg select audio video canvas".split())
BROKEN = frozenset("svg math select".split())
CONTAINERS = frozenset("html body div section main article td tr tbody table center span".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|iframe|textarea|title)\b[^>]*+(?:>.*?(?:</\1\s*+[^>]*+(?:>|\Z)|\Z)|\Z)
    |<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']|"[^"<]*+"|'[^'<]*+')*+)(?:>|\Z)|<[/!?a-zA-Z][^>]*+(?:>|\Z)|[^<]++|<""",
    re.S | re.I | re.X,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z0-9]+")

_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


@dataclass
class Block:
    path: int
    furniture: bool
    text: str
    links: int
    named: tuple[int, ...] = ()


@dataclass
class Page:
    """A page's blocks of text, and its element tokens: the path of names from the root down, as a hash, in order of opening."""

    blocks: list[Block] = field(default_factory=list)
    order: list[int] = field(default_factory=list)
    parent: dict[int, int] = field(default_factory=dict)
    tag: dict[int, str] = field(default_factory=dict)


def _named(tag: str, attributes: dict[str, str]) -> str:
    """An element's token: its tag with its first class, or else its id, numbers left out."""
    name = (attributes.get("class", "").split() or attributes.get("id", "").split() or [""])[0]
    return f"{tag}.{re.sub('[0-9]+', '', name)}" if name else tag


def _furniture(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element surely holds page furniture. ``inside``: it stands in an article or main element."""
    if tag in FURNITURE_TAGS or tag == "header" and not inside:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return True
    return attributes.get("role", "").lower() in FURNITURE_ROLES


def _named_furniture(tag: str, attributes: dict[str, str]) -> bool:
    """Whether an element's class or id names page furniture, which a wrapper's may do as well."""
    role = attributes.get("role", "").lower()
    if tag in ("html", "body", "article", "main") or role in ("main", "article"):
        return False
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        words = _WORD.findall(name)
        if words and words[0] not in ("has", "with", "no", "without") and not FURNITURE_WORDS.isdisjoint(words):
            return True
    return False


def _judge(blocks: list[Block], slots: dict[int, str], holders: dict[int, tuple[int, ...]], within: dict[int, int]) -> None:
    """Mark the blocks in elements that are furniture by name, but not in those that hold the page's text.

    ``slots``: article and main elements; ``holders``: the named elements around each of them; ``within``:
    the slot that each named element stands in, or 0. Around a slot, those that hold the main element or the
    slot with most free words are wrappers. Within the slot (or on a page without one) those with more than half of
    its free words are.
    """
    free = [0 if b.furniture else len(b.text.split()) - b.links for b in blocks]
    held: Counter[int] = Counter()
    for b, n in zip(blocks, free, strict=True):
        for element in b.named:
            held[element] += n
    best = max(slots, key=lambda x: (slots[x] == "main", held[x], -x), default=0)
    wrappers = set(holders.get(best, ()))
    total = held[best] if best else sum(free)
    wrappers |= {x for x, slot in within.items() if slot == best and 2 * held[x] > total}
    for b in blocks:
        b.furniture = b.furniture or any(x in within and x not in wrappers for x in b.named)


def parse(source: str) -> Page:
    """Cut a page at block elements. Missing end tags are implied the usual way; unclosed elements end with the page."""
    page, stack = Page(), [("", 0, False, False, False, (), 0, False, 0)]  # tag, path, furniture, inside an article, inside a link, named elements and slots around, slot, skipped, where a block breaks out to
    slots: dict[int, str] = {}
    holders: dict[int, tuple[int, ...]] = {}
    within: dict[int, int] = {}
    number = 0
    standing: Counter[str] = Counter()  # tags on the stack, so that end tags of none of them cost nothing
    parts: list[str] = []
    links = 0

    def close_block() -> None:
        nonlocal links
        if parts:
            if text := " ".join(entities.unescape("".join(parts)).split()):
                _, path, furniture, _, _, named, *_ = stack[-1]
                page.blocks.append(Block(path, furniture, text, links, named))
            parts.clear()
            links = 0

    def pop_to(depth: int) -> None:
        if any(x[0] in BLOCKS for x in stack[depth:]):
            close_block()
        standing.subtract(x[0] for x in stack[depth:])
        del stack[depth:]

    for m in _TOKEN.finditer(source):
        raw, end, tag, inner = m.groups()
        if raw is not None or tag is None:
            if raw is None and not stack[-1][7] and not m[0].startswith("<!") and (m[0][0] != "<" or m[0] == "<"):
                parts.append(m[0])
                if stack[-1][4]:
                    links += len(m[0].split())
            continue
        tag = tag.lower()
        if end and not standing[tag]:
            continue
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if stack[k][0] in ("article", "main", "body", "table") and tag not in BLOCKS:
                    break
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCKS:
            if stack[-1][8]:
                standing.subtract(x[0] for x in stack[stack[-1][8] :])
                del stack[stack[-1][8] :]
            close_block()
            for k in range(len(stack) - 1, 0, -1) if standing["p"] > 0 or any(standing[x] > 0 for x in CLOSES.get(tag, ())) else ():
                if stack[k][0] == "p" or stack[k][0] in CLOSES.get(tag, ()):
                    pop_to(k)
                    break
                if stack[k][0] in BLOCKS and stack[k][0] not in ("tr", "td", "th"):
                    break
        if tag in VOID:
            continue
        attributes = {a.lower(): x or y or z for a, x, y, z in _ATTRIBUTE.findall(inner)} if inner.strip() else {}
        _, path, furniture, inside, link, named, slot, skipped, broken = stack[-1]
        skipped = skipped or tag in SKIPPED
        broken = broken or (len(stack) if tag in BROKEN else 0)
        if tag in BLOCKS and not skipped:
            above, path = path, hash((path, _named(tag, attributes)))
            page.order.append(path)
            page.parent[path], page.tag[path] = above, tag
        role = attributes.get("role", "").lower()
        is_slot = tag in ("article", "main") or role in ("main", "article")
        inside = inside or is_slot
        furniture = furniture or _furniture(tag, attributes, inside)
        number += 1
        if is_slot and not furniture and not skipped and not slot:
            slots[number], holders[number], named, slot = "main" if "main" in (tag, role) else "article", named, (*named, number), number
        elif not furniture and len(named) < MOST_NAMED and _named_furniture(tag, attributes):
            within[number], named = slot, (*named, number)
        standing[tag] += 1
        stack.append((tag, path, furniture, inside, link or tag == "a", named, slot, skipped, broken))
        if inner.rstrip().endswith("/") and tag not in BLOCKS:
            standing[tag] -= 1
            stack.pop()
    close_block()
    _judge(page.blocks, slots, holders, within)
    return page


def occurrence_vectors(pages: list[list]) -> dict[object, tuple[int, ...]]:
    """How often each token stands on each of ``pages`` (lists of tokens)."""
    found: dict[object, list[int]] = {}
    for k, tokens in enumerate(pages):
        for token, n in Counter(tokens).items():
            found.setdefault(token, [0] * len(pages))[k] = n
    return {token: tuple(v) for token, v in found.items()}


def in_order(tokens: list[int], pages: list[list[int]]) -> list[int]:
    """The largest part of ``tokens`` (each once on every page), page after page, that stands in the same order on all of ``pages``."""
    for page in pages:
        place = {token: k for k, token in enumerate(page)}
        ends: list[int] = []  # the least last place of a run of each length, and its token
        last, before = [], {}
        for token in tokens:
            k = bisect_left(ends, place[token])
            ends[k:], last[k:] = ([place[token]], [token]) if k == len(ends) else ([place[token], *ends[k + 1 :]], [token, *last[k + 1 :]])
            before[token] = last[k - 1] if k else None
        kept, token = [], last[-1] if last else None
        while token is not None:
            kept.append(token)
            token = before[token]
        tokens = kept[::-1]
    return tokens


def valid_classes(pages: list[list[int]], support: int) -> list[list[int]]:
    """Classes of tokens with equal occurrence vectors that ``support`` pages have, ordered alike on each of them.

    Of tokens that stand once on their pages those out of order are left out; others are a class only
    if each page repeats them in turn as often as its count says.
    """
    vectors = occurrence_vectors(pages)
    together: dict[tuple[int, ...], list[list[int]]] = {}
    for k, page in enumerate(pages):
        for token in page:
            together.setdefault(vectors[token], [[] for _ in pages])[k].append(token)
    out = []
    for vector, sequences in together.items():
        there = [s for s in sequences if s]
        if len(there) < support:
            continue
        if max(vector) == 1:
            out.append(in_order(there[0], there[1:]))
        else:
            size = len(set(there[0]))
            if all(s == there[0][:size] * n for s, n in zip(sequences, vector, strict=True) if n):
                out.append(there[0][:size])
    return out


def constant(pages: list[dict[int, list[str]]], support: int) -> dict[int, set[str]]:
    """By path the strings that all pages with that path have there, equally often."""
    together: dict[int, list[list[str]]] = {}
    for page in pages:
        for path, strings in page.items():
            together.setdefault(path, []).append(strings)
    out = {}
    for path, lists in together.items():
        common = set(min(lists, key=len)) if len(lists) >= support else set()
        for strings in lists:
            if not common:
                break
            common.intersection_update(strings)
        if common:
            counts = [Counter(x for x in strings if x in common) for strings in lists]
            out[path] = {x for x in common if len({c[x] for c in counts}) == 1}
    return out


class Template:
    """What the pages of a group have in common.

    The tokens are the elements, by their path of names. Tokens with equal occurrence vectors over the distinct
    pages are a class if they are ordered alike on all pages that have them (``valid_classes``). Classes
    nest: a token lies in a slot of its parent's class if on each page it stands once in each occurrence of
    the parent, or not at all (another layout). From the root down that nest, a page's main slot is the last
    token of a valid class in which lies at least half of the text, on the pages that have it, that is
    neither furniture nor the template's own; an article or main element ends the way. Blocks that all distinct
    pages with their path have alike are the template's own and no part of the text; outside of article and
    main elements also those of which that is true of each word. ``support`` without end switches all of this off.
    """

    def __init__(self, pages: list[Page], support: int = SUPPORT):
        # Copies of a page say nothing of the template.
        distinct = list({tuple((b.path, b.text) for b in p.blocks): p for p in pages}.values())
        self.parent = {path: above for p in pages for path, above in p.parent.items()}
        self.tag = {path: tag for p in pages for path, tag in p.tag.items()}
        self.vectors = occurrence_vectors([p.order for p in distinct])
        self.tokens = {token for c in valid_classes([p.order for p in distinct], support) for token in c}
        words: list[dict[int, list[str]]] = []
        blocks: list[dict[int, list[str]]] = []
        for page in distinct:
            words.append({})
            blocks.append({})
            for b in page.blocks:
                words[-1].setdefault(b.path, []).extend(b.text.split())
                blocks[-1].setdefault(b.path, []).append(b.text)
        self.constant, self.repeated = constant(words, support), constant(blocks, support)
        self.weights: dict[int, list[int]] = {}
        for k, page in enumerate(distinct):
            own: Counter[int] = Counter()
            for b in page.blocks:
                if not b.furniture:
                    same, told = self.constant.get(b.path), b.text.split()
                    own[b.path] += max(0, (sum(w not in same for w in told) if same else len(told)) - b.links)
            for path in reversed(dict.fromkeys(page.order)):  # parents open before their children
                if own[path]:
                    self.weights.setdefault(path, [0] * len(distinct))[k] = own[path]
                    own[page.parent[path]] += own[path]

    def _nested(self, path: int, parent: int) -> bool:
        return path in self.tokens and all(n == m or n == 0 for n, m in zip(self.vectors[path], self.vectors[parent], strict=True))

    def _holds_most(self, path: int, parent: int) -> bool:
        own, whole = self.weights.get(path), self.weights.get(parent)
        return own is not None and 2 * sum(own) >= sum(w for w, there in zip(whole, self.vectors[path], strict=True) if there)

    def main(self, page: Page) -> int:
        """The page's main slot; where no class tells, its first article or main element, or its root (0: all of it)."""
        children: dict[int, list[int]] = {}
        for path in dict.fromkeys(page.order):
            children.setdefault(page.parent[path], []).append(path)
        at = max((p for p in children.get(0, []) if p in self.tokens), key=lambda p: sum(self.weights.get(p, [])), default=0)
        while at and self.tag[at] not in ("article", "main"):
            below = [p for p in children.get(at, []) if self.tag[p] in CONTAINERS and self._nested(p, at) and self._holds_most(p, at)]
            if not below:
                break
            at = max(below, key=lambda p: (self.tag[p] in ("article", "main"), sum(self.weights[p])))
        # A root that holds it all tells nothing.
        if at and self.tag[at] not in ("html", "body"):
            return at
        return next((p for p in page.order if self.tag[p] in ("article", "main")), 0)

    def extract(self, page: Page) -> str:
        """The blocks of the page's main slot that are neither furniture nor the template's own."""
        main = self.main(page)
        own = main and self.tag[main] in ("article", "main")
        inside = {main}
        for path in page.order:
            if page.parent[path] in inside:
                inside.add(path)
        out = []
        for b in page.blocks:
            if b.furniture or b.path not in inside:
                continue
            if not (b.text in self.repeated.get(b.path, ()) if own else self.constant.get(b.path, set()).issuperset(b.text.split())):
                out.append(b.text)
        return "\n".join(out)


def extract(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Pages are grouped by host (lower case; a null or odd url counts as the empty host), and hosts with
    more than ``group`` pages are dealt by a hash of page_id and url to groups of about that many, so a
    task holds one group at a time. A page alone in its group makes a template of its own. A null html
    is empty and gives an empty text. Rows with equal page_id are pages of their own. An empty table
    gives an empty result. Other columns of ``pages`` are not used.
    """
    keyed = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))).alias("host"),
    )
    # Only large hosts are asked for, of which there is one for ``group`` pages at most.
    large = keyed.groupBy("host").count().where(F.col("count") > group).select("host", F.ceil(F.col("count") / group).cast("int").alias("groups"))
    large = cut(large)
    large = F.broadcast(large) if large.count() <= MOST_BROADCAST_ROWS else large
    dealt = keyed.join(large, "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("groups", F.lit(1))).cast("int"))

    def rows(read: Iterator[tuple]) -> Iterator[tuple]:
        for _, together in groupby(read, key=lambda r: r[:2]):
            held = [(page_id, url, parse(html)) for *_, page_id, url, html in together]
            template = Template([page for *_, page in held])
            for page_id, url, page in held:
                text = template.extract(page)
                yield page_id, url, text, len(text)

    return map_rows(dealt.select("host", "part", "page_id", "url", "html").repartition("host", "part").sortWithinPartitions("host", "part", "page_id"), rows, _SCHEMA)
