"""HTML extraction by wrapper induction: pages of a host are aligned by simple tree matching."""

from __future__ import annotations

import functools
import hashlib
import html
import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, join_facts

# Groups of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math select object canvas audio video".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "li main menu nav ol p pre search section summary table caption colgroup tbody td tfoot th thead tr ul button label option legend".split()
)
CLOSES_P = BLOCK - frozenset("html head body td th tr tbody thead tfoot caption colgroup button label option legend li dd dt".split())
#: By element, what it ends when still open, and where the search for that stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that hold no part of an article.
SIDE = frozenset("head nav aside footer form menu dialog button search fieldset".split())
#: Words of class, id and role that mark the same.
SIDE_WORD = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|adv|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|alert\w*|newsletter\w*|subscri\w*|sign-?up|menu\w*|nav\w*|breadcrumb\w*|"
    r"side-?bar\w*|widget\w*|related\w*|recommend\w*|shar(?:e|ing)\w*|social\w*|foot(?:er)?\w*|copyright|legal|comments?\w*|repl(?:y|ies)|respond|disqus|pop-?up\w*|modal\w*|overlay|login\w*|search\w*|"
    r"pagination|pager|tags|toolbar|skip|complementary|contentinfo|navigation)(?=$|[-_ ])"
)
#: Inside an article only names that say so of the whole element, from its first word on.
INSIDE_WORD = re.compile(r"(?:^| )(?:ads?|advert\w*|adsense|sponsored|promo|cookie\w*|newsletter|subscribe|share|social|comments?|comment-list|replies|respond|disqus|pop-?up|modal)(?=$|[ ]|[-_](?:box|slot|unit|banner|block|list|form|section|area|bar|buttons?|signup|thread)\b)")
HEAD_WORD = re.compile(r"(?:^|[-_ ])(?:header|masthead|site-?head\w*|top-?bar\w*)(?=$|[-_ ])")

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)


#: Elements below this depth are aligned as if they stood at it.
DEEP = 200


class Node:
    """A block element. content: its child nodes and its text runs [text, characters of it in links, links]."""

    __slots__ = ("key", "content")

    def __init__(self, key: str):
        self.key, self.content = key, []


def _key(tag: str, attributes: str) -> str:
    if not attributes or attributes.isspace():
        return tag
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMED.finditer(attributes)}
    names = " ".join(re.sub(r"\d+", "", f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}".lower()).split())
    return f"{tag}|{names}" + (" hidden" if _HIDDEN.search(attributes) else "") if names or _HIDDEN.search(attributes) else tag


def parse(page: str) -> Node:
    """The tree of block elements. Inline elements only mark text as linked; text without a block stands in the root."""
    root = Node("#")
    stack, tags, links, at, n = [root], ["#"], 0, 0, len(page)

    def text(to: int) -> None:
        if to > at and (run := page[at:to]) and not run.isspace():
            add(html.unescape(run) if "&" in run else run)
        elif to > at:
            add(" ")

    def add(run: str) -> None:
        if len(stack) > DEEP and stack[DEEP - 1].content[-1] is not stack[-1]:  # text goes on after a deeper element
            stack[-1] = Node(stack[-1].key)
            stack[DEEP - 1].content.append(stack[-1])
        content = stack[-1].content
        if content and type(content[-1]) is list:
            content[-1][0].append(run)
        elif not run.isspace():
            content.append([[run], 0, 0])
        else:
            return
        if links:
            content[-1][1] += len(run)

    def close(names: set[str], stop: set[str]) -> None:
        for k in range(len(tags) - 1, 0, -1):
            if tags[k] in names:
                del stack[k:], tags[k:]
                return
            if tags[k] in stop:
                return

    while True:
        m = _MARK.search(page, at)
        if m is None:
            text(n)
            return root
        text(m.start())
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                links = 0
            elif tag in BLOCK and tag in tags:
                close({tag}, {"article", "main", "body"} - {tag} if tag not in ("html", "body") else set())
            elif tag == "br" or tag == "p":
                add(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if not m[3].endswith("/"):
                at = page.find(">", end.end() - 1) + 1 if end else n
                at = at or n
            continue
        if tag == "br":
            add(" ")
        elif tag == "a":
            links = 1
            if stack[-1].content and type(stack[-1].content[-1]) is list:
                stack[-1].content[-1][2] += 1
        if tag not in BLOCK:
            continue
        if tag in CLOSES_P:
            close({"p"}, {"table", "td", "th", "article", "section", "div", "button", "li", "body"})
        if tag in ("html", "body", "head") and tag in tags:
            continue
        if tag == "body" and "head" in tags:
            close({"head"}, set())
        if tag in ENDS:
            close(*ENDS[tag])
        links = 0 if tag not in ("div", "p", "h1", "h2", "h3", "h4", "span") else links
        deep = len(stack) >= DEEP
        node = Node("nav" if deep and _is_side(stack[-1].key, True) else _key(tag, m[3]))  # a part of a side part is one
        stack[DEEP - 1 if deep else -1].content.append(node)
        if tag not in VOID:
            stack.append(node)
            tags.append(tag)


@dataclass
class Slot:
    """A template node: children in order; on how many pages it stands, characters of text and of linked text
    over all pages. Neighbours with one key share a slot; their texts are told apart. `texts` of a page's slot are the
    checksums of its texts there, those of a settled template's slot the ones that are template, and `varies` is the
    share of others. The root's `content` stands for what the page says."""

    key: str
    children: list = field(default_factory=list)
    pages: int = 0
    chars: int = 0
    linked: int = 0
    texts: dict = field(default_factory=dict)
    content: int = 0
    varies: float = 1.0
    label: bool = False

    def size(self) -> int:
        return 1 + len(self.texts) + sum(c.size() for c in self.children)


def own_text(node: Node) -> str:
    return " ".join(" ".join("".join(x[0]) for x in node.content if type(x) is list).split())


def checksum(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def skeleton(node: Node) -> Slot:
    """The page's own template: runs of neighbours with the same key become one slot, as do their children. Pages
    whose text is the same but for side parts and links are copies: they count as one content."""
    own = _merged([node])
    content = hashlib.blake2b(digest_size=8)

    def read(s: Slot) -> None:
        if not _is_side(s.key, False):
            if s.chars and s.linked <= 0.6 * s.chars:
                content.update(b"".join(t.to_bytes(4, "little") for t in s.texts))
            for c in s.children:
                read(c)

    read(own)
    own.content = int.from_bytes(content.digest(), "little", signed=True)
    return own


def bare(slot: Slot) -> Slot:
    """The slot without its texts, for a template."""
    slot.texts, slot.content = {}, 0
    for c in slot.children:
        bare(c)
    return slot


def _runs(nodes: list[Node]) -> list[list[Node]]:
    """The child nodes of all nodes, dealt to slots: neighbours with the same key share one, and the nodes' runs
    are aligned in order with one another. A child that finds no slot after its neighbour's gets one there."""
    runs: list[list[Node]] = []
    for node in nodes:
        last = -1
        for x in node.content:
            if type(x) is list:
                continue
            j = next((j for j in range(max(last, 0), len(runs)) if runs[j][0].key == x.key), None)
            if j is None:
                runs.insert(j := last + 1, [])
            runs[j].append(x)
            last = j
    return runs


def _merged(nodes: list[Node]) -> Slot:
    slot = Slot(nodes[0].key, pages=1)
    for node in nodes:
        if text := own_text(node):
            slot.texts[checksum(text)] = ()
        for x in node.content:
            if type(x) is list:
                slot.chars += sum(map(len, x[0]))
                slot.linked += x[1]
    slot.children = [_merged(r) for r in _runs(nodes)]
    return slot


def matching(a: list[Slot], b: list[Slot], known: dict) -> list[tuple[int, int]]:
    """Simple tree matching of two sequences of subtrees: the order-preserving pairs of equal keys with the
    largest total of matched nodes."""
    if not a or not b:
        return []
    if [x.key for x in a] == [y.key for y in b] and len({x.key for x in a}) == len(a):
        return [(i, i) for i in range(len(a))]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weight(x, y, known))
    pairs, i, j = [], len(a), len(b)
    while i and j:
        w = weight(a[i - 1], b[j - 1], known)
        if w and best[i][j] == best[i - 1][j - 1] + w:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def weight(x: Slot, y: Slot, known: dict) -> int:
    """Nodes matched between two subtrees; 0 if the roots differ."""
    if x.key != y.key:
        return 0
    at = (id(x), id(y))
    if at not in known:
        known[at] = 1 + sum(weight(x.children[i], y.children[j], known) for i, j in matching(x.children, y.children, known))
    return known[at]


def merge(a: Slot, b: Slot, known: dict | None = None) -> Slot:
    """Both templates aligned: matched slots become one, the others are kept in order."""
    known = {} if known is None else known
    out = Slot(a.key, [], a.pages + b.pages, a.chars + b.chars, a.linked + b.linked)
    i = j = 0
    for p, q in [*matching(a.children, b.children, known), (len(a.children), len(b.children))]:
        out.children += a.children[i:p] + b.children[j:q]
        if p < len(a.children):
            out.children.append(merge(a.children[p], b.children[q], known))
        i, j = p + 1, q + 1
    return out


@functools.lru_cache(100_000)
def _is_side(key: str, inside: bool) -> bool:
    tag, _, names = key.partition("|")
    if tag in SIDE or "hidden" in names.split():
        return True
    if tag in ("html", "body", "main", "article", "#") or re.fullmatch("h[1-6]", tag):
        return False
    if inside:
        return bool(INSIDE_WORD.search(names))
    return bool(SIDE_WORD.search(names)) or tag == "header" or bool(HEAD_WORD.search(names))


def label(page: Slot) -> Slot:
    """Marks the slots of a page that may hold its article, given the figures of its host's template (see fill): all in
    the page's own article or main elements but side parts by element or name and lists of links; without any such
    element, in the part of the page that holds most of the text that varies. Which of their texts are template is
    decided text by text (see fixed)."""

    def side(s: Slot, inside: bool) -> bool:
        if _is_side(s.key, inside):
            return True
        chars, linked = total(s)
        return s.key.partition("|")[0] in ("ul", "ol", "dl", "table", "div", "section") and chars > 0 and linked > 0.6 * chars

    def total(s: Slot) -> tuple[float, float]:
        parts = [total(c) for c in s.children]
        return s.chars + sum(p[0] for p in parts), s.linked + sum(p[1] for p in parts)

    def find(s: Slot, tags: tuple) -> list[Slot]:
        tag, _, names = s.key.partition("|")
        if tag in tags or "main" in tags and "main" in names.split():
            return [s]
        return [] if _is_side(s.key, False) else [x for c in s.children for x in find(c, tags)]

    def free(s: Slot) -> float:
        return 0 if side(s, False) else s.chars * s.varies + sum(map(free, s.children))

    roots = [r for r in find(page, ("article",)) if total(r)[0]] or [r for r in find(page, ("main",)) if total(r)[0]]
    if not roots:
        at = page
        while (best := max(at.children, key=free, default=None)) is not None and free(best) > 0.6 * free(at) and at.chars < 0.1 * free(at):
            at = best
        roots = [at]

    def mark(s: Slot) -> None:
        s.label = s.chars > 0
        for c in s.children:
            if not side(c, True):
                mark(c)

    for r in roots:
        mark(r)
    return page


def slots(template: Slot) -> list[Slot]:
    """A template's slots, which are numbered in this order."""
    return [template, *(s for c in template.children for s in slots(c))]


def places(page: Slot, template: Slot | None, numbers: dict[int, int], known: dict) -> list[int]:
    """By the page's slots the numbers of the template's slots that they match; -1 without one."""
    matched = dict(matching(page.children, template.children, known)) if template else {}
    out = [numbers[id(template)] if template else -1]
    for i, c in enumerate(page.children):
        out += places(c, template.children[matched[i]] if i in matched else None, numbers, known)
    return out


def settle(template: Slot, figures: dict[int, tuple[int, list[int]]]) -> Slot:
    """Gives each slot the texts that are template. figures: by slot how many different texts it has, and these."""
    for k, s in enumerate(slots(template)):
        n, found = figures.get(k, (0, []))
        s.texts, s.varies = dict.fromkeys(found), 1 - len(found) / n if n else 1.0
    return template


def fill(page: Slot, template: Slot | None, known: dict) -> None:
    """Gives the page's slots the figures of the settled template's slots that they match, characters as means of the
    slot's pages; slots without text on this page stay so, and slots without a match have no template text."""
    if template is None:
        page.texts, page.varies = {}, 1.0
    else:
        if page.chars:
            page.chars, page.linked = template.chars / template.pages, template.linked / template.pages
        page.texts, page.varies = template.texts, template.varies
    matched = dict(matching(page.children, template.children, known)) if template else {}
    for i, c in enumerate(page.children):
        fill(c, template.children[matched[i]] if i in matched else None, known)


def shape(slot: Slot) -> tuple:
    return (slot.key, tuple(shape(c) for c in slot.children))


def _layout(slot: Slot) -> tuple:
    """The shape with the slots that have text: all that a page's labels depend on besides the template."""
    return (slot.key, slot.chars > 0, tuple(_layout(c) for c in slot.children))


def _labels(slot: Slot) -> tuple:
    return (slot.key, slot.label, frozenset(slot.texts), tuple(_labels(c) for c in slot.children))


def blocks(nodes: list[Node], labels: tuple, out: dict[int, frozenset]) -> None:
    """Collects the labelled nodes, each with its slot's template texts."""
    if labels[1]:
        out.update((id(node), labels[2]) for node in nodes)
    for r, c in zip(_runs(nodes), labels[3], strict=True):
        blocks(r, c, out)


def _in_order(node: Node, chosen: dict[int, frozenset], template: bool) -> list[tuple[str, bool]]:
    """The runs of text below a node in page order, and whether each is template. template: whether such runs go; a
    heading goes only if nothing of the article follows it in its part, and never if it is the first level's."""
    out: list[tuple[str, bool]] = []
    headings: list[tuple[str, bool]] = []  # fixed ones that wait for what they head
    texts = chosen.get(id(node))
    is_fixed = bool(texts) and checksum(own_text(node)) in texts
    for x in node.content:
        if type(x) is list:
            run = " ".join("".join(x[0]).split()) if texts is not None else ""
            found = [(run, is_fixed)] if run else []
        else:
            found = _in_order(x, chosen, template)
            level = re.fullmatch("h([1-6])", x.key.partition("|")[0])
            if template and level and found and all(f for _, f in found):
                if level[1] != "1":
                    headings += found
                    continue
                found = [(r, False) for r, _ in found]
        if headings and any(not f for _, f in found):
            out += [(r, False) for r, _ in headings]
            headings = []
        out += found
    return out + headings


def extract(tree: Node, own: Slot, template: Slot, cache: dict) -> str:
    """The article: all runs that aren't template. If these make up less than a third of the characters, the page's
    contents are near copies of one another rather than a template, and all stays."""
    at = _layout(own)
    if at not in cache:
        fill(own, template, {})
        cache[at] = _labels(label(own))
    chosen: dict[int, frozenset] = {}
    blocks([tree], cache[at], chosen)
    runs = _in_order(tree, chosen, True)
    kept = [r for r, f in runs if not f]
    if 3 * sum(map(len, kept)) < sum(len(r) for r, _ in runs):
        kept = [r for r, _ in _in_order(tree, chosen, False)]
    return "\n".join(kept)


def _induce(pages: DataFrame, salts: int) -> DataFrame:
    """(host, template): pages are merged batch by batch, then by host and salt, then by host."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[tuple, Slot]] = {}
        n = 0

        def out() -> pa.RecordBatch:
            hosts, made = list(held), []
            for host in hosts:
                whole = None
                for s in held[host].values():
                    whole = s if whole is None else merge(whole, s)
                made.append(pickle.dumps(whole))
            return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(made, pa.binary())], names=["host", "template"])

        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
                own = bare(skeleton(parse(page.as_py() or "")))
                same, at = held.setdefault(host, {}), shape(own)
                if at in same:
                    add(same[at], own)
                else:
                    same[at] = own
                    n += own.size()
            if n > 200_000:
                yield out()
                held.clear()
                n = 0
        if held:
            yield out()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, key = None, None
        for batch in batches:
            key = key or [batch.column(0)[0].as_py()]
            for t in batch.column("template").to_pylist():
                made = pickle.loads(t) if made is None else merge(made, pickle.loads(t))
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array([pickle.dumps(made)], pa.binary())], names=["host", "template"])

    parts = pages.mapInArrow(partial, "host string, template binary").withColumn("salt", F.pmod(F.xxhash64("template"), F.lit(salts)))
    salted = parts.groupBy("host", "salt").applyInArrow(joined, "host string, template binary")
    return salted.groupBy("host").applyInArrow(joined, "host string, template binary")


def _settled(rows: DataFrame, templates: DataFrame, max_broadcast: int, share: float = 0.6) -> DataFrame:
    """(host, template), settled: a slot's text is template if it stands there on a fair share of the host's different
    contents, of which one more is taken to lack it, so that a single page has no template. Every content and every
    text of every slot is counted; the counts meet by host, slot and text."""
    rows, shared = _with_templates(rows, templates, max_broadcast)

    def spot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[Slot, dict, dict]] = {}
        for batch in batches:
            seen: set[tuple] = set()
            for page, host, own in zip(batch.column("html"), batch.column("host").to_pylist(), batch.column("template")):
                if host not in known:
                    if len(known) > 2000:
                        known.clear()
                    template = pickle.loads(shared.value[host] if shared else own.as_py())
                    known[host] = template, {id(s): k for k, s in enumerate(slots(template))}, {}
                template, numbers, cache = known[host]
                own = skeleton(parse(page.as_py() or ""))
                if (at := shape(own)) not in cache:
                    if len(cache) > 5000:
                        cache.clear()
                    cache[at] = places(own, template, numbers, {})
                seen.add((host, -1, 0, own.content))
                seen.update((host, k, t, own.content) for k, s in zip(cache[at], slots(own)) if k >= 0 for t in s.texts)
            columns = list(zip(*seen)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["host", "slot", "text", "content"])

    counts = rows.mapInArrow(spot, "host string, slot int, text long, content long").groupBy("host", "slot", "text").agg(F.count_distinct("content").alias("n"))
    scratch = Scratch(rows.sparkSession)
    counts = scratch.write(counts, "counts")
    totals = scratch.write(counts.groupBy("host").agg(F.max(F.when(F.col("slot") < 0, F.col("n"))).alias("of"), F.count("*").alias("rows")), "totals")
    n_rows = totals.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    fixed = F.collect_list(F.when(F.col("n") >= share * (F.col("of") + 1), F.col("text")))
    figures = join_facts(counts.filter("slot >= 0"), totals, ["host"], "rows", n_rows).groupBy("host", "slot").agg(F.count("*").alias("n"), fixed.alias("fixed"))
    figures = figures.groupBy("host").agg(F.collect_list(F.struct("slot", "n", "fixed")).alias("figures"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pickle.dumps(settle(pickle.loads(t), {x["slot"]: (x["n"], x["fixed"]) for x in f or ()})) for t, f in zip(batch.column("template").to_pylist(), batch.column("figures").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(made, pa.binary())], names=["host", "template"])

    return templates.join(figures, "host", "left").mapInArrow(put, "host string, template binary")


def _with_templates(rows: DataFrame, templates: DataFrame, max_broadcast: int):
    """The rows with their host's template, or with null and a broadcast of all templates if these are small."""
    size = templates.agg(F.coalesce(F.sum(F.octet_length("template")), F.lit(0))).first()[0]
    if size > max_broadcast:
        return rows.join(templates.hint("merge"), "host").select(*rows.columns, "template"), None
    shared = rows.sparkSession.sparkContext.broadcast({r.host: bytes(r.template) for r in templates.collect()})
    return rows.withColumn("template", F.lit(None).cast("binary")), shared


def add(a: Slot, b: Slot) -> None:
    """b's figures added to a, which has the same shape."""
    a.pages, a.chars, a.linked = a.pages + b.pages, a.chars + b.chars, a.linked + b.linked
    for x, y in zip(a.children, b.children):
        add(x, y)


def extract_pages(pages: DataFrame, salts: int = 64, max_broadcast: int = 32 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars): the article of every page, from the whole html.

    A null or empty html gives an empty text; pages without a host (null or other urls) form a host of their
    own; repeated rows give repeated results; an empty table an empty one. Other columns are ignored.

    Templates are induced from all pages of a host, pre-merged in each task, so that a hot host's pages never
    meet in one task; a second pass counts each slot's texts against all of the host's different contents. The templates are broadcast if they take max_broadcast bytes at most, and are joined to the
    pages by host otherwise. Which part is the article is decided for each layout of a host's pages."""
    spark = pages.sparkSession
    scratch = Scratch(spark)
    host = F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.lower(host).alias("host"))
    templates = scratch.write(_induce(rows.select("host", "html"), salts), "templates")
    templates = scratch.write(_settled(rows.select("host", "html"), templates, max_broadcast), "settled")
    rows, shared = _with_templates(rows, templates, max_broadcast)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[Slot, dict]] = {}
        for batch in batches:
            texts = []
            for page, host, own in zip(batch.column("html"), batch.column("host").to_pylist(), batch.column("template")):
                if host not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[host] = pickle.loads(shared.value[host] if shared else own.as_py()), {}
                template, cache = known[host]
                if len(cache) > 5000:
                    cache.clear()
                tree = parse(page.as_py() or "")
                texts.append(extract(tree, skeleton(tree), template, cache))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
