"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged: each node (its path of tags and classes) counts the presentations it has, that is its runs of child
tags, and the contents, that is its texts, links and images. Entropy over these gives a node's importance, composite from the leaves up:
what looks and reads the same on every page of a site is unimportant. Branches all of whose nodes are unimportant go from each page. A prior multiplies the
importance of nodes whose tag or class names a role that is never main text, such as menus and adverts, whose texts may well differ from
page to page, but not of wrappers around the main text; and within an article only branches set apart by a class can be boilerplate, since
one article may be on many pages. There a class has the prior only if it names a role and nothing else: `related-posts` is a role,
`related-work` and `search-engine-history` may be a section of the article, and the tree alone decides on them. A button amid a sentence is part of it.

The tree is a table by (host, node) from its counts on: entropies, weights and sums are Spark aggregations, and no task holds a host.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Below this importance a branch is boilerplate. GAMMA weighs a node's children against its own presentation, PRIOR a role's importance.
LEAST_IMPORTANCE, GAMMA, PRIOR = 0.3, 0.9, 0.25
#: A node that a class names by a role is a wrapper, not that role, if it has this share of the main text; articles are the main text if they have that share of what is left.
WRAPPER, MAIN_SHARE = 0.8, 1 / 3
#: Elements deeper than this stand in the one at this depth, as browsers have it.
DEEPEST = 512
#: Unimportant nodes of so many bytes in all are broadcast; more are joined to each page's own nodes.
BROADCAST_BYTES = 16 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg object select title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Roles that are never main text, as tags and as words of class, id and role.
NOISE_TAGS = frozenset("nav header footer aside form menu dialog button search fieldset head".split()) | RAW
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies discussion disqus dialog footer form header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related replies reply responses respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split())
#: Words that may stand beside a role's name in a class without telling of anything else.
FRAME_WORDS = frozenset("area article articles bar block body bottom box btn button buttons card cards col column container content count cta customer customers desktop entry facebook feed footer form group header icon icons inline inner item items js large left link links list main mobile module news outer page panel post posts primary reader readers right row secondary section site slot small stories story thread top twitter unit user users visitor visitors wrap wrapper your".split())
#: What a page's main text stands in, if it has such a node.
MAIN_TAGS = frozenset(("article", "main"))
#: An opening tag closes these open ones first.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPE = frozenset("ul ol dl table div section article main nav aside body html td th".split())
CLOSES_P = BLOCKS - {"body", "html", "head", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z]+")
TELLING = re.compile(r"class|id|role|hidden|style|itemprop", re.I)


@dataclass(slots=True)
class Node:
    """key: a hash of the path that merges the node with its like on other pages. role, main: the nearest node from here up that is named by a role, or is an article."""

    tag: str
    kind: str
    key: int
    depth: int
    parent: Node | None
    role: Node | None = None
    main: Node | None = None
    named: bool = False
    kinds: list[str] = field(default_factory=list)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


@lru_cache(maxsize=1 << 14)
def _look(tag: str, telling: str) -> tuple[str, bool, bool, bool, bool]:
    """(kind, role, sure, main, named) of a node by its tag and the attributes that tell its role; sure: by more than a word among others of a class."""
    names = _attributes(telling)
    tokens = [set(WORDS.findall(t.lower())) for t in re.sub(r"([a-z])([A-Z])", r"\1-\2", " ".join(names.get(k, "") for k in ("class", "id", "role"))).split()]
    words = set().union(*tokens)
    hidden = "hidden" in names or names.get("aria-hidden") == "true" or "display:none" in names.get("style", "").replace(" ", "")
    role = tag in NOISE_TAGS or hidden or bool(words & NOISE_WORDS)
    sure = tag in NOISE_TAGS or hidden or any(t & NOISE_WORDS and all(len(w) == 1 or w in NOISE_WORDS or w in FRAME_WORDS for w in t) for t in tokens)
    main = (tag in MAIN_TAGS or names.get("role") == "main" or names.get("itemprop") == "articleBody")
    return (f"{tag}.{'.'.join(sorted(words))}" if words else tag), role and tag not in ("html", "body"), sure, main, bool(words)


@lru_cache(maxsize=1 << 16)
def _key(parent: int, kind: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{parent}/{kind}".encode("utf-8", "surrogatepass")) - 2**63


def _node(tag: str, raw: str, parent: Node, amid: bool) -> Node:
    """amid: text of the parent stands before it on its line."""
    kind, role, sure, main, named = _look(tag, raw if raw and TELLING.search(raw) else "")
    while parent.depth >= DEEPEST:
        parent = parent.parent
    if not parent.kinds or parent.kinds[-1] != kind:
        parent.kinds.append(kind)
    node = Node(tag, kind, _key(parent.key, kind), parent.depth + 1, parent, parent.role, parent.main, named)
    if role and (sure or parent.main is None) and not (tag == "button" and amid):
        node.role = node
    if main:
        node.main = node
    return node


def _target(raw: str, name: str) -> str | None:
    return _attributes(raw).get(name) if name in raw.lower() else None


def parse(page: str, linked: bool = True) -> tuple[list[Node], list[tuple[Node, str]], list[tuple[Node, str]]]:
    """(nodes, blocks of text with the node they stand in, links and images with theirs), in page order."""
    root = Node("", "", 0, 0, None)
    nodes: list[Node] = [root]
    blocks: list[tuple[Node, str]] = []
    links: list[tuple[Node, str]] = []
    stack, pieces, at = [root], [], 0
    opened: Counter = Counter()  # tags on the stack
    owner: Node | None = None

    def flush() -> None:
        nonlocal owner
        if not pieces:
            owner = None
            return
        text = " ".join("".join(pieces).split())
        if text and owner is not None:
            blocks.append((owner, text))
        pieces.clear()
        owner = None

    def say(raw: str) -> None:
        nonlocal owner
        if not raw:
            return
        if owner is not None and stack[-1].role is not owner.role:
            flush()
        if owner is None and not raw.isspace():
            owner = stack[-1]
        pieces.append(html.unescape(raw) if "&" in raw else raw)

    def close(depth: int) -> None:
        gone = stack[depth:]
        if any(n.tag in BLOCKS for n in gone):
            flush()
        for n in gone:
            opened[n.tag] -= 1
        del stack[depth:]

    def close_open(tags: set[str]) -> None:
        if not any(opened[t] > 0 for t in tags):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                close(depth)
                return
            if stack[depth].tag in SCOPE:
                return

    while m := TOKEN.search(page, at):
        say(page[at:m.start()])
        at = m.end()
        end, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            if opened[tag] > 0:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                close(depth)
            continue
        if tag == "br" or tag == "wbr":
            pieces.append(" " if tag == "br" else "")
            continue
        if tag in CLOSES_P:
            close_open({"p"})
        if tag in CLOSES:
            close_open(CLOSES[tag])
        if tag in BLOCKS:
            flush()
        node = _node(tag, raw, stack[-1], owner is stack[-1])
        nodes.append(node)
        if tag in RAW:
            ended = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at) if not raw.rstrip().endswith("/") else None
            at = ended.end() if ended else at if raw.rstrip().endswith("/") else len(page)
        elif tag in VOID:
            if linked and tag == "img" and (src := _target(raw, "src")):
                links.append((node, src))
        else:
            if linked and tag == "a" and (href := _target(raw, "href")):
                links.append((node, href))
            if not raw.endswith("/") or tag in BLOCKS or tag == "a":
                stack.append(node)
                opened[tag] += 1
    say(page[at:])
    flush()
    return nodes, blocks, links


def host_of(url: str | None) -> str:
    """The host of a URL in lower case, without port; empty for null."""
    return re.sub(r"^[^:/?#]*://|^//", "", url or "").split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower()


def tree_counts(pages: DataFrame) -> DataFrame:
    """(host, node, parent, what, value, n, w): what each host's tree counts.

    what 'page': pages that have the node; w is its weight among its parent's children, one over a run's length for each run it is in.
    'style': pages where its child tags run as in value. 'text': for each content, the sum of its counts by page, and in w of
    count * ln(count), which are all that its entropy over pages needs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int, str, int], list[float]] = {}

        def emit() -> pa.RecordBatch:
            keys = list(zip(*sums)) if sums else [[]] * 5
            values = list(zip(*sums.values())) if sums else [[], []]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            out = [*(pa.array(k, t) for k, t in zip(keys, kinds)), pa.array(values[0], pa.int64()), pa.array(values[1], pa.float64())]
            sums.clear()
            return pa.RecordBatch.from_arrays(out, ["host", "node", "parent", "what", "value", "n", "w"])

        def add(key: tuple[str, int, int, str, int], n: int, w: float) -> None:
            held = sums.setdefault(key, [0, 0.0])
            held[0] += n
            held[1] += w

        for batch in batches:
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                host = host_of(url)
                nodes, blocks, links = parse(page or "")
                styles: dict[int, set[tuple[str, ...]]] = {}
                parents: dict[int, tuple[int, str]] = {}
                for node in nodes:
                    styles.setdefault(node.key, set()).add(tuple(node.kinds))
                    if node.parent is not None:
                        parents[node.key] = (node.parent.key, node.kind)
                for key, (parent, kind) in parents.items():
                    add((host, key, parent, "page", 0), 1, sum(run.count(kind) / len(run) for run in styles[parent] if run))
                    for run in styles[key]:
                        add((host, key, parent, "style", xxhash.xxh3_64_intdigest(" ".join(run).encode("utf-8", "surrogatepass")) - 2**63), 1, 0.0)
                contents = Counter((node.key, xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63) for node, text in (*blocks, *links) if node.parent is not None)
                for (key, value), n in contents.items():
                    add((host, key, parents[key][0], "text", value), n, n * math.log(n))
                if len(sums) > 200_000:
                    yield emit()
        yield emit()

    parts = pages.select("url", "html").mapInArrow(count, "host string, node long, parent long, what string, value long, n long, w double")
    return parts.groupBy("host", "node", "parent", "what", "value").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))


def importances(counts: DataFrame) -> DataFrame:
    """(host, node, pages, importance): 1 for a node of one page, of which entropy says nothing.

    A node with contents has 1 less their mean entropy over the pages. Another has its own presentation's entropy and the weighted mean of
    its children, by GAMMA to the number of its presentations. That is a sum over its subtree with the product of the weights on the way;
    it is made in rounds that double the depth they reach, each some joins by (host, node)."""
    one = lambda what, value: F.sum(F.when(F.col("what") == what, value))
    stats = counts.groupBy("host", "node", "parent").agg(
        one("page", F.col("n")).alias("pages"), one("page", F.col("w")).alias("weight"),
        one("style", F.col("n")).alias("shown"), one("style", F.col("n") * F.log("n")).alias("nlogn"), one("style", F.lit(1)).alias("runs"),
        one("text", F.lit(1)).alias("contents"), one("text", F.log("n") - F.col("w") / F.col("n")).alias("entropy"),
    )
    m, keep, read = F.log("pages"), F.pow(F.lit(GAMMA), F.col("runs")), F.col("contents") > 0
    sure = F.col("pages") == 1
    own = F.when(sure, 1.0).when(read, 1 - F.col("entropy") / F.col("contents") / m).otherwise((1 - keep) * (F.log("shown") - F.col("nlogn") / F.col("shown")) / m)
    down = F.when(sure | F.coalesce(read, F.lit(False)), 0.0).otherwise(keep / F.col("shown"))  # what a child's weight counts
    tree = written(stats.select("host", "node", "parent", "pages", "weight", own.alias("total"), down.alias("down")))
    above = tree.select("host", F.col("node").alias("parent"), F.col("down").alias("per"))
    jumps = written(tree.join(above, ["host", "parent"]).where("per > 0").select("host", "node", F.col("parent").alias("up"), (F.col("weight") * F.col("per")).alias("share")))
    sums = tree.select("host", "node", "total")
    while not jumps.isEmpty():
        below = jumps.join(sums, ["host", "node"]).groupBy("host", F.col("up").alias("node")).agg(F.sum(F.col("share") * F.col("total")).alias("more"))
        sums = written(sums.join(below, ["host", "node"], "left").select("host", "node", (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total")))
        further = jumps.select("host", F.col("node").alias("up"), F.col("up").alias("top"), F.col("share").alias("times"))
        jumps = written(jumps.join(further, ["host", "up"]).select("host", "node", F.col("top").alias("up"), (F.col("share") * F.col("times")).alias("share")))
    return tree.select("host", "node", "pages").join(sums, ["host", "node"]).withColumnRenamed("total", "importance")


def _chain(node: Node | None, what: str) -> list[Node]:
    """The nodes named by a role, or the articles, from this one up."""
    out = []
    while node is not None and (at := getattr(node, what)) is not None:
        out.append(at)
        node = at.parent
    return out


def main_text(page: str | None, low: set[int] | frozenset[int]) -> str:
    """The blocks of a page that are left, joined by spaces. low: nodes of the host's tree that are unimportant."""
    nodes, blocks, _ = parse(page or "", linked=False)
    mains: dict[int, Node] = {}
    size: Counter = Counter()
    for node, text in blocks:
        for x in _chain(node, "main"):
            mains[id(x)] = x
            size[id(x)] += len(text)
    # An article within a role, such as a sidebar's teaser or a comment, is the main text only if there are no others and it has half of the page.
    free = [x for x in mains.values() if x.role is None] or [x for x in mains.values() if 2 * size[id(x)] >= sum(len(t) for _, t in blocks)][:1]
    chosen = {id(x) for x in free}
    inside = {id(n) for n, _ in blocks if any(id(x) in chosen for x in _chain(n, "main"))}
    judged = [(n, t) for n, t in blocks if id(n) in inside] or blocks
    whole, part = sum(len(t) for _, t in judged), Counter()
    roles = {}
    for node, text in judged:
        for r in _chain(node, "role"):
            roles[id(r)] = r
            part[id(r)] += len(text)
    around = set()  # the articles and what they stand in
    for x in free:
        while x is not None and id(x) not in around:
            around.add(id(x))
            x = x.parent
    wrappers = {k for k, r in roles.items() if k in around or (r.tag not in NOISE_TAGS or r.tag == "form") and part[k] >= WRAPPER * whole}

    important = set()
    for node in reversed(nodes[1:]):  # a branch is as important as its most important node on this page
        if node.key not in low or id(node) in important:
            important |= {id(node), id(node.parent)}
    stays, plain, protected = {id(nodes[0])}, {id(nodes[0])}, set()  # by the prior and the tree; by the prior alone; within the main text
    for node in nodes[1:]:  # parents come before children
        me, up = id(node), id(node.parent)
        if up in protected or me in chosen:
            protected.add(me)
        tree = 0.0 if me not in important and me not in around and (me not in protected or node.named and node.tag not in MAIN_TAGS) else 1.0
        prior = PRIOR if node.role is node and me not in wrappers else 1.0
        if up in plain and prior >= LEAST_IMPORTANCE:
            plain.add(me)
        if up in stays and tree * prior >= LEAST_IMPORTANCE:
            stays.add(me)
    left = [(n, t) for n, t in blocks if id(n) in stays] or [(n, t) for n, t in blocks if id(n) in plain]
    main = [(n, t) for n, t in left if id(n) in inside]
    if sum(len(t) for _, t in main) >= MAIN_SHARE * sum(len(t) for _, t in left):
        left = main
    return " ".join(t for _, t in left)


def extracted(pages: DataFrame, least: float = LEAST_IMPORTANCE, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars) of each page.

    A null or empty page has an empty text; pages without a host share the empty one; pages of any length are read whole; repeated rows
    each count as a page, so on a host of copies alone nothing is unimportant enough to leave a page empty; an importance of exactly `least`
    stays; an empty table stays empty; columns other than page_id, url and html do not matter, whatever their names. Broken markup is read
    as browsers do: unclosed tags end with their parents."""
    pages = pages.select("page_id", "url", "html")
    low = written(importances(written(tree_counts(pages))).where(F.col("importance") < least).select("host", "node"))
    out = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"

    def rows(batch: pa.RecordBatch, lows: list) -> pa.RecordBatch:
        texts = [main_text(page, low) for page, low in zip(batch.column("html").to_pylist(), lows)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    size = low.agg(F.sum(F.octet_length("host") + 16)).first()[0] or 0
    if size <= most_bytes:
        by: dict[str, set[int]] = {}
        for r in low.toLocalIterator():  # most_bytes bounds these rows
            by.setdefault(r["host"], set()).add(r["node"])
        known = pages.sparkSession.sparkContext.broadcast(by)

        def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield rows(batch, [known.value.get(host_of(url), ()) for url in batch.column("url").to_pylist()])

        return pages.mapInArrow(extract, out)

    def own_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column("url").to_pylist()
            nodes = [sorted({n.key for n in parse(page or "", linked=False)[0][1:]}) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(map(host_of, urls), pa.string()), pa.array(nodes, pa.list_(pa.int64()))], ["digest", "host", "nodes"])

    # Each page's own nodes meet the unimportant ones by (host, node); equal pages of a host share their rows.
    named = pages.withColumn("digest", F.xxhash64("url", "html"))
    own = named.select("digest", "url", "html").mapInArrow(own_nodes, "digest long, host string, nodes array<long>").select("digest", "host", F.explode("nodes").alias("node"))
    lows = own.join(low, ["host", "node"]).groupBy("digest").agg(F.collect_set("node").alias("low"))

    def extract_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows(batch, [set(x or ()) for x in batch.column("low").to_pylist()])

    return named.join(lows, "digest", "left").select("page_id", "url", "html", "low").mapInArrow(extract_joined, out)
