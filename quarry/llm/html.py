"""Main text of web pages by a site style tree.

The element trees of a host's pages are merged by style path (tags with their classes). A node has two entropies over
the host's different pages: of its presentation (the sequence of its children's styles) and of its content (the text of
its branch), each from 0 (the same on every page) to 1 (different on every page). The larger, drawn to 1 where few pages
speak, is the node's importance on its site. What an element is for, by tag and class, weighs it: importance times weight
decides whether a branch stays. Branches that hold an article are never taken whole.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .urlfilter import host_and_path

#: Pages' worth of belief in importance 1 that a node starts with; weight times importance under which a branch goes.
PRIOR, LOW = 3.0, 0.3
#: Weights: inside an article, outside one on a page that has one, classes that leave doubt. Classes of noise weigh nothing.
INSIDE, OUTSIDE, DOUBT = 2.0, 0.5, 0.25
#: Rows of low paths to a host's pages are joined under so many salts where they are too many to broadcast.
SALTS = 32

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and elements of markup that is no text; both go.
OPAQUE = frozenset("script style textarea title iframe noembed noframes xmp".split())
REPLACED = frozenset("noscript template svg object select option button canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
AWAY = frozenset("nav footer aside form head menu dialog fieldset".split())
MAIN = frozenset(["article", "main"])
CLOSES_ITSELF = frozenset("li dt dd tr td th option".split())
#: Words of a class, id or role: of what is never the article, and of what is not where it stands outside one.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion comment comments replies reply disqus cookie cookies consent popup modal newsletter subscribe nav navbar navigation menu breadcrumb breadcrumbs sidebar related recommend recommended recommendations pagination contentinfo complementary".split()
)
DOUBT_WORDS = frozenset("banner respond notice side footer header masthead share sharing social widget search login toolbar".split())
#: First words of a class that tells what an element has, not what it is.
HAS = frozenset("has with without no not is show hide hidden above below before after under".split())
MASK = 0x7FFFFFFFFFFFFFFF


def digest(s: str | bytes) -> int:
    return xxhash.xxh64_intdigest(s) >> 1


def role(names: list[str]) -> tuple[bool, bool]:
    """Whether the classes tell of noise, and whether they leave doubt."""
    noise = doubt = False
    for name in names:
        words = re.split(r"[_\-:]+|(?<=[a-z])(?=[A-Z])", name)
        words = [w.lower() for w in words if w]
        if not words or words[0] in HAS:
            continue
        noise |= not NOISE_WORDS.isdisjoint(words)
        doubt |= not DOUBT_WORDS.isdisjoint(words)
    return noise, doubt


class Page:
    """Block elements as columns, parents before children; 0 is the page. ``runs`` are (node, text) and (node, None) at a
    block's edge, in page order."""

    __slots__ = ("parent", "path", "style", "tag", "noise", "doubt", "items", "runs")

    def __init__(self) -> None:
        self.parent, self.path, self.style, self.tag = [-1], [0], [""], [""]
        self.noise, self.doubt = [False], [False]
        self.items: list[list] = [[]]  # for each node its children (ints) and texts (str), in order
        self.runs: list[tuple[int, str | None]] = []

    def text(self, node: int, s: str) -> None:
        if s:
            self.items[node].append(s)
            self.runs.append((node, s))

    def add(self, parent: int, tag: str, attributes: str) -> int:
        names = [w for got in CLASS.findall(attributes) for x in got for w in x.split()] if attributes else []
        noise, doubt = role(names) if names else (False, False)
        style = f"{tag}.{'.'.join(sorted(re.sub('[0-9]{3,}', '#', n) for n in names))}" if names else tag
        node = len(self.parent)
        self.parent.append(parent)
        self.path.append(digest(f"{self.path[parent]}>{style}"))
        self.style.append(style)
        self.tag.append(tag)
        self.noise.append(noise)
        self.doubt.append(doubt)
        self.items.append([])
        self.items[parent].append(node)
        return node


def ends_of(text: str, tag: str) -> dict[int, int]:
    """Where the content of each element of ``tag`` ends, by the place behind its start tag; none for one without an end."""
    found, open_at = {}, []
    for m in re.finditer(rf"<(/?){re.escape(tag)}(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*>", text, re.I):
        if not m[1]:
            open_at.append(m.end())
        elif open_at:
            found[open_at.pop()] = m.end()
    return found


def parse(page: str | None) -> Page:
    """A forgiving parse into block elements; inline elements join their text to the block around them.

    Elements that are replaced or opaque go with their content; where they close themselves or have no end, only the tag
    goes. One pass, whatever the depth.
    """
    out, text, at = Page(), page or "", 0
    n = len(text)
    stack: list[int] = [0]
    opened: dict[str, list[int]] = defaultdict(list)  # places on the stack by tag
    mains: list[int] = []
    ends: dict[str, dict[int, int]] = {}
    closing: dict[str, tuple[list[int], list[int]]] = {}

    def edge() -> None:
        out.runs.append((stack[-1], None))

    def pop() -> None:
        tag = out.tag[stack.pop()]
        opened[tag].pop()
        if mains and mains[-1] == len(stack):
            mains.pop()

    while at < n:
        m = TAG.search(text, at)
        if not m:
            out.text(stack[-1], text[at:])
            break
        out.text(stack[-1], text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                where = opened[tag][-1] if opened[tag] else 0
                # A stray end inside an article does not close what is around the article.
                if where and (not mains or where >= mains[-1] or tag in ("body", "html")):
                    while len(stack) > where:
                        pop()
                edge()
            continue
        if tag in OPAQUE or tag in REPLACED:
            if m[3].rstrip().endswith("/"):
                continue
            if tag in OPAQUE:
                if tag not in closing:
                    got = [(e.start(), e.end()) for e in re.finditer(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", text, re.I)]
                    closing[tag] = [a for a, _ in got], [b for _, b in got]
                starts, stops = closing[tag]
                k = bisect_left(starts, at)
                at = stops[k] if k < len(stops) else at
            else:
                if tag not in ends:
                    ends[tag] = ends_of(text, tag)
                at = ends[tag].get(at, at)
            continue
        if tag == "br":
            out.text(stack[-1], " ")
            continue
        if tag not in BLOCK:
            continue
        while len(stack) > 1:
            inner = out.tag[stack[-1]]
            if not (inner in ("p", "head") or inner == tag and inner in CLOSES_ITSELF):
                break
            pop()
        edge()
        node = out.add(stack[-1], tag, m[3])
        if tag != "hr":
            opened[tag].append(len(stack))
            if tag in MAIN:
                mains.append(len(stack))
            stack.append(node)
        edge()
    return out


def contexts(p: Page) -> tuple[list[bool], list[bool], list[bool], list[int]]:
    """By node: gone by its tag or class at any importance, inside an article, holds an article, characters of its branch."""
    n = len(p.parent)
    gone, inside, holds = [False] * n, [False] * n, [False] * n
    size = [0] * n
    for i in range(1, n):
        up = p.parent[i]
        inside[i] = inside[up] or p.tag[i] in MAIN
        gone[i] = gone[up] or p.tag[i] in AWAY or (p.tag[i] == "header" and not inside[i]) or (p.noise[i] and p.tag[i] not in ("html", "body", *MAIN))
    for i in range(n - 1, 0, -1):
        size[i] += sum(len(x) for x in p.items[i] if isinstance(x, str)) if not gone[i] else 0
        size[p.parent[i]] += size[i]
        if inside[i] and not gone[i] or holds[i]:
            holds[p.parent[i]] = True
    size[0] += sum(len(x) for x in p.items[0] if isinstance(x, str))
    return gone, inside, holds, size


def kept(p: Page, importance: dict[int, float], low: float, by_class: bool = True) -> list[bool]:
    """By node whether its own text stays."""
    gone, inside, holds, size = contexts(p)
    if not by_class:
        gone, holds = _by_tag(p)
    has_main = holds[0]
    n = len(p.parent)
    away, own = [False] * n, [True] * n
    for i in range(n):
        up = p.parent[i]
        if i and (away[up] or gone[i]):
            away[i] = True
            continue
        if i and not (holds[i] and not inside[i]):
            weight = INSIDE if inside[i] else OUTSIDE if has_main else 1.0
            if by_class and p.doubt[i] and not inside[i] and (has_main or 2 * size[i] <= size[0]):
                weight = DOUBT
            away[i] = p.tag[i] not in MAIN and weight * importance.get(p.path[i], 1.0) < low
        elif has_main:  # around an article: the text that lies in no element of its own
            own[i] = OUTSIDE * importance.get(text_path(p.path[i]), 1.0) >= low
    return [o and not a for o, a in zip(own, away, strict=True)]


def _by_tag(p: Page) -> tuple[list[bool], list[bool]]:
    n = len(p.parent)
    gone, inside, holds = [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        inside[i] = inside[p.parent[i]] or p.tag[i] in MAIN
        gone[i] = gone[p.parent[i]] or p.tag[i] in AWAY or (p.tag[i] == "header" and not inside[i])
    for i in range(n - 1, 0, -1):
        if inside[i] and not gone[i] or holds[i]:
            holds[p.parent[i]] = True
    return gone, holds


def text_path(path: int) -> int:
    """The path of the text that lies between a node's children."""
    return digest(f"{path}>#text")


def blocks(p: Page, keep: list[bool]) -> Iterator[str]:
    """Text of the kept blocks in page order."""
    run: list[str] = []
    for node, s in p.runs:
        if s is not None:
            if keep[node]:
                run.append(s)
        elif run:
            got = " ".join(entities.unescape("".join(run)).split())
            run = []
            if got:
                yield got
    if run:
        got = " ".join(entities.unescape("".join(run)).split())
        if got:
            yield got


def main_text(page: str | None, importance: dict[int, float] | None = None, low: float = LOW) -> str:
    """The kept blocks joined by a line end. Where nothing would be left, tags and classes decide alone, and then tags alone."""
    p = parse(page)
    for known, by_class in ((importance or {}, True), ({}, True), ({}, False)):
        got = "\n".join(blocks(p, kept(p, known, low, by_class)))
        if got:
            return got
    return ""


def branches(p: Page) -> tuple[dict[int, tuple[int, int]], int]:
    """By style path (content, presentation): all branches of a page with one path are one node of the site's tree. And the page's content."""
    n = len(p.parent)
    own, look, loose = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        seen, texts = [], []
        for x in p.items[i]:
            if isinstance(x, int):
                seen.append(f"{own[x]:x}")
            elif words := " ".join(x.split()):
                texts.append(words)
                seen.append(words)
        own[i] = digest("\n".join(seen))
        look[i] = digest(" ".join(p.style[x] for x in p.items[i] if isinstance(x, int)))
        loose[i] = digest("\n".join(texts)) if texts and len(seen) > len(texts) else 0
    merged: dict[int, tuple[int, int]] = {}
    for i in range(n):
        for path, a, b in ((p.path[i], own[i], look[i]), (text_path(p.path[i]), loose[i], 0)) if loose[i] else ((p.path[i], own[i], look[i]),):
            x, y = merged.get(path, (0, 0))
            merged[path] = (x * 1000003 + a) & MASK, (y * 1000003 + b) & MASK
    return merged, own[0]


def style_trees(pages: DataFrame, url: str, html: str, prior: float, bound: float) -> DataFrame:
    """(h, path, e): the importance of the nodes of each host's tree, where it is under ``bound``."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for host, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                merged, whole = branches(parse(page.as_py()))
                for path, (own, look) in merged.items():
                    for c, v in zip(cols, (host, whole, path, own, look), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]], ["h", "page", "path", "own", "look"])

    host, _ = host_and_path(F.col(url))
    rows = pages.select(host.alias("h"), html).mapInArrow(nodes, "h string, page long, path long, own long, look long")
    rows = common.cut(rows.distinct())  # pages alike count once
    return importances(rows, prior).where(F.col("e") < bound)


def importances(rows: DataFrame, prior: float) -> DataFrame:
    """(h, path, e) of rows (h, page, path, own, look): the larger entropy, to the base of the number of pages, and
    ``prior`` pages more with entropy 1. One page has entropy 1."""

    def entropy(of: str) -> DataFrame:
        each = rows.groupBy("h", "path", of).agg(F.count(F.lit(1)).alias("c"))
        sums = each.groupBy("h", "path").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"))
        return sums.select("h", "path", "m", F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.log("m"))).otherwise(1.0).alias(f"e_{of}"))

    both = entropy("own").join(entropy("look").drop("m"), ["h", "path"])
    # One and the same presentation on all pages and one and the same content give 0, up to rounding.
    e = F.greatest(F.lit(0.0), "e_own", "e_look")
    return both.select("h", "path", ((F.col("m") * e + prior) / (F.col("m") + prior)).alias("e"))


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", prior: float = PRIOR, low: float = LOW) -> DataFrame:
    """(key, url, text, n_chars) for every row of pages.

    Null and empty pages and pages without text give the empty text. A null url, or one without ``://``, belongs to the
    host of the empty name. Pages of any length and depth are read whole; repeated rows stay, and count once in the trees.
    Ties do not arise. An empty table gives an empty result. Other columns of the input are left out; its columns may have
    any names, but key and url must not be named text or n_chars. The trees' unimportant paths are broadcast where they
    are few, and else joined by host under salts, so that a host with a third of all pages is dealt to many tasks.
    """
    bound = low / min(INSIDE, OUTSIDE, 1.0)
    weak = style_trees(pages, url, html, prior, bound)
    weak = common.cut(weak.groupBy("h").agg(F.collect_list(F.struct("path", "e")).alias("low")))
    size = weak.agg(F.coalesce(F.sum(F.size("low")), F.lit(0)).alias("n")).first()["n"]
    host, _ = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("_k"), F.col(url).alias("_u"), F.col(html).alias("_x"), host.alias("_h"))
    if size <= common.BROADCAST_ROWS:
        rows = rows.join(F.broadcast(weak), F.col("_h") == F.col("h"), "left")
    else:
        rows = rows.withColumn("_s", F.pmod(F.xxhash64("_x", "_u"), F.lit(SALTS)))
        many = weak.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.join(many, (F.col("_h") == F.col("h")) & (F.col("_s") == F.col("s")), "left")
    rows = rows.select("_k", "_u", "_x", F.col("low.path").alias("_p"), F.col("low.e").alias("_e"), "_h")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, dict[int, float]] = {}
        for b in batches:
            got = []
            for x, h, paths, e in zip(b.column(2), b.column(5).to_pylist(), b.column(3), b.column(4), strict=True):
                if h not in trees:  # a host's tree is the same on all its rows
                    if len(trees) >= 256:
                        trees.clear()
                    trees[h] = dict(zip(paths.as_py() or (), e.as_py() or (), strict=True))
                got.append(main_text(x.as_py(), trees[h], low))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())], [key, url, "text", "n_chars"])

    kind = pages.schema[key].dataType.simpleString()
    return rows.mapInArrow(texts, f"`{key}` {kind}, `{url}` string, text string, n_chars long")
