"""Main text of web pages by a minimum cut over their blocks.

A page is read into blocks: stretches of text between block-level tags, with character references decoded and white
space made one space. A logistic classifier gives each block log odds of being content: from its length, share of link text, ending and
being a heading, by weights that train() learns from a bounded sample of pages whose structure tells (they have an article or main element; blocks
in it, and not in boilerplate, against all others), and from its ancestors' tags, roles and class names, by fixed weights (below). These become the capacities
of its terminal edges: to the source if content is likelier, to the sink if not. Smoothness edges join each block
to the next ones on the page, the more strongly the nearer they are in the document tree, and blocks with one parent. They decide where
nothing names a block: a short line between paragraphs of one parent is content, and the same line between links is not.
The maximum flow's cut with the least cost labels the blocks; those on the source's side are joined by line feeds.

Null and empty html: empty text. Formulas (math) are text of their block. What stands in for scripts, frames, objects, images' maps and media where a browser can't show them (noscript, object, map, audio, video) is not
shown and no text. Text in scripts, styles, templates, form controls and comments never is a block. A line break inside a
block is white space. Unclosed and stray tags are closed as browsers do in the common cases. Ties of the cut go to boilerplate. Whole pages are read, in time that grows with
their length however deep or broken their tags are. With too few pages to learn from, TEXT_WEIGHTS are taken. Repeated rows get equal results.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Tag names of HTML.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = frozenset("script style template noscript svg canvas object iframe select textarea button datalist audio video map title head".split())
RAW_TAGS = frozenset(("script", "style", "textarea", "title", "iframe"))
#: What a starting tag closes when it is open inside the nearest of the containers.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in class names and ids of boilerplate, and of main text.
AGAINST = frozenset("ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation navi menu menubar breadcrumb breadcrumbs crumbs sidebar sidenav aside widget widgets rail footer foot masthead topbar toolbar pagination pager paging related recommended recommendations trending share sharing social follow comment comments commentlist discussion disqus replies reply respond cookie cookies consent gdpr notice notification alert popup modal overlay dialog newsletter subscribe subscription signup login signin register search copyright legal disclaimer skip toc tags taglist".split())
FOR = frozenset("article content post entry main story text body prose".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Weights of the log odds.
W = {"inside": 3.0, "outside": -5.0, "for": 1.5, "bad_tag": -9.0, "header": -7.0, "against": -8.0, "hidden": -8.0}
#: Of a block's text, where they can't be learnt: a base, words (in 40ths, up to 40), share of link text, an ending, a heading.
TEXT_WEIGHTS = (-0.5, 1.5, -4.0, 1.0, 0.5)
NEXT, NEAR, SIBLING = 0.6, 1.2, 0.4
#: About so many pages that weights are learnt from; blocks of a page, evenly spread; and blocks of each kind at least.
MOST_PAGES, MOST_BLOCKS, LEAST_BLOCKS = 1000, 60, 40

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Element:
    __slots__ = ("against", "bad", "depth", "favour", "header", "hidden", "main", "parent", "tag")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
        names = {w.lower() for k in ("class", "id") if k in got for w in _NAME_WORD.findall(got[k])}
        role = got.get("role", "").lower()
        up = parent
        self.main = bool(up and up.main) or tag in ("article", "main") or role in ("main", "article")
        outer = tag in ("html", "body", "article", "main")
        self.bad = bool(up and up.bad) or tag in BAD_TAGS or role in BAD_ROLES
        self.header = bool(up and up.header) or ((tag == "header" or "header" in names) and not self.main)
        self.against = bool(up and up.against) or (bool(names & AGAINST) and not outer)
        self.favour = bool(up and up.favour) or (bool(names & FOR) and not outer)
        self.hidden = bool(up and up.hidden) or "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "").lower()


class Block:
    __slots__ = ("element", "linked", "parts", "size")

    def __init__(self, element: Element):
        self.element, self.parts, self.linked, self.size = element, [], 0, 0


def blocks(html: str) -> list[tuple[Element, str, float]]:
    """(element, text, share of link text) of a page, in order; texts aren't empty."""
    root = Element("", "", None)
    stack, found, block, links, skipped, at = [root], [], Block(root), 0, 0, 0
    open_at: dict[str, list[int]] = {}  # where each tag is open in the stack, and all block tags
    holders, last_end = [0], html.rfind(">")

    def last(tag: str) -> int:
        """The place of the innermost open tag, 0 for none."""
        got = open_at.get(tag)
        return got[-1] if got else 0

    def innermost(tags) -> int:
        return max(map(last, tags))

    def close() -> None:
        nonlocal block
        text = " ".join("".join(block.parts).split())
        if text:
            found.append((block.element, text, block.linked / max(1, block.size)))
        block = Block(stack[holders[-1]])

    def add(raw: str) -> None:
        if raw and not skipped:
            text = entities.unescape(raw) if "&" in raw else raw
            block.parts.append(text)
            n = len(text.strip())
            block.size += n
            if links:
                block.linked += n

    def pop_to(k: int) -> None:
        nonlocal links, skipped
        broke = False
        while len(stack) > k:
            e = stack.pop()
            open_at[e.tag].pop()
            if holders[-1] == len(stack):
                holders.pop()
            links -= e.tag == "a"
            skipped -= e.tag in SKIPPED_TAGS
            broke |= e.tag in BLOCK_TAGS
        if broke:
            close()

    while True:
        m = _TAG.search(html, at) if at <= last_end else None  # no tag ends after the last >
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                add(entities.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag, ending, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if ending:
            k = last(tag)
            if k and (tag in BLOCK_TAGS or tag in SKIPPED_TAGS or holders[-1] <= k):
                pop_to(k)
            elif not k and tag in ("br", "p"):
                close() if tag == "p" else add(" ")
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK_TAGS:
            k = last("p")
            if k > innermost(("table", "td", "th", "caption", "object", "button")) and tag not in ("body", "html", "head"):
                pop_to(k)
            if tag in CLOSES:
                shut, within = CLOSES[tag]
                k = innermost(shut)
                if k > innermost(within):
                    pop_to(k)
            if tag == "body":
                if last("head"):
                    pop_to(open_at["head"][0])
            close()
        if tag in VOID_TAGS or attributes.endswith("/") and tag not in BLOCK_TAGS and tag not in RAW_TAGS:
            continue
        if tag == "a" and links:  # links don't nest
            k = last("a")
            if k and holders[-1] <= k:
                pop_to(k)
        open_at.setdefault(tag, []).append(len(stack))
        if tag in BLOCK_TAGS:
            holders.append(len(stack))
        stack.append(Element(tag, attributes, stack[-1]))
        links += tag == "a"
        skipped += tag in SKIPPED_TAGS
        if tag in BLOCK_TAGS:
            block = Block(stack[-1])
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.start() if end else len(html)
    close()
    return found


def text_features(element: Element, text: str, linked: float) -> tuple[float, ...]:
    return (1.0, min(text.count(" ") + 1, 40) / 40, linked, float(text[-1] in ".!?…:\"'”»)"), float(element.tag[:1] == "h" and element.tag[1:].isdigit()))


def named(e: Element, has_main: bool) -> float:
    """Log odds from the names of a block's ancestors."""
    s = (W["inside"] if e.main else W["outside"]) if has_main else 0.0
    return s + W["for"] * (e.favour and not e.main) + W["bad_tag"] * e.bad + W["header"] * e.header + W["against"] * e.against + W["hidden"] * e.hidden


def log_odds(element: Element, text: str, linked: float, has_main: bool, weights=TEXT_WEIGHTS) -> float:
    return sum(w * x for w, x in zip(weights, text_features(element, text, linked), strict=True)) + named(element, has_main)


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Weights of a logistic regression, by Newton's steps; the ridge holds them within bounds where the classes part."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return tuple(w.tolist())


def train(pages: DataFrame, html: str = "html") -> tuple[float, ...]:
    """Weights of text_features() from about MOST_PAGES pages (by hash, equal ones once), MOST_BLOCKS blocks of each."""
    share = min(1.0, MOST_PAGES / max(pages.count(), 1))
    some = pages.select(F.col(html).alias("html")).where(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < int(share * (1 << 30)))
    some = some.where(F.lower("html").rlike("<(article|main)[ >]")).distinct()

    def build(batches):
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                found = blocks(t)
                if any(e.main for e, _, _ in found):
                    step = -(-len(found) // MOST_BLOCKS)
                    rows += [(*text_features(e, x, k), float(named(e, True) > 0)) for e, x, k in found[::step]]
            cols = np.array(rows, float).reshape(-1, len(TEXT_WEIGHTS) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(list(cols), pa.list_(pa.float64()))], ["x"])

    got = some.mapInArrow(build, "x array<double>").toArrow()["x"].to_pylist()
    rows = np.array(sorted(got), float).reshape(-1, len(TEXT_WEIGHTS) + 1)
    x, y = rows[:, :-1], rows[:, -1]
    return fitted(x, y) if min(y.sum(), len(y) - y.sum()) >= LEAST_BLOCKS else TEXT_WEIGHTS


def tree_distance(a: Element, b: Element) -> int:
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def smoothness(elements: list[Element]) -> list[tuple[int, int, float]]:
    edges, last = [], {}
    for i, e in enumerate(elements):
        for step in (1, 2):
            if i >= step:
                edges.append((i - step, i, (NEXT if step == 1 else 0.0) + NEAR / step / (1 + tree_distance(elements[i - step], e))))
        if id(e.parent) in last:
            edges.append((last[id(e.parent)], i, SIBLING))
        last[id(e.parent)] = i
    return edges


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side: terminal capacities from the log odds, smoothness edges both ways; maximum flow by level graphs."""
    n = len(odds)
    to, cap, out = [], [], [[] for _ in range(n + 2)]

    def join(a: int, b: int, c: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((c, back))

    for i, s in enumerate(odds):
        if s > 0:
            join(n, i, s, 0.0)
        else:
            join(i, n + 1, -s, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        level, queue = [-1] * (n + 2), deque([n])
        level[n] = 0
        while queue:
            v = queue.popleft()
            for e in out[v]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[n + 1] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        v = n
        while True:
            if v == n + 1:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if cap[e] <= 1e-9)
                v = to[path[k] ^ 1]
                del path[k:]
            while nxt[v] < len(out[v]):
                e = out[v][nxt[v]]
                if cap[e] > 1e-9 and level[to[e]] == level[v] + 1:
                    break
                nxt[v] += 1
            if nxt[v] < len(out[v]):
                path.append(out[v][nxt[v]])
                v = to[path[-1]]
            elif path:
                level[v] = -1
                v = to[path.pop() ^ 1]
            else:
                break


def main_text(html: str | None, weights=TEXT_WEIGHTS) -> str:
    found = blocks(html or "")
    has_main = any(e.main for e, _, _ in found)
    content = minimum_cut([log_odds(e, t, k, has_main, weights) for e, t, k in found], smoothness([e for e, _, _ in found]))
    return "\n".join(t for (_, t, _), c in zip(found, content, strict=True) if c)


def extract(pages: DataFrame, weights=None, html: str = "html") -> DataFrame:
    """All columns of pages but html, with text and n_chars (columns of these names are replaced). Weights are train()'s, learnt from these pages if not given."""
    weights = train(pages, html) if weights is None else weights
    source = pages.select(*(c for c in pages.columns if c not in ("text", "n_chars") or c == html))
    keep = [f for f in source.schema.fields if f.name != html]
    types = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "text string, n_chars bigint"])

    def build(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                texts = [main_text(t, weights) for t in part.column(part.schema.get_field_index(html)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(f.name)) for f in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*(f.name for f in keep), "text", "n_chars"])

    return source.mapInArrow(build, types)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html")))
