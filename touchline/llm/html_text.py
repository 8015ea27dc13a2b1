"""Operator 3: main text of web pages by wrapper induction.

All pages of one host and layout are parsed and aligned by simple tree matching: parts of them in each task, then the trees of the tasks. What
stays constant over the aligned pages is template, what varies is a slot. A page's content is the article that its markup names, or else the part of the tree that holds most of the varying text; template
nodes and parts that markup names as navigation, adverts, forms, comments and so on are left out.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import partitions, written

LEAST = 4  # aligned pages with different texts that a node must be constant over to be template
BROADCAST = 64 << 20  # bytes of wrappers that are sent to all executors, at most; beyond, pages and wrappers join by shuffle
SLOTS = 4  # texts that a wrapper node remembers while it is induced

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks whose start ends an open paragraph.
_ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())
#: Elements that a start tag closes if they are open (the usual omitted end tags).
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"},
}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
_DROPPED = frozenset("head nav aside footer form script style noscript template iframe svg button select textarea input object canvas audio video map dialog".split())
#: Parts of class and id names that mark what is not article text (fixed values).
_MARKED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription "
    "signup popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments respond replies disqus share sharing social related "
    "recommended recommendations widget toolbar pagination pager masthead topbar skip login search".split()
)
#: Elements of running text; they are template only with all that is below.
_TEXTUAL = frozenset("p b i em strong a span".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
_START = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile("[\"'>]")
#: Elements whose content is no markup; all up to their end tag is left out.
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "svg", "template", "xmp")}
#: One attribute after the other, so that what a quoted value holds is no attribute.
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_LOOKED = frozenset(("class", "id", "role", "hidden", "style"))
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("children", "kind", "marked", "tag")

    def __init__(self, tag: str, kind: str, marked: bool):
        self.tag, self.kind, self.marked, self.children = tag, kind, marked, []


def _attributes(tag: str, raw: str) -> tuple[str, bool]:
    """Kind of an element (tag and class) and whether it is marked as something other than content."""
    found = {}
    for m in _ATTRIBUTE.finditer(raw):
        if (name := m[1].lower()) in _LOOKED:
            found.setdefault(name, m[2] or m[3] or m[4] or "")
    names = f"{found.get('class', '')} {found.get('id', '')}"
    marked = tag in _DROPPED or "hidden" in found or found.get("role", "").lower() in _ROLES
    marked = marked or _UNSEEN.search(found.get("style", "")) is not None
    marked = marked or (tag not in ("html", "body", "main", "article") and any(p.lower() in _MARKED for p in _SPLIT.split(names)))
    return f"{tag}.{re.sub('[0-9]+', '', found.get('class', ''))}", marked


_short = lru_cache(maxsize=4096)(_attributes)


def _tag_end(html: str, at: int, quoted: bool) -> tuple[int, bool]:
    """End of the tag whose name ends at `at` (-1 for none), and whether quoted values may still hide a `>` further on.

    Quotes that swallow the rest of a page hide nothing from there on, so every page is read in linear time.
    """
    k = at
    while quoted and (m := _STOP.search(html, k)):
        if m[0] == ">":
            return m.end(), True
        if (k := html.find(m[0], m.end()) + 1) == 0:
            break
    return html.find(">", at) + 1 or -1, False


def _tags(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether it ends an element, name, attributes) of each tag; comments and raw elements come without a name."""
    at, quoted, n = 0, True, len(html)
    while m := _START.search(html, at):
        name = ""
        if m[1]:
            end = html.find("-->", m.end()) + 3
            end = n if end == 2 else end
        elif m[3] is None:
            end = html.find(">", m.end()) + 1
            if not end:
                return
        else:
            end, quoted = _tag_end(html, m.end(), quoted)
            if end < 0:
                return
            name = m[3].lower()
            if name in _RAW and not m[2]:
                close, name = _RAW[name].search(html, end), ""
                end = close.end() if close else n
        yield m.start(), end, bool(m[2]), name, html[m.end() : end - 1] if name else ""
        at = end


def parse(html: str) -> Node:
    """Tree of elements and texts (strings, references decoded); tolerant of what is missing."""
    root = Node("html", "html.", False)
    stack, at = [root], 0
    opened: Counter[str] = Counter()  # by tag, in the stack

    def close(k: int) -> None:
        for n in stack[k:]:
            opened[n.tag] -= 1
        del stack[k:]

    for start, end, ends, tag, raw in _tags(html):
        if start > at:
            stack[-1].children.append(unescape(html[at:start]))
        at = end
        if not tag:
            continue
        if ends:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                    break
            continue
        if tag == "html":
            continue
        if tag in _ENDS_P and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph and what is open in it
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in _BLOCK:
                    break
        if tag in _CLOSES and any(opened[t] for t in _CLOSES[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _STOPS.get(tag, ()):
                    break
                if stack[k].tag in _CLOSES[tag]:
                    close(k)
        if tag == "body" and stack[-1].tag == "head":
            close(len(stack) - 1)
        kind, marked = (_short if len(raw) < 2000 else _attributes)(tag, raw)
        if tag == "header" and not (opened["article"] or opened["main"]):
            marked = True
        node = Node(tag, kind, marked)
        stack[-1].children.append(node)
        if tag not in _VOID and not raw.endswith("/"):
            stack.append(node)
            opened[tag] += 1
    if at < len(html):
        stack[-1].children.append(unescape(html[at:]))
    return root


def _own(node: Node) -> str:
    return " ".join("".join(c for c in node.children if isinstance(c, str)).split())


class Wrapper:
    """A tree in which repeated neighbours are one node; each node knows how many pages have it and which texts it held."""

    def __init__(self, kind: str, pages: int = 0, texts: list[str] | None = None, children: list[Wrapper] | None = None):
        self.kind, self.pages, self.texts, self.children = kind, pages, texts or [], children or []

    def add(self, text: str) -> None:
        if text not in self.texts and len(self.texts) < SLOTS:
            self.texts.append(text)

    def template(self, pages: int) -> bool:
        """Constant over enough pages."""
        return len(self.texts) == 1 and self.pages >= max(LEAST, 0.8 * pages) and bool(self.texts[0])

    def constant(self, pages: int) -> bool:
        """Template with all that is below."""
        if not self.template(pages):
            return False
        left = list(self.children)
        while left:
            w = left.pop()
            if len(w.texts) != 1:
                return False
            left += w.children
        return True

    def dump(self) -> list:
        """All nodes from the root on, each before its children, with their number."""
        out, left = [], [self]
        while left:
            w = left.pop()
            out.append([w.kind, w.pages, w.texts, len(w.children)])
            left += reversed(w.children)
        return out

    @staticmethod
    def load(x: list) -> Wrapper:
        made: list[Wrapper] = []  # roots of what follows, the next one last
        for kind, pages, texts, n in reversed(x):
            children = [made.pop() for _ in range(n)]
            made.append(Wrapper(kind, pages, texts, children))
        return made[0]


def _match(nodes: list, parts: list[Wrapper]) -> tuple[int, ...]:
    """Simple tree matching of one level: the part of each node (-1 for none), in order, parts may repeat; most nodes matched."""
    if not parts or not nodes:
        return (-1,) * len(nodes)
    kinds = tuple(n.kind for n in nodes), tuple(p.kind for p in parts)
    return (_matched_again if len(nodes) + len(parts) < 100 else _matched)(*kinds)


def _matched(nodes: tuple[str, ...], parts: tuple[str, ...]) -> tuple[int, ...]:
    """Every few rows of the table of matches are kept, the rows between are made again on the way back: memory stays near sqrt(nodes) x parts."""
    m, n = len(nodes), len(parts)
    every = m if m * n < 4_000_000 else math.isqrt(m) + 1
    column = np.array(parts, object)
    same = {k: column == k for k in set(nodes)}

    def up(row: np.ndarray, i: int) -> np.ndarray:
        made = row.copy()
        made[:n] = np.maximum(row[:n], np.where(same[nodes[i]], row[:n] + 1, 0))
        return np.maximum.accumulate(made[::-1])[::-1]

    row, kept = np.zeros(n + 1, np.int32), {}
    for i in range(m - 1, -1, -1):
        if (i + 1) % every == 0 or i == m - 1:
            kept[i + 1] = row
        row = up(row, i)
    out, j, rows, low = [], 0, [], 0
    for i in range(m):
        if i % every == 0:
            low = i
            top = min(i + every, m)
            rows = [kept[top]]
            for x in range(top - 1, i - 1, -1):
                rows.append(up(rows[-1], x))
            rows.reverse()
        here, below, kind = int(rows[i - low][j]), rows[i - low + 1], same[nodes[i]]
        k = -1
        if n - j > 64:
            hits = kind[j:] & (below[j:n] == here - 1)
            first = int(hits.argmax())
            k = j + first if hits[first] else -1
        else:
            k = next((x for x in range(j, n) if kind[x] and below[x] == here - 1), -1)
        out.append(k)
        j = max(j, k)
    return tuple(out)


#: Pages of one layout ask for the same few levels again and again.
_matched_again = lru_cache(maxsize=8192)(_matched)


def _insert(wrapper: Wrapper, nodes: list) -> list[Wrapper]:
    """The part of each node at the level below the wrapper; what the wrapper lacks is inserted where it stands."""
    parts, place, last, out = list(wrapper.children), 0, 0, []
    for child, k in zip(nodes, _match(nodes, wrapper.children), strict=True):
        if k >= 0:
            part = wrapper.children[k]
            last = parts.index(part, last)
            place = last + 1
        elif place and parts[place - 1].kind == child.kind:
            part = parts[place - 1]
        else:
            part = Wrapper(child.kind)
            parts.insert(place, part)
            place += 1
        out.append(part)
    wrapper.children = parts
    return out


def _merge(wrapper: Wrapper, node: Node) -> None:
    """Align a page's tree with the wrapper."""
    left = [(wrapper, node)]
    while left:
        wrapper, node = left.pop()
        wrapper.add(_own(node))
        nodes = [c for c in node.children if isinstance(c, Node)]
        if not nodes:
            continue
        parts, used = _insert(wrapper, nodes), set()
        for part in parts:
            if id(part) not in used:
                used.add(id(part))
                part.pages += 1
        left += reversed(list(zip(parts, nodes, strict=True)))


def _join(wrapper: Wrapper, other: Wrapper) -> None:
    """Align the wrapper of other pages with this one."""
    wrapper.pages += other.pages
    left = [(wrapper, other)]
    while left:
        wrapper, other = left.pop()
        for text in other.texts:
            wrapper.add(text)
        if not other.children:
            continue
        parts, counted = _insert(wrapper, other.children), {}
        for part, child in zip(parts, other.children, strict=True):
            have = counted.get(id(part), 0)
            part.pages += max(child.pages - have, 0)  # pages may hold several of these
            counted[id(part)] = max(child.pages, have)
        left += reversed(list(zip(parts, other.children, strict=True)))


def induce(pages: list[str]) -> str:
    """Wrapper of pages of one host, as JSON; pages with the same text count once."""
    root, seen = Wrapper("html."), set()
    for html in pages:
        tree = parse(html)
        text = "\n".join(_blocks(tree, {}, 0))
        if text not in seen:
            seen.add(text)
            root.pages += 1
            _merge(root, tree)
    return json.dumps(root.dump(), ensure_ascii=False)


def layout(root: Node) -> str:
    """Kinds of the outermost elements of a page that are more than one."""
    while len(nodes := [c for c in root.children if isinstance(c, Node) and c.tag != "head"]) == 1:
        root = nodes[0]
    return "\n".join(sorted({c.kind for c in nodes}))


@lru_cache(maxsize=256)
def _loaded(wrapper: str) -> Wrapper:
    return Wrapper.load(json.loads(wrapper))


@lru_cache(maxsize=256)
def _of_host(wrappers: str) -> dict[str, Wrapper]:
    return {k: Wrapper.load(w) for k, w in json.loads(wrappers).items()}


def _blocks(node: Node, parts: dict[int, Wrapper], pages: int) -> list[str]:
    """Texts of blocks in page order, without marked parts and template."""
    out: list[str] = []
    texts: list[str] = []

    def close() -> None:
        text = " ".join("".join(texts).split())
        texts.clear()
        if text:
            out.append(text)

    left = [(iter(node.children), False)]
    while left:
        children, block = left[-1]
        for c in children:
            if isinstance(c, str):
                texts.append(c)
                continue
            if c.tag == "br":
                texts.append(" ")
            part = parts.get(id(c))
            if c.marked or (part is not None and part.texts[:1] == [_own(c)] and (part.constant if c.tag in _TEXTUAL else part.template)(pages)):
                if c.tag in _BLOCK:
                    close()
                continue
            if c.tag in _BLOCK:
                close()
            left.append((iter(c.children), c.tag in _BLOCK))
            break
        else:
            left.pop()
            if block:
                close()
    close()
    return out


def _aligned(root: Node, wrapper: Wrapper | None) -> tuple[dict[int, Wrapper], dict[int, int], dict[str, list[Node]]]:
    """Of all nodes outside marked parts: their part of the wrapper, the characters of text at and below them that are not template, and the outermost articles and mains."""
    parts: dict[int, Wrapper] = {}
    order: list[tuple[Node, int]] = []
    named: dict[str, list[Node]] = {"article": [], "main": []}
    left: list[tuple[Node, Wrapper | None, int, frozenset[str]]] = [(root, wrapper, -1, frozenset())]
    while left:
        node, part, above, within = left.pop()
        if part is not None:
            parts[id(node)] = part
        if above >= 0 and node.tag in named and node.tag not in within:
            named[node.tag].append(node)
            within = within | {node.tag}
        order.append((node, above))
        nodes = [c for c in node.children if isinstance(c, Node)]
        at = _match(nodes, part.children) if part is not None else (-1,) * len(nodes)
        place = len(order) - 1
        left += [(c, part.children[k] if k >= 0 else None, place, within) for c, k in zip(reversed(nodes), reversed(at), strict=True) if not c.marked]
    pages = wrapper.pages if wrapper else 0
    sums = [0] * len(order)
    for i in range(len(order) - 1, -1, -1):
        node, above = order[i]
        own, part = _own(node), parts.get(id(node))
        sums[i] += 0 if part is not None and part.template(pages) and part.texts[0] == own else len(own)
        if above >= 0:
            sums[above] += sums[i]
    return parts, {id(node): n for (node, _), n in zip(order, sums, strict=True)}, named


def main_text(html: str, wrapper: Wrapper | None) -> str:
    """Blocks of the content of a page, joined by line ends."""
    return _main(parse(html), wrapper)


def _main(root: Node, wrapper: Wrapper | None) -> str:
    parts, varying, named = _aligned(root, wrapper)
    found = named["article"] or named["main"]
    if not found:
        node = root
        while True:  # down to the part that holds most of the varying text alone
            below = [(varying[id(c)], c) for c in node.children if isinstance(c, Node) and not c.marked]
            total = len(_own(node)) + sum(n for n, _ in below)
            n, best = max(below, key=lambda x: x[0], default=(0, None))
            if best is None or best.tag not in _BLOCK or best.tag in ("p", "li", "pre", "td") or n < 0.8 * max(total, 1):
                break
            node = best
        found = [node]
    return "\n".join(t for node in found for t in _blocks(node, parts, wrapper.pages if wrapper else 0))


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Host, layout, hash of the text and html of each page; pages of a task with the same host and text once."""
    seen = set()
    for batch in batches:
        out: dict[str, list] = {"host": [], "layout": [], "told": [], "html": []}
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            tree = parse(html)
            told = int.from_bytes(blake2b("\n".join(_blocks(tree, {}, 0)).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
            if (host, told) not in seen:
                seen.add((host, told))
                for c, x in zip(out, (host, layout(tree), told, html), strict=True):
                    out[c].append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if c == "told" else pa.string()) for c, x in out.items()], names=list(out))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrapper of the pages of each host and layout in this task, which come in order; a text of a host counts once."""
    at, root, first, last = None, Wrapper("html."), 0, None

    def made(rows: list) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["host", "layout", "first", "wrapper"])

    for batch in batches:
        done = []
        for host, told, kind, html in zip(*(batch.column(c).to_pylist() for c in ("host", "told", "layout", "html")), strict=True):
            if (host, kind) != at:
                if at:
                    done.append((*at, first, json.dumps(root.dump(), ensure_ascii=False)))
                at, root, first, last = (host, kind), Wrapper("html."), told, None
            if told != last:
                last = told
                root.pages += 1
                _merge(root, parse(html))
        if done:
            yield made(done)
    if at:
        yield made([(*at, first, json.dumps(root.dump(), ensure_ascii=False))])


def _induced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of a host: by layout where it has enough pages, and under '*' that of all its pages."""
    at, every, found = None, Wrapper("html."), {}

    def made() -> pa.RecordBatch:
        kept = {k: w.dump() for k, w in found.items() if w.pages >= LEAST} | {"*": every.dump()}
        return pa.RecordBatch.from_arrays([pa.array([at], pa.string()), pa.array([json.dumps(kept, ensure_ascii=False)], pa.string())], names=["host", "wrapper"])

    for batch in batches:
        for host, kind, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "layout", "wrapper")), strict=True):
            if host != at:
                if at is not None:
                    yield made()
                at, every, found = host, Wrapper("html."), {}
            part = Wrapper.load(json.loads(wrapper))
            _join(every, part)
            if kind in found:
                _join(found[kind], part)
            else:
                found[kind] = part
    if at is not None:
        yield made()


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, wrapper in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
            if html:
                tree, known = parse(html), _of_host(wrapper) if wrapper else {}
                texts.append(_main(tree, known.get(layout(tree)) or known.get("*")))
            else:
                texts.append("")
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of the main text of every page, from its whole html.

    Blocks come in page order, white space inside each is one space, and one line end joins them. A null or empty html gives ''. Pages
    without a url share an empty host. Nesting may be of any depth; a tag that never ends is text, and quotes that would swallow the rest of a
    page hide no tag end. Elements whose style hides them are left out. Repeated rows get equal texts, and pages of a host with the same text count once for the wrapper.
    An empty table stays empty; other columns are ignored.
    """
    spark = pages.sparkSession
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))
    told = rows.where("html <> ''").select("host", "html").mapInArrow(_told, "host string, layout string, told long, html string")
    told = told.repartition(partitions(spark), "host", "told").sortWithinPartitions("host", "layout", "told", "html")
    parts = written(told.mapInArrow(_parts, "host string, layout string, first long, wrapper string"), "wrapper-parts")
    parts = parts.repartition(partitions(spark), "host").sortWithinPartitions("host", "layout", "first", "wrapper")
    wrappers = written(parts.mapInArrow(_induced, "host string, wrapper string"), "wrappers")
    if wrappers.agg(F.coalesce(F.sum(F.octet_length("wrapper")), F.lit(0))).first()[0] <= BROADCAST:
        wrappers = F.broadcast(wrappers)
    kind = dict(pages.dtypes)
    return rows.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper").mapInArrow(_extracted, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
