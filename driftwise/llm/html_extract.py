"""Main-text extraction by wrapper induction.

Pages become DOM trees in which runs of like siblings are one repeated node.  The trees of a host are aligned by
simple tree matching and merged into its template; each template node counts its pages and the texts that recur in
it.  A page is aligned with its host's template: text that nearly all pages share is template, varying text is
content, unless the slot is a menu, header, footer, sidebar, notice, advert, form or comment area.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import stored, text_bytes

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub "
    "sup time tt u var br wbr img label td th".split())
#: Elements whose text is no article text.
SKIPPED = frozenset(
    "head script style noscript template svg math iframe object embed canvas audio video form button input select option "
    "optgroup textarea datalist dialog nav footer aside menu frameset noframes title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form status tablist".split())
#: Words of class and id values that name an area beside the article.
AREAS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner billboard breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disclaimer disqus donate footer footnav gdpr header masthead menu modal nav navbar navigation "
    "newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promoted promotion "
    "reactions related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription taboola tags teaser toc toolbar topbar trending widget widgets".split())
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section table ul".split())
SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
           "option": ("option",), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody", "tfoot")}
SCOPE = frozenset("ul ol dl table select".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?:(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<loose>[^>]*+)(?:>|\Z))|<[!?/][^>]*(?:>|\Z)",
    re.S)
ATTR = re.compile(r"([a-zA-Z][\w:-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: A text that this share of a host's pages has in the same slot is template, if the host has enough pages.
CONSTANT_SHARE, CONSTANT_PAGES = 0.8, 10
#: Recurring texts counted in a template node (heavy-hitter counters; a text of a larger share cannot be lost).
COUNTERS = 64
#: A slot of this mean share of link text is a menu.
LINK_SHARE = 0.6
#: Levels of a tree.  As in browsers, elements nested deeper become siblings at that level; none of their text is lost.
DEPTH = 150
#: Total bytes of templates up to which they are broadcast.
BROADCAST_BYTES = 64 << 20


class Node:
    __slots__ = ("tag", "label", "area", "kids", "parent", "slot", "depth")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.kids, self.slot = tag, parent, [], None
        self.depth = parent.depth + 1 if parent is not None else 0
        self.label, self.area = tag, tag in SKIPPED
        if attrs:
            self._read(attrs)

    def _read(self, attrs: str) -> None:
        got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)}
        names = " ".join((got.get("class", ""), got.get("id", "")))
        if names != " ":
            self.label = f"{self.tag}.{re.sub(r'[0-9]+', '#', ' '.join(sorted(names.split())))}"
            words = {w.lower() for w in WORDS.findall(names)}
            self.area = self.area or (bool(words & AREAS) and self.tag not in ("html", "body", "article", "main"))
            if self.tag == "article" and words & {"comment", "comments", "reply"}:
                self.area = True
        if got.get("role", "").lower() in ROLES or "hidden" in got or got.get("aria-hidden") == "true" or \
                re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", "")):
            self.area = self.area or self.tag not in ("html", "body")
        if got.get("role", "").lower() == "main":
            self.tag = "main"


def parse(page: str) -> Node:
    """DOM tree of a page, with HTML's implied end tags; texts are decoded strings among the children."""
    root = Node("#root", None)
    now, pos, n = root, 0, len(page)
    over: list[str] = []  # open elements beyond DEPTH
    while pos < n:
        m = TAG.search(page, pos)
        if m is None:
            now.kids.append(html.unescape(page[pos:]))
            break
        if m.start() > pos:
            now.kids.append(html.unescape(page[pos:m.start()]))
        pos = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag in over:
                while over.pop() != tag:
                    pass
                now = Node("div", now.parent)  # what follows is a block of its own
                now.parent.kids.append(now)
            else:
                now = _close(now, tag)
                if now.depth < DEPTH:
                    over.clear()
            continue
        if tag in CLOSES_P:
            now = _implied(now, ("p",), SCOPE)
        if tag in SIBLING:
            now = _implied(now, SIBLING[tag], SCOPE)
        elif tag in HEADINGS:
            now = _implied(now, tuple(HEADINGS), CLOSES_P - HEADINGS)
        deep = now.depth >= DEPTH
        node = Node(tag, now.parent if deep else now, m["attrs"] or m["loose"] or "")
        node.parent.kids.append(node)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(page, pos)
            pos = end.start() if end else n
        if tag not in VOID:
            now = node
            if deep:
                over.append(tag)
    return root


def _implied(now: Node, tags: tuple, stop: frozenset) -> Node:
    """Close the nearest open element of ``tags``, unless an element of ``stop`` or another block lies between."""
    at = now
    while at.parent is not None and at.tag not in stop:
        if at.tag in tags:
            return at.parent
        if at.tag not in INLINE and "p" in tags:
            return now
        at = at.parent
    return now


def _close(now: Node, tag: str) -> Node:
    at = now
    while at.parent is not None:
        if at.tag == tag or at.label.split(".")[0] == tag:
            return at.parent
        if tag in INLINE and at.tag not in INLINE:
            return now
        at = at.parent
    return now


# ---------------------------------------------------------------- templates

#: A template node: [label, pages, items, characters, link characters, {text hash: count}, children]
LABEL, PAGES, ITEMS, CHARS, LINKS, TEXTS, KIDS = range(7)


def _own_text(node: Node) -> str:
    """Text of the node outside block children."""
    out = []

    def walk(x: Node) -> None:
        for k in x.kids:
            if isinstance(k, str):
                out.append(k)
            elif k.tag == "br":
                out.append(" ")
            elif k.tag in INLINE:
                walk(k)

    walk(node)
    return " ".join("".join(out).split())


def _linked(node: Node, inside: bool = False) -> int:
    """Characters of the node's own text inside links."""
    n = 0
    for k in node.kids:
        if isinstance(k, str):
            n += len(k.strip()) if inside else 0
        elif k.tag in INLINE:
            n += _linked(k, inside or k.tag == "a")
    return n


def _key(text: str) -> str:
    return format(zlib.crc32(text.encode("utf-8", "replace")), "x")


def shape(nodes: list[Node]) -> list:
    """Template node of a run of like siblings of one page; each page node learns its slot."""
    first = nodes[0]
    slot = [first.label, 1, len(nodes), 0, 0, {}, []]
    runs: list[list[Node]] = []
    for node in nodes:
        node.slot = slot
        text = _own_text(node)
        if text:
            slot[CHARS] += len(text)
            slot[LINKS] += _linked(node)
            slot[TEXTS][_key(text)] = 1
        for kid in _blocks(node):
            if kid.tag in RAW or kid.tag == "head":
                continue
            if runs and runs[-1][0].label == kid.label:
                runs[-1].append(kid)
            else:
                runs.append([kid])
    merged: list = []
    for run in runs:
        merged = _merge_kids(merged, [shape(run)]) if len(nodes) > 1 else [*merged, shape(run)]
    slot[KIDS] = merged
    return slot


def _blocks(node: Node) -> Iterator[Node]:
    """Block children, also those inside inline children."""
    for k in node.kids:
        if isinstance(k, str):
            continue
        if k.tag in INLINE:
            yield from _blocks(k)
        else:
            yield k


def _trim(texts: dict) -> None:
    """Keep the COUNTERS most frequent texts, each less what the next one has (Misra and Gries)."""
    if len(texts) > COUNTERS:
        order = sorted(texts.items(), key=lambda x: (-x[1], x[0]))
        least = order[COUNTERS][1]
        texts.clear()
        texts.update((k, n - least) for k, n in order[:COUNTERS] if n > least)


def match(a: list, b: list, memo: dict) -> int:
    """Simple tree matching: the most nodes that two trees of equal root label can pair in order."""
    if a[LABEL] != b[LABEL]:
        return 0
    key = (id(a), id(b))
    if key not in memo:
        memo[key] = 1 + _grid(a[KIDS], b[KIDS], memo)[-1][-1]
    return memo[key]


def _grid(x: list, y: list, memo: dict) -> list[list[int]]:
    rows = [[0] * (len(y) + 1)]
    for p in x:
        last, row = rows[-1], [0]
        for j, q in enumerate(y):
            row.append(max(last[j + 1], row[j], last[j] + match(p, q, memo)))
        rows.append(row)
    return rows


def align(x: list, y: list, memo: dict) -> list[tuple]:
    """Children in order as pairs (of x or None, of y or None)."""
    if len(x) == len(y) and all(p[LABEL] == q[LABEL] for p, q in zip(x, y)):
        return list(zip(x, y))
    rows, out = _grid(x, y, memo), []
    i, j = len(x), len(y)
    while i or j:
        if i and j and (m := match(x[i - 1], y[j - 1], memo)) and rows[i][j] == rows[i - 1][j - 1] + m:
            i, j = i - 1, j - 1
            out.append((x[i], y[j]))
        elif i and rows[i][j] == rows[i - 1][j]:
            i -= 1
            out.append((x[i], None))
        else:
            j -= 1
            out.append((None, y[j]))
    return out[::-1]


def merge(a: list, b: list) -> list:
    """Merge template b into a; both have the same root label."""
    for k in (PAGES, ITEMS, CHARS, LINKS):
        a[k] += b[k]
    for text, n in b[TEXTS].items():
        a[TEXTS][text] = a[TEXTS].get(text, 0) + n
    _trim(a[TEXTS])
    a[KIDS] = _merge_kids(a[KIDS], b[KIDS])
    return a


def _merge_kids(x: list, y: list) -> list:
    return [merge(p, q) if p and q else p or q for p, q in align(x, y, {})]


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _page_tree(page: str) -> tuple[Node, list]:
    root = parse(page)
    return root, shape([root])


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the pages of a task into one template per host."""
    found: dict[str, list] = {}

    def out() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([json.dumps(t) for t in found.values()], pa.string())], names=["host", "template"])
        found.clear()
        return got

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            slot = _page_tree(page.as_py().decode())[1]
            found[host] = merge(found[host], slot) if host in found else slot
            if len(found) >= 2000:
                yield out()
    yield out()


def _reduce(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
    template = None
    for text in sorted(parts["template"].to_pylist()):
        own = json.loads(text)
        template = own if template is None else merge(template, own)
    return pa.table({"host": [key[0].as_py()], "template": [json.dumps(template)]})


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, template)``: templates merged inside each task, then one row per task and host meets in the host's group."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), text_bytes(html_col).alias("html"))
    return rows.mapInArrow(_induce, "host string, template string").groupBy("host").applyInArrow(_reduce, "host string, template string")


# ---------------------------------------------------------------- extraction


def _assign(slot: list, template: list, to: dict) -> None:
    """Align a page's slots with the template's nodes."""
    to[id(slot)] = template
    for p, q in align(slot[KIDS], template[KIDS], {}):
        if p and q:
            _assign(p, q, to)


class _Page:
    """One page against its host's template."""

    def __init__(self, page: str, template: list | None):
        self.root, slot = _page_tree(page)
        self.to: dict = {}
        if template is not None:
            _assign(slot, template, self.to)
        self.heads: dict[int, bool] = {}

    def _node(self, node: Node) -> list | None:
        return self.to.get(id(node.slot)) if node.slot is not None else None

    def holds_article(self, node: Node) -> bool:
        """Whether an article, main or first heading lies inside (such an area is no side area by its name)."""
        key = id(node)
        if key not in self.heads:
            self.heads[key] = any(not isinstance(k, str) and (k.tag in ("article", "main", "h1") and not k.area or self.holds_article(k)) for k in node.kids)
        return self.heads[key]

    def dropped(self, node: Node) -> bool:
        if node.area and (node.tag in SKIPPED or not self.holds_article(node)):
            return True
        t = self._node(node)
        if t is not None and node.tag in ("ul", "ol", "div", "section", "table", "p") and not self.holds_article(node):
            chars, links = _mass(t)
            return chars > 0 and links >= LINK_SHARE * chars
        return False

    def constant(self, node: Node, text: str) -> bool:
        t = self._node(node)
        return t is not None and t[PAGES] >= CONSTANT_PAGES and t[TEXTS].get(_key(text), 0) >= CONSTANT_SHARE * t[PAGES]

    def texts(self, node: Node, out: list[tuple[str, bool]], inside: bool, heading: bool = False) -> None:
        """Blocks of a kept element in page order as (text, is constant)."""
        buffer: list[str] = []

        def flush(owner: Node) -> None:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text and not (heading and owner.tag not in HEADINGS):
                out.append((text, self.constant(owner, text)))

        def walk(x: Node, owner: Node) -> None:
            for k in x.kids:
                if isinstance(k, str):
                    buffer.append(k)
                elif k.tag in ("br", "wbr", "td", "th"):
                    buffer.append("" if k.tag == "wbr" else " ")
                    walk(k, owner)
                elif k.tag in INLINE:
                    if not k.area:
                        walk(k, owner)
                else:
                    flush(owner)
                    if k.tag == "header":
                        if inside:  # an article's own header: its headings
                            self.texts(k, out, inside, True)
                    elif not self.dropped(k):
                        self.texts(k, out, inside, heading)

        walk(node, node)
        flush(node)

    def article(self) -> tuple[Node, bool]:
        """The element that holds the article: the largest <article>, else <main>, else the heaviest subtree."""
        for tag in ("article", "main"):
            found: list[Node] = []
            self._find(self.root, tag, found)
            if found:
                return max(found, key=self.weight), True
        at = self.root
        while True:
            kids = [k for k in at.kids if not isinstance(k, str) and k.tag not in INLINE and k.tag != "header" and not self.dropped(k)]
            best = max(kids, key=self.weight, default=None)
            if best is None or best.tag in CLOSES_P - {"div", "section", "article", "main", "table"} or self.weight(best) < 0.8 * self.weight(at):
                return at, at.tag not in ("#root", "html", "body")
            at = best

    def _find(self, node: Node, tag: str, found: list[Node]) -> None:
        for k in node.kids:
            if isinstance(k, str) or (k.area and (k.tag in SKIPPED or not self.holds_article(k))):
                continue
            if k.tag == tag:
                found.append(k)
            else:
                self._find(k, tag, found)

    def weight(self, node: Node) -> int:
        out: list[tuple[str, bool]] = []
        self.texts(node, out, True)
        return sum(len(t) for t, same in out if not same)

    def text(self) -> str:
        node, inside = self.article()
        out: list[tuple[str, bool]] = []
        self.texts(node, out, inside)
        varying = [t for t, same in out if not same]
        # an article that is constant for more than two thirds is a near copy of others of its host: it keeps its blocks
        if not varying or inside and 3 * sum(map(len, varying)) < sum(len(t) for t, _ in out):
            varying = [t for t, _ in out]
        return "\n".join(varying)


def _mass(t: list) -> tuple[int, int]:
    """Characters and link characters of a template subtree."""
    chars, links = t[CHARS], t[LINKS]
    for k in t[KIDS]:
        a, b = _mass(k)
        chars, links = chars + a, links + b
    return chars, links


def main_text(page: str, template: list | None = None) -> str:
    """The article of a page; without a template only the page itself speaks."""
    return _Page(page, template).text() if page else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, list] = {}
    for batch in batches:
        *rest, pages, templates = batch.columns
        texts = []
        for page, template in zip(pages, templates.to_pylist()):
            if template is not None and template not in known:
                if len(known) >= 500:
                    known.clear()
                known[template] = json.loads(template)
            texts.append(main_text(page.as_py().decode(), known.get(template)))
        yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string())], names=[*batch.schema.names[:-2], "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Whole pages are read; null html gives the empty text; a null url is a host of its own.  Repeated pages are
    extracted alike; copies of one page that make up a host keep their text.  Empty table: no rows.
    """
    templates = stored(induce(pages, url_col, html_col), "templates")
    size = templates.agg(F.sum(F.octet_length("template") + F.octet_length("host"))).first()[0] or 0
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), text_bytes(html_col).alias("html"))
    side = F.broadcast(templates) if size <= BROADCAST_BYTES else templates
    both = rows.join(side, "host", "left").select("page_id", "url", "html", "template")
    out = both.mapInArrow(_extract, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
