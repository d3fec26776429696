"""Main text of web pages by composite text density.

Each DOM node has C characters, T tags, LC characters in links and LT link tags below it. With the body's ratio of link
characters r = LCb / Cb, its density is

    C/T * log( C/LC * T/LT ) / log( ln( C/(C-LC) * LC + r * C + e ) )

(zero divisors count as one, and the divisor at the end is at least one: with few links the inner logarithm is near one).
Inline elements are no nodes of their own: they count as tags of their block. A node's sum is that of its children's
densities; the node with the largest sum, the first among equals, holds the text. Siblings on its path to the body that
are at least as dense as the least dense node of the path, and are not mostly links, belong to it as well; so do runs of
text directly in the path's nodes, by the same test, and headings that lead a part that belongs to it.

What density can't tell, since it is prose or no text at all, is taken out first: elements that are by their name no main
text (scripts, styles, forms, menus, footers, asides), hidden ones, and parts named as adverts, notices or reader
comments. Parts named as menus, sidebars and the like are counted as all others are, and taken out of the selection.

Defined results: null or empty html gives the empty text; broken markup is read as browsers do (implied end tags, text
outside any element, cut pages); repeated rows give repeated results; null ids and addresses stay null; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names and markers of parts that are no main text.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset(
    "head title script style noscript template nav footer aside form button select textarea input iframe svg canvas object embed audio video dialog menu noembed noframes xmp datalist map math".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
#: Parts of prose.
PROSE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle adbox adslot sponsor sponsored sponsors promo promoted promotion cookie cookies consent gdpr notice notices "
    "notification alert alerts announcement disclaimer toast popup modal overlay newsletter paywall comment comments commentlist disqus responses discussion reactions replies respond".split()
)
#: Parts of links and controls.
LINKS = frozenset(
    "banner subscribe subscription signup login sidebar sidenav aside rail menu nav navbar navigation breadcrumb breadcrumbs footer masthead social share sharing related recommended "
    "recommendations widget widgets toolbar pagination pager search skip".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEADERS = frozenset("header topbar".split())
#: Class names that begin so tell about the layout or belong to the article, whatever follows.
LAYOUT = frozenset("has with without no is js".split())
OWN = frozenset("article post entry story content".split())
HOLDERS = frozenset(("html", "body", "article", "main"))
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split()
)
#: Opening the first closes an open one of the second, unless one of the third lies between.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
    "tbody": (("tr", "tbody", "thead"), ("table",)),
    "tfoot": (("tr", "tbody", "thead"), ("table",)),
}
SCOPE = frozenset("html body article main section table td th button object caption".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRIBUTES = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|)|["'])*+>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")


def _end_of_raw(name: str, page: str, at: int, cache: dict) -> int:
    if name not in cache:
        cache[name] = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE)
    m = cache[name].search(page, at)
    return m.start() if m else -1


class Page:
    """The tree in document order: parallel lists for nodes, and the texts with the node that holds each."""

    def __init__(self, page: str, marked: bool = True):
        self.marked = marked  # class and id names count
        self.tag, self.parent = ["#root"], [-1]
        self.drop, self.late = [False], [False]  # taken out before anything is counted, or of what is selected
        self.events: list[tuple[int, str | None]] = []  # (node, text), or (node, None) where a block begins or ends
        self.open = [0]
        self.language: str | None = None  # as the page declares it
        self.held: Counter = Counter()  # open elements by name, so that a search for one that isn't open costs nothing
        self._read(page)

    def _start(self, name: str, attributes: str, closed: bool) -> None:
        if name in ("html", "meta") and self.language is None and attributes:
            self._declare(name, attributes)
        if name in CLOSES_P:
            self._close(("p",), SCOPE)
        if name in IMPLIED:
            self._close(*IMPLIED[name])
        node, up = len(self.tag), self.open[-1]
        self.tag.append(name)
        self.parent.append(up)
        drop, late = self._unwanted(name, attributes)
        self.drop.append(self.drop[up] or drop)
        self.late.append(self.late[up] or late)
        if name not in INLINE:
            self.events.append((up, None))
        elif name == "br":
            self.events.append((up, " "))
        if name not in VOID and not closed:
            self.open.append(node)
            self.held[name] += 1

    def _declare(self, name: str, attributes: str) -> None:
        given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        if name == "html":
            self.language = given.get("lang") or given.get("xml:lang") or None
        elif given.get("http-equiv", "").strip().lower() == "content-language":
            self.language = given.get("content") or None

    def _unwanted(self, name: str, attributes: str) -> tuple[bool, bool]:
        if name in DROPPED:
            return True, False
        if name in HOLDERS:
            inside = attributes.lower() if name == "article" and attributes else ""
            return bool(inside) and any(w in ("comment", "comments", "related", "ad", "advert", "sponsored", "promo") for m in re.finditer(r"class\s*=\s*[\"']?([^\"'>]*)", inside) for w in _WORD.findall(m[1])), False
        late = name == "header" and not self._in_article()
        if attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if key in ("class", "id") and self.marked:
                    for x in value.split():
                        parts = _WORD.findall(x)
                        if not parts or parts[0] in LAYOUT:
                            continue
                        if not PROSE.isdisjoint(parts):
                            return True, False
                        late = late or not LINKS.isdisjoint(parts) or (not HEADERS.isdisjoint(parts) and parts[0] not in OWN and not self._in_article())
                if key == "role" and value.strip() in ROLES:
                    late = True
                if key == "hidden" or (key == "aria-hidden" and value == "true"):
                    return True, False
                if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    return True, False
        return False, late

    def _in_article(self) -> bool:
        return bool(self.held["article"] or self.held["main"])

    def _close(self, names: tuple[str, ...], barrier) -> None:
        if not any(self.held[n] for n in names):
            return
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[i]]
            if tag in names:
                self._pop(i)
                return
            if tag in barrier:
                return

    def _pop(self, i: int) -> None:
        for node in reversed(self.open[i:]):
            self.held[self.tag[node]] -= 1
            if self.tag[node] not in INLINE:
                self.events.append((self.parent[node], None))
        del self.open[i:]

    def _end(self, name: str) -> None:
        if not self.held[name]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[i]]
            if tag == name:
                self._pop(i)
                return
            if name in INLINE and tag not in INLINE:
                return
            if tag in ("article", "main", "table") and name not in HOLDERS and name not in ("div", "section"):
                return

    def _text(self, text: str) -> None:
        if text:
            self.events.append((self.open[-1], entities.unescape(text) if "&" in text else text))

    def _read(self, page: str) -> None:
        at, n, raw_ends = 0, len(page), {}
        while at < n:
            lt = page.find("<", at)
            if lt < 0 or lt + 1 >= n:
                self._text(page[at:] if lt < 0 else page[at:lt])
                break
            c = page[lt + 1]
            if c == "!" or c == "?":
                self._text(page[at:lt])
                if page.startswith("<!--", lt):
                    end = page.find("-->", lt + 2)  # <!--> is a whole comment
                    at = n if end < 0 else end + 3
                else:
                    end = page.find(">", lt)
                    at = n if end < 0 else end + 1
                continue
            closing = c == "/"
            m = _NAME.match(page, lt + 1 + closing)
            if not m:
                if closing:  # a bogus comment
                    self._text(page[at:lt])
                    end = page.find(">", lt)
                    at = n if end < 0 else end + 1
                else:
                    self._text(page[at : lt + 1])
                    at = lt + 1
                continue
            self._text(page[at:lt])
            rest = _ATTRIBUTES.match(page, m.end())
            if rest:
                stop = rest.end()
            else:
                stop = page.find(">", m.end()) + 1
                if not stop:
                    break  # cut inside a tag
            name = m[0].lower()
            at = stop
            if closing:
                self._end(name)
                continue
            attributes = page[m.end() : stop - 1]
            self._start(name, attributes, attributes.endswith("/") and name not in HOLDERS and name not in CLOSES_P)
            if name in RAW:
                end = _end_of_raw(name, page, at, raw_ends)
                if end < 0:
                    break
                at = end


def _density(c: int, t: int, lc: int, lt: int, share: float) -> float:
    if not c:
        return 0.0
    t = max(t, 1)
    inner = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
    return c / t * math.log(c / max(lc, 1) * (t / max(lt, 1))) / max(math.log(inner), 1.0)


def _densities(p: Page, body: int) -> tuple[list[float], list[float], list[int], list[int]]:
    """Density of each node, the sum of its children's, its characters and those in links."""
    n = len(p.tag)
    chars, tags, linked, links = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    block = list(range(n))  # the nearest element that is not inline
    for i in range(1, n):
        in_link[i] = in_link[p.parent[i]] or p.tag[i] == "a"
        if p.tag[i] in INLINE:
            block[i] = block[p.parent[i]]
    for node, text in p.events:
        if text and not p.drop[node]:
            k = len(_SPACE.sub(" ", text).strip())
            chars[node] += k
            if in_link[node]:
                linked[node] += k
    for i in range(n - 1, 0, -1):
        if not p.drop[i]:
            up = p.parent[i]
            chars[up] += chars[i]
            linked[up] += linked[i]
            tags[up] += tags[i] + 1
            links[up] += links[i] + (p.tag[i] == "a")
    share = linked[body] / max(chars[body], 1)
    density, total = [0.0] * n, [0.0] * n
    for i in range(n):
        if not p.drop[i] and block[i] == i:
            density[i] = _density(chars[i], tags[i], linked[i], links[i], share)
            if i:
                total[block[p.parent[i]]] += density[i]
    return density, total, chars, linked


def _bare_runs(p: Page, above: set[int], keep: list[bool], least: float, share: float) -> set[int]:
    """Places of the events in runs of text that stand directly in nodes of the path, with the inline elements among
    them, and that pass the test of siblings."""
    out: set[int] = set()
    run: list[int] = []
    for k, (node, text) in enumerate([*p.events, (0, None)]):
        if text is not None:
            if not p.drop[node] and not p.late[node] and not keep[node]:
                run.append(k)
            continue
        if any(p.events[i][0] in above and p.events[i][1].strip() for i in run):
            inline: set[int] = set()
            c = lc = 0
            for i in run:
                node, size, linked = p.events[i][0], len(_SPACE.sub(" ", p.events[i][1]).strip()), False
                while node not in above and node:
                    inline.add(node)
                    linked = linked or p.tag[node] == "a"
                    node = p.parent[node]
                c += size
                lc += size * linked
            if 2 * lc < c and _density(c, len(inline), lc, sum(p.tag[i] == "a" for i in inline), share) >= least:
                out.update(run)
        run = []
    return out


def main_text(page: str | None) -> str:
    """The blocks of the selected parts, one to a line. Where names of classes and ids would take everything out (a
    wrapper with a telling name), the page is read by its elements alone."""
    if not page:
        return ""
    return _selected(Page(page)) or _selected(Page(page, marked=False))


def read(page: str | None) -> tuple[str, str | None]:
    """Main text, or all text where there is none, and the declared language."""
    if not page:
        return "", None
    p = Page(page)
    text = _selected(p) or _selected(Page(page, marked=False))
    return text or " ".join(x for _, x in p.events if x), p.language


def _holder(p: Page, total: list[float], body: int) -> int:
    """The node of the largest sum below the body."""
    inside = [False] * len(p.tag)
    inside[body] = True
    for i in range(1, len(p.tag)):
        inside[i] = inside[i] or inside[p.parent[i]]
    return max((i for i in range(len(p.tag)) if inside[i] and not p.drop[i] and (i == body or p.tag[i] not in INLINE)), key=lambda i: (total[i], -i))


def _selected(p: Page) -> str:
    n = len(p.tag)
    body = next((i for i in range(n) if p.tag[i] == "body" and not p.drop[i]), 0)
    density, total, chars, linked = _densities(p, body)
    if not chars[0]:
        return ""
    path = [_holder(p, total, body)]
    while path[-1] != body:
        path.append(p.parent[path[-1]])
    least = min(density[i] for i in path if i == body or p.tag[i] not in INLINE)
    chosen, on_path, above = {path[0]}, set(path), set(path[1:])
    beside: dict[int, list[int]] = {i: [] for i in above}
    for i in range(1, n):
        if p.parent[i] in above and not p.drop[i] and p.tag[i] not in INLINE and chars[i]:
            beside[p.parent[i]].append(i)
            if i not in on_path and density[i] >= least and 2 * linked[i] < chars[i]:
                chosen.add(i)
    for children in beside.values():  # headings that lead a chosen part, or the part that holds the selection
        leads = False
        for i in reversed(children):
            if p.tag[i] in HEADINGS and leads and 2 * linked[i] < chars[i]:
                chosen.add(i)
            leads = i in chosen or i in on_path
    keep = [False] * n
    for i in range(n):
        keep[i] = i in chosen or (i > 0 and keep[p.parent[i]])
    bare = _bare_runs(p, above, keep, least, linked[body] / max(chars[body], 1)) if above else set()
    blocks: list[str] = []
    parts: list[str] = []
    for k, (node, text) in enumerate(p.events):
        if text is None:
            if parts:
                blocks.append("".join(parts))
                parts = []
        elif (keep[node] or k in bare) and not p.drop[node] and not p.late[node]:
            parts.append(text)
    blocks.append("".join(parts))
    return "\n".join(x for x in (_SPACE.sub(" ", b).strip() for b in blocks) if x)


def extract(pages: DataFrame) -> DataFrame:
    """pages -> (page_id, url, text, n_chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for k in range(0, b.num_rows, 256):
                texts += [main_text(x) for x in b.column(2).slice(k, 256).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_text_density(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
